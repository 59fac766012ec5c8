"""Measures of two records that depend on a few of their values only: computed once for each pair of values, not once a pair of records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import placed, settled

#: So many pairs of values are kept in a table that is broadcast; with more, each pair of records is measured by itself.
MOST = 2_000_000

#: Result by name: (column of the left side, column of the right side, the measure of the two, a filter of it or None).
Measures = dict[str, tuple[str, str, Callable[[Column, Column], Column], Callable[[Column], Column] | None]]


class Valued:
    """left and right with what their pairs need for the measures; `onto` puts the measures (of which a filter drops pairs) on pairs
    that hold all columns of left and right with prefixes.

    Where the distinct values of both sides make few pairs (at most `most`, and less than a tenth of the pairs of rows), those are
    measured and written once, rows carry the numbers of their values, and pairs look the measure up. Else pairs carry the values."""

    def __init__(self, left: DataFrame, right: DataFrame, measures: Measures, most: int = MOST):
        self.measures, self.tables = measures, {}
        distinct = lambda d, i: d.agg(F.count("*"), *[F.count_distinct(m[i]) + F.max(F.col(m[i]).isNull().cast("int")) for m in measures.values()]).first()
        n, m = distinct(left, 0), distinct(right, 1)
        for k, (name, (a, b, measure, keep)) in enumerate(measures.items(), 1):
            x, y = n[k] or 0, m[k] or 0
            if x * y > most or x * y * 10 > n[0] * m[0]:
                continue
            values = [settled(placed(d.select(F.col(c).alias(v)).distinct(), [F.col(v)], f"_{v}")) for d, c, v in ((left, a, "a"), (right, b, "b"))]
            spread = max(1, min(64, x * y // 4000))
            both = values[0].repartition(spread, "a").join(F.broadcast(values[1])).select((F.col("_a") * y + F.col("_b")).alias("_key"), measure(F.col("a"), F.col("b")).alias(name))
            self.tables[name] = settled(both.where(keep(F.col(name))) if keep else both), y
            left = self._numbered(left, a, values[0], "a", f"_n_{name}")
            right = self._numbered(right, b, values[1], "b", f"_n_{name}")
        direct = [v for k, v in measures.items() if k not in self.tables]
        gone = lambda i: [v[i] for v in measures.values() if v[i] not in {d[i] for d in direct}]
        self.left, self.right = left.drop(*gone(0)), right.drop(*gone(1))

    @staticmethod
    def _numbered(d: DataFrame, c: str, values: DataFrame, v: str, name: str) -> DataFrame:
        return d.join(F.broadcast(values), F.col(c).eqNullSafe(F.col(v)), "left").drop(v).withColumnRenamed(f"_{v}", name)

    def onto(self, pairs: DataFrame, l: str, r: str) -> DataFrame:  # noqa: E741
        for name, (table, y) in self.tables.items():
            key = F.col(f"{l}__n_{name}") * y + F.col(f"{r}__n_{name}")
            pairs = pairs.withColumn("_key", key).join(F.broadcast(table), "_key").drop("_key")
        for name, (a, b, measure, keep) in self.measures.items():
            if name not in self.tables:
                pairs = pairs.withColumn(name, measure(F.col(f"{l}_{a}"), F.col(f"{r}_{b}")))
                pairs = pairs.where(keep(F.col(name))) if keep else pairs
        return pairs
