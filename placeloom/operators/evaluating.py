"""Precision, recall and F1 of matches and of binary labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _rates(tp: Column, fp: Column, fn: Column) -> list[Column]:
    p, r = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0)), F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))
    return [p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1")]


def match_quality(answers: DataFrame, truth: DataFrame, column: str = "answer") -> DataFrame:
    """One row: tp, fp, fn, precision, recall, f1 of pairs answered 1 against true pairs (l_id, r_id); rates without a base are 0."""
    t = truth.select("l_id", "r_id").distinct()
    yes = answers.where(F.col(column) == 1)
    tp = yes.join(t, ["l_id", "r_id"], "left_semi").agg(F.count("*").alias("tp"))
    one = yes.agg(F.count("*").alias("yes")).join(tp).join(t.agg(F.count("*").alias("truths")))
    c = one.select("tp", (F.col("yes") - F.col("tp")).alias("fp"), (F.col("truths") - F.col("tp")).alias("fn"))
    return c.select("tp", "fp", "fn", *_rates(F.col("tp"), F.col("fp"), F.col("fn")))


def label_quality(df: DataFrame, predicted: Column, actual: Column) -> DataFrame:
    """One row: the same for labels, those above 0 being positive."""
    p, a = predicted > 0, actual > 0
    n = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0))
    c = df.agg(n(p & a).alias("tp"), n(p & ~a).alias("fp"), n(~p & a).alias("fn"))
    return c.select("tp", "fp", "fn", *_rates(F.col("tp"), F.col("fp"), F.col("fn")))
