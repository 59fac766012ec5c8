"""Tables in the shared folder, places in a global order, and connected components by iterated smallest labels."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def settled(df: DataFrame) -> DataFrame:
    """df written as Parquet under spark.checkpoint.dir and read again, so lineage and size estimates start anew. Where that
    setting is unset, a session on one machine takes its warehouse folder; on a cluster that is an error."""
    spark, sc = df.sparkSession, df.sparkSession.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder and sc.master.startswith("local["):
        folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = f"{folder.rstrip('/')}/placeloom/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def placed(df: DataFrame, order: list[Column], name: str, size: Column | None = None) -> DataFrame:
    """df with its place (from 0) in a global order, without gathering rows in one task: rows are dealt to sorted ranges and counted as
    they are written, and the sizes of the ranges before (one number a range comes to the driver) are added. size: so many places a
    row takes (not null), else one; such rows are shuffled once more."""
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    # the number of the range in the upper bits, the row's place inside in the lower 33
    ranged = settled(dealt.withColumn("_at", F.monotonically_increasing_id()))
    part, inside = F.shiftrightunsigned("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    at, starts = 0, {}
    for k, length in sorted((r["k"], r["n"]) for r in ranged.groupBy(part.alias("k")).agg((F.count("*") if size is None else F.sum(size)).alias("n")).collect()):
        starts[k] = at
        at += length
    before = F.create_map(*[F.lit(x) for pair in (starts or {0: 0}).items() for x in pair])
    if size is not None:
        inside = F.coalesce(F.sum(size).over(W.partitionBy(part).orderBy("_at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return ranged.withColumn(name, (inside + F.element_at(before, part.cast("int"))).cast("bigint")).drop("_at")


def sent(df: DataFrame, most: int) -> DataFrame:
    """df, to be joined: marked for a broadcast if it has at most so many rows. With more, the join deals both sides."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above u is tied to the smallest of u and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """u and every neighbour below it are tied to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    tied = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
    return tied.where("a <> b").distinct()


def components(nodes: DataFrame, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """id, component (the smallest id that can be reached) for nodes (id) and undirected edges (a, b). Ids are strings or numbers.

    Large-star and small-star steps alternate (Kiveris et al., 2014) until every component is a star around its smallest id; the
    number of rounds grows with the logarithm of the graph, not with its paths. Edges are written to the shared folder each round.
    """
    now = settled(edges.select("a", "b").where("a <> b").distinct())
    mark = None
    for _ in range(rounds):
        now = settled(_small_star(_large_star(now)))
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark:
            return nodes.select("id").distinct().join(now, F.col("id") == F.col("a"), "left").select("id", F.coalesce("b", "id").alias("component"))
        mark = seen
    raise RuntimeError(f"components did not settle in {rounds} rounds")
