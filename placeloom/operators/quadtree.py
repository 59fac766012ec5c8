"""Adaptive quadtree blocking without a tree: each point's whole path is folded once, splits are counted by prefix."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A node splits while its diagonal is above this and it holds points of more than so many areas.
SMALLEST, MOST_AREAS = 15.0, 2


def depth_of(width: float, height: float, smallest: float = SMALLEST) -> int:
    """Levels until the diagonal is at most `smallest`."""
    d, n = math.hypot(width, height), 0
    while d > smallest:
        d, n = d / 2, n + 1
    return n


def path(x: Column, y: Column, box: tuple[float, float, float, float], depth: int) -> Column:
    """Digits 0 (north-east), 1 (north-west), 2 (south-west), 3 (south-east) down to depth. Points on the lines between cells go
    round: north belongs to 0, west to 1, south to 2, east to 3; the very centre goes to 0. y grows southwards. Null outside the box."""
    bx, by, bw, bh = box
    start = F.struct(F.lit(bx).alias("x"), F.lit(by).alias("y"), F.lit(bw).alias("w"), F.lit(bh).alias("h"), F.lit("").alias("p"))

    def step(s, _):
        w, h = s["w"] / 2, s["h"] / 2
        v, k = s["x"] + w, s["y"] + h
        digit = F.when((x <= v) & (y < k), "1").when((x < v) & (y >= k), "2").when((x >= v) & (y > k), "3").otherwise("0")
        east, south = digit.isin("0", "3"), digit.isin("2", "3")
        return F.struct(F.when(east, v).otherwise(s["x"]).alias("x"), F.when(south, k).otherwise(s["y"]).alias("y"), w.alias("w"), h.alias("h"), F.concat(s["p"], digit).alias("p"))

    inside = x.between(bx, bx + bw) & y.between(by, by + bh)
    folded = F.aggregate(F.sequence(F.lit(1), F.lit(depth)), start, step, lambda s: s["p"]) if depth else F.lit("")
    return F.when(inside, folded)


def leaves(pois: DataFrame, members: DataFrame, box: tuple[float, float, float, float], most_areas: int = MOST_AREAS, depth: int | None = None) -> DataFrame:
    """belong, poi_id, leaf, level of each point inside the box.

    A node splits while it holds points of more than most_areas areas (the root: while there are more areas with points at all).
    A child's areas are among its parent's, so a point's leaf level is the number of its prefixes that split.
    """
    depth = depth_of(box[2], box[3]) if depth is None else depth
    placed = pois.select("belong", F.col("id").alias("poi_id"), path(F.col("x"), F.col("y"), box, depth).alias("path")).where("path is not null")
    prefixes = placed.select("*", F.explode(F.sequence(F.lit(0), F.lit(max(depth - 1, 0)))).alias("n")).withColumn("prefix", F.expr("substring(path, 1, n)")) if depth else None
    if not depth:
        return placed.select("belong", "poi_id", F.lit("").alias("leaf"), F.lit(0).alias("level"))
    own = prefixes.where("n > 0").join(members.select("belong", "poi_id", "aoi_id"), ["belong", "poi_id"]).groupBy("prefix").agg(F.count_distinct("aoi_id").alias("c"))
    root = members.agg(F.lit("").alias("prefix"), F.count_distinct("aoi_id").alias("c"))
    splits = own.unionByName(root).where(F.col("c") > most_areas).select("prefix")
    level = prefixes.join(splits, "prefix").groupBy("belong", "poi_id").agg(F.count("*").alias("level"))
    out = placed.join(level, ["belong", "poi_id"], "left").withColumn("level", F.coalesce("level", F.lit(0)).cast("int"))
    return out.select("belong", "poi_id", F.expr("substring(path, 1, level)").alias("leaf"), "level")


def blocks(leaf_of: DataFrame, members: DataFrame) -> DataFrame:
    """leaf, belong, poi_id, internal: each leaf's own points, and below the root all points of areas that have one of them.

    Points and leaves meet once for each area, in as many shares of its points as there are tasks; of several areas that a point and a
    leaf have in common, the smallest makes the row. So rows are neither shuffled nor made distinct afterwards."""
    spark = leaf_of.sparkSession
    spread = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    point = ["belong", "poi_id"]
    own = leaf_of.select("leaf", "level", *point).distinct()
    of = members.where("aoi_id is not null").groupBy(*point).agg(F.collect_set("aoi_id").alias("areas"))
    with_areas = own.join(of, point, "left")
    reached = with_areas.where("level > 0").select("leaf", F.explode("areas").alias("aoi_id")).groupBy("leaf").agg(F.collect_set("aoi_id").alias("reached"))
    drawn = of.join(own.groupBy(*point).agg(F.collect_set("leaf").alias("leaves")), point, "left")
    drawn = drawn.select(*point, "areas", "leaves", F.explode("areas").alias("aoi_id"), F.pmod(F.xxhash64(*point), F.lit(spread)).alias("_share"))
    shares = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(spread - 1).cast("bigint")))
    reached = reached.select("leaf", "reached", F.explode("reached").alias("aoi_id")).select("*", shares.alias("_share"))
    both = [d.repartition(spread, "aoi_id", "_share") for d in (reached, drawn)]
    first = (F.size("areas") == 1) | (F.size("reached") == 1) | (F.col("aoi_id") == F.array_min(F.array_intersect("areas", "reached")))
    met = both[0].join(both[1].hint("shuffle_hash"), ["aoi_id", "_share"]).where(first)
    # A leaf below the root draws those of its own points that belong to an area.
    rest = with_areas.where((F.col("level") == 0) | F.col("areas").isNull()).select("leaf", *point, F.lit(True).alias("internal"))
    return met.select("leaf", *point, F.coalesce(F.array_contains("leaves", F.col("leaf")), F.lit(False)).alias("internal")).unionByName(rest)


def measures(leaf_of: DataFrame, members: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """leaf, points, areas, diagonal, density (points by projected area) of each leaf."""
    side = F.pow(F.lit(2.0), F.col("level"))
    n = leaf_of.groupBy("leaf", "level").agg(F.count("*").alias("points"))
    a = leaf_of.join(members, ["belong", "poi_id"]).groupBy("leaf").agg(F.count_distinct("aoi_id").alias("areas"))
    diagonal = F.sqrt(F.pow(F.lit(box[2]) / side, 2) + F.pow(F.lit(box[3]) / side, 2))
    return n.join(a, "leaf", "left").select("leaf", "points", F.coalesce("areas", F.lit(0)).alias("areas"), diagonal.alias("diagonal"), (F.col("points") / (F.lit(box[2] * box[3]) / side / side)).alias("density"))
