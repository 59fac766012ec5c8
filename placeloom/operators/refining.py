"""Refinement of area relations: labels 0 (none), 1 (same as), 2 (inside) between left and right records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import settled

#: How far two probabilities must lie apart, and how low the lower must be, for it to be dropped.
GAP, DOUBT = 0.1, 0.7


def extended(relations: DataFrame) -> DataFrame:
    """relations (a, b, label) closed to the fixed point of two rules about a record x: x inside y and x same as z give z inside y, and
    x same as y and x same as z give y same as z, where (x, y) is listed in that order and the other relation in either.

    Only listed pairs are set: `inside` where the pair is listed in just that order, `same` in either order, also over a label
    that is already there. A pair may be found to be both; then it is labelled inside and still counts as same. So found relations
    only grow, and rounds go on until one finds nothing.
    """
    now = settled(relations.select("a", "b", (F.col("label") == 1).alias("same"), (F.col("label") == 2).alias("inside")))
    while True:
        listed = now.where("same").select(F.col("a").alias("x"), F.col("b").alias("y"))
        either = listed.unionByName(listed.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct().withColumnRenamed("y", "z")
        held = now.where("inside").select(F.col("a").alias("x"), F.col("b").alias("y")).join(either, "x").select(F.col("z").alias("a"), F.col("y").alias("b"), F.lit(False).alias("s"), F.lit(True).alias("i"))
        like = listed.join(either, "x").where("y <> z").select("y", "z")
        like = like.select(F.col("y").alias("a"), F.col("z").alias("b")).unionByName(like.select(F.col("z").alias("a"), F.col("y").alias("b")))
        new = held.unionByName(like.select("a", "b", F.lit(True).alias("s"), F.lit(False).alias("i"))).groupBy("a", "b").agg(F.max("s").alias("s"), F.max("i").alias("i"))
        both = now.join(new, ["a", "b"], "left").withColumns({"s": F.coalesce("s", F.lit(False)), "i": F.coalesce("i", F.lit(False))})
        after = settled(both.select("a", "b", (F.col("same") | F.col("s")).alias("same"), (F.col("inside") | F.col("i")).alias("inside"), ((F.col("s") & ~F.col("same")) | (F.col("i") & ~F.col("inside"))).alias("grew")))
        if not after.where("grew").limit(1).count():
            return now.select("a", "b", F.when(F.col("inside"), 2).when(F.col("same"), 1).otherwise(0).alias("label"))
        now = after.drop("grew")


def repaired(relations: DataFrame, gap: float = GAP, doubt: float = DOUBT) -> DataFrame:
    """relations (a, b, label, prob): of two `inside` of one left record, the less probable becomes 0 if it is further than gap
    below the other and under doubt. The most probable of a record decides, so one aggregate serves for all pairs."""
    top = relations.where("label = 2").groupBy("a").agg(F.max("prob").alias("_top"))
    drop = (F.col("label") == 2) & (F.col("_top") - F.col("prob") > gap) & (F.col("prob") < doubt)
    return relations.join(top, "a", "left").withColumn("label", F.when(drop, 0).otherwise(F.col("label"))).drop("_top")
