"""Areas of interest: neighbourhoods within eps, and the ordered claims of points by areas."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeloom.functions.spatial import RADIUS_M, haversine, straight

from .components import components, settled


def cells(lon: Column, lat: Column, metres: float, max_lat: float) -> tuple[Column, Column]:
    """Grid cell numbers; a cell is at least `metres` wide and high at every latitude up to max_lat."""
    step = math.degrees(metres / RADIUS_M) * 1.01
    wide = min(360.0, step / max(math.cos(math.radians(min(abs(max_lat), 89.9))), 1e-6) * 1.01)
    return F.floor(lon / wide), F.floor(lat / step)


def largest_latitude(*frames: DataFrame) -> float:
    return max([0.0, *(abs(x) for d in frames for x in d.agg(F.max("latitude"), F.min("latitude")).first() if x is not None)])


#: Cells are so many times finer than the distance, so that few pairs in them are too far apart.
FINE = 3


def meeting(a: DataFrame, b: DataFrame, metres: float, max_lat: float | None = None, inclusive: bool = False, alike: tuple[list[str], list[str]] | None = None) -> DataFrame:
    """Pairs closer than `metres` (strict, unless inclusive) with all columns of both sides, as a_* and b_*, so that nothing has to be
    joined to the pairs: an equi-join on fine grid cells, each row of a probing those around it that can be near enough, and what is
    left of them by the exact distance. Put the smaller side in a, and of both only what is read.

    Distances that straight lines through the earth decide with a margin are not computed.

    alike: columns of a and of b by which the rows of a cell are sorted before they meet. A merge join then gives the pairs of one row of
    b together, those with alike rows of a side by side, so that results much larger than the records are small as files."""
    if max_lat is None:
        max_lat = largest_latitude(a, b)
    ax, ay = cells(F.col("longitude"), F.col("latitude"), metres / FINE, max_lat)
    steps = [(i, j) for i in range(-FINE, FINE + 1) for j in range(-FINE, FINE + 1)]
    around = F.explode(F.array(*[F.struct((ax + i).alias("_cx"), (ay + j).alias("_cy")) for i, j in steps]))
    spots = {f"_{n}": c for n, c in zip("xyz", straight(F.col("longitude"), F.col("latitude")), strict=True)}
    side = lambda d, p: d.toDF(*[x if x in ("_cx", "_cy") else f"{p}_{x}" for x in d.columns])
    # A record meets many others here, so even a table of one small file is spread over all cores before that.
    spark = a.sparkSession
    spread = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    left = side(a.repartition(spread).withColumns(spots).withColumn("_c", around).select("*", "_c._cx", "_c._cy").drop("_c"), "a")
    right = side(b.withColumns(spots | {"_cx": ax, "_cy": ay}), "b")
    d = haversine(F.col("a_longitude"), F.col("a_latitude"), F.col("b_longitude"), F.col("b_latitude"))
    apart = [F.col(f"a__{n}") - F.col(f"b__{n}") for n in "xyz"]
    square = apart[0] * apart[0] + apart[1] * apart[1] + apart[2] * apart[2]
    surely, hardly = (2 * RADIUS_M * math.sin(min(max(metres + k * (0.01 + metres * 1e-5), 0.0) / (2 * RADIUS_M), math.pi / 2)) for k in (-1, 1))
    exact = d <= metres if inclusive else d < metres
    left, right = left.repartition(spread, "_cx", "_cy"), right.repartition(spread, "_cx", "_cy")
    if alike:  # the filter holds for every row; without it the optimizer drops a sort below a join
        laid = lambda d, p, columns: d.sortWithinPartitions("_cx", "_cy", *[f"{p}_{c}" for c in columns]).where(F.monotonically_increasing_id() >= 0)
        left, right = laid(right, "b", alike[1]), laid(left, "a", alike[0])
    pairs = left.join(right, ["_cx", "_cy"]).where((square < surely * surely) | ((square <= hardly * hardly * (1 + 1e-9)) & exact))
    return pairs.withColumn("metres", d).drop("_cx", "_cy", *[f"{p}__{n}" for p in "ab" for n in "xyz"])


def near(a: DataFrame, b: DataFrame, metres: float, max_lat: float | None = None) -> DataFrame:
    """Pairs (a_id, a_belong, b_id, b_belong, metres) closer than `metres` (strict). Put the smaller side in a."""
    own = lambda d: d.select("id", "belong", "longitude", "latitude")
    return meeting(own(a), own(b), metres, max_lat).select("a_id", "a_belong", "b_id", "b_belong", "metres")


def point_key() -> Column:
    return F.concat_ws(":", "belong", "id")


def claims(pois: DataFrame, areas: DataFrame, eps: float, min_points: int) -> DataFrame:
    """aoi_id, belong, poi_id: which area claims which point; each point at most once, areas in the order of aoi_ord.

    An area with fewer than min_points points within eps claims the unclaimed ones. Another claims outwards: each newly claimed
    point with at least min_points neighbours (itself not counted) adds its own. Pairs within eps and components of them are
    found in parallel; only the order inside one component is sequential, and components cannot affect each other.
    """
    max_lat = largest_latitude(pois, areas)
    p = pois.select(point_key().alias("id"), F.col("id").alias("own"), "longitude", "latitude")
    area_key = F.concat(F.lit("2:"), F.col("a_id"))
    seeds = settled(meeting(areas.select("id", "aoi_ord", "longitude", "latitude"), p, eps, max_lat).select(area_key.alias("a"), "a_aoi_ord", F.col("b_id").alias("b")))
    around = meeting(p, p, eps, max_lat).where("a_own <> b_own").groupBy("a_id").agg(F.collect_list("b_id").alias("beside"))
    # A point with fewer neighbours adds none, so it carries no claim on and ties nothing.
    dense = settled(around.where(F.size("beside") >= min_points).withColumnRenamed("a_id", "a"))
    ties = dense.select("a", F.explode("beside").alias("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    part = components(seeds.select(F.col("b").alias("id")).unionByName(dense.select(F.col("a").alias("id"))), seeds.select("a", "b").unionByName(ties))
    own = seeds.groupBy("a").agg(F.max("a_aoi_ord").alias("aoi_ord"), F.collect_list("b").alias("beside"), F.min("b").alias("id"))
    # components without an area claim nothing
    tagged = own.join(part, "id").select("component", "a", "aoi_ord", "beside", F.lit(True).alias("area"))
    near_points = dense.join(part, F.col("a") == F.col("id")).join(tagged.select("component").distinct(), "component", "left_semi")
    with_part = tagged.unionByName(near_points.select("component", "a", F.lit(None).cast("bigint").alias("aoi_ord"), "beside", F.lit(False).alias("area")))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        s = g[g.area].sort_values(["aoi_ord", "a"])
        n = g[~g.area]
        beside = dict(zip(n.a, n.beside, strict=True))
        taken, out = set(), []
        for area, own in zip(s.a, s.beside, strict=True):
            wide = len(own) >= min_points
            queue = list(own)
            while queue:  # an area's points are the same in whatever order they are reached
                point = queue.pop()
                if point in taken:
                    continue
                taken.add(point)
                out.append((area, point))
                if wide:
                    queue.extend(x for x in beside.get(point, ()) if x not in taken)
        return pd.DataFrame(out, columns=["a", "b"])

    got = with_part.groupBy("component").applyInPandas(run, "a string, b string")
    return got.select(F.substring_index("a", ":", -1).alias("aoi_id"), F.substring_index("b", ":", 1).cast("int").alias("belong"), F.expr("substring(b, instr(b, ':') + 1)").alias("poi_id"))


def inverted(members: DataFrame) -> DataFrame:
    """belong, poi_id, areas: the areas of each point."""
    return members.groupBy("belong", "poi_id").agg(F.sort_array(F.collect_set("aoi_id")).alias("areas"))


def coverage(pois: DataFrame, members: DataFrame) -> DataFrame:
    """One row: covered points, outliers, areas with a point."""
    return pois.agg(F.count("*").alias("n")).join(members.agg(F.count_distinct("belong", "poi_id").alias("covered"), F.count_distinct("aoi_id").alias("areas"))).select("covered", (F.col("n") - F.col("covered")).alias("outliers"), "areas")


def truth_in_areas(truth: DataFrame, members: DataFrame) -> DataFrame:
    """One row: how many true pairs (l_id, r_id) share an area."""
    left = members.where("belong = 0").select(F.col("poi_id").alias("l_id"), F.col("aoi_id").alias("x"))
    right = members.where("belong = 1").select(F.col("poi_id").alias("r_id"), F.col("aoi_id").alias("x"))
    both = truth.select("l_id", "r_id").distinct().join(left, "l_id").join(right, ["r_id", "x"]).select("l_id", "r_id").distinct()
    return both.agg(F.count("*").alias("shared"))
