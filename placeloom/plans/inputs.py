"""Deterministic point tables made from the driver's tables, by integer arithmetic that any engine repeats, and the same in SQL.

Customers are the left records, suppliers the right ones, nations the areas; names come from parts. Areas' members are set by
arithmetic too, so that blocking can be compared without the sequential claims.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeloom.config import CITIES, City
from placeloom.functions.spatial import HALF_X, HALF_Y, web_mercator_x, web_mercator_y

#: Parts that lend names: the first so many keys exist at every scale.
NAMES = 200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _placed(df: DataFrame, key, city: City) -> DataFrame:
    u, v = (key * 7919) % 4132 / F.lit(4132.0), (key * 104729) % 2025 / F.lit(2025.0)
    df = df.withColumns({"longitude": F.lit(city.west) + u * F.lit(city.east - city.west), "latitude": F.lit(city.south) + v * F.lit(city.north - city.south)})
    return df.withColumns({"x": web_mercator_x(F.col("longitude")), "y": web_mercator_y(F.col("latitude"))})


def pois(spark: SparkSession, sf_dir: str, city: str = "nj") -> DataFrame:
    """belong 0 from customer, 1 from supplier."""
    c = CITIES[city]
    names = table(spark, sf_dir, "part").where(F.col("p_partkey") < NAMES).select("p_partkey", "p_name", "p_type", "p_brand")
    left = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("m"), ((F.col("c_custkey") * 7) % NAMES).alias("p_partkey"))
    right = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), ((F.col("s_suppkey") * 3) % NAMES).alias("p_partkey"))
    k = F.col("k").cast("string")
    left = left.join(F.broadcast(names), "p_partkey").select("k", F.lit(0).alias("belong"), k.alias("id"), F.concat("p_name", F.lit(" "), (F.col("k") % 9).cast("string")).alias("name"), F.concat("p_type", F.lit(" "), "p_brand").alias("category"), F.when(F.col("k") % 11 != 0, F.concat(F.lit("No "), (F.col("k") % 90).cast("string"), F.lit(" "), F.col("m"), F.lit(" road"))).alias("address"))
    right = right.join(F.broadcast(names), "p_partkey").select("k", F.lit(1).alias("belong"), k.alias("id"), F.when(F.col("k") % 3 == 0, F.concat("p_name", F.lit(" (Branch (no) "), (F.col("k") % 5).cast("string"), F.lit(")"))).otherwise(F.concat("p_name", F.lit(" shop"))).alias("name"), F.col("p_type").alias("category"), F.concat(F.lit("No "), (F.col("k") % 90).cast("string"), F.lit(" road")).alias("address"))
    return _placed(left, F.col("k"), c).unionByName(_placed(right, F.col("k") * 13 + 5, c))


def areas(spark: SparkSession, sf_dir: str, city: str = "nj") -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("k"), F.lit(2).alias("belong"), F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"), F.lit("area").alias("category"), F.lit("").alias("address"), F.col("n_nationkey").cast("bigint").alias("aoi_ord"))
    return _placed(n, F.col("k") * 31 + 11, CITIES[city])


def members(spark: SparkSession, sf_dir: str, city: str = "nj") -> DataFrame:
    """aoi_id, belong, poi_id: every third point belongs to an area."""
    return pois(spark, sf_dir, city).where(F.col("k") % 3 == 0).select(((F.col("k") * 5 + F.col("belong")) % 25).cast("string").alias("aoi_id"), "belong", F.col("id").alias("poi_id"))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """l_id, r_id: suppliers and the customer whose key is 3 times theirs, as far as the two share a name's part."""
    return table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 3).cast("string").alias("l_id"), F.col("s_suppkey").cast("string").alias("r_id"))


def _sql_placed(key: str, c: City) -> str:
    lon, lat = f"({c.west!r}::double + (({key}) * 7919) % 4132 / 4132.0::double * {c.east - c.west!r}::double)", f"({c.south!r}::double + (({key}) * 104729) % 2025 / 2025.0::double * {c.north - c.south!r}::double)"
    return f"{lon} AS longitude, {lat} AS latitude, {lon} * {HALF_X}::double / 180 AS x, -ln(tan(({lat} + 90) * pi() / 360)) / (pi() / 180) * {HALF_Y}::double / 180 AS y"


def sql(city: str = "nj") -> str:
    """The same as CTEs: pois, areas, members, truth."""
    c = CITIES[city]
    return f"""names AS (SELECT p_partkey, p_name, p_type, p_brand FROM part WHERE p_partkey < {NAMES}),
pois AS (
 SELECT c_custkey AS k, 0 AS belong, c_custkey::varchar AS id, p_name || ' ' || (c_custkey % 9)::varchar AS name, p_type || ' ' || p_brand AS category,
  CASE WHEN c_custkey % 11 <> 0 THEN 'No ' || (c_custkey % 90)::varchar || ' ' || c_mktsegment || ' road' END AS address, {_sql_placed("c_custkey", c)}
 FROM customer JOIN names ON p_partkey = (c_custkey * 7) % {NAMES}
 UNION ALL
 SELECT s_suppkey, 1, s_suppkey::varchar, CASE WHEN s_suppkey % 3 = 0 THEN p_name || ' (Branch (no) ' || (s_suppkey % 5)::varchar || ')' ELSE p_name || ' shop' END, p_type,
  'No ' || (s_suppkey % 90)::varchar || ' road', {_sql_placed("s_suppkey * 13 + 5", c)}
 FROM supplier JOIN names ON p_partkey = (s_suppkey * 3) % {NAMES}),
areas AS (SELECT n_nationkey::bigint AS k, 2 AS belong, n_nationkey::varchar AS id, n_name AS name, n_nationkey::bigint AS aoi_ord, {_sql_placed("n_nationkey::bigint * 31 + 11", c)} FROM nation),
members AS (SELECT ((k * 5 + belong) % 25)::varchar AS aoi_id, belong, id AS poi_id FROM pois WHERE k % 3 = 0),
truth AS (SELECT (s_suppkey * 3)::varchar AS l_id, s_suppkey::varchar AS r_id FROM supplier)"""


#: SQL forms of the distance functions over column names.
def sql_haversine(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    return f"(asin(sqrt({sql_arc(lon1, lat1, lon2, lat2)})) * 12742000.0::double)"


def sql_arc(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    a, b = f"radians({lat1})", f"radians({lat2})"
    return f"(sin(({b} - {a}) / 2) ** 2 + cos({a}) * cos({b}) * sin((radians({lon2}) - radians({lon1})) / 2) ** 2)"


def sql_rounded(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    arc = sql_arc(lon1, lat1, lon2, lat2)
    return f"round_even(atan2(sqrt({arc}), sqrt(1 - {arc})) * 12746.0::double * 1000, 0)::bigint"


#: SQL of a text's characters, and of a text without brackets (openers bound the rounds).
def sql_chars(s: str) -> str:
    return f"list_distinct(list_filter(string_split({s}, ''), lambda c: c <> ''))"


def sql_clean(s: str) -> str:
    rounds = f"range(0, greatest(1, length({s}) - length(replace(replace({s}, '(', ''), '（', ''))))"
    return f"list_reduce(list_prepend({s}, list_transform({rounds}, lambda i: '')), lambda a, b: regexp_replace(a, '[（(][^()（）]*?[)）]', '', 'g'))"


def sql_tokens(s: str) -> str:
    return f"list_filter(regexp_split_to_array({s}, '\\s+'), lambda t: t <> '')"
