"""Readers of the cities' CSV files, in one schema, and Parquet in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placeloom.config import AREA, LEFT, RIGHT
from placeloom.functions.spatial import web_mercator_x, web_mercator_y

COLUMNS = ("id", "name", "address", "category", "longitude", "latitude", "x", "y", "belong")

#: Where each city's files keep (id, name, address, category parts, longitude, latitude).
LAYOUTS = {
    ("nj", LEFT): ("shop_id", "name", "address", ("big_category", "small_category"), "longitude", "latitude"),
    ("nj", RIGHT): ("id", "name", "address", ("category",), "lng", "lat"),
    ("nj", AREA): ("shop_id", "name", "address", ("big_category", "small_category"), "longitude", "latitude"),
    ("hz", LEFT): ("id", "name", "address", ("big_category", "medium_category", "small_category"), "wgs84lon", "wgs84lat"),
    ("hz", RIGHT): ("shop_id", "name", "address", ("big_category", "small_category"), "longitude", "latitude"),
    ("hz", AREA): ("shop_id", "name", "address", ("big_category", "small_category"), "longitude", "latitude"),
    ("pit", LEFT): ("index", "name", "address", (), "longitude", "latitude"),
    ("pit", RIGHT): ("index", "name", "address", (), "longitude", "latitude"),
    ("pit", AREA): ("index", "name", "address", (), "longitude", "latitude"),
}


def plain_id(c: Column) -> Column:
    """Numbers as whole numbers (4640190.0 is 4640190), anything else as it is."""
    return F.when(c.rlike(r"^[0-9]+\.0+$"), F.regexp_replace(c, r"\.0+$", "")).otherwise(c)


def shaped(rows: DataFrame, layout: tuple, belong: int, null_text: str = "nan") -> DataFrame:
    """rows of a file in the common schema. Missing parts of a joined category read null_text; other missing text stays null."""
    key, name, address, category, lon, lat = layout
    if not category:
        cat = F.lit("")
    elif len(category) == 1:
        cat = F.col(category[0])
    else:
        cat = F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit(null_text)) for c in category])
    out = rows.select(plain_id(F.col(key).cast("string")).alias("id"), F.col(name).alias("name"), F.col(address).alias("address"), cat.alias("category"), F.col(lon).try_cast("double").alias("longitude"), F.col(lat).try_cast("double").alias("latitude"))
    return out.select("*", web_mercator_x(F.col("longitude")).alias("x"), web_mercator_y(F.col("latitude")).alias("y"), F.lit(belong).alias("belong"))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text; quoted line breaks and doubled quotes are read as such."""
    return spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8", nullValue="")


def read_pois(spark: SparkSession, city: str, left: str, right: str) -> DataFrame:
    """Both sides of a city."""
    return shaped(read_csv(spark, left), LAYOUTS[city, LEFT], LEFT).unionByName(shaped(read_csv(spark, right), LAYOUTS[city, RIGHT], RIGHT))


def read_areas(spark: SparkSession, city: str, path: str) -> DataFrame:
    """Areas, with aoi_ord (their order in the file)."""
    return shaped(read_csv(spark, path).coalesce(1).withColumn("_o", F.monotonically_increasing_id()), LAYOUTS[city, AREA], AREA).withColumn("aoi_ord", F.monotonically_increasing_id())


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the area classifier: e_name, e_category, e_type; an unnamed index column is left out."""
    return read_csv(spark, path).select("e_name", "e_category", F.col("e_type").cast("int").alias("e_type"))


def read_word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """word, vec (array<double>) from a text file with a word and its numbers on each line."""
    parts = F.split("value", r"\s+")
    return spark.read.text(path).where(F.length("value") > 0).select(F.element_at(parts, 1).alias("word"), F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: x.cast("double")).alias("vec"))


def save(df: DataFrame, path: str) -> None:
    """Replaces what is at path."""
    df.write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
