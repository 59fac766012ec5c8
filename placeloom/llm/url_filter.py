"""URL filter: rules first, else logistic regression on hashed character n-grams of host and path."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rules of the contract: (host, path prefix, verdict). Fixed values.
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))

#: Names that the small labelled URL table is made of: each is a host's name, under several domains and paths.
BLOCKED_NAMES = ("spam-farm", "casino-win", "free-bets", "cheap-pills", "link-farm", "win-casino", "bets-online", "pills-shop", "casino-bonus", "cheap-loans", "free-spins", "spam-links")
ALLOWED_NAMES = ("library", "museum", "weather", "news", "history", "science", "gardening", "university", "cooking", "travel", "archive", "forum", "blog.stories", "m.reading", "www.letters", "notes")
DOMAINS, PATHS = ("example.com", "example.net", "example.org"), ("/en/12", "/fr/345/", "/de/67.html", "/es/890")


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The small labelled table: url, label (1: block). 336 rows, made from the names above."""
    rows = [(f"https://{n}.{d}{p}", y) for y, names in ((1, BLOCKED_NAMES), (0, ALLOWED_NAMES)) for n in names for d in DOMAINS for p in PATHS]
    return spark.createDataFrame(rows, "url string, label int")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased. Path: then up to ? # or the end. Both empty without ://."""
    u = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def grams(host: Column, path: Column, n: int, buckets: int) -> Column:
    """Distinct buckets of the n-grams of host and of path, each with its bounds marked."""

    def of(text: Column, seed: int) -> Column:
        spots = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(spots, lambda i: F.pmod(F.xxhash64(F.lit(seed), F.substring(text, i, F.lit(n))), F.lit(buckets)).cast("int"))

    return F.array_distinct(F.concat(of(F.concat(F.lit("^"), host, F.lit("$")), 1), of(F.concat(F.lit("^"), path, F.lit("$")), 2)))


def train(labelled: DataFrame, n: int = 4, buckets: int = 4096, rounds: int = 300, rate: float = 0.5, decay: float = 1e-3, most: int = 5000) -> tuple[list[float], float]:
    """Weights by bucket and the bias: batch gradient descent on a table of at most `most` rows (more is an error, not a cut)."""
    t = pick(labelled, "url", "label")
    host, path = host_and_path(F.col("url"))
    rows = t.select(grams(host, path, n, buckets).alias("g"), F.col("label").cast("int").alias("y")).where("y is not null").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the labelled table has more than {most} rows")
    weights, bias = [0.0] * buckets, 0.0
    for _ in range(rounds):
        slope: dict[int, float] = {}
        up = 0.0
        for g, y in rows:
            z = bias + sum(weights[k] for k in g)
            miss = y - 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
            up += miss
            for k in g:
                slope[k] = slope.get(k, 0.0) + miss
        for k, s in slope.items():
            weights[k] += rate * (s / len(rows) - decay * weights[k])
        bias += rate * up / max(1, len(rows))
    return weights, bias


def judge(pages: DataFrame, model: tuple[list[float], float], rules=RULES, n: int = 4, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, score for every row.

    A rule fits its host and all subdomains when the path starts with the rule's; the longest wins, in ties the first by text.
    Without a rule the verdict is the model's. A null or odd url has empty host and path and is judged like any other;
    repeated rows each give a row; an empty table gives none. One narrow pass: only page_id and url are read.
    """
    weights, bias = model
    host, path = host_and_path(F.col("url"))
    t = pick(pages, "page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    rule = verdict = None
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        rule = F.when(fits, F.lit(h + p)).otherwise(F.lit(None).cast("string") if rule is None else rule)
        verdict = F.when(fits, F.lit(v)).otherwise(F.lit(None).cast("string") if verdict is None else verdict)
    z = F.aggregate(grams(F.col("host"), F.col("path"), n, len(weights)), F.lit(float(bias)), lambda a, g: a + F.element_at(F.lit(weights), g + 1))
    t = t.select("*", (rule if rule is not None else F.lit(None).cast("string")).alias("rule"), (verdict if verdict is not None else F.lit(None).cast("string")).alias("_v"), (1 / (1 + F.exp(-z))).alias("score"))
    return t.select("page_id", "host", "path", "rule", F.coalesce("_v", F.when(F.col("score") >= threshold, "block").otherwise("allow")).alias("verdict"), "score")
