"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch is the k smallest distinct 48-bit hashes of a text's word shingles, ascending. Sketches of parts merge by keeping
the k smallest of their union. From two sketches follow resemblance, containment and distinct counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import pick

#: Hash values lie in 0 .. SPACE - 1; a sketch prints each as DIGITS hex digits.
BITS, DIGITS = 48, 12
SPACE = float(2**BITS)


def sketch(text: Column, k: int = 128, words: int = 5) -> Column:
    """array<bigint>: the k smallest hashes of the shingles of `words` words; fewer words are one shingle; empty without words."""
    w = F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda x: x != "")
    ids = F.transform(w, lambda x: F.xxhash64(x))

    def shingles(a: Column) -> Column:
        one = F.array(F.xxhash64(F.array_join(F.transform(a, lambda x: x.cast("string")), ",")))
        many = F.transform(F.sequence(F.lit(1), F.size(a) - (words - 1)), lambda i: F.xxhash64(*[F.element_at(a, i + j) for j in range(words)]))
        return F.when(F.size(a) == 0, F.array().cast("array<bigint>")).when(F.size(a) < words, one).otherwise(many)

    hashes = F.element_at(F.transform(F.array(ids), shingles), 1)
    return F.slice(F.array_sort(F.array_distinct(F.transform(hashes, lambda h: F.shiftrightunsigned(h, 64 - BITS)))), 1, k)


def merged(a: Column, b: Column, k: int = 128) -> Column:
    """The sketch of two parts together."""
    return F.slice(F.array_sort(F.array_union(a, b)), 1, k)


def distinct_count(a: Column, k: int = 128) -> Column:
    """Distinct shingles: exact below k, else (k - 1) / (the k-th smallest hash as a part of the hash space)."""
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) * F.lit(SPACE) / (F.element_at(a, -1) + 1))


def resemblance(a: Column, b: Column, k: int = 128) -> Column:
    """Jaccard likeness, 0 to 1: of the k smallest of the union, the part in both. Two empty sketches: 1."""
    both = merged(a, b, k)
    shared = F.size(F.array_intersect(both, F.array_intersect(a, b)))
    return F.when(F.size(both) == 0, 1.0).otherwise(shared / F.greatest(F.size(both), F.lit(1)))


def containment(a: Column, b: Column, k: int = 128) -> Column:
    """The part of a's shingles that b has, from resemblance and distinct counts, held to 0 .. 1. An empty a: 1."""
    r = resemblance(a, b, k)
    share = r * distinct_count(merged(a, b, k), k) / F.greatest(distinct_count(a, k), F.lit(1.0))
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), share))


def printed(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), DIGITS, "0")), "")


def with_next(docs: DataFrame, rows_per_range: int = 500, most_ranges: int = 8192) -> tuple[DataFrame, W]:
    """doc_id, text, _next (the text of the next document by descending doc_id; after the last: the first), _real; and the window.

    Ids are cut into ranges at quantiles, one exchange deals rows by range, and each range also gets a copy of the row that
    follows its last one, so no task sees more than its range. Nulls come last; equal ids follow each other by text.
    """
    t = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ids = t.select("doc_id", F.xxhash64("text").alias("_h"))
    n = ids.count()
    parts = max(1, min(n // rows_per_range, most_ranges))
    cuts = ids.where("doc_id is not null").agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 20 * parts)).first()[0] if parts > 1 else []
    cuts = sorted(set(cuts or []))
    # ascending cuts c1 < c2 < ...: range 0 holds the ids up to c1; nulls are in range -1, the last by descending id
    if cuts:
        steps = F.lit(cuts)
        low = F.aggregate(F.sequence(F.lit(1), F.lit(len(cuts).bit_length())), F.struct(F.lit(0).alias("a"), F.lit(len(cuts)).alias("b")), lambda s, _: F.when(s["a"] < s["b"], F.when(F.element_at(steps, (F.floor((s["a"] + s["b"]) / 2) + 1).cast("int")) < F.col("doc_id"), F.struct((F.floor((s["a"] + s["b"]) / 2) + 1).cast("int").alias("a"), s["b"].alias("b"))).otherwise(F.struct(s["a"].alias("a"), F.floor((s["a"] + s["b"]) / 2).cast("int").alias("b")))).otherwise(s), lambda s: s["a"])
    else:
        low = F.lit(0)
    ranged = lambda d: d.withColumn("_range", F.when(F.col("doc_id").isNull(), -1).otherwise(low))
    # The first row of each range (one small row for each range comes to the driver) follows the last of the range above.
    first = F.struct(F.col("doc_id").isNull().alias("z"), (-F.col("doc_id")).alias("m"), F.col("_h").alias("h"))
    heads = {r["_range"]: r["m"] for r in ranged(ids).groupBy("_range").agg(F.min(first).alias("m")).collect()}
    order = sorted(heads, reverse=True)
    goes = [(None if heads[r].m is None else -heads[r].m, heads[r].h, order[i - 1]) for i, r in enumerate(order)]
    small = t.sparkSession.createDataFrame(goes, "_id long, _hh long, _to int")
    t = ranged(t).withColumn("_h", F.xxhash64("text"))
    copy = t.join(F.broadcast(small), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_hh"))).select("doc_id", "text", F.col("_to").alias("_range"), "_h", F.lit(False).alias("_real"))
    both = t.withColumn("_real", F.lit(True)).unionByName(copy)
    window = W.partitionBy("_range").orderBy(F.desc("_real"), F.desc_nulls_last("doc_id"), "_h")
    return both.withColumn("_next", F.lead("text").over(window)), window


def fingerprints(docs: DataFrame, k: int = 128, words: int = 5) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next and distinct_shingles for every row.

    The edited text is the text whose last floor(n_chars / 2) code points give way to the first as many (or all) of the next
    document. Null text counts as empty; ids may be null or repeat (see with_next); an only document is its own next. Texts
    without words have an empty fingerprint; two empty ones are alike (1). Repeated rows each give a row; an empty table none.
    """
    t, window = with_next(docs)
    cut = F.floor(F.length("text") / 2).cast("int")
    t = t.withColumn("_edited", F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - cut), F.substring(F.coalesce("_next", "text"), F.lit(1), cut)))
    t = t.select("_range", "_real", "doc_id", "_h", F.length("text").cast("long").alias("n_chars"), F.sha2("_edited", 256).alias("edited_sha256"), sketch(F.col("text"), k, words).alias("_a"), sketch(F.col("_edited"), k, words).alias("_b"))
    t = t.withColumn("_c", F.lead("_a").over(window)).where("_real")
    return t.select("doc_id", "n_chars", "edited_sha256", printed(F.col("_a")).alias("fingerprint"), printed(F.col("_b")).alias("edited_fingerprint"), resemblance(F.col("_a"), F.col("_b"), k).alias("near_edited"), resemblance(F.col("_a"), F.coalesce("_c", "_a"), k).alias("near_next"), distinct_count(F.col("_a"), k).alias("distinct_shingles"))
