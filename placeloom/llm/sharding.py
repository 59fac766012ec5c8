"""Sharding by histogram sort.

The sort key is (hash of the text, hash of the id), so equal texts are neighbours. Each round counts, exactly and over all
rows, the bytes and rows between evenly spaced probes inside every key interval that still holds an unmet splitter; the next
round probes only those intervals. A splitter is met when the bytes below it are within tolerance of its target. Then one
exchange deals the rows to their ranges.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick, stored

#: Bits of the key that each round's probes resolve: first those of the text's hash, then those of the id's.
STEPS = (12, 26, 40, 52, 64, 76, 90, 104, 116, 128)
LOW = -(2**63)


@dataclass(frozen=True)
class Splitter:
    """Rows whose key is below (h, d) lie left of it; so many rows and bytes do."""

    h: int
    d: int
    rows: int
    size: int


def _prefix(bits: int) -> Column:
    """The first bits of the key, as a number that orders like it; beyond 64 bits, those of the id's hash."""
    return F.shiftright("_h", 64 - bits) if bits <= 64 else F.shiftright("_d", 128 - bits)


def splitters(keys: DataFrame, targets: int, tolerance: list[float]) -> tuple[list[Splitter], int, int]:
    """Splitters of equal bytes over keys (_h, _d, _size), and all rows and bytes. tolerance: bytes, by splitter.

    Counts are exact; the driver holds at most 4096 (later 16,384) of them per open interval, and there are fewer intervals than splitters.
    """
    first = keys.groupBy(_prefix(STEPS[0]).alias("p")).agg(F.count("*").alias("n"), F.sum("_size").alias("b")).collect()
    total_rows, total = sum(r.n for r in first), sum(r.b for r in first)
    aims = [total * (i + 1) / targets for i in range(targets - 1)]
    met: dict[int, Splitter] = {}

    def walk(bins, level: int, rows: int, size: int, wanted: list[int], h: int | None) -> dict:
        """Meets what it can at the edges of bins (prefix, rows, bytes), ascending; returns what is open, by prefix."""
        edges = [(rows, size, None)]
        for p, n, b in bins:
            edges.append((edges[-1][0] + n, edges[-1][1] + b, p))
        sums, left = [e[1] for e in edges], {}
        for i in wanted:
            k = min(max(bisect_right(sums, aims[i]), 1), len(edges) - 1)
            below, above = edges[k - 1], edges[k]
            near = min((below, above), key=lambda e: abs(e[1] - aims[i]))
            if abs(near[1] - aims[i]) <= tolerance[i] or level == len(STEPS) - 1:
                if near is below:
                    at = above[2]
                else:
                    at = above[2] + 1
                shift = 64 - STEPS[level] if STEPS[level] <= 64 else 128 - STEPS[level]
                edge = at << shift
                if h is None:
                    met[i] = Splitter(edge, LOW, near[0], near[1]) if edge < 2**63 else Splitter(2**63 - 1, 2**63 - 1, near[0], near[1])
                else:
                    met[i] = Splitter(h, edge, near[0], near[1]) if edge < 2**63 else Splitter(h, 2**63 - 1, near[0], near[1])
            else:
                left.setdefault(above[2], (below[0], below[1], []))[2].append(i)
        return left

    if not total_rows:
        return [Splitter(2**63 - 1, 2**63 - 1, 0, 0)] * (targets - 1), 0, 0
    left = {(None, p): v for p, v in walk(sorted((r.p, r.n, r.b) for r in first), 0, 0, 0, list(range(targets - 1)), None).items()}
    for level in range(1, len(STEPS)):
        if not left:
            break
        bits, before = STEPS[level], STEPS[level - 1]
        if before == 64:  # from here on the interval is one text; its rows are told apart by their ids
            left = {(p, None): v for (_, p), v in left.items()}
        hs, ps = sorted({h for h, _ in left if h is not None}), sorted({p for _, p in left if p is not None})
        rows = keys
        if hs:
            rows = rows.where(F.col("_h").isin(hs))
        if ps:
            rows = rows.where(_prefix(before).isin(ps))
        got = rows.groupBy((F.col("_h") if hs else F.lit(None).cast("long")).alias("h"), (F.lit(None).cast("long") if before == 64 else _prefix(before)).alias("o"), _prefix(bits).alias("p")).agg(F.count("*").alias("n"), F.sum("_size").alias("b")).collect()
        bins: dict = {}
        for r in got:
            bins.setdefault((r.h, r.o), []).append((r.p, r.n, r.b))
        after = {}
        for key, (n, b, wanted) in left.items():
            for p, v in walk(sorted(bins[key]), level, n, b, wanted, key[0]).items():
                after[(key[0], p)] = v
        left = after
    out, last = [], None
    for i in range(targets - 1):
        s = met[i]
        last = s if last is None or (s.h, s.d) > (last.h, last.d) else last
        out.append(last)
    return out, total_rows, total


def shard(docs: DataFrame, n_shards: int = 8, tolerance: float = 0.01, ranges_per_shard: int = 16, rows_per_range: int = 2_000_000) -> DataFrame:
    """The rows of docs with size, text_crc32, law, shard, slot and grown_shard before their own other columns (doc_id, text, _rest*).

    The law is `bytes`: each shard's bytes are within `tolerance` of an equal part, or as near as its rows allow. Equal texts
    share a shard unless their group alone is larger than the tolerance leaves room for; then it is cut by id.
    A null text has size 1 and counts as empty; a null id is an id of its own. Rows that repeat an id and text have equal
    keys and stay together. An empty table gives no rows. Slots count from 0 in key order in each shard, without gaps.
    """
    rows = pick(docs, "doc_id", "text", keep_rest=True)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = rows.withColumns({"_h": F.xxhash64(text), "_size": F.octet_length(text).cast("long") + 1, "_crc": F.crc32(text.cast("binary"))}).withColumn("_d", F.xxhash64("_h", "doc_id"))
    keys = stored(rows.select("_h", "_d", "_size"), "shard-keys")
    per = max(ranges_per_shard, -(-keys.count() // (rows_per_range * n_shards)))
    n = n_shards * per
    total = keys.agg(F.sum("_size")).first()[0] or 0
    tight, loose = tolerance * total / n_shards, total / n / 4
    cuts, n_rows, _ = splitters(keys, n, [tight if (i + 1) % per == 0 else loose for i in range(n - 1)])
    # A range is found by its key's first 12 bits; only splitters that lie inside such a bin are compared.
    inside = [c for c in cuts if c.h & (2**52 - 1) or c.d != LOW]
    edges = sorted(c.h for c in cuts if not (c.h & (2**52 - 1) or c.d != LOW))
    starts = [bisect_right(edges, p << 52) for p in range(-2048, 2048)]
    range_no = F.element_at(F.lit(starts), (F.shiftright("_h", 52) + 2049).cast("int"))
    for c in inside:
        range_no = range_no + ((F.col("_h") > c.h) | ((F.col("_h") == c.h) & (F.col("_d") >= c.d))).cast("int")
    from pyspark.sql import Window as W

    begins = [0, *[c.rows for c in cuts]]
    base = [b - begins[i // per * per] for i, b in enumerate(begins)]
    placed = rows.withColumn("_range", range_no)
    place = F.row_number().over(W.partitionBy("_range").orderBy("_h", "_d")).cast("long") - 1
    rest = [c for c in rows.columns if c.startswith("_rest")]
    return placed.withColumn("_place", place).select(
        "doc_id", F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.lit("bytes").alias("law"),
        F.floor(F.col("_range") / per).cast("int").alias("shard"),
        (F.element_at(F.lit(base), F.col("_range") + 1) + F.col("_place")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "text", *rest,
    )
