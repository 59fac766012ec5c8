"""Secret scan with corpus-wide ownership frequency.

Candidates are spans that look like credentials. Their hashes are counted over the whole corpus by distinct repositories and
owners: a value in the hands of many owners is a copied example, one that few owners hold is live-looking.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Base kinds: (name, pattern, least length of group 2). Fixed values. A run of 24+ or 20+ characters is a leftmost maximal
#: run, so asking for the length in the pattern finds the same spans as dropping short runs; for assign it would not be.
KINDS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""", 6),
    ("access", r"()(AKIA[A-Z0-9]{16,})", 20),
    ("hex", r"()([0-9a-f]{24,})", 24),
)
#: What the method adds: long runs that mix cases and digits, such as provider keys; kept only where few owners hold them.
ADDED = ("mixed", r"()([A-Za-z0-9_-]{24,})", 24)

SPAN = "struct<start:int,end:int,kind:string,value:string>"


def _found(text: Column, kind: str, pattern: str, least: int) -> Column:
    """Spans of one kind, leftmost and non-overlapping, in code points, end exclusive; texts without a match cost one search.

    The text between matches and the matches alternate, so running sums of their lengths place each match.
    """
    empty = F.array().cast(f"array<{SPAN}>")
    match = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(2)), F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda v, h: F.struct(v.alias("v"), h.alias("h")))
    parts = F.zip_with(match, F.slice(F.split(text, pattern, -1), 1, F.size(match)), lambda m, g: F.struct(m["v"].alias("v"), m["h"].alias("h"), g.alias("g")))

    def step(acc, m):
        start = acc["at"] + F.length(m["g"])
        end = start + F.length(m["h"]) + F.length(m["v"])
        good = F.length(m["v"]) >= least
        if kind == ADDED[0]:
            good = good & m["v"].rlike("[0-9]") & m["v"].rlike("[A-Z]") & m["v"].rlike("[a-z]")
        span = F.array(F.struct(start.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), m["v"].alias("value")))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.when(good, span).otherwise(empty)).alias("out"))

    found = F.aggregate(parts, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), found).otherwise(empty)


def scan(docs: DataFrame, owner: str = "source", repository: tuple[str, ...] = ("source", "lang"), few_owners: int = 2, keep_rest: bool = False) -> DataFrame:
    """doc_id, spans for every row: array of (start, end, kind, value, owners, repositories, live), by start, then kind as listed.

    All base spans stay; a span that the method adds stays only if its value is live-looking: at most `few_owners` owners
    hold it. Null text counts as empty; rows without an owner or repository count as one unnamed. Rows that repeat stay
    apart. Only spans are shuffled, never texts without one; values held by a third of all rows are counted by owner first.
    With keep_rest, text and the other columns follow as text, _rest0, ...
    """
    place = {c: i for i, c in reversed(list(enumerate(docs.columns)))}
    flat = docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))])  # other columns may differ in case alone
    own = lambda c: F.col(f"_c{place[c]}")
    filled = lambda c: F.coalesce(own(c).cast("string"), F.lit(""))
    others = [i for i in range(len(docs.columns)) if i not in (place["doc_id"], place["text"])]
    carried = [own("text").alias("text"), *[F.col(f"_c{i}").alias(f"_rest{k}") for k, i in enumerate(others)]] if keep_rest else []
    spans_of = F.concat(*[_found(filled("text"), *k) for k in (*KINDS, ADDED)])
    found = flat.select(own("doc_id").alias("doc_id"), filled(owner).alias("_owner"), F.concat_ws("\x01", *map(filled, repository)).alias("_repository"), spans_of.alias("_spans"), *carried)
    rows = stored(found, "secret-spans").withColumn("_row", F.concat_ws(":", F.input_file_name(), F.col("_metadata.row_index").cast("string")))
    keep = [c for c in found.columns if c not in ("_owner", "_repository", "_spans")]
    none = F.array().cast("array<struct<start:int,end:int,kind:string,value:string,owners:bigint,repositories:bigint,live:boolean>>")
    without = rows.where(F.size("_spans") == 0).select(*keep, none.alias("spans"))
    spans = rows.where(F.size("_spans") > 0).select("_row", "_owner", "_repository", F.explode("_spans").alias("s")).withColumn("_hash", F.xxhash64("s.value"))
    by_owner = spans.groupBy("_hash", "_owner", "_repository").agg(F.lit(1).alias("x")).groupBy("_hash", "_owner").agg(F.count("*").alias("r"))
    held = by_owner.groupBy("_hash").agg(F.count("*").alias("owners"), F.sum("r").alias("repositories"))
    live = F.col("owners") <= few_owners
    order = F.array_position(F.array(*[F.lit(k[0]) for k in (*KINDS, ADDED)]), F.col("s.kind"))
    judged = spans.select("_row", "_hash", "s").join(held, "_hash").where(live | (F.col("s.kind") != ADDED[0]))
    one = F.struct(F.col("s.start").alias("a"), order.alias("o"), F.struct("s.start", "s.end", "s.kind", "s.value", "owners", "repositories", live.alias("live")).alias("s"))
    by_row = judged.groupBy("_row").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["s"]).alias("spans"))
    having = rows.where(F.size("_spans") > 0).join(by_row, "_row", "left").select(*keep, F.coalesce("spans", none).alias("spans"))
    return without.unionByName(having)


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """text with every span, overlapping ones as one, replaced by mark."""

    def step(acc, s):
        fresh = s["start"] >= acc["at"]
        piece = F.concat(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], piece)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
