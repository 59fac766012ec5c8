"""Benchmark decontamination by spaced-seed hashing.

Fixed masks over runs of tokens skip some positions; the tokens at the others are hashed. Hashes of test passages and of
documents are joined, and around each hit the two token runs are laid on each other and compared position by position, so an
overlap counts although words in it were replaced.

Documents are read once whatever the size of the benchmark: a filter of bounded size, made of the test hashes, drops nearly all of
a document's hashes on the spot, and only documents that keep some are written out with their words for the joins.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MULTIPLIER, mixed, pick, slices, stored, texts_of, tidy, word_ids

#: Masks: 1 is hashed, 0 is ignored. Fixed values.
MASKS = ("11101011", "110110101", "1100101101", "10110100111")
#: Passages up to so many words have masks as long as themselves beside these.
SHORT = 14
#: Everything in ASCII but letters and digits parts words; A-Z count as a-z.
SPLIT = bytes((c | 32) if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
#: The filter of test hashes: up to MOST of them are broadcast as they are (64 MB); of more, three bits each in SLOTS numbers (64 MB).
MOST, SLOTS = 8_000_000, 1 << 23


def words(text: bytes) -> list[bytes]:
    return text.translate(SPLIT).split()


def whole_masks(n: int, alike: float = 0.8) -> list[str]:
    """Masks over all n words of a short passage. Where s words may be replaced, places are dealt to s + 2 classes in turn and each
    mask ignores s classes, so whichever s words are replaced, one mask sees none of them."""
    s = n - ceil(alike * n - 1e-9)
    return ["".join("0" if i % (s + 2) in out else "1" for i in range(n)) for out in combinations(range(s + 2), s)]


def masks_of(n: int, alike: float = 0.8) -> list[str]:
    return [m for m in MASKS if len(m) <= n] + (whole_masks(n, alike) if n <= SHORT else [])


def seed_hashes(ids, mask: str):
    """One hash for each place where the mask fits on ids (numpy uint64)."""
    import numpy as np

    n = len(ids) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, len(mask), np.uint64)
    for k, c in enumerate(mask):
        if c == "1":
            h = h * np.uint64(MULTIPLIER) + ids[k : k + n]
    return mixed(h)


def longest_alike(same, least: float) -> tuple[int, int]:
    """The longest run [a, b) of a boolean array whose mean is at least `least`; its ends are trimmed to equal places."""
    import numpy as np

    p = np.concatenate([[0.0], np.cumsum(same - least)]) + 1e-9 * np.arange(len(same) + 1)
    low = np.minimum.accumulate(p)
    begin = np.searchsorted(-low, -(p[1:] + 1e-9), "left")
    size = np.arange(1, len(p)) - begin
    b = int(size.argmax()) + 1
    a = int(begin[b - 1])
    if size[b - 1] <= 0:
        return 0, 0
    on = np.flatnonzero(same[a:b])
    return (a + int(on[0]), a + int(on[-1]) + 1) if len(on) else (0, 0)


def needed(size: int, alike: float, share: float, evidence: int) -> int:
    """Equal words that an overlap with a passage of `size` words needs: `share` of it, and `evidence` words or, of a passage with few
    more than that or less, `alike` of it."""
    return max(ceil(share * size - 1e-9), min(ceil(alike * size - 1e-9), evidence))


def overlap(ids, own, shifts: list[int], alike: float, share: float, evidence: int) -> tuple[int, int, int] | None:
    """(equal words, first word in the document, the word after the last) of a document's words and a passage's, laid on each other at
    each of the shifts; None if that is not enough."""
    import numpy as np

    size, runs, best = len(own), [], None
    for shift in sorted(shifts):
        lo, hi = max(0, -shift), min(size, len(ids) - shift)
        same = np.zeros(size, bool)
        same[lo:hi] = own[lo:hi] == ids[lo + shift : hi + shift]
        a, b = longest_alike(same, alike)
        if b > a:
            runs.append((shift, a, b, same))
    for shift, a, b, _ in runs:  # words put in or left out shift the rest a little: such runs count together
        on = np.zeros(size, bool)
        first, last = a + shift, b + shift
        for s2, a2, b2, same2 in runs:
            if abs(s2 - shift) <= max(2, size // 5):
                on[a2:b2] |= same2[a2:b2]
                first, last = min(first, a2 + s2), max(last, b2 + s2)
        got = int(on.sum())
        if got >= needed(size, alike, share, evidence) and (best is None or got > best[0]):
            best = (got, first, last)
    return best


def passages(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """item, words (hashes, as bytes) of each distinct passage with words, stored; and item, item_id of every row."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        number = word_ids()
        for batch in slices(batches):
            w = [number.of(words(x), np.uint64).tobytes() for x in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(w, pa.binary())], ["item_id", "words"])

    b = pick(benchmark, "item_id", "text").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    rows = stored(b.mapInArrow(run, "item_id long, words binary"), "leak-passages").where(F.octet_length("words") > 0)
    return stored(rows.select("words").distinct().withColumn("item", F.monotonically_increasing_id()), "leak-items"), rows


def seeds(items: DataFrame, alike: float) -> DataFrame:
    """hash, item, spot: every place of every mask of a passage."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in slices(batches, "words", 1_000_000):
            out = [[], [], []]
            for item, w in zip(batch.column("item").to_pylist(), batch.column("words").to_pylist(), strict=True):
                ids = np.frombuffer(w, np.uint64)
                for mask in masks_of(len(ids), alike):
                    h = seed_hashes(ids, mask)
                    for column, x in zip(out, (h.view(np.int64), np.full(len(h), item), np.arange(len(h))), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else [], pa.int64()) for x in out], ["hash", "item", "spot"])

    return stored(items.select("item", "words").mapInArrow(run, "hash long, item long, spot long"), "leak-seeds")


class Filter:
    """Which hashes may be among the test hashes: certain for up to MOST of them, else by bits."""

    def __init__(self, hashes, bits):
        self.hashes, self.bits = hashes, bits

    def __call__(self, h):
        import numpy as np

        u = np.uint64
        need = (u(1) << (h & u(63))) | (u(1) << ((h >> u(6)) & u(63))) | (u(1) << ((h >> u(12)) & u(63)))
        at = np.flatnonzero((self.bits[(h >> u(18)) & u(len(self.bits) - 1)] & need) == need)
        if self.hashes is None or not len(at):
            return at
        x = h[at].view(np.int64)
        spot = np.minimum(np.searchsorted(self.hashes, x), len(self.hashes) - 1)
        return at[self.hashes[spot] == x]


def filter_of(hashes: DataFrame) -> Filter:
    """The filter of a column hash of distinct numbers; its bits are put together on executors."""
    import numpy as np

    n = hashes.count()
    slots = min(SLOTS, 1 << (n + 64).bit_length())
    bits = np.zeros(slots, np.uint64)
    one = lambda k: F.expr(f"shiftleft(1L, cast(shiftrightunsigned(hash, {k}) & 63 as int))")
    t = hashes.select(F.expr(f"shiftrightunsigned(hash, 18) & {slots - 1}L").alias("slot"), one(0).bitwiseOR(one(6)).bitwiseOR(one(12)).alias("b")).groupBy("slot").agg(F.bit_or("b").alias("bits")).toArrow()
    bits[t.column("slot").to_numpy()] = t.column("bits").to_numpy().view(np.uint64)
    return Filter(np.sort(hashes.toArrow().column("hash").to_numpy()) if n <= MOST else None, bits)


def _found(docs: DataFrame, benchmark: DataFrame, alike: float, share: float, evidence: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, digest, item, equal_words, item_words, first_word, end_word by row of docs (doc_id, text) and distinct passage; and item, item_id."""
    items, rows = passages(benchmark)
    own = seeds(items, alike)
    sizes = [r.n for r in items.select((F.octet_length("words") / 8).cast("int").alias("n")).where(F.col("n") <= SHORT).distinct().collect()]
    masks = list(MASKS) + [m for n in sorted(sizes) for m in whole_masks(n, alike)]
    shared = docs.sparkSession.sparkContext.broadcast(filter_of(own.select("hash").distinct()))

    def hits(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        may, number = shared.value, word_ids()
        row = TaskContext.get().partitionId() << 36
        for batch in slices(batches):
            out = [[] for _ in range(6)]
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch), strict=True):
                row += 1
                ids = number.of(words(text), np.uint64)
                got = [(h[at], at) for h, at in ((h, may(h)) for h in (seed_hashes(ids, m) for m in masks) if len(h)) if len(at)]
                if got:
                    values = (row, doc, hashlib.md5(text, usedforsecurity=False).digest(), ids.tobytes(), np.concatenate([x for x, _ in got]).view(np.int64), np.concatenate([x for _, x in got]))
                    for column, v in zip(out, values, strict=True):
                        column.append(v)
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], ["row", "doc_id", "digest", "words", "hash", "at"])

    def compared(batches):
        import numpy as np
        import pyarrow as pa

        for batch in slices(batches, "words"):
            out = []
            for row, item, shifts, w, p in zip(*(batch.column(c).to_pylist() for c in ("row", "item", "shifts", "words", "passage")), strict=True):
                best = overlap(np.frombuffer(w, np.uint64), np.frombuffer(p, np.uint64), shifts, alike, share, evidence)
                if best:
                    out.append((row, item, best[0], len(p) // 8, best[1], best[2]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["row", "item", "equal_words", "item_words", "first_word", "end_word"])

    met = stored(docs.mapInArrow(tidy(hits), "row long, doc_id long, digest binary, words binary, hash array<long>, at array<long>"), "leak-hits")
    at = met.select("row", F.explode(F.arrays_zip("hash", "at")).alias("x")).select("row", F.col("x.hash").alias("hash"), F.col("x.at").alias("at"))
    pairs = at.join(own, "hash").select("row", "item", (F.col("at") - F.col("spot")).alias("shift")).groupBy("row", "item").agg(F.collect_set("shift").alias("shifts"))
    laid = pairs.join(met.select("row", "words"), "row").join(items.select("item", F.col("words").alias("passage")), "item")
    out = laid.mapInArrow(tidy(compared), "row long, item long, equal_words long, item_words long, first_word long, end_word long")
    return stored(out, "leak-overlaps").join(met.select("row", "doc_id", "digest"), "row").drop("row"), rows.join(items, "words").select("item", "item_id")


def overlaps(docs: DataFrame, benchmark: DataFrame, alike: float = 0.8, share: float = 0.5, evidence: int = 12) -> DataFrame:
    """doc_id, item_id, equal_words, item_words, first_word, end_word: one row for each document and test passage that overlap.

    An overlap counts when places where at least `alike` of the words are equal hold so many of the passage's words as `needed` asks:
    half of it, and 12 words or four fifths of a shorter passage. Passages of every length are searched; those without words
    overlap nothing, and so do null and empty texts. Very long texts are searched whole. Repeated rows and passages each give their
    rows, with their ids, also null ones. Either table may be empty: then there is no row. Other columns are not read, whatever their names.
    """
    t = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found, items = _found(t, benchmark, alike, share, evidence)
    return found.join(items, "item").select("doc_id", "item_id", "equal_words", "item_words", "first_word", "end_word")


def clean(docs: DataFrame, benchmark: DataFrame, alike: float = 0.8, share: float = 0.5, evidence: int = 12) -> DataFrame:
    """The rows of docs, all columns as they are, whose text overlaps no test passage (see overlaps)."""
    names = docs.columns
    spot = ([i for i, c in enumerate(names) if c == "text"] or [i for i, c in enumerate(names) if c.lower() == "text"])[0]
    flat = docs.toDF(*[f"c{i}" for i in range(len(names))])
    text = F.coalesce(F.col(f"c{spot}").cast("string"), F.lit(""))
    leaking = _found(flat.select(F.lit(None).cast("long").alias("doc_id"), text.alias("text")), benchmark, alike, share, evidence)[0].select(F.col("digest").alias("_leak")).distinct()
    return flat.join(leaking, F.unhex(F.md5(text.cast("binary"))) == F.col("_leak"), "left_anti").toDF(*names)
