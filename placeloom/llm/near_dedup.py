"""Near-duplicate linking by MinHash with tensored banding.

A document gets `collections` small collections of `rows` minhashes each. A table key is a pair of collections, so that all
pairs of collections give about collections^2 / 2 tables of 2 * rows minhashes from collections * rows minhashes: about a square
root of what as many separate tables would need. A document enters a table only where both its small collections were met by
some other document, which a count of the small collections tells first. Candidates are confirmed on their full shingle sets.

Rows of one shingle set are one class before anything is paired; classes have numbers of their own, so that ids may repeat, and
ids come in at the end alone. In each bucket all members are first compared with the smallest one; then, for buckets whose members are not all connected yet, pairs of members
in different components are compared too, one of the two outside the bucket's largest component. Pairs inside a component are
never needed, so a large group of copies costs its size, not its square, and no link between different components is lost.

A parity sketch (for each of 1024 parts of the hash space, whether an odd number of shingles lies in it) bounds the difference
of two sets from below: they differ in at least as many shingles as their sketches have different bits. Pairs that this bound
rules out, or that share an earlier bucket, never leave the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeloom.operators.components import components as connected

from .common import documents, shingle_hashes, slices, stored, texts_of, tidy, word_ids

COLLECTIONS, ROWS = 14, 4
#: Words are parted by these; A-Z count as a-z. (bytes.split() and bytes.lower() do just that.)
PROFILE = "doc_id long, digest binary, n_shingles long, content binary, small array<long>, parity array<long>"
PARITY_BITS = 1024


def seeds(n: int):
    """n odd multipliers and n offsets for minhashing (fixed by rule)."""
    import numpy as np

    rng = np.random.default_rng(20_240_601)
    return rng.integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, dtype=np.uint64)


def minhashes(h, a, b, piece: int = 4096):
    """The minhashes (32 bits) of 64-bit shingle hashes, in pieces so that a very long text needs little memory."""
    import numpy as np

    low = np.full(len(a), 2**32 - 1, np.uint64)
    for i in range(0, len(h), piece):
        x = h[i : i + piece, None] * a + b
        low = np.minimum(low, (x >> np.uint64(32)).min(axis=0))
    return low.astype(np.uint32)


def profiles(docs: DataFrame, collections: int = COLLECTIONS, rows: int = ROWS) -> DataFrame:
    """doc_id, digest (of the text), n_shingles, content (a digest of the shingle set), small (hashes of the small collections), parity (the parity sketch)."""

    def run(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa
        import xxhash

        a, b = seeds(collections * rows)
        number = word_ids()
        for batch in slices(batches):
            digest, n, content, small, parity = [], [], [], [], []
            for text in texts_of(batch):
                digest.append(hashlib.md5(text, usedforsecurity=False).digest())
                h = shingle_hashes(number.of(text.lower().split(), np.uint64))
                n.append(len(h))
                if len(h):
                    m = minhashes(h, a, b)
                    content.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest())
                    small.append([xxhash.xxh64_intdigest(m[i * rows : (i + 1) * rows].tobytes(), i) - 2**63 for i in range(collections)])
                    parity.append(np.packbits(np.bincount((h & np.uint64(PARITY_BITS - 1)).astype(np.int64), minlength=PARITY_BITS).astype(np.uint8) & 1).view(np.int64))
                else:
                    content.append(None)
                    small.append([])
                    parity.append([])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(digest, pa.binary()), pa.array(n, pa.int64()), pa.array(content, pa.binary()), pa.array(small, pa.list_(pa.int64())), pa.array(parity, pa.list_(pa.int64()))], ["doc_id", "digest", "n_shingles", "content", "small", "parity"])

    return docs.mapInArrow(tidy(run), PROFILE)


def shingle_sets(docs: DataFrame) -> DataFrame:
    """id, set (the whole shingle set, sorted, as bytes of 64-bit hashes) of docs (id, text)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        number = word_ids()
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([shingle_hashes(number.of(t.lower().split(), np.uint64)).tobytes() for t in texts_of(batch)], pa.binary())], ["id", "set"])

    return docs.select("id", "text").mapInArrow(tidy(run), "id long, set binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union on full sets."""
    left = pairs.join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b")
    both = left.join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a").select("a", "b", "sa", "sb")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    keep.append(False)
                    continue
                both = np.concatenate([x, y])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(tidy(run), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """id, component (the smallest id that can be reached) of every id in links (a, b)."""
    nodes = links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id")))
    return stored(connected(nodes, links), "dedup-components")


#: Members of a bucket that meet in one task at most, apart from the replicas that let blocks of a larger bucket meet.
BLOCK = 2000


def linked(docs: DataFrame, percent: int = 85, collections: int = COLLECTIONS, rows: int = ROWS) -> DataFrame:
    """doc_id, digest (md5 of the text), n_shingles, component (a number; null: linked with nothing) for every row of docs (doc_id, text)."""
    t = docs
    all_docs = stored(profiles(t, collections, rows), "dedup-profiles")
    live = all_docs.where("content is not null and doc_id is not null")
    whole = live.groupBy("content").agg(F.min("digest").alias("digest"), F.first("small").alias("small"), F.first("parity").alias("parity"), F.first("n_shingles").alias("n"))
    classes = stored(whole.withColumn("rep", F.monotonically_increasing_id()), "dedup-classes")
    spread = classes.select("rep", F.posexplode("small").alias("i", "h"))
    met = spread.groupBy("i", "h").agg(F.count("*").alias("c")).where("c > 1").select("i", "h")
    mine = spread.join(met, ["i", "h"]).groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("i", "h"))).alias("s")).where(F.size("s") > 1)
    pairs_of = F.flatten(F.transform("s", lambda x: F.transform(F.filter("s", lambda y: y["i"] > x["i"]), lambda y: F.struct(F.xxhash64(x["i"], x["h"], y["i"], y["h"]).alias("key"), x["i"].alias("i"), y["i"].alias("j")))))
    keyed = mine.select("rep", F.explode(pairs_of).alias("p")).select("rep", "p.key", "p.i", "p.j")
    leaders = keyed.groupBy("key").agg(F.min("rep").alias("leader"), F.count("*").alias("c")).where("c > 1").select("key", "leader")
    buckets = stored(keyed.join(leaders, "key").select("key", "i", "j", "rep", "leader"), "dedup-buckets")
    # One text of each class that met another: equal texts give equal sets, so of texts that repeat any serves.
    involved = classes.join(buckets.select("rep").distinct(), "rep", "left_semi").select(F.col("rep").alias("id"), "digest")
    texts = t.where("doc_id is not null").withColumn("digest", F.unhex(F.md5(F.col("text").cast("binary")))).join(involved, "digest").select("id", "text")
    sets = stored(shingle_sets(texts).groupBy("id").agg(F.min("set").alias("set")), "dedup-sets")
    sketched = classes.select("rep", "n", "parity")

    def possible(na, nb, pa, pb):
        """Whether sizes and sketches allow the likeness: it needs at most (100 - percent) / (100 + percent) of both sizes as difference."""
        differ = F.lit(0)
        for k in range(PARITY_BITS // 64):
            differ = differ + F.bit_count(pa[k].bitwiseXOR(pb[k]))
        return (F.least(na, nb) * 100 >= F.greatest(na, nb) * percent) & (differ * (100 + percent) <= (na + nb) * (100 - percent))

    star = buckets.where("rep <> leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()
    star = star.join(sketched.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("parity").alias("pa")), "a").join(sketched.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("parity").alias("pb")), "b")
    first = stored(star.where(possible(F.col("na"), F.col("nb"), F.col("pa"), F.col("pb"))).select("a", "b"), "dedup-pairs")
    links = stored(confirmed(first, sets, percent), "dedup-links")
    part = components(links)
    # Buckets that hold several components: pairs across them, one side outside the bucket's largest component. A pair counts in
    # the first bucket it shares alone: the one of the first two collections in which both agree.
    own = buckets.join(part, buckets.rep == part.id, "left").select("key", "i", "j", "rep", F.coalesce("component", "rep").alias("g"))
    groups = own.groupBy("key", "g").agg(F.count("*").alias("c"))
    open_ = groups.groupBy("key").agg(F.count("*").alias("k"), F.max_by("g", F.struct("c", "g")).alias("largest")).where("k > 1").select("key", "largest")
    rest = stored(own.join(open_, "key").join(classes.select("rep", "n", "small", "parity"), "rep"), "dedup-open")
    # A bucket is cut into blocks of BLOCK members by hash; each pair of blocks meets under a key of its own.
    rest = stored(rest.join(rest.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "key").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")), "dedup-blocks")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    named = lambda d, p: d.select("key", "p", "q", *[F.col(c).alias(f"{p}_{c}") for c in ("rep", "g", "n", "small", "parity")], *(["i", "j"] if p == "x" else []))
    x = named(rest.where("g <> largest").withColumn("p", F.col("block")).withColumn("q", every), "x")
    y = named(rest.withColumn("q", F.col("block")).withColumn("p", every), "y")
    agree = F.filter(F.zip_with(F.sequence(F.lit(0), F.lit(collections - 1)), F.zip_with("x_small", "y_small", lambda p, q: p == q), lambda k, same: F.when(same, k)), lambda k: k.isNotNull())
    once = (F.get(agree, F.lit(0)) == F.col("i")) & (F.get(agree, F.lit(1)) == F.col("j"))
    may = possible(F.col("x_n"), F.col("y_n"), F.col("x_parity"), F.col("y_parity"))
    across = x.join(y, (x["key"] == y["key"]) & (x["p"] == y["p"]) & (x["q"] == y["q"]) & (F.col("x_g") != F.col("y_g")) & may & once).select(F.least("x_rep", "y_rep").alias("a"), F.greatest("x_rep", "y_rep").alias("b")).distinct()
    second = across.join(first, ["a", "b"], "left_anti")
    more = stored(confirmed(second, sets, percent), "dedup-links")
    final = components(links.unionByName(more)) if more.limit(1).count() else part
    placed = classes.join(final, classes.rep == final.id, "left").select("content", F.coalesce("component", "rep").alias("component"))
    return all_docs.withColumn("known", F.when(F.col("doc_id").isNotNull(), F.col("content"))).select("doc_id", "digest", "n_shingles", "known").join(placed, F.col("known") == placed["content"], "left").select("doc_id", "digest", "n_shingles", "component")


def grouped(docs: DataFrame, percent: int = 85, collections: int = COLLECTIONS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row.

    Texts are whole; null and empty ones have no shingles and are their own component. Each row is a document: rows that repeat an
    id are linked by their texts alone, and each has its own component's smallest id. A null id takes no part in links and is kept.
    An empty table gives no rows. Very long texts are hashed in pieces. Other columns are not read, whatever their names.
    """
    each = stored(linked(documents(docs), percent, collections, rows), "dedup-rows")
    least = each.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("least"))
    component = F.coalesce("least", "doc_id")
    out = each.join(least, "component", "left")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def survivors(docs: DataFrame, percent: int = 80, collections: int = 20, rows: int = ROWS) -> DataFrame:
    """The rows of docs, all columns as they are, without those that another row of their component stands for.

    Of each component the row with the smallest id stays, of several the one whose text has the smallest digest; rows equal in id and
    text are one document, of which one row stays. Texts without words are linked with nothing, and rows with a null id stay.
    """
    each = stored(linked(documents(docs), percent, collections, rows), "dedup-rows").where("doc_id is not null")
    first = each.where("component is not null").groupBy("component").agg(F.min(F.struct("doc_id", "digest")).alias("first"))
    lost = each.join(first, "component").where((F.col("doc_id") != F.col("first.doc_id")) | (F.col("digest") != F.col("first.digest"))).select(F.col("doc_id").alias("_lost"), F.col("digest").alias("_by")).distinct()
    again = each.groupBy("doc_id", "digest").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("_again"), F.col("digest").alias("_as"))
    names = docs.columns
    spot = lambda name: F.col(f"c{([i for i, c in enumerate(names) if c == name] or [i for i, c in enumerate(names) if c.lower() == name])[0]}")
    flat = docs.toDF(*[f"c{i}" for i in range(len(names))]).withColumns({"_id": spot("doc_id").cast("long"), "_digest": F.unhex(F.md5(F.coalesce(spot("text").cast("string"), F.lit("")).cast("binary")))})
    left = flat.join(lost, (F.col("_id") == F.col("_lost")) & (F.col("_digest") == F.col("_by")), "left_anti")
    twice = (F.col("_id") == F.col("_again")) & (F.col("_digest") == F.col("_as"))
    if again.limit(1).count():
        left = left.join(again, twice, "left_anti").unionByName(left.join(again, twice, "left_semi").dropDuplicates(["_id", "_digest"]))
    return left.drop("_id", "_digest").toDF(*names)
