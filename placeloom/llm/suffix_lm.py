"""Language-model scoring by a probabilistic suffix tree over words.

The root is the smoothed distribution of single words. Below it, a context (the last one, two, ... words) becomes a state if it
is frequent enough and its next-word distribution diverges from that of its longest proper suffix. A state keeps the
probabilities of the next words that have evidence in it and differ; all others share the rest of its mass in its suffix's
proportions, so every state's distribution sums to one. A word is scored in the longest suffix of what precedes it that is a
state.

All counts are of the whole corpus, and what a context or a next word needs is a fixed count and a fixed divergence, so the tree
grows with the input. Words are split and hashed once; each level is one pass over the stored hashes. A context is counted if it
is frequent and its suffix is followed by more than one word: where a suffix has one next word, so has everything that ends with
it, and nothing can diverge. So levels shrink, and the tree ends by itself at the first level without a state.

A score is a sum: each transition and each state adds one value for each place it occurs at. The values of the most frequent ones
(a bounded number) are broadcast, all others are asked for: a run of texts asks for each of its sequences once, in sorted arrays that
go to ranges of keys, where the values are, and what comes back is a sum for each text. Bitmaps of bounded size tell which sequences
can have a value at all, and where they err the values' ranges say so.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, documents, remainder, stored, tidy

#: The end of a text, counted as a word of its own.
END = b""
#: A bitmap has about 16 bits a key, and 64 times as many (8 MB) at most, at any size of the corpus.
SLOTS = 1 << 20
#: Constants of the 64-bit hash that the built-in function xxhash64 gives for longs (fixed values).
P1, P2, P3, P4, P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5


def word_hash(word: bytes) -> int:
    """62 bits, not negative."""
    import xxhash

    return xxhash.xxh64_intdigest(word) >> 2


def word_hashes(words):
    """word_hash of each of an Arrow array of distinct strings (not a slice), out of its buffer."""
    import numpy as np
    import xxhash

    _, offsets, data = words.buffers()
    at = np.frombuffer(offsets, np.int64)[: len(words) + 1].tolist()
    raw, digest = data.to_pybytes() if data else b"", xxhash.xxh64_intdigest
    return (np.fromiter((digest(raw[i:j]) for i, j in zip(at, at[1:], strict=False)), np.uint64, len(words)) >> np.uint64(2)).astype(np.int64)


def _hashed(x, seed):
    """xxhash64 of longs (uint64 arrays) as the built-in function gives it."""
    import numpy as np

    u, turned = np.uint64, lambda v, n: (v << u(n)) | (v >> u(64 - n))
    h = (seed + u((P5 + 8) & (2**64 - 1))) ^ (turned(x * u(P2), 31) * u(P1))
    h = turned(h, 27) * u(P1) + u(P4)
    h = (h ^ (h >> u(33))) * u(P2)
    h = (h ^ (h >> u(29))) * u(P3)
    return h ^ (h >> u(32))


def chained(ctx, word):
    """The hash of a sequence from that of all its words but the last, and that word's: equal to xxhash64(ctx, word) in SQL."""
    import numpy as np

    return _hashed(word.view(np.uint64), _hashed(ctx.view(np.uint64), np.uint64(42))).view(np.int64)


def lined_up(texts):
    """The hashes of all texts' words in one array, a -1 before each text and its end after it, and where each text starts.

    texts: an Arrow array of large strings. Words are split and told apart in Arrow, and each distinct one is hashed once."""
    import numpy as np
    import pyarrow.compute as pc

    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    coded = lists.flatten().dictionary_encode()
    index, h = coded.indices.to_numpy(), word_hashes(coded.dictionary)
    doc = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    blank = np.flatnonzero(h == word_hash(END))
    if len(blank):  # what leading or trailing blanks leave
        real = index != blank[0]
        index, doc = index[real], doc[real]
    h = np.append(h, word_hash(END))
    size = np.bincount(doc, minlength=len(texts)) + 2
    starts = np.cumsum(size) - size
    out = np.full(int(size.sum()), -1, np.int64)
    out[np.arange(len(doc)) + 2 * doc + 1] = h[index]
    out[starts + size - 1] = h[-1]
    return out, starts


def pieces(batches, most: int = 8_000_000):
    """(batch, from, to, texts): runs of texts of a batch with about `most` bytes, as Arrow strings; null: empty."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        texts = pc.take(pc.fill_null(batch.column("text").cast(pa.large_string()), ""), np.arange(batch.num_rows))
        total = np.cumsum(pc.binary_length(texts).to_numpy())
        begin = 0
        while begin < len(texts):
            end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + most, "right")))
            # a copy: Arrow splits slices of an array at wrong places
            yield batch, begin, end, pc.take(texts, np.arange(begin, end))
            begin = end


def in_words(docs: DataFrame) -> DataFrame:
    """doc_id, row (numbers of their own): arrays, learn, ids, by blocks of docs (doc_id, text, learn) that are alike in learn; stored.

    ids.block: each text's number of words and its end, the differences of the hashes of the distinct ones, the most frequent first, and
    all words by their place in that: about a third of what the hashes take."""

    def run(batches):
        import numpy as np
        import pandas as pd
        import pyarrow as pa
        from pyspark import TaskContext

        row, held, n = TaskContext.get().partitionId() << 36, [], 0

        def flush():
            *numbers, doc = zip(*held, strict=True)
            a, size, learn = (np.concatenate(x) for x in numbers)
            doc = pa.concat_arrays(doc)
            of = np.repeat(learn, size)
            for kind in (True, False):
                own = np.flatnonzero(learn == kind)
                if not len(own):
                    continue
                codes, h = pd.factorize(a[of == kind])
                count = np.bincount(codes)
                order = np.lexsort((np.where(count < 4, h, 0), -count))
                place = np.empty(len(h), np.uint32)
                place[order] = np.arange(len(h))
                ids = pa.StructArray.from_arrays([pa.array([packed(size[own].astype(np.uint32), np.diff(h[order], prepend=0), place[codes])], pa.binary())], ["block"])
                lists = [pa.ListArray.from_arrays([0, len(own)], x) for x in (doc.take(pa.array(own)), pa.array(row + own))]
                yield pa.RecordBatch.from_arrays([*lists, pa.array([kind]), ids], ["doc_id", "row", "learn", "ids"])

        for batch, begin, end, texts in pieces(batches):
            a, starts = lined_up(texts)
            part = batch.slice(begin, end - begin)
            held.append((a[a >= 0], np.diff(np.append(starts, len(a))) - 1, part.column("learn").to_numpy(zero_copy_only=False).astype(bool), part.column("doc_id")))
            n += len(a)
            if n >= 4_000_000:
                yield from flush()
                row += sum(len(x[1]) for x in held)
                held, n = [], 0
        if held:
            yield from flush()

    return stored(docs.select("doc_id", "text", "learn").mapInArrow(tidy(run), "doc_id array<long>, row array<long>, learn boolean, ids struct<block: binary>"), "lm-ids", "zstd")


def unfolded(batch, most: int):
    """The same as runs, of blocks of in_words; doc_id, row and learn are told by text, if batch has them."""
    import numpy as np
    import pyarrow as pa

    for k, blob in enumerate(batch.column("ids").field(0).to_pylist()):
        size, h, codes = unpacked(blob, np.uint32, np.int64, np.uint32)
        size, h = size.astype(np.int64), np.cumsum(h)
        ends = np.cumsum(size)
        begin = 0
        while begin < len(size):
            done = int(ends[begin - 1]) if begin else 0
            end = max(begin + 1, int(np.searchsorted(8 * ends, 8 * done + most, "right")))
            own = size[begin:end]
            starts = np.cumsum(own + 1) - own - 1
            out = np.empty(int(own.sum()) + len(own), np.int64)
            real = np.ones(len(out), bool)
            real[starts] = False
            out[starts], out[real] = -1, h[codes[done : ends[end - 1]]]
            rest = [batch.column(c)[k].values.slice(begin, end - begin) for c in ("doc_id", "row") if c in batch.schema.names]
            rest = [*rest, pa.array(np.full(len(own), batch.column("learn")[k].as_py()))] if rest else [pa.nulls(len(own))]
            yield pa.RecordBatch.from_arrays(rest, ["doc_id", "row", "learn"][: len(rest)]), out, starts
            begin = end


def runs(batches, most: int = 2_000_000):
    """(batch, hashes with a -1 before each text, where each text starts): runs of texts of in_words, or of rows of plain hashes (ids,
    as bytes), with about `most` bytes."""
    import numpy as np
    import pyarrow as pa

    from .common import slices

    def plain():
        for batch in batches:
            if pa.types.is_struct(batch.column("ids").type):
                yield from unfolded(batch, most)
            else:
                yield from ((x, None, None) for x in slices([batch], "ids", most))

    for batch, out, starts in plain():
        if out is not None:
            yield batch, out, starts
            continue
        ids = batch.column("ids")
        first, n = ids.offset, len(ids)
        width = np.int64 if pa.types.is_large_binary(ids.type) else np.int32
        at = np.frombuffer(ids.buffers()[1], width)[first : first + n + 1].astype(np.int64)
        size = np.diff(at) // 8
        starts = np.cumsum(size + 1) - size - 1
        out = np.empty(int(size.sum()) + n, np.int64)
        out[starts] = -1
        real = np.ones(len(out), bool)
        real[starts] = False
        out[real] = np.frombuffer(ids.buffers()[2], np.uint8)[at[0] : at[-1]].view(np.int64) if len(out) > n else 0
        yield batch, out, starts


def word_counts(words: DataFrame) -> DataFrame:
    """h (hash of a word), c (its count) over rows of in_words, ends included."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        held, n = [], 0

        def flush():
            k, c = np.unique(np.concatenate(held), return_counts=True)
            for i in range(0, len(k), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(k[i : i + 200_000]), pa.array(c[i : i + 200_000])], ["h", "c"])

        for _, a, _ in runs(batches):
            held.append(a[a >= 0])
            n += len(a)
            if n >= 3_000_000:
                yield from flush()
                held, n = [], 0
        if held:
            yield from flush()

    return words.select("ids").mapInArrow(tidy(run), "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def packed(*arrays) -> bytes:
    """Arrays of numbers as bytes, compressed: first the lengths, then all first bytes of an array's numbers, all second ones and so on."""
    import numpy as np
    import pyarrow as pa

    raw = b"".join(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes() for x in arrays)
    return np.array([len(x) for x in arrays], np.int64).tobytes() + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def unpacked(blob, *kinds):
    """What packed has made of arrays of these types."""
    import numpy as np
    import pyarrow as pa

    sizes = np.frombuffer(blob, np.int64, len(kinds)).tolist()
    widths = [np.dtype(k).itemsize for k in kinds]
    total = sum(n * w for n, w in zip(sizes, widths, strict=True))
    raw = np.frombuffer(pa.decompress(blob[8 * len(kinds) :], total, "zstd", asbytes=True) if total else b"", np.uint8)
    out, at = [], 0
    for n, w, k in zip(sizes, widths, kinds, strict=True):
        out.append(np.ascontiguousarray(raw[at : at + n * w].reshape(w, n).T).reshape(-1).view(k))
        at += n * w
    return out


def bitmap(keys: DataFrame, column: str):
    """The bits of a column of hashes, put together on executors; at most SLOTS numbers come to the driver.

    Tasks send the sorted places of their bits, cut into ranges."""
    import numpy as np

    slots, ranges = min(SLOTS, 1 << (keys.count() // 4 + 64).bit_length()), 64

    def placed(batches):
        import pyarrow as pa

        held, n = [], 0

        def flush():
            at = np.unique(np.concatenate(held))
            edges = np.searchsorted(at, np.arange(ranges + 1) * slots)
            own = np.flatnonzero(np.diff(edges))
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array([packed(np.diff(at[edges[k] : edges[k + 1]], prepend=np.uint32(0))) for k in own], pa.binary())], ["part", "bits"])

        for batch in batches:
            held.append((batch.column(0).to_numpy().view(np.uint64) & np.uint64(64 * slots - 1)).astype(np.uint32))
            n += batch.num_rows
            if n >= 4_000_000:
                yield from flush()
                held, n = [], 0
        if n:
            yield from flush()

    def joined(batches):
        import pyarrow as pa

        now, bits = None, np.zeros(slots, bool)
        done = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], ["part", "bits"])
        for batch in batches:
            for part, blob in zip(batch.column("part").to_pylist(), batch.column("bits").to_pylist(), strict=True):
                if part != now:
                    if now is not None:
                        yield done()
                    now, bits = part, np.zeros(slots, bool)
                bits[np.cumsum(unpacked(blob, np.uint32)[0], dtype=np.int64) - part * slots] = True
        if now is not None:
            yield done()

    out = np.zeros((ranges, slots // ranges), np.uint64)
    t = keys.select(column).mapInArrow(tidy(placed), "part int, bits binary").repartition("part").sortWithinPartitions("part")
    for part, bits in t.mapInArrow(tidy(joined), "part int, bits binary").collect():
        out[part] = np.frombuffer(bits, np.uint64)
    return out.reshape(-1)


def marked(bits, g):
    """Whether the bit of each hash is set."""
    import numpy as np

    u = g.view(np.uint64)
    return (bits[(u >> np.uint64(6)) & np.uint64(len(bits) - 1)] >> (u & np.uint64(63))) & np.uint64(1) > 0


def walk(a, frequent: list, branching: list, every: bool = False):
    """By length of context, from one word: for each place whose preceding words may be a counted context, the place, the hashes of
    the context, of its longest proper suffix (0: the root), of context and word, and of suffix and word. a: word hashes, -1 between texts.

    frequent[k], branching[k]: bitmaps of the sequences of k + 1 words that are frequent, and of the contexts of as many words that
    more than one word follows. Where a context's suffix is followed by one word alone, context and word are as frequent as the context.
    every: those places too, where a longer context may be counted.
    """
    import numpy as np

    if not frequent:
        return
    at = np.flatnonzero(a >= 0)
    at = at[marked(frequent[0], a[at])]
    h, suffix, live = a[at], np.zeros(len(at), np.int64), np.ones(len(at), bool)
    last = a.copy()  # by place, the hash of the sequence of so many words that ends there, where its words but the last are frequent
    for k in range(len(frequent)):
        on = at + 1 < len(a)
        on[on] = a[at[on] + 1] >= 0
        at, ctx, suffix, live = at[on] + 1, h[on], suffix[on], live[on]
        g, own = chained(ctx, a[at]), last[at]
        shown = live | every
        yield at[shown], ctx[shown], suffix[shown], g[shown], own[shown]
        if k + 1 == len(frequent) or k >= len(branching):
            return
        last[at] = g
        stays = ~live
        stays[live] = marked(frequent[k + 1], g[live])
        at, h, suffix = at[stays], g[stays], own[stays]
        live = marked(branching[k], suffix)


def compacted(words: DataFrame, frequent: list, branching: list) -> DataFrame:
    """ids: of each row of words, the runs of words that contexts of the last length and longer ones can be in, each with the word that
    follows, and a -1 behind each run; stored. A frequent context's parts are frequent, so its places stay whole."""
    k = len(frequent)
    shared = words.sparkSession.sparkContext.broadcast((frequent, branching))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for _, a, starts in runs(batches):
            for at, *_ in walk(a, *shared.value, every=True):
                pass
            keep = np.zeros(len(a) + 1, bool)
            for back in range(k + 1):
                keep[at - back] = True
            stays = keep.copy()
            stays[1:] |= keep[:-1]
            out = np.where(keep, np.append(a, -1), -1)[stays]
            ends = np.cumsum(stays)[np.append(starts[1:] - 1, len(a))]
            ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(0, ends * 8).astype(np.int64)), pa.py_buffer(out)]).cast(pa.binary())
            ids = ids.filter(pa.array(np.diff(ends, prepend=0) > 0))
            yield pa.RecordBatch.from_arrays([ids], ["ids"])

    return stored(words.select("ids").mapInArrow(tidy(run), "ids binary"), "lm-runs", "zstd")


def dealt(ctx, part, buckets: int):
    """The bucket of each context, or of one part of a context so frequent that its words are dealt apart."""
    import numpy as np

    return (_hashed(ctx.view(np.uint64), part.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def transitions(words: DataFrame, shared, least: int, often: int, contexts: DataFrame | None = None) -> DataFrame:
    """ctx, w, c, size, s: how often (least times at least) a word follows a context of the last level that is broadcast, how often any
    word follows it (often times at least), and its suffix; with w = -1 the context itself (without a suffix). Words that are too rare after the suffix
    are so after the context, and are left out. shared: bitmaps for walk and of those that are not too rare, and contexts so frequent
    that their words are dealt to 64 parts; also, the most frequent words by rank, which are sent as that. contexts: g, c, s (hash, size and suffix) of all contexts of the last level, if they are known;
    else sizes are counted and sent along.

    What a task has counted goes to buckets of contexts as sorted arrays, one row a bucket, and each bucket is added up by itself.
    """
    buckets, told = 4 * max(1, int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))), contexts is not None

    def counted(batches):
        import numpy as np
        import pandas as pd
        import pyarrow as pa

        frequent, branching, known, heavy, *common = shared.value
        rank_of = pd.Index(common[0] if common else np.zeros(0, np.int64)).get_indexer
        held, n = [], 0

        def flush():
            ctx, w, s, g, suffix = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            # Each sequence once, in the order of contexts; sorting needs far less memory than hashing, and the parts go when they are used.
            order = np.argsort(g)
            g = g[order]
            new = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
            first, c = order[new], np.diff(np.append(new, len(g)))
            del g, order, new
            by = np.argsort(ctx[first])
            c, first = c[by], first[by]
            ctx, w, s, suffix = ctx[first], w[first], s[first], suffix[first]
            del by, first
            head = np.flatnonzero(np.append(True, ctx[1:] != ctx[:-1]))
            own, s, size = ctx[head], s[head], np.add.reduceat(c, head)
            on = np.flatnonzero(marked(known, suffix))
            of = np.searchsorted(head, on, "right") - 1
            ctx, w, c = ctx[on], w[on], c[on]
            del suffix, on
            rank = (rank_of(w) + 1).astype(np.uint32)
            many = found(heavy, own) >= 0
            to = dealt(own, np.zeros(len(own), np.int64), buckets)
            at = to[of]
            apart = np.flatnonzero(many[of])
            at[apart] = dealt(ctx[apart], w[apart] & 63, buckets)
            order = np.argsort(at.astype(np.uint16) if buckets < 2**16 else at, kind="stable")
            rows = np.concatenate([np.flatnonzero(~many), np.repeat(np.flatnonzero(many), 64)])
            to = np.concatenate([to[~many], dealt(own[rows[(~many).sum() :]], np.tile(np.arange(64), many.sum()), buckets)])
            to, rows = np.divmod(np.unique(to * len(own) + rows), len(own))
            edges, heads = np.searchsorted(at[order], np.arange(buckets + 1)), np.searchsorted(to, np.arange(buckets + 1))
            out = [[], []]
            for k in np.unique(to):
                i, j = order[edges[k] : edges[k + 1]], rows[heads[k] : heads[k + 1]]
                next_words = np.bincount(np.searchsorted(own[j], ctx[i]), minlength=len(j))
                out[0].append(int(k))
                out[1].append(packed(np.diff(own[j], prepend=0), next_words.astype(np.uint32), size[j] * (not told), s[j][(next_words > 0) & (not told)], rank[i], w[i[rank[i] == 0]].view(np.uint8), c[i].astype(np.uint32)))
                if len(out[0]) == 64:
                    yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary())], ["bucket", "counts"])
                    out = [[], []]
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary())], ["bucket", "counts"])

        for _, a, _ in runs(batches):
            for at, ctx, s, g, suffix in walk(a, frequent, branching):
                pass
            if told:
                on = np.flatnonzero(marked(known, suffix))
                at, ctx, s, g, suffix = at[on], ctx[on], s[on], g[on], suffix[on]
            if len(at):
                held.append((ctx, a[at], s, g, suffix))
                n += len(at)
            if n >= 2_500_000:
                yield from flush()
                n = 0
        if held:
            yield from flush()

    def placed(batches):
        import numpy as np
        import pyarrow as pa

        _, branching, _, heavy, *_ = shared.value
        held = [tuple(batch.column(x).to_numpy() for x in ("g", "c", "s")) for batch in batches if batch.num_rows]
        if held:
            own, size, s = (np.concatenate(x) for x in zip(*held, strict=True))
            rows = np.flatnonzero(marked(branching[-1], s)) if branching else np.arange(len(own))  # as walk does
            many = found(heavy, own[rows]) >= 0
            rows = np.concatenate([rows[~many], np.repeat(rows[many], 64)])
            to = dealt(own[rows], np.concatenate([np.zeros((~many).sum(), np.int64), np.tile(np.arange(64), many.sum())]), buckets)
            to, rows = np.divmod(np.unique(to * len(own) + np.argsort(np.argsort(own))[rows]), len(own))
            rows = np.argsort(own)[rows]
            edges = np.searchsorted(to, np.arange(buckets + 1))
            none = np.zeros(0, np.uint32)
            for k in np.unique(to):
                j = rows[edges[k] : edges[k + 1]]
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([packed(np.diff(own[j], prepend=0), np.zeros(len(j), np.uint32), size[j], s[j], none, none.view(np.uint8), none)], pa.binary())], ["bucket", "counts"])

    def added(batches):
        import numpy as np
        import pyarrow as pa

        def opened(blob):
            d, times, size, s, rank, rest, c = unpacked(blob, np.int64, np.uint32, np.int64, np.int64, np.uint32, np.uint8, np.uint32)
            own, w = np.cumsum(d), np.empty(len(rank), np.int64)
            far = rank == 0
            w[far] = rest.view(np.int64)
            if not far.all():
                w[~far] = shared.value[4][rank[~far] - 1]
            return own, times, size, own if len(s) == len(own) else own[times > 0][: len(s)], s, w, c

        def finished(bucket, held):
            own, times, size, led, s, w, c = (np.concatenate(x) for x in zip(*map(opened, held), strict=True))
            ctx = np.repeat(own, times)
            led, spot = np.unique(led, return_index=True)
            s = s[spot]
            own, back = np.unique(own, return_inverse=True)
            size = np.bincount(back, size).astype(np.int64)
            order = np.lexsort((w, ctx))
            ctx, w = ctx[order], w[order]
            new = np.flatnonzero(np.concatenate([[True], (ctx[1:] != ctx[:-1]) | (w[1:] != w[:-1])])[: len(ctx)])
            c = np.add.reduceat(c[order].astype(np.int64), new) if len(new) else np.zeros(0, np.int64)
            ctx, w = ctx[new], w[new]
            at = np.searchsorted(own, ctx)
            on = (c >= least) & (size[at] >= often)
            mine = (size >= often) & (dealt(own, np.zeros(len(own), np.int64), buckets) == bucket)
            columns = [(ctx[on], own[mine]), (w[on], np.full(mine.sum(), -1)), (c[on], size[mine]), (size[at][on], size[mine]), (s[np.searchsorted(led, ctx[on])], np.zeros(mine.sum(), np.int64))]
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in columns], ["ctx", "w", "c", "size", "s"])

        now, held = None, []
        for batch in batches:
            for bucket, counts in zip(batch.column("bucket").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                if bucket != now and held:
                    yield finished(now, held)
                    held = []
                now = bucket
                held.append(counts)
        if held:
            yield finished(now, held)

    t = words.select("ids").mapInArrow(tidy(counted), "bucket long, counts binary")
    if told:
        t = t.unionAll(contexts.select("g", "c", "s").mapInArrow(tidy(placed), "bucket long, counts binary"))
    t = t.repartition("bucket").sortWithinPartitions("bucket")
    return t.mapInArrow(tidy(added), "ctx long, w long, c long, size long, s long")


def found(keys, wanted):
    """The places of wanted in sorted keys, -1 where it is not."""
    import numpy as np

    if not len(keys):
        return np.full(len(wanted), -1, np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


class Tree:
    """hashes and counts of the frequent words; by level that has a state: how many contexts, states and kept next words.

    values: key (the hash of a sequence, or ~ that of a state) and its value v, a table; keys and gain: those broadcast. frequent and
    branching: bitmaps for walk; rest and also: bitmaps of the values that are asked for, by
    their keys and by a hash of them."""

    def __init__(self, hashes, counts, total: int, distinct: int):
        self.hashes, self.counts, self.total, self.distinct = hashes, counts, total, distinct
        self.levels: list[dict] = []
        self.frequent, self.branching, self.values = [], [], None

    def __getstate__(self):
        return self.__dict__ | {"values": None}

    def looked_up(self, a, places=None):
        """For word hashes with -1 between texts: each place's sum of broadcast values as a natural logarithm, and place and key of every value to be asked for."""
        import numpy as np
        import pandas as pd

        places = places or pd.Index(self.keys).get_indexer
        log, spots, wanted = np.zeros(len(a)), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at, ctx, _, g, _ in walk(a, self.frequent, self.branching):
            for key in (g, ~ctx):
                hit = places(key) if len(self.keys) else np.full(len(key), -1)
                on = hit >= 0
                log[at[on]] += self.gain[hit[on]]
                far = np.flatnonzero(~on)
                far = far[marked(self.rest, key[far])]
                far = far[marked(self.also, _hashed(key[far].view(np.uint64), np.uint64(42)).view(np.int64))]
                spots.append(at[far])
                wanted.append(key[far])
        return log, np.concatenate(spots), np.concatenate(wanted)

    def gains(self, a):
        """log10 of each word's probability under the tree, less that under the root alone, by the broadcast values."""
        import numpy as np

        return self.looked_up(a)[0] / np.log(10)


def learnt(words: DataFrame, depth: int = 6, least: int = 3, often: int = 20, evidence: float = 6.0, diverge: float = 2.0, discount: float = 0.5, part: float = 4e-7, known_part: float = 2e-7) -> tuple[Tree, DataFrame]:
    """The tree of words (rows of in_words), and all word counts (h, c).

    depth: the tree's memory, the most words of a context; the tree ends before it at a level without a state. often: what a context
    needs; least: what a next word needs in it, and evidence: how many nats its count must diverge (as a Poisson count) from what the
    suffix foretells for it to be kept; diverge: what a state must gain in all, for itself and each kept next word. part: of all words, what a sequence
    needs for its value to be broadcast (at most depth / part of them, 16 bytes each, and far fewer in text); known_part: the same
    for a word's count. What is rarer is asked for (values) or joined (counts).
    """
    import numpy as np

    sc, deep = words.sparkSession.sparkContext, None
    counts = stored(word_counts(words), "lm-words")
    total, distinct = counts.agg(F.sum("c"), F.count("*")).first()
    total, distinct = int(total or 0), int(distinct)
    top = counts.where(F.col("c") >= max(2, known_part * total)).toArrow()
    tree = Tree(top.column("h").to_numpy(), top.column("c").to_numpy(), total, distinct)
    shorter = counts.where(F.col("c") >= least).select(F.col("h").alias("key"), F.log((F.col("c") + 1) / F.lit(float(total + distinct + 1))).alias("suffix"))
    contexts = counts.where((F.col("c") >= often) & (F.col("h") != word_hash(END))).select(F.col("h").alias("g"), "c", F.lit(0).cast("long").alias("s"))
    whole = Window.partitionBy("ctx")
    mass = lambda on: {"took": F.sum(F.when(on, F.exp("own"))).over(whole), "had": F.sum(F.when(on, F.exp("suffix"))).over(whole)}
    share = F.when(F.col("took").isNotNull(), F.log(F.greatest(1 - F.col("took"), F.lit(1e-12)) / F.greatest(1 - F.col("had"), F.lit(1e-12))))
    differs = lambda q: F.col("c") * (F.col("own") - q) - (F.col("c") - discount - F.col("size") * F.exp(q)) >= evidence
    every = words.sparkSession.createDataFrame([], "key long, v double, c long")
    while len(tree.frequent) < depth:
        tree.frequent.append(bitmap(contexts, "g"))
        heavy = np.sort(contexts.where(F.col("c") >= max(2, total / 2000)).toArrow().column("g").to_numpy())
        if len(tree.frequent) == 3:  # few words are in a context so long, and all longer ones are there too
            deep = words = compacted(words, tree.frequent, tree.branching)
        shared = sc.broadcast((tree.frequent, tree.branching, bitmap(shorter, "key"), heavy, tree.hashes[np.argsort(-tree.counts)]))
        # A context of two words is followed by a word wherever it occurs, so its size is its count; longer ones need not have been counted.
        t = stored(transitions(words, shared, least, often, contexts if len(tree.frequent) <= 2 else None), "lm-counts", "zstd")
        shared.destroy()
        sizes = t.where("w = -1").select("ctx", "size")
        key = F.col("w") if len(tree.frequent) == 1 else F.xxhash64("s", "w")
        rows = t.where("w <> -1").withColumn("key", key).join(shorter.hint("shuffle_hash"), "key").select("ctx", "w", "c", "size", "suffix")
        rows = rows.repartition("ctx").withColumn("own", F.log((F.col("c") - discount) / F.col("size")))
        # All of a context is in one place now. What is left to the others changes by what is kept, and a word may differ from that alone.
        rows = rows.withColumns(mass(differs(F.col("suffix")))).withColumn("left", share)
        rows = rows.withColumn("keep", differs(F.col("suffix")) | F.coalesce(differs(F.col("suffix") + F.col("left")), F.lit(False))).drop("took", "had", "left")
        of = lambda x: F.when(F.col("keep"), x)
        rows = rows.withColumns(mass(F.col("keep")) | {"n": F.sum(of(F.col("c"))).over(whole), "better": F.sum(of(F.col("c") * (F.col("own") - F.col("suffix")))).over(whole), "k": F.count(of(F.lit(1))).over(whole), "lead": F.min(of(F.col("w"))).over(whole)})
        is_state = (F.col("better") + (F.col("size") - F.col("n")) * share > diverge * (1 + F.col("k"))) & (F.col("had") < 1) & (F.col("took") < 1)
        rows = rows.withColumn("share", F.when(is_state, share))
        level = rows.select("ctx", "w", F.xxhash64("ctx", "w").alias("g"), "c", F.when(F.col("share").isNull(), F.col("suffix")).when(F.col("keep"), F.col("own")).otherwise(F.col("suffix") + F.col("share")).alias("suffix"), of(F.col("own") - F.col("suffix") - F.col("share")).alias("v"), (F.col("w") != word_hash(END)).alias("goes_on"), (F.col("c") == F.col("size")).alias("alone"), F.when(F.col("w") == F.col("lead"), F.col("share")).alias("share"), "size", "k")
        level = stored(level, "lm-level", "zstd")
        states = level.where("share is not null")
        n, kept = states.agg(F.count("*"), F.sum("k")).first()
        if not n:
            tree.frequent.pop()
            break
        tree.levels.append({"contexts": sizes.count(), "state": np.int64(n), "kept": int(kept)})
        every = every.unionByName(states.select(F.bitwise_not("ctx").alias("key"), F.col("share").alias("v"), F.col("size").alias("c"))).unionByName(level.where("v is not null").select(F.col("g").alias("key"), "v", "c"))
        contexts = level.where((F.col("c") >= often) & F.col("goes_on")).select("g", "c", F.col("w").alias("s"))
        more = stored(sizes.select("ctx").join(level.where("alone").select("ctx"), "ctx", "left_anti"), "lm-branching")
        if len(tree.frequent) == depth or not contexts.limit(1).count() or not more.limit(1).count():
            break
        tree.branching.append(bitmap(more, "ctx"))
        discard(t, more)
        shorter = level.select(F.col("g").alias("key"), "suffix")
    enough = F.col("c") >= max(2, part * total)
    held = every.where(enough).select("key", "v").toArrow()
    tree.keys, tree.gain = held.column("key").to_numpy(), held.column("v").to_numpy()
    tree.values = stored(every.where(~enough).select("key", "v"), "lm-tree")
    discard(every, *([deep] if deep is not None else []))
    tree.rest, tree.also = bitmap(tree.values, "key"), bitmap(tree.values.select(F.xxhash64("key").alias("key")), "key")
    return tree, counts


def ranged(keys, buckets: int):
    """Where the ranges of keys begin, in sorted keys (uint64) of which each bucket has one range, and where the last ends."""
    import numpy as np

    edges = np.array([(k << 64) // buckets for k in range(buckets)], np.uint64)
    return np.append(np.searchsorted(keys, edges), len(keys))


def questions(key, row, buckets: int):
    """(bucket, blob) of the values that rows ask for: the first row, each distinct key of the bucket, how many rows ask for it and which."""
    import numpy as np

    # A blob counts rows from its first one in 32 bits.
    part, out = (row - row.min()) >> 32, []
    for p in np.unique(part):
        mine = np.flatnonzero(part == p)
        u, r = key[mine].view(np.uint64), row[mine]
        order = np.argsort(u)
        u, r, first = u[order], r[order], r.min()
        at = np.flatnonzero(np.append(True, u[1:] != u[:-1]))
        edges, ends = ranged(u[at], buckets), np.append(at, len(u))
        times, ref = np.diff(ends).astype(np.uint32), (r - first).astype(np.uint32)
        u = u[at]
        for k in np.flatnonzero(np.diff(edges)):
            i, j = edges[k], edges[k + 1]
            out.append((int(k), packed(np.array([first]), np.diff(u[i:j], prepend=np.uint64(0)), times[i:j], ref[ends[i] : ends[j]])))
    return out


def answered(asked: DataFrame, values: DataFrame, buckets: int) -> DataFrame:
    """row, far_gain (log10): the sums of the values (key, v) that rows ask for (bucket, asked: blobs of questions); each value meets a
    run of texts once, and what goes back is one number for each text of the run and bucket."""

    def told(batches):
        import numpy as np
        import pyarrow as pa

        held, n = [], 0

        def flush():
            key, v = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(key)
            key, v = key[order], v[order]
            edges = ranged(key, buckets)
            own = np.flatnonzero(np.diff(edges))
            blobs = [packed(np.diff(key[edges[k] : edges[k + 1]], prepend=np.uint64(0)), v[edges[k] : edges[k + 1]]) for k in own]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(np.zeros(len(own)), pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "kind", "blob"])

        for batch in batches:
            held.append((batch.column("key").to_numpy().view(np.uint64), batch.column("v").to_numpy()))
            n += batch.num_rows
            if n >= 1_000_000:
                yield from flush()
                held, n = [], 0
        if n:
            yield from flush()

    def met(batches):
        import numpy as np
        import pyarrow as pa

        now, held, key, v = None, [], np.zeros(0, np.uint64), np.zeros(0)
        for batch in batches:
            out = [[], []]
            for bucket, kind, blob in zip(*(batch.column(x).to_pylist() for x in ("bucket", "kind", "blob")), strict=True):
                if bucket != now:
                    now, held, key, v = bucket, [], np.zeros(0, np.uint64), np.zeros(0)
                if kind == 0:
                    d, x = unpacked(blob, np.uint64, np.float64)
                    held.append((np.cumsum(d), x))
                    continue
                if held:
                    key, v = (np.concatenate(x) for x in zip(*held, strict=True))
                    order = np.argsort(key)
                    key, v, held = key[order], v[order], []
                first, d, times, ref = unpacked(blob, np.int64, np.uint64, np.uint32, np.uint32)
                at = np.repeat(found(key, np.cumsum(d)), times)
                at, ref = at[at >= 0], ref[at >= 0]
                if len(at):
                    ref, back = np.unique(ref, return_inverse=True)
                    out[0].append(int(first[0]))
                    out[1].append(packed(np.diff(ref, prepend=np.uint32(0)), np.bincount(back, v[at])))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary())], ["first", "sums"])

    def added(batches):
        import numpy as np
        import pyarrow as pa

        def finished(first, held):
            ref, v = (np.concatenate(x) for x in zip(*held, strict=True))
            ref, back = np.unique(ref, return_inverse=True)
            return pa.RecordBatch.from_arrays([pa.array(first + ref.astype(np.int64)), pa.array(np.bincount(back, v) / np.log(10))], ["row", "far_gain"])

        now, held = None, []
        for batch in batches:
            for first, blob in zip(batch.column("first").to_pylist(), batch.column("sums").to_pylist(), strict=True):
                if first != now and held:
                    yield finished(now, held)
                    held = []
                now = first
                d, v = unpacked(blob, np.uint32, np.float64)
                held.append((np.cumsum(d, dtype=np.uint32), v))
        if held:
            yield finished(now, held)

    both = values.select("key", "v").mapInArrow(tidy(told), "bucket int, kind int, blob binary").unionAll(asked.select("bucket", F.lit(1).alias("kind"), F.col("asked").alias("blob")))
    sums = both.repartition("bucket").sortWithinPartitions("bucket", "kind").mapInArrow(tidy(met), "first long, sums binary")
    return sums.repartition("first").sortWithinPartitions("first").mapInArrow(tidy(added), "row long, far_gain double")


def scored(words: DataFrame, tree: Tree, counts: DataFrame, last: bool = False) -> DataFrame:
    """doc_id, learn, n_tokens, n_known, train_tokens, base_score, score of every text of in_words, whole (log10).
    last: words are deleted when they have been read.

    Words whose count the tree carries are looked up on the spot; each text's rarer ones, counted once a text, are joined to all
    counts, and the values that the tree does not carry are asked for (see answered), so that nothing that grows is broadcast.
    """
    sc = words.sparkSession.sparkContext
    shared = sc.broadcast(tree)
    buckets = max(1, min(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), max(sc.defaultParallelism, tree.values.count() >> 17)))

    def run(batches):
        import numpy as np
        import pandas as pd
        import pyarrow as pa

        tree = shared.value
        known, places, logs = pd.Index(tree.hashes), pd.Index(tree.keys), np.log10(tree.counts + 1.0)
        held, n = [], 0

        def asked():
            blobs = questions(*(np.concatenate(x) for x in zip(*held, strict=True)), buckets)
            none = [pa.nulls(len(blobs), t) for t in (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays([*none, pa.array([k for k, _ in blobs], pa.int32()), pa.array([b for _, b in blobs], pa.binary())], names)

        for batch, a, starts in runs(batches):
            real = a >= 0
            at = known.get_indexer(a)
            on = (at >= 0) & real
            log = np.zeros(len(a))
            log[on] = logs[at[on]]
            size = np.diff(np.append(starts, len(a))) - 1
            far = np.flatnonzero(real & ~on)
            doc, h = np.searchsorted(starts, far, "right") - 1, a[far]
            order = np.lexsort((h, doc))
            doc, h = doc[order], h[order]
            new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])])[: len(doc)]
            first = np.flatnonzero(new)
            times = np.diff(np.append(first, len(doc)))
            offsets = pa.array(np.searchsorted(doc[first], np.arange(len(starts) + 1), "left"), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int64())) for x in (h[first], times)]
            number_of = lambda x: np.add.reduceat(x, starts)
            gain, place, key = tree.looked_up(a, places.get_indexer)
            held.append((key, batch.column("row").to_numpy()[np.searchsorted(starts, place, "right") - 1]))
            n += len(key)
            none = [pa.nulls(len(starts), t) for t in (pa.int32(), pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), batch.column("learn"), pa.array(size, pa.int64()), pa.array(number_of(on.astype(np.int64)), pa.int64()), pa.array(number_of(log)), pa.array(number_of(gain) / np.log(10)), *lists, *none], names)
            if n >= 1_500_000:
                yield asked()
                held, n = [], 0
        if n:
            yield asked()

    names = ["doc_id", "row", "learn", "n", "known", "base", "gain", "rare", "times", "bucket", "asked"]
    both = stored(words.mapInArrow(tidy(run), "doc_id long, row long, learn boolean, n long, known long, base double, gain double, rare array<long>, times array<long>, bucket int, asked binary"), "lm-scores", "zstd")
    shared.destroy()
    if last:
        discard(words)
    rows = both.where("bucket is null").drop("bucket", "asked")
    rare = rows.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("h"), F.col("x.times").alias("f"))
    # Each sum is written by itself, so that the shuffles of one are gone before the other's begin.
    more = stored(rare.join(counts, "h").groupBy("row").agg(F.sum(F.col("f") * F.log10(F.col("c") + 1)).alias("more"), F.sum("f").alias("also")), "lm-rare")
    far = stored(answered(both.where("bucket is not null").select("bucket", "asked"), tree.values, buckets), "lm-far")
    both = rows.drop("rare", "times").join(more, "row", "left").join(far, "row", "left")
    base = F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n") * F.log10(F.lit(float(tree.total + tree.distinct + 1)))
    return both.select("doc_id", "learn", F.col("n").alias("n_tokens"), (F.col("known") + F.coalesce("also", F.lit(0))).alias("n_known"), F.lit(tree.total).cast("long").alias("train_tokens"), base.alias("base_score"), (base + F.col("gain") + F.coalesce("far_gain", F.lit(0.0))).alias("score"))


def run(docs: DataFrame, folds: int = 7, held: int = 2) -> DataFrame:
    """Learns from the documents whose crc32(doc_id) mod folds is not `held`, and scores all whole texts.

    Null and empty texts are an end alone; ids may be null or repeat, and each row is scored; very long texts are one row of hashes.
    An empty table gives no rows. Other columns are not read, whatever their names. With nothing to learn from, a score is the base.
    """
    words = in_words(documents(docs).withColumn("learn", remainder(F.col("doc_id"), folds) != held))
    s = scored(words, *learnt(words.where("learn")), last=True)
    return s.select("doc_id", (~F.col("learn")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
