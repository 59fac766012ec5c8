"""op1, op2 and op9: held-out accuracy, exact counts, and odd inputs."""

import math
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from placeloom.llm import common, quality, suffix_lm, toxicity

from .conftest import ODD, SCHEMA, prose, rows


def auc(scores, labels):
    pairs = [(s, t) for s, a in zip(scores, labels, strict=True) if a for t, b in zip(scores, labels, strict=True) if not b]
    return sum((s > t) + 0.5 * (s == t) for s, t in pairs) / len(pairs)


def labelled(spark, make, column, n=400):
    rng = random.Random(3)
    data = [(i, *make(rng)) for i in range(n)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t, _ in data], SCHEMA)
    labels = spark.createDataFrame([(i, y) for i, _, y in data], f"doc_id long, {column} int")
    return docs, labels, {i: y for i, _, y in data}


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_quality(spark, clashing, nothing):
    def make(rng):
        t, y = prose(rng, 80), int(rng.random() < 0.7)
        return (t if y else " ".join(w + "###" for w in t.split())), y

    d, labels, y = labelled(spark, make, "quality")
    m = quality.train(d, labels)
    s = {r.doc_id: r.score for r in quality.score(d, m).collect()}
    ids = [i for i in s if held(i)]
    assert auc([s[i] for i in ids], [y[i] for i in ids]) > 0.95
    odd = quality.score(clashing, m).collect()
    assert len(odd) == len(rows() + ODD) and all(0 <= r.score <= 1 for r in odd) and quality.score(nothing, m).count() == 0
    assert quality.train(nothing, labels).scores(*quality.encoded([b"", b"a b"])).shape == (2,)


def test_encoding_does_not_depend_on_neighbours():
    texts = [b"", b"abc abc abc", "é ü".encode(), b"x" * 2000, b"\n\n"]
    x, bags = quality.encoded(texts)
    at = 0
    for t, n in zip(texts, bags, strict=True):
        one, k = quality.encoded([t])
        assert k[0] == n and np.allclose(one, x[at : at + n])
        at += n


def test_toxicity(spark, docs, clashing, nothing):
    def make(rng):
        t, y = prose(rng, 60).split(), int(rng.random() < 0.3)
        for _ in range(3 * y):
            t.insert(rng.randrange(len(t)), rng.choice(["vile", "nasty", "rotten"]))
        return " ".join(t), y

    d, labels, y = labelled(spark, make, "toxic")
    m = toxicity.train(d, labels)
    s = {r.doc_id: r.score for r in toxicity.score(d, m).collect()}
    ids = [i for i in s if held(i)]
    assert auc([s[i] for i in ids], [y[i] for i in ids]) > 0.95
    odd = toxicity.score(clashing, m).collect()
    assert len(odd) == len(rows() + ODD) and all(0 <= r.score <= 1 for r in odd) and toxicity.score(nothing, m).count() == 0
    kept = toxicity.ordinary(d, m).select("doc_id").collect()
    assert {r.doc_id for r in kept} == {i for i in s if s[i] < 0.5}
    assert toxicity.score(docs, toxicity.train(nothing, labels)).count() == len(odd)
    assert all(toxicity.train(clashing, labels.where("false")).scores([b"", b"x"]) < 0.5)


def test_a_bounded_sample_takes_whole_texts(spark):
    d = spark.createDataFrame([(i, f"{'vile' if i % 2 else 'kind'} w{i}") for i in range(200)], "doc_id long, TEXT string")
    y = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(3, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    got = []
    fitted = toxicity.fitted
    toxicity.fitted = lambda rows, parts: got.append((rows, parts)) or fitted(rows, parts)
    try:
        assert toxicity.train(d, y, most_bytes=200).scores([b"vile", b"kind"]).argmax() == 0
    finally:
        toxicity.fitted = fitted
    (rows, parts), = got
    assert parts == {1: sum(not held(i) for i in range(1, 200, 2)), 0: sum(not held(i) for i in range(0, 200, 2))}
    assert all(100 < sum(len(b" ".join(w)) for c, w, _ in rows if c == y) <= 200 for y in (0, 1))
    assert toxicity.ordinary(d, fitted(rows, parts)).columns == ["doc_id", "TEXT"]


def brute_log_probability(data, label, order, word):
    """ln of the probability of a word with its end in the class of a label, by the definition, out of dictionaries of strings."""
    def of(w):
        s = "\1" + w + "\2"
        return [s[max(0, i + 1 - order) : i + 1] if i + 1 >= order else "\0" * (order - i - 1) + s[: i + 1] for i in range(1, len(s))]

    seen = {c: Counter(g for y, t in data if y == c for w in set(t.split()) for g in of(w)) for c in (0, 1)}
    levels, now = {}, set(seen[0]) | set(seen[1])
    for k in range(order - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in now)
        now = set(levels[k])

    def p(counts, g, rest):
        n1, n2 = sum(c == 1 for c in counts.values()), sum(c == 2 for c in counts.values())
        less = n1 / (n1 + 2 * n2) if n1 else 0.5
        same = [c for x, c in counts.items() if x[:-1] == g[:-1]]
        return max(counts.get(g, less) - less, 0) / sum(same) + less * len(same) / sum(same) * rest if same else rest

    out = 0.0
    for g in of(word):
        shared = 1 / 256
        for k in range(1, order):
            shared = p(levels[k], g[-k:], shared)
        out += math.log(p(seen[label], g, shared))
    return out


def test_toxicity_equals_brute_force():
    rng = random.Random(4)
    make = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(1, 6)))
    data = [(int(k < 5), " ".join(make() for _ in range(12))) for k in range(14)]
    names = sorted({w for _, t in data for w in t.split()})
    counts = [[sum(y == c and w in t.split() for y, t in data) for w in names] for c in (1, 0)]
    for order in (2, 3, 4):
        m = toxicity.build(toxicity.told_apart([w.encode() for w in names], order), counts, order)
        unseen = ["zz", "abcd", "c" * 9, "cabz"]
        got = m.of_words([w.encode() for w in names + unseen])
        want = [brute_log_probability(data, 1, order, w) - brute_log_probability(data, 0, order, w) for w in names + unseen]
        assert np.abs(got - want).max() < 1e-9
        text = " ".join(names[:5] + ["zz"]).upper()
        n = sum(len(w) + 1 for w in text.split())
        assert abs(m.differences([text.encode(), b""])[0] - sum(got[i] for i in (*range(5), len(names))) / n) < 1e-12


def test_lm_counts_and_odd_inputs(spark, docs, clashing, nothing):
    got = suffix_lm.run(clashing).collect()
    data = rows() + ODD
    counts = Counter()
    words = lambda t: [*(t or "").encode().lower().split(), b""]
    crc = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7
    for r in data:
        if crc(r[0]) != 2:
            counts.update(words(r[1]))
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(r[0]), crc(r[0]) == 2, len(words(r[1])), sum(counts[w] > 0 for w in words(r[1])), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words(r[1])), 4)) for r in data)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert suffix_lm.run(nothing).count() == 0


def test_lm_states_sum_to_one_and_help(spark):
    rng = random.Random(5)
    after = {a: rng.sample(range(40), 3) for a in range(40)}

    def text():
        a, out = rng.randrange(40), []
        for _ in range(60):
            out.append(f"w{a}")
            a = rng.choice(after[a])
        return " ".join(out)

    d = spark.createDataFrame([(i, text(), "en", "s", 0) for i in range(200)], SCHEMA)
    table = suffix_lm.in_words(d.withColumn("learn", F.lit(True)))
    tree, counts = suffix_lm.learnt(table, known_part=1e-9)
    assert tree.levels[0]["state"] > 30 and all(x["state"] <= 2 for x in tree.levels[1:])  # one word tells all there is to tell
    words = sorted({f"w{a}" for a in range(40)})
    count = dict(zip(tree.hashes.tolist(), tree.counts.tolist(), strict=True))
    for context in ("w1", "w2 w3", "w39 w0 w7"):
        total = 1 / (tree.total + tree.distinct + 1)  # all words never seen
        for nxt in [*words, None]:
            a, _ = suffix_lm.lined_up(pa.array([f"{context} {nxt}" if nxt else context], pa.large_string()))
            at = len(a) - 2 if nxt else len(a) - 1
            total += 10 ** tree.gains(a)[at] * (count[int(a[at])] + 1) / (tree.total + tree.distinct + 1)
        # an unseen word is also scored by the state, so its part is that state's share
        a, _ = suffix_lm.lined_up(pa.array([f"{context} zzz"], pa.large_string()))
        total += (10 ** tree.gains(a)[len(a) - 2] - 1) / (tree.total + tree.distinct + 1)
        assert abs(total - 1) < 1e-6
    s = suffix_lm.scored(table, tree, counts).agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    assert (s.s - s.b) / s.n > 0.5


def brute_scores(texts, depth=6, least=3, often=20, evidence=6.0, diverge=2.0, discount=0.5):
    """The suffix tree by its definition, over all contexts, with dictionaries alone; log10 of each text."""
    data = [[*t.encode().lower().split(), b""] for t in texts]
    one = Counter(w for d in data for w in d)
    n, v = sum(one.values()), len(one)
    after = [defaultdict(Counter) for _ in range(depth + 1)]
    for d in data:
        for i in range(1, len(d)):
            for k in range(1, min(depth, i) + 1):
                after[k][tuple(d[i - k : i])][d[i]] += 1
    states = {}

    def p(ctx, w):
        """ln of the probability of w after ctx, in its longest suffix that is a state."""
        for k in range(len(ctx), 0, -1):
            if ctx[-k:] in states:
                share, kept = states[ctx[-k:]]
                return kept[w] if w in kept else p(ctx[1 - k :] if k > 1 else (), w) + share
        return math.log((one[w] + 1) / (n + v + 1))

    for k in range(1, depth + 1):
        new = {}
        for ctx, follow in after[k].items():
            size = sum(follow.values())
            if size < often or k > 1 and len(after[k - 1][ctx[1:]]) < 2:
                continue
            every = {w: (math.log((c - discount) / size), p(ctx[1:], w), c) for w, c in follow.items() if c >= least}
            differs = lambda x, q: x[2] * (x[0] - q) - (x[2] - discount - size * math.exp(q)) >= evidence  # noqa: B023, E731
            kept = {w: x for w, x in every.items() if differs(x, x[1])}
            took, had = (sum(math.exp(x[i]) for x in kept.values()) for i in (0, 1))
            left = math.log(max(1 - took, 1e-12) / max(1 - had, 1e-12))
            kept = {w: x for w, x in every.items() if w in kept or kept and differs(x, x[1] + left)}
            took, had = (sum(math.exp(x[i]) for x in kept.values()) for i in (0, 1))
            if not kept or took >= 1 or had >= 1:
                continue
            share = math.log((1 - took) / (1 - had))
            if sum(x[2] * (x[0] - x[1]) for x in kept.values()) + (size - sum(x[2] for x in kept.values())) * share > diverge * (1 + len(kept)):
                new[ctx] = (share, {w: x[0] for w, x in kept.items()})
        if not new:
            break
        states |= new
    return [sum(p(tuple(d[max(0, i - depth) : i]), w) for i, w in enumerate(d)) / math.log(10) for d in data], Counter(len(x) for x in states)


def test_lm_equals_brute_force(spark):
    rng = random.Random(9)
    verse = prose(rng, 40)  # many texts hold it whole, so that frequent contexts have one next word
    texts = [" ".join([*(f"a{i} b{j} c{int(i + j > 1)}" for i, j in [[rng.randrange(2) for _ in range(2)] for _ in range(20)]), *([verse] * (k % 2)), f"rare{k}"]) for k in range(60)]
    texts += [f"{verse} then {k % 3} and {verse}" for k in range(30)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    table = suffix_lm.in_words(d.withColumn("learn", F.lit(True)))
    tree, counts = suffix_lm.learnt(table)
    want, states = brute_scores(texts)
    assert [int(x["state"]) for x in tree.levels] == [states[k + 1] for k in range(len(states))] and len(states) > 1
    got = {r.doc_id: r.score for r in suffix_lm.scored(table, tree, counts).collect()}
    assert max(abs(got[i] - x) for i, x in enumerate(want)) < 1e-6


def test_compacted_words_keep_all_long_contexts(spark):
    rng = random.Random(4)
    verse = prose(rng, 12).split()
    texts = [" ".join(" ".join([prose(rng, rng.randrange(1, 9)), *verse[rng.randrange(4) : rng.randrange(6, 12)]]) for _ in range(3)) for _ in range(120)] + ["", "one"]
    a, _ = suffix_lm.lined_up(pa.array(texts, pa.large_string()))

    def bits(keys):
        out = np.zeros(1 << 14, np.uint64)
        for k in np.asarray(keys, np.int64).view(np.uint64).tolist():
            out[k >> 6 & (1 << 14) - 1] |= np.uint64(1 << (k & 63))
        return out

    often = lambda keys: [k for k, c in Counter(keys.tolist()).items() if c >= 20]
    frequent, branching = [bits(often(a[a >= 0]))], []
    for _ in range(2):
        at, ctx, _, g, _ = list(suffix_lm.walk(a, frequent, branching))[-1]
        after = defaultdict(set)
        for c, w in zip(ctx.tolist(), a[at].tolist(), strict=True):
            after[c].add(w)
        frequent.append(bits([x for x in often(g) if x not in g[a[at] == suffix_lm.word_hash(b"")]]))
        branching.append(bits([c for c, w in after.items() if len(w) > 1]))
    words = suffix_lm.in_words(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2).withColumn("learn", F.lit(True)))
    kept = [np.frombuffer(r.ids, np.int64) for r in suffix_lm.compacted(words, frequent, branching).collect()]
    short = np.concatenate([np.append(-1, x) for x in kept])
    seen = lambda x: Counter(zip(*(y.tolist() for y in (lambda at, ctx, s, g, own: (ctx, x[at], s, g, own))(*list(suffix_lm.walk(x, frequent, branching))[-1])), strict=True))
    assert seen(short) == seen(a) and len(seen(a)) > 5
    assert 0 < (short >= 0).sum() < (a >= 0).sum()


def test_words_are_split_at_ascii_blanks_alone():
    texts = ["", "  a\tB \x0b\x0cb\r\n ", "\u00a0x\u3000y z\x1cw\x85", "\n", "É é AÉ"]
    a, starts = suffix_lm.lined_up(pa.array(texts, pa.large_string()))
    want = []
    for t in texts:
        want += [-1, *[suffix_lm.word_hash(w) for w in t.encode().lower().split()], suffix_lm.word_hash(b"")]
    assert a.tolist() == want and [a[i] for i in starts] == [-1] * len(texts)
    # in pieces of an array that is itself a slice
    batch = pa.RecordBatch.from_arrays([pa.array(["cut off", *texts, None, "a b c " * 50])], ["text"]).slice(1)
    got = [suffix_lm.lined_up(t)[0].tolist() for _, _, _, t in suffix_lm.pieces([batch], 10)]
    assert len(got) > 2 and [x for g in got for x in g] == want + [-1, suffix_lm.word_hash(b""), -1, *[suffix_lm.word_hash(w) for w in (b"a", b"b", b"c")] * 50, suffix_lm.word_hash(b"")]


def test_lm_grows_with_the_corpus(spark):
    rng = random.Random(7)
    # the fourth word follows from the three before it, and fewer of them tell less
    text = lambda: " ".join(f"a{i} b{j} c{k} d{int(i + j + k > 1)}" for i, j, k in [[rng.randrange(2) for _ in range(3)] for _ in range(50)])
    d = spark.createDataFrame([(i, text()) for i in range(40)], "doc_id long, text string")
    encoded = lambda docs: suffix_lm.in_words(docs.withColumn("learn", F.lit(True)))
    table = encoded(d)
    tree, counts = suffix_lm.learnt(table)
    assert len(tree.levels) > 2 and tree.levels[2]["state"] > 0
    # all values joined give what all values broadcast give
    apart, also = suffix_lm.learnt(table, part=1.0)
    assert len(apart.keys) == 0 < len(tree.keys)
    a, b = ({r.doc_id: r.score for r in suffix_lm.scored(table, *m).collect()} for m in ((tree, counts), (apart, also)))
    assert len(a) == 40 and all(abs(a[i] - b[i]) < 1e-6 for i in a)
    # what a context needs does not rise with the words around it
    pair = spark.createDataFrame([(i, "left right " * 3) for i in range(10)] + [(10 + i, "x " * 300_000) for i in range(10)], "doc_id long, text string")
    got = {r.doc_id: r for r in suffix_lm.scored(encoded(pair), *suffix_lm.learnt(encoded(pair))).collect()}
    assert got[0].score > got[0].base_score + 5


def test_toxicity_is_fitted_in_little_memory(monkeypatch):
    """pipeline: the driver holds words as numbers and the expressions of one order at a time."""
    import tracemalloc

    rng = random.Random(3)
    names = ["".join(rng.choices("abcdefghijklmnop", k=9)).encode() for _ in range(40_000)]
    rows = []
    for i in range(600):
        own = rng.sample(names, 300)
        rows.append((i % 2, toxicity.Packed(b" ".join(own)) if i % 3 else own, [1] * 300))
    held, real = [], toxicity.told_apart
    monkeypatch.setattr(toxicity, "told_apart", lambda *a: held.append(a[1]) or real(*a))
    tracemalloc.start()
    m = toxicity.fitted(rows, {0: 300, 1: 300})
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert m.order in held and len(m.keys) and peak < 135 * sum(len(w) + 1 for w in {w for r in rows for w in r[1]})


class _Captured:
    """Stands for the words' table and keeps the functions that are mapped over it."""

    def __init__(self):
        self.runs, self.sparkSession = [], self
        self.conf = {"spark.sql.shuffle.partitions": "50"}

    def mapInArrow(self, run, schema):
        self.runs.append(run)
        return self

    def select(self, *_):
        return self

    repartition = sortWithinPartitions = select


def test_suffix_counts_hold_little_memory_and_are_right():
    n, full = 400_000, np.full(1 << 10, 2**64 - 1, np.uint64)
    a = np.minimum(np.random.default_rng(5).zipf(1.3, n), 50_000).astype(np.int64)
    t = _Captured()
    suffix_lm.transitions(t, SimpleNamespace(value=([full], [], full, np.array([1, 2]))), 1, 1)
    batches = [pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in np.split(a, 400)], pa.binary())], ["ids"])]
    list(t.runs[0](batches))
    tracemalloc.start()
    try:
        packed = list(t.runs[0](batches))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 100 * n
    rows = sorted((k, v) for b in packed for k, v in zip(*(c.to_pylist() for c in b.columns), strict=True))
    added = list(t.runs[1]([pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["bucket", "counts"])]))
    got = Counter({(c, w): k for b in added for c, w, k in zip(*(b.column(x).to_pylist() for x in ("ctx", "w", "c")), strict=True) if w >= 0})
    assert got == Counter((c, w) for x in np.split(a, 400) for c, w in zip(x[:-1].tolist(), x[1:].tolist(), strict=True))


def test_workers_hold_short_runs_and_give_memory_back():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 100_000] * 50)], ["text"])
    runs = list(common.slices([batch]))
    assert sum(r.num_rows for r in runs) == 50 and max(r.num_rows for r in runs) <= 20
    assert list(common.tidy(common.slices)([batch])) == runs
    model = toxicity.fitted([(i % 2, [b"good" if i % 2 else b"bad", b"word"], [1, 2]) for i in range(40)], {0: 20, 1: 20})
    docs = _Captured()
    docs.sparkContext, docs.columns, docs.schema = docs, ["text"], None
    docs.broadcast, docs.toDF = lambda x: SimpleNamespace(value=x), lambda *_: docs
    toxicity.ordinary(docs, model)
    flat = pa.RecordBatch.from_arrays([pa.array(["good word", "bad word"])], ["c0"])
    assert sum(b.num_rows for b in docs.runs[0]([flat])) == 1 and not model.known


def test_values_asked_for_by_runs_equal_a_join(spark):
    """op9_suffix_lm: a run asks for each key once, whatever its sign and place, and gets one sum for each row; keys without a value add nothing."""
    rng = np.random.default_rng(3)
    keys = np.unique(np.append(rng.integers(-(2**63), 2**63 - 1, 3000), [-(2**63), -1, 0, 2**63 - 1]))
    own = dict(zip(keys[::2].tolist(), rng.normal(size=len(keys[::2])).tolist(), strict=True))
    blobs, want, asks = [], defaultdict(float), 0
    for run in range(6):
        key, row = rng.choice(keys, 4000), run * 100 + rng.integers(0, 60, 4000) + (rng.integers(0, 2, 4000) << 36)
        asks += len(key)
        for k, r in zip(key.tolist(), row.tolist(), strict=True):
            if k in own:
                want[r] += own[k] / math.log(10)
        blobs += suffix_lm.questions(key, row, 7)
    assert {k for k, _ in blobs} == set(range(7)) and sum(len(b) for _, b in blobs) < 12 * asks
    asked = spark.createDataFrame([(k, bytearray(b)) for k, b in blobs], "bucket int, asked binary")
    values = spark.createDataFrame(list(own.items()), "key long, v double").repartition(3)
    got = suffix_lm.answered(asked, values, 7)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    rows = got.collect()
    assert len(rows) == len(want) == len({r.row for r in rows}) and all(abs(want[r.row] - r.far_gain) < 1e-9 for r in rows)
    assert suffix_lm.answered(asked.limit(0), values, 7).count() == suffix_lm.answered(asked, values.limit(0), 7).count() == 0


def test_bitmap_has_the_bits_of_its_keys(spark):
    keys = [*np.random.default_rng(2).integers(-(2**63), 2**63 - 1, 5000).tolist(), 0, -1, 5, 5]
    bits = suffix_lm.bitmap(spark.createDataFrame([(k,) for k in keys], "g long").repartition(3), "g")
    assert set(np.flatnonzero(np.unpackbits(bits.view(np.uint8), bitorder="little")).tolist()) == {k & (64 * len(bits) - 1) for k in keys}
    assert suffix_lm.marked(bits, np.array(keys)).all() and not suffix_lm.bitmap(spark.createDataFrame([], "g long"), "g").any()


def test_counts_of_several_runs_of_words_are_added(spark):
    """op9_suffix_lm: what tasks have counted apart is decoded by itself; each context's size and suffix come with it."""
    texts = [f"a{i % 3} b{i % 2} c d{i % 5}" for i in range(60)]
    words = suffix_lm.in_words(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5).withColumn("learn", F.lit(True)))
    h = lambda w: suffix_lm.word_hash(w.encode())
    full = np.full(1 << 10, 2**64 - 1, np.uint64)
    shared = spark.sparkContext.broadcast(([full], [], full, np.array([h("c")])))
    got = suffix_lm.transitions(words, shared, 1, 1).collect()
    data = [[*t.split(), ""] for t in texts]
    size, both = Counter(w for d in data for w in d[:-1]), Counter(x for d in data for x in zip(d, d[1:], strict=False))
    assert {(r.ctx, r.w): (r.c, r.size, r.s) for r in got if r.w != -1} == {(h(a), h(b)): (c, size[a], 0) for (a, b), c in both.items()}
    assert sorted((r.ctx, r.size) for r in got if r.w == -1) == sorted((h(w), n) for w, n in size.items())
