"""op4, op5, op10 and the pipeline against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from placeloom.llm import decontaminate, near_dedup, packing

from .conftest import ODD, SCHEMA, prose, rows


def reference_tokenizer():
    import public_tokenizers as files
    from tokenizers import Tokenizer

    return Tokenizer.from_file(files.path("byte_bpe_50k.json"))


ENCODER = packing.Encoder(*packing.tokenizer_files())
OWN = reference_tokenizer()


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(max_codepoint=0x2FF, exclude_categories=["Cs"])) | st.text())
def test_encoder_equals_tokenizer(text):
    assert ENCODER(text).tolist() == OWN.encode(text, add_special_tokens=False).ids


def test_encoder_on_every_low_character():
    for c in range(0x250):
        for text in (f"{chr(c)}<|endoftext|>{chr(c)}", chr(c), f"a{chr(c)}b", f" {chr(c)} {chr(c)}{chr(c)}1", f"x{chr(c)}\n{chr(c)}"):
            assert ENCODER(text).tolist() == OWN.encode(text, add_special_tokens=False).ids, hex(c)


def test_special_strings_are_tokens():
    assert ENCODER("hello <|endoftext|> there").tolist() == [31373, 220, 50256, 612]


def test_packing(spark, clashing, nothing):
    got = packing.pack(clashing, keep_ids=True).collect()
    want = defaultdict(list)
    for r in rows() + ODD:
        want[r[0]].append([*OWN.encode(r[1] or "", add_special_tokens=False).ids, 1])
    stream = defaultdict(list)
    by = defaultdict(list)
    for r in got:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        stream[r.sequence_id].append((r.offset, r.length))
        by[r.doc_id, r.start].append(r)
    for s, pieces in stream.items():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048 and (at == 2048 or s == max(stream))
    for doc, lists in want.items():
        pieces = sorted((r.start, r.ids) for r in got if r.doc_id == doc)
        assert sorted(x for _, ids in pieces for x in ids) == sorted(x for ids in lists for x in ids)
        if len(lists) == 1:
            assert [x for _, ids in pieces for x in ids] == lists[0]
    assert packing.pack(nothing).count() == 0
    whole = packing.sequences(packing.pack(clashing, keep_ids=True)).collect()
    assert sum(len(r.ids) for r in whole) == sum(r.length for r in got)


def benchmark(spark, items):
    return spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")


def test_decontamination(spark, docs, clashing, nothing):
    rng = random.Random(2)
    item = prose(rng, 40)
    w = item.split()
    swapped = [x if i % 7 else "swapped" for i, x in enumerate(w)]
    short_item = "five words make an item"
    cases = [
        (1, prose(rng, 50) + " " + item + " " + prose(rng, 30)), (2, " ".join(swapped)), (3, " ".join(w[:30])), (4, " ".join(w[:12]) + " " + prose(rng, 60)), (5, prose(rng, 100)),
        (6, item.upper().replace(" ", ", ")), (7, "here five words make an item there"), (8, None), (9, " ".join(w[:20] + ["extra"] + w[20:])), (10, "five words make no item"),
    ]
    d = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in cases], SCHEMA)
    b = benchmark(spark, [item, short_item, None, "", "two words"])
    hits = {(r.doc_id, r.item_id) for r in decontaminate.overlaps(d, b).collect()}
    assert hits == {(1, 0), (2, 0), (3, 0), (6, 0), (7, 1), (9, 0), (10, 1)}  # four of five words are enough
    assert {r.doc_id for r in decontaminate.clean(d, b).collect()} == {4, 5, 8}
    assert decontaminate.overlaps(docs, b).count() == 0 and decontaminate.overlaps(nothing, b).count() == 0
    assert decontaminate.overlaps(d, benchmark(spark, []) if False else b.where("item_id < 0")).count() == 0
    assert decontaminate.clean(docs, b).count() == docs.count()
    assert decontaminate.overlaps(clashing, b).count() == 0 and decontaminate.clean(clashing, b).columns == clashing.columns
    twice = b.unionByName(b.where("item_id = 0").selectExpr("cast(null as long) as item_id", "text"))
    assert {(r.doc_id, r.item_id) for r in decontaminate.overlaps(d, twice).collect()} == hits | {(i, None) for i, x in hits if x == 0}


def test_decontamination_equals_an_aligner(spark, monkeypatch):
    """Passages of 1 to 60 words planted with as many replaced words as leave 80 %: all that an aligner at every shift finds."""
    rng = random.Random(21)
    make = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    items = {n: make(n) for n in range(1, 61)}
    data, planted = [], {}
    for n, item in items.items():
        for _ in range(8):
            own = list(item)
            for k in rng.sample(range(n), n - math.ceil(0.8 * n)):
                own[k] = "other"
            planted[len(data)] = n
            data.append(make(rng.randrange(0, 40)) + own + make(rng.randrange(0, 40)))
    d = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(data)], "doc_id long, text string")
    b = spark.createDataFrame([(n, " ".join(t)) for n, t in items.items()], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.overlaps(d, b).collect()}
    number = {}
    of = lambda t: np.array([number.setdefault(w, len(number) + 1) for w in t], np.uint64)
    want = {(i, n) for i, t in enumerate(data) for n, item in items.items() if set(t) & set(item) and decontaminate.overlap(of(t), of(item), list(range(-n, len(t))), 0.8, 0.5, 12)}
    assert got <= want and {(i, n) for i, n in planted.items()} <= want
    for n in items:  # at every length
        mine = [i for i, k in planted.items() if k == n]
        assert sum((i, n) in got for i in mine) >= 0.9 * len(mine), n
    assert len(got) >= 0.98 * len(want)
    monkeypatch.setattr(decontaminate, "MOST", 0)  # with the bits alone
    assert {(r.doc_id, r.item_id) for r in decontaminate.overlaps(d, b).collect()} == got


def test_masks_of_short_passages_miss_no_replacement():
    for n in range(1, decontaminate.SHORT + 1):
        s = n - math.ceil(0.8 * n)
        for out in combinations(range(n), s):
            assert any(all(m[i] == "0" for i in out) for m in decontaminate.whole_masks(n)), (n, out)


def brute(data, percent=85):
    sets = {}
    for d, t in data:
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    up = {d: d for d in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {d: (len(sets[d]), top(d)) for d in sets}


@pytest.mark.parametrize("seed", [1, 2])
def test_near_dedup(spark, seed):
    rng = random.Random(seed)
    data, i = [], 0
    for _ in range(12):  # chains of copies of copies, so that components are longer than links
        t = prose(rng, rng.choice([8, 40, 150])).split()
        for _ in range(rng.randrange(1, 9)):
            data.append((i, " ".join(t)))
            i += 1
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                t[rng.randrange(len(t))] = f"edit{rng.randrange(10**6)}"
    shared = prose(rng, 60)
    data += [(i + k, f"{shared} {prose(rng, 25)}") for k in range(20)]  # much in common, never enough
    rng.shuffle(data)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.grouped(spark.createDataFrame([(*r, "en", "s", 0) for r in data], SCHEMA)).collect()}
    assert got == brute(data)


def by_row(data, percent):
    """For each row (id, text): the rows of its component, by brute force over rows."""
    sets = []
    for _, t in data:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(data)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(data)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                up[max(top(a), top(b))] = min(top(a), top(b))
    return [[k for k in range(len(data)) if top(k) == top(i)] for i in range(len(data))]


def test_repeated_ids_with_different_texts(spark):
    rng = random.Random(6)
    near = lambda t: " ".join([*t.split()[:-1], f"end{rng.randrange(10**6)}"])
    texts = [prose(rng, 80) for _ in range(12)]
    data = [(i // 2, t) for i, t in enumerate(texts)] + [(100 + i, near(t)) for i, t in enumerate(texts)] + [(3, texts[6]), (4, near(texts[8])), (9, ""), (9, None), (9, " ")]
    got = Counter((r.doc_id, r.component_id, r.kept) for r in near_dedup.grouped(spark.createDataFrame([(*r, "en", "s", 0) for r in data], SCHEMA).repartition(3)).collect())
    least = [min(data[k][0] for k in g) for g in by_row(data, 85)]
    assert got == Counter((d, c, d == c) for (d, _), c in zip(data, least, strict=True))
    stays = Counter((r.doc_id, r.text or "") for r in near_dedup.survivors(spark.createDataFrame([(*r, "en", "s", 0) for r in data], SCHEMA).repartition(3)).collect())
    want = set()
    for i, g in enumerate(by_row(data, 80)):
        first = min(data[k][0] for k in g)
        want.add((first, min((data[k][1] or "" for k in g if data[k][0] == first), key=lambda t: hashlib.md5(t.encode()).digest())))
    assert stays == Counter(want)


def test_a_bucket_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    rng = random.Random(12)
    w = prose(rng, 60).split()
    data = [(i, " ".join([*w[:45], *(f"v{i // 2}x{k}" for k in range(14)), f"tail{i}"])) for i in range(40)]  # pairs, all alike but not enough
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.grouped(spark.createDataFrame([(*r, "en", "s", 0) for r in data], SCHEMA)).collect()}
    assert got == brute(data)


def test_near_dedup_odd(spark, clashing, nothing):
    got = near_dedup.grouped(clashing).collect()
    want = brute([(r[0], r[1]) for r in rows() + ODD if r[0] is not None])  # here rows that repeat an id are equal
    assert len(got) == len(rows() + ODD)
    for r in got:
        if r.doc_id is None:
            assert r.kept and r.component_id is None
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.component_id == r.doc_id)
    assert near_dedup.grouped(nothing).count() == 0


def write(df, path, name):
    df.write.parquet(f"{path}/{name}.parquet")


def test_pipeline_stages(spark, tmp_path, clashing):
    rng = random.Random(8)
    item = prose(rng, 30)
    data = [(i, prose(rng, 50), "en", f"s{i % 4}", 5) for i in range(60)]
    data += [(100, item + " tail", "en", "s0", 5), (101, data[0][1], "en", "s1", 5), (102, data[1][1] + ' token = "0123456789abcdef0123456789abcdef"', "en", "s1", 5)]
    data += [(200 + i, prose(rng, 30) + " vile nasty rotten " * 3, "en", "s2", 5) for i in range(40)]
    data += [(None, None, None, None, None), (300, None, "en", "s", 0), (300, None, "en", "s", 0)]
    docs = spark.createDataFrame([(*r, "x", 1, 2, "k", 3) for r in data], f"{SCHEMA}, TEXT string, row long, h long, key string, `a.b` int")
    write(spark.createDataFrame([(r[0], 1, int(r[0] >= 200)) for r in data if r[0] is not None and r[0] < 300], "doc_id long, quality int, toxic int"), tmp_path, "labels")
    write(spark.createDataFrame([(0, item)], "item_id long, text string"), tmp_path, "benchmark")
    seen = [docs.collect()]
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns, name
            assert out.dtypes == docs.dtypes, name
            now = spark.createDataFrame(out.collect(), docs.schema)
            seen.append(now.collect())
        else:
            pieces = out.collect()
    ids = [[r[0] for r in s] for s in seen]
    assert len(set(ids[0]) - set(ids[1])) >= 36 and set(ids[1]) >= {r[0] for r in data if r[0] is not None and r[0] < 200}
    assert 101 not in ids[2] and 0 in ids[2] and ids[2].count(300) == 1 and ids[2].count(None) == 1
    assert set(ids[2]) - set(ids[3]) == {100}
    text = {r[0]: r[1] for r in seen[4]}
    assert len(ids[4]) == len(ids[3]) and text.get(102, "[secret]").count("0123456789abcdef") == 0
    assert sum(p.length for p in pieces) == sum(len(OWN.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in seen[4])


def test_pipeline_links_from_80_percent(spark):
    w = prose(random.Random(11), 104).split()
    text = lambda k: " ".join([*w[:-k], *(f"new{k}x{i}" for i in range(k))])
    data = [(0, " ".join(w)), (1, text(10)), (2, text(12))]  # 90 of 110 shingles and 88 of 112 in common with the first
    assert {d: c for d, (_, c) in brute(data, 80).items()} == {0: 0, 1: 0, 2: 2} and len({c for _, c in brute(data).values()}) == 3
    left = corpus_pipeline.near_dedup_stage(spark, spark.createDataFrame([(*r, "en", "s", 0) for r in data], SCHEMA), "")
    assert sorted(r.doc_id for r in left.collect()) == [0, 2]
