"""What keeps queries from growing beyond their input: plans without joins to the pairs, values measured once, and the same results by brute force."""

import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from placeloom.config import CITIES
from placeloom.functions import text, vectors
from placeloom.operators import areas, candidates, clustering, features, valued
from placeloom.operators.components import placed
from placeloom.plans import registry

from .conftest import SF

#: Queries over all pairs of records that are near each other.
FLAT = ["char_containment", "jaro_winkler", "char_jaccard", "distance_similarity", "ordered_jaccard", "attribute_likeness", "pad_pair"]


@pytest.mark.parametrize("name", FLAT)
def test_pairs_are_not_joined_again(spark, name):
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"Join \[_?[ab]?_?_cx", plan) and not re.search(r"Join \[[^\]]*\b[lr]_id#", plan) and not re.search(r"hashpartitioning\([^)]*\b[lr]_id#", plan)


def _metres(p, q):
    (x, y), (u, v) = [tuple(map(math.radians, r)) for r in (p, q)]
    h = math.sin((v - y) / 2) ** 2 + math.cos(y) * math.cos(v) * math.sin((u - x) / 2) ** 2
    return 2 * 6371000.0 * math.asin(math.sqrt(min(1.0, h)))


@pytest.mark.parametrize(("south", "reach"), [(31.9, 400.0), (-70.0, 35.0), (0.0, 0.5)])
def test_meeting_equals_brute_force(spark, south, reach):
    r = random.Random(7)
    wide = reach / 30000
    spots = [(118 + r.random() * wide, south + r.random() * wide) for _ in range(160)]
    rows = [(str(i), i % 2, *p) for i, p in enumerate(spots)] + [("none", 0, None, south), ("odd", 1, float("nan"), south), ("same", 0, *spots[1])]
    d = spark.createDataFrame(rows, "id string, belong int, longitude double, latitude double")
    got = areas.meeting(d.where("belong = 1"), d.where("belong = 0"), reach).select("a_id", "b_id", "metres").collect()
    good = [x for x in rows if x[2] is not None and not math.isnan(x[2])]
    want = {(a[0], b[0]) for a in good if a[1] for b in good if not b[1] and _metres(a[2:], b[2:]) < reach}
    assert len(got) == len(want) > 100 and {(x.a_id, x.b_id) for x in got} == want
    assert all(x.metres < reach for x in got)


def test_alike_rows_meet_side_by_side(spark):
    """pairs of a record of b lie together, sorted by the value of a, so that columns of many pairs repeat and are small as files."""
    r = random.Random(3)
    d = spark.createDataFrame([(i, i % 2, f"w{i * 7 % 10}", 118.8 + r.random() / 200, 31.9 + r.random() / 200) for i in range(400)], "id int, belong int, word string, longitude double, latitude double")
    a, b = d.where("belong = 1"), d.where("belong = 0")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = [(x.b_id, x.a_word, x.a_id) for x in areas.meeting(a, b, 150.0, alike=(["word"], ["word"])).collect()]
        want = {(x.b_id, x.a_word, x.a_id) for x in areas.meeting(a, b, 150.0).collect()}
        plan = registry.queries()["pad_pair"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(got) == len(want) > 2000 and set(got) == want
    turns = [i for i, x in enumerate(got) if not i or got[i - 1][0] != x[0]]
    assert len(turns) == len({x[0] for x in got})
    assert all(x[0] != y[0] or x[1] <= y[1] for x, y in zip(got, got[1:]))
    assert re.search(r"Sort \[_cx#[^\]]*_cy#[^\]]*\bb_words#", plan) and re.search(r"Sort \[_cx#[^\]]*_cy#[^\]]*\ba_words#", plan)


@pytest.mark.parametrize("most", [0, 1000])
def test_measures_by_value_equal_those_by_pair(spark, most):
    side = lambda n, m: spark.createDataFrame([(i, None if i % m == 5 else f"name {i % m}", "x" * (i % 3)) for i in range(n)], "id int, name string, kind string")
    left, right = side(300, 7), side(200, 11)
    measures = {"sim": ("name", "name", lambda a, b: F.coalesce(text.edit_likeness(a, b), F.lit(-1.0)), lambda x: x >= 0.9), "same": ("kind", "kind", lambda a, b: a == b, None)}
    v = valued.Valued(left, right, measures, most)
    assert len(v.tables) == (2 if most else 0)
    prefixed = lambda d, p: d.toDF(*[f"{p}_{c}" for c in d.columns])
    got = v.onto(prefixed(v.left, "l").crossJoin(prefixed(v.right, "r")), "l", "r").select("l_id", "r_id", "sim", "same")
    both = prefixed(left, "l").crossJoin(prefixed(right, "r"))
    want = both.select("l_id", "r_id", F.coalesce(text.edit_likeness(F.col("l_name"), F.col("r_name")), F.lit(-1.0)).alias("sim"), (F.col("l_kind") == F.col("r_kind")).alias("same")).where("sim >= 0.9")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("most", [0, 100])
def test_candidates_of_hand_made_blocks(spark, monkeypatch, most):
    """Own leaves, leaves reached by an area of the other (whose record need not lie in the box), areas that meet; pairs are not shuffled."""
    monkeypatch.setattr(valued.Valued.__init__, "__defaults__", (most,))
    x, y = 118.8, 31.94
    points = [("l", 0), ("far", 0), ("drawn", 0), ("alone", 0), ("r", 1), ("q", 1), ("root", 1)] + [(f"o{i}", 1) for i in range(40)]
    pois = spark.createDataFrame([(i, b, "other" if i[0] == "o" else "cafe", x + (1 if i == "far" else 0), y) for i, b in points], "id string, belong int, name string, longitude double, latitude double")
    leaf = spark.createDataFrame([(0, "l", "1", 1), (1, "q", "1", 1), (0, "far", "1", 1), (0, "alone", "2", 1), (1, "root", "", 0)], "belong int, poi_id string, leaf string, level int")
    members = spark.createDataFrame([("A", 1, "q"), ("A", 1, "r"), ("A", 0, "drawn"), ("B", 1, "root")], "aoi_id string, belong int, poi_id string")
    got = candidates.candidates(pois, leaf, members, CITIES["nj"])
    assert {(r.l_id, r.r_id) for r in got.collect() if r.r_id[0] != "o" or r.r_id == "q"} == {("l", "q"), ("l", "r"), ("drawn", "q"), ("drawn", "r")}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"(Join \[|hashpartitioning\()[^\])]*\b([lr]_id|[ab]_id)#", plan)


def _pairs(spark, n=400):
    rows = [(i, str(i), str(i), f"cafe {i % 3}", f"house {i % 4}" if i % 5 else None, "food", "food/drink", None if i % 7 == 0 else f"road {i % 2}", "way 1", 118.8, 31.9, 118.8, 31.9) for i in range(n)]
    return spark.createDataFrame(rows, "pair_id long, l_id string, r_id string, l_name string, r_name string, l_category string, r_category string, l_address string, r_address string, l_longitude double, l_latitude double, r_longitude double, r_latitude double")


def test_equal_values_are_measured_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def measure(a, b):
        seen.add(1)
        return float(len(a or "") - len(b or ""))

    got = features.by_values(_pairs(spark), "l_name", "r_name", measure, "m").collect()
    assert len(got) == 400 and seen.value == 15 and all(r.m == len(r.l_name) - len(r.r_name or "") for r in got)


def test_equal_texts_are_encoded_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def encoder(texts):
        seen.add(len(texts))
        return features.hashed_encoder(texts)

    got = {r.pair_id: r for r in features.encoded_properties(_pairs(spark), encoder).collect()}
    assert len(got) == 400 and seen.value == 8 + 2 + 4
    for i, a, b in ((1, "cafe 1", "house 1"), (5, "cafe 2", ""), (7, "cafe 1", "house 3")):
        x, y = features.hashed_encoder([a, b])
        assert abs(got[i].name_sim - sum(p * q for p, q in zip(x, y, strict=True))) < 1e-12


def test_features_by_numbers_of_values(spark):
    """resolution_pipeline: pairs are not shuffled for the features of few distinct values; nulls count as values."""
    p = spark.createDataFrame([(b, str(i), None if i % 7 == 0 else f"cafe {i % 7}", f"food {i % 2}", None if i % 4 == 0 else f"road {i % 3}", 118.8 + i / 1000, 31.9) for b in (0, 1) for i in range(60)], "belong int, id string, name string, category string, address string, longitude double, latitude double")
    pairs = spark.createDataFrame([(i, str(i % 60), str(i * 7 % 59)) for i in range(900)], "pair_id long, l_id string, r_id string")
    for has_category in (True, False):
        got, want = features.raw_by_value(pairs, p, has_category), features.raw_features(features.joined(pairs, p), has_category)
        assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.select(got.columns).collect())) and got.count() == 900
    plan = features.raw_by_value(pairs, p)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_places_need_one_shuffle(spark):
    """rows are counted as they are written, so what is read again is not shuffled."""
    d = spark.range(1000).select((F.col("id") * 7 % 1000).alias("a"), F.when(F.col("id") % 3 > 0, F.col("id") % 4).alias("n"))
    got = placed(d, [F.col("a")], "p")
    assert all(x.p == x.a for x in got.collect()) and got.columns == ["a", "n", "p"]
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    before, sizes = 0, placed(d.where("n is not null"), [F.col("a")], "p", F.col("n")).orderBy("a").collect()
    for x in sizes:
        assert x.p == before
        before += x.n
    assert placed(d.where("a < 0"), [F.col("a")], "p").count() == 0


@pytest.mark.parametrize("few", [1000, 3])
def test_equal_pairs_of_texts_are_encoded_once(spark, few):
    """pair_embeddings: records with equal texts share one vector, which is also finished once; a null is as the text nan."""
    seen = spark.sparkContext.accumulator(0)

    def encoder(texts):
        seen.add(len(texts))
        return features.hashed_encoder(texts)

    name = lambda b, i: None if i % 7 == 0 else "nan" if i % 7 == 1 else f"cafe {b} (x) {i % 7}"
    p = spark.createDataFrame([(b, str(i), name(b, i), "food", None if i % 2 else f"road {b}", 118.8, 31.9) for b in (0, 1) for i in range(60)], "belong int, id string, name string, category string, address string, longitude double, latitude double")
    pairs = spark.createDataFrame([(i, str(i % 60), str(i * 7 % 59)) for i in range(900)], "pair_id long, l_id string, r_id string")
    got = features.semantic_by_value(pairs, p, encoder, vectors.written, few=few)
    assert got._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 0
    want = features.semantic(features.joined(pairs, p)).select("pair_id", vectors.written(F.col("vec")).alias("vec"))
    assert seen.value <= 12 * 12 and sorted(got.collect()) == sorted(want.collect()) and got.count() == 900


def test_prompts_are_made_in_one_pass(spark):
    plan = registry.queries()["render_prompt"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [batch_id") == 1


def _vectors(n, seed=3):
    import numpy as np

    x = np.random.default_rng(seed).normal(size=(n, 5)).round(1)
    x[::4] = x[0]  # copies
    return x


def test_nearest_rows_in_small_matrices(monkeypatch):
    """Many copies tie, by `near`; no matrix is larger than asked for."""
    import numpy as np
    import pandas as pd

    x, q = _vectors(300), _vectors(90, 4)
    q[:9] = x[0]
    near, sizes, real = np.random.default_rng(1).permutation(300), [], np.partition
    monkeypatch.setattr(np, "partition", lambda a, *k, **o: sizes.append(a.size) or real(a, *k, **o))
    best = None
    for k in range(0, 300, 50):
        rows = pd.DataFrame({"near": near[k : k + 50], "label": near[k : k + 50] % 7, "v": list(x[k : k + 50])})
        best = clustering.nearest_rows(rows, q, 5, best, width=20)
    assert max(sizes) <= 50 * 20
    got = {i: sorted(n for a, n in zip(best[0].tolist(), best[1].tolist(), strict=True) if a == i) for i in range(90)}
    d = ((x[:, None, :] - q[None, :, :]) ** 2).sum(2).round(12)
    assert got == {i: sorted(sorted(zip(d[:, i].tolist(), near.tolist(), strict=True))[k][1] for k in range(5)) for i in range(90)}


def test_cosines_in_blocks_equal_those_of_pairs(spark):
    rows = [(i % 3 if i % 50 else None, i, None if i == 7 else [0.0] * 5 if i == 8 else [float(t) for t in v]) for i, v in enumerate(_vectors(200))]
    e = spark.createDataFrame(rows, "by int, i long, v array<float>")
    got = vectors.pair_cosines(e, size=20)
    assert "mapInPandas" in (plan := got._jdf.queryExecution().optimizedPlan().toString()) or "FlatMapGroupsInPandas" in plan
    b = e.where("v is not null").withColumnsRenamed({"i": "j", "v": "w"})
    want = e.where("v is not null").join(b, "by").where("i < j").select("i", "j", vectors.cosine(F.col("v"), F.col("w")).alias("cosine"))
    x, y = ({(r.i, r.j): r.cosine for r in d.collect()} for d in (got, want))
    bare = {k for k, c in x.items() if c is None}
    assert len(bare) == len([r for r in rows if r[0] == 1 and r[1] != 7]) and all(7 in k for k in bare)
    x = {k: c for k, c in x.items() if c is not None}
    assert x.keys() == y.keys() and len(x) > 6000 and max(abs(x[k] - y[k]) for k in x) < 1e-12


@pytest.mark.parametrize("percent", [0, 5, 50, 100])
def test_percentile_by_counting(spark, percent):
    import numpy as np

    x = _vectors(150)
    e = spark.createDataFrame([(i, [float(t) for t in v]) for i, v in enumerate(x)] + [(900, None)], "id long, v array<double>")
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(2))[np.triu_indices(len(x), 1)]
    df = clustering.distance_percentile(e, "v", percent, size=40)
    assert abs(df.first().eps - np.percentile(d, percent)) < 1e-7
    assert clustering.distance_percentile(e.where("id = 900"), "v", percent).first().eps is None


def test_agglomerative_takes_any_number_of_pairs(spark):
    """as many pairs as there are; rounds on all cores give the clusters of the chains; few distinct vectors still give all clusters."""
    import numpy as np

    x = np.random.default_rng(5).normal(size=(330, 5))
    x[300:] = x[0]  # copies
    e = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "pair_id long, a double, b double, c double, d double, e double")
    want = clustering.ward_labels(x, 90)
    got = {r.pair_id: r.label for r in clustering.clustered(e, list("abcde"), "agglomerative", most=50, direct=50).collect()}
    assert [got[i] for i in range(330)] == want.tolist()
    rows = e.select("pair_id", F.array(*"abcde").alias("v"))
    got = {r.pair_id: r.label for r in clustering.ward_large(rows, 90, rest=20, small=0).collect()}
    assert [got[i] for i in range(330)] == want.tolist()
    odd = rows.where("pair_id >= 298").unionByName(spark.createDataFrame([(900, [float("nan")] * 5)], "pair_id long, v array<double>"))
    few = {r.pair_id: r.label for r in clustering.ward_large(odd, 5).collect()}
    assert len(few) == 33 and few.pop(900) == -1 and sorted(set(few.values())) == [0, 1, 2, 3, 4] and few[328] != few[329] != few[300] == few[327]


def test_vectors_are_written_in_the_encoders_pass(spark):
    """pair_embeddings: numbers are rounded and written once each, in batches, as the expression over their elements gave them."""
    d = spark.createDataFrame([(i, " ".join(f"w{i * k % 17}" for k in range(i % 9))) for i in range(300)], "id int, s string")
    e = features.encoded(d, "s", "vec")
    by_element = F.array_join(F.transform("vec", lambda x: F.round(x, 6).cast("string")), ",")
    got = e.select("id", vectors.written(F.col("vec")).alias("t"))
    assert got._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert sorted(got.collect()) == sorted(e.select("id", by_element.alias("t")).collect())
    odd = spark.createDataFrame([(0, [0.0000005, -0.0000004, 1.0, float("nan"), float("inf")]), (1, None), (2, [])], "id int, v array<double>")
    assert dict(odd.select("id", vectors.written(F.col("v"))).collect()) == {0: "1e-06,0.0,1.0,NaN,Infinity", 1: None, 2: ""}
    one = [0.0] * 64
    for w in "b a b".split():
        h = zlib.crc32(w.encode())
        one[h % 64] += 1.0 if h >> 31 else -1.0
    size = sum(x * x for x in one) ** 0.5
    assert [list(x) for x in features.hashed_encoder(["b a b", ""])] == [[x / size for x in one], [0.0] * 64]
