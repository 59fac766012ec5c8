"""Golden values, invariants and brute force for the resolution operators."""

import itertools
import json
import math
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from placeloom.config import CITIES, Options
from placeloom.functions import likeness, text
from placeloom.functions.spatial import haversine, projected_box, rounded_distance, web_mercator_x, web_mercator_y
from placeloom.operators import areas, balancing, batching, candidates, classifying, clustering, features, prompting, quadtree, refining, resolving, responding
from placeloom.plans import inputs, resolution
from placeloom.sources import pois as poi_source
from placeloom.sources import settings as client_settings

from .conftest import SF


def value(spark, column, **cols):
    names = list(cols) or ["_"]
    return spark.createDataFrame([tuple(cols.values()) or (1,)], ", ".join(f"{n} {'string' if isinstance(cols.get(n, 1), (str, type(None))) else 'double' if isinstance(cols[n], float) else 'int'}" for n in names)).select(column.alias("v")).first().v


def test_spatial_goldens(spark):
    lon, lat = F.col("lon"), F.col("lat")
    assert value(spark, web_mercator_x(lon), lon=118.8) == pytest.approx(13224755.5062, abs=1e-3)
    assert value(spark, web_mercator_y(lat), lat=31.94) == pytest.approx(-3755437.27, abs=1e-2)
    one = {"a": 118.80, "b": 31.94, "c": 118.803, "d": 31.942}
    assert value(spark, haversine(*[F.col(x) for x in "abcd"]), **one) == pytest.approx(359.9865, abs=1e-3)
    assert value(spark, rounded_distance(F.col("b"), F.col("a"), F.col("d"), F.col("c")), **one) == 360
    assert value(spark, rounded_distance(F.lit("abc"), F.col("a"), F.col("d"), F.col("c")), **one) == -1


@pytest.mark.parametrize("s,want", [("Cafe (North (Gate)) One", "Cafe  One"), ("店（万达）", "店"), ("a(b）c", "ac"), ("(all)", ""), ("x(y", "x(y"), ("", "")])
def test_brackets(spark, s, want):
    assert value(spark, text.without_brackets(F.col("s")), s=s) == want


@pytest.mark.parametrize("f,s,want", [
    (text.plain_code, "A07", "a7"), (text.plain_code, "B00123C0", "b123c0"), (text.plain_code, "XY0099Z", "xy99z"),
    (text.plain_category, "美食/其他美食", "美食 美食"), (text.plain_category, "亲子 更多亲子服务", "亲子 亲子服务"), (text.plain_category, "酒店 豪华型", "酒店 豪华"), (text.plain_category, "干锅/香锅", "干锅 香锅"),
    (text.plain_address, "南京市江宁区双龙大道旁边", "双龙大道边"), (text.plain_address, "经济技术开发区胜太路", "经济技术胜太路"), (text.plain_address, "斜对面3号", "斜3号"), (text.plain_address, "文靖路向北80米", "文靖路"),
])
def test_normal_forms(spark, f, s, want):
    assert value(spark, f(F.col("s")), s=s) == want


@pytest.mark.parametrize("f,a,b,want", [
    (lambda a, b: text.set_likeness(text.characters(a), text.characters(b)), "abc", "abd", 0.5), (lambda a, b: text.set_likeness(text.characters(a), text.characters(b)), "red bolt", "red ring", 0.363636),
    (text.edit_likeness, "Kitten", "sitting", 0.571429), (text.edit_likeness, "", "x", 0), (text.edit_likeness, "", "", 1), (text.edit_likeness, "Blue Moon", "BLUE MOON", 1),
    (text.ordered_likeness, "food burger", "burger food", 0.81), (text.ordered_likeness, "food", "food burger", 0.5), (text.ordered_likeness, "food burger", "food", 0.45), (text.ordered_likeness, "", "", 1),
    (likeness.address_likeness, None, None, 1), (likeness.name_likeness, "", "", 1), (likeness.name_likeness, "a", "", 0), (likeness.name_likeness, "abc (x)", "cab", 1),
])
def test_likenesses(spark, f, a, b, want):
    assert value(spark, f(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(want, abs=1e-6)


def table_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row, before = [0] * (len(b) + 1), row
        for j, y in enumerate(b):
            row[j + 1] = before[j] + 1 if x == y else max(before[j + 1], row[j])
    return row[-1]


@given(st.text("abc中", max_size=12), st.text("abc中", max_size=12))
def test_subsequence(a, b):
    assert likeness.subsequence(a, b) == table_lcs(a, b)
    assert 0 <= likeness.jaro_winkler(a, b) <= 1 and likeness.two_way(a, b) == pytest.approx(likeness.two_way(b, a))


def test_edit_ratio():
    assert likeness.subsequence("kitten", "sitting") == 4 and likeness.subsequence("abcbdab", "bdcaba") == 4
    assert likeness.edit_ratio("kitten", "sitting") == pytest.approx(0.615385, abs=1e-6)


def test_framing_of_pairs(spark):
    a, b = ["l"] * 5, ["r"] * 200
    df = spark.createDataFrame([(a, b), (b, a), (b, b), (a, a)], "a array<string>, b array<string>")
    f = text.framed_pair(F.col("a"), F.col("b"), 20, 4)
    for r in df.select("a", "b", *[c.alias(k) for k, c in f.items()]).collect():
        more = len(r.a) + len(r.b) + 3 - 20
        x, y = r.a, r.b
        if more > 0:
            if more < len(y):
                y = y[: len(y) - more]
            elif more < len(x):
                x = x[: len(x) - more]
            else:
                x, y = x[:4], y[:4]
        full = ["[CLS]", *x, "[SEP]", *y, "[SEP]"]
        assert r.tokens == (full + ["[PAD]"] * 20)[:20] and r.mask == [int(i < len(full)) for i in range(20)] and r.segments == [int(len(x) + 2 <= i < len(full)) for i in range(20)]


def test_robust_scale(spark):
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate([1, 2, 3, 4, 100])], "i int, x double")
    assert [r.x for r in features.robust_scaled(df, ["x"]).orderBy("i").collect()] == [-1, -0.5, 0, 0.5, 48.5]
    flat = spark.createDataFrame([(1, 5.0), (2, 5.0)], "i int, x double")
    assert {r.x for r in features.robust_scaled(flat, ["x"]).collect()} == {0.0}
    assert features.robust_scaled(flat.where("i > 2"), ["x"]).count() == 0


def test_quartiles_are_exact(spark):
    rng = random.Random(3)
    data = [(rng.gauss(0, 5), rng.choice([None, -1.0, 0.0, 0.0, 2.0]), 7.0 if i % 3 else None) for i in range(501)]
    got = features.quartiles(spark.createDataFrame(data, "a double, hot double, one double"), ["a", "hot", "one"])
    for i, q in enumerate(got):
        want = np.quantile([r[i] for r in data if r[i] is not None], [0.25, 0.5, 0.75])
        assert max(abs(x - y) for x, y in zip(q, want, strict=True)) < 1e-12


def claims_by_loop(pois, aois, eps, least):
    def dist(a, b):
        x, y = math.radians(a[2]), math.radians(b[2])
        h = math.sin((y - x) / 2) ** 2 + math.cos(x) * math.cos(y) * math.sin((math.radians(b[1]) - math.radians(a[1])) / 2) ** 2
        return 2 * math.asin(math.sqrt(h)) * 6371000

    taken = {}
    for a in aois:
        seeds = sorted((p for p in pois if dist(a, p) < eps), key=lambda p: p[0])
        queue, wide = list(seeds), len(seeds) >= least
        while queue:
            p = queue.pop(0)
            if p[0] in taken:
                continue
            taken[p[0]] = a[0]
            near = sorted((q for q in pois if q[0] != p[0] and dist(p, q) < eps), key=lambda q: q[0])
            if wide and len(near) >= least:
                queue += near
    return taken


def test_points_with_few_neighbours_tie_no_claims(spark, monkeypatch):
    p = [(f"{i:03d}", 118.80 + i * 0.0002, 31.93) for i in range(40)]  # one row of points, each with two neighbours
    pois = spark.createDataFrame([(i, 0, x, y) for i, x, y in p], "id string, belong int, longitude double, latitude double")
    a = [("a0", 118.80, 31.93), ("a1", 118.8062, 31.93)]
    aois = spark.createDataFrame([(i, x, y, k) for k, (i, x, y) in enumerate(a)], "id string, longitude double, latitude double, aoi_ord long")
    tied, real = [], areas.components
    monkeypatch.setattr(areas, "components", lambda nodes, edges: tied.append(edges.count()) or real(nodes, edges))
    got = {r.poi_id: r.aoi_id for r in areas.claims(pois, aois, 25.0, 3).collect()}
    assert got == claims_by_loop(p, a, 25.0, 3)
    assert tied == [5]  # the areas' own points only: two and three


@pytest.mark.parametrize("seed", range(3))
def test_claims_equal_the_loop(spark, seed):
    rng = random.Random(seed)
    p = [(f"{i:03d}", 118.80 + rng.random() / 400, 31.93 + rng.random() / 400) for i in range(120)]
    a = [(f"a{i}", 118.80 + rng.random() / 400, 31.93 + rng.random() / 400) for i in range(9)]
    pois = spark.createDataFrame([(i, 0, x, y) for i, x, y in p], "id string, belong int, longitude double, latitude double")
    aois = spark.createDataFrame([(i, x, y, k) for k, (i, x, y) in enumerate(a)], "id string, longitude double, latitude double, aoi_ord long")
    got = {r.poi_id: r.aoi_id for r in areas.claims(pois, aois, 25.0, 5).collect()}
    assert got == claims_by_loop(p, a, 25.0, 5)


def tree_by_recursion(points, member, box, smallest=15.0, most=2):
    areas_of = {}
    for a, p in member:
        areas_of.setdefault(p, set()).add(a)
    out = {}

    def walk(own, x, y, w, h, path):
        n = len({a for a, _ in member}) if not path else len({a for p in own for a in areas_of.get(p[0], ())})
        if math.hypot(w, h) <= smallest or n <= most:
            names = {p[0] for p in own}
            if path:
                names |= {q for a, q in member if any(a in areas_of.get(p[0], ()) for p in own)}
            if own:
                out[path] = ({p[0] for p in own}, names)
            return
        v, k, kids = x + w / 2, y + h / 2, {0: [], 1: [], 2: [], 3: []}
        for p in own:
            kids[1 if p[1] <= v and p[2] < k else 2 if p[1] < v and p[2] >= k else 3 if p[1] >= v and p[2] > k else 0].append(p)
        for d, inside in kids.items():
            walk(inside, v if d in (0, 3) else x, k if d in (2, 3) else y, w / 2, h / 2, path + str(d))

    x, y, w, h = box
    walk([p for p in points if x <= p[1] <= x + w and y <= p[2] <= y + h], *box, "")
    return out


@pytest.mark.parametrize("seed", range(3))
def test_quadtree_equals_recursion(spark, seed):
    rng = random.Random(seed)
    box = (0.0, 0.0, 512.0, 256.0)
    pts = [(str(i), float(rng.randrange(-10, 520)), float(rng.randrange(-10, 264))) for i in range(150)] + [("c", 256.0, 128.0)]
    member = [(str(rng.randrange(12)), str(i)) for i in range(0, 150, 2)]
    pois = spark.createDataFrame([(0, i, x, y) for i, x, y in pts], "belong int, id string, x double, y double")
    mem = spark.createDataFrame([(a, 0, p) for a, p in member], "aoi_id string, belong int, poi_id string")
    leaf = quadtree.leaves(pois, mem, box).cache()
    want = tree_by_recursion(pts, member, box)
    got = {}
    for r in leaf.collect():
        got.setdefault(r.leaf, set()).add(r.poi_id)
    assert got == {k: v[0] for k, v in want.items()}
    blocks = {}
    for r in quadtree.blocks(leaf, mem).collect():
        blocks.setdefault(r.leaf, set()).add(r.poi_id)
    assert blocks == {k: v[1] for k, v in want.items()}


def test_root_that_is_a_leaf_draws_nothing(spark):
    pois = spark.createDataFrame([(0, "a", 1.0, 1.0), (0, "b", 900.0, 1.0)], "belong int, id string, x double, y double")
    mem = spark.createDataFrame([("1", 0, "a"), ("1", 0, "b")], "aoi_id string, belong int, poi_id string")
    leaf = quadtree.leaves(pois, mem, (0.0, 0.0, 100.0, 100.0))
    assert [(r.leaf, r.poi_id) for r in quadtree.blocks(leaf, mem).collect()] == [("", "a")]


def test_depths_of_the_cities():
    assert [quadtree.depth_of(*projected_box(c)[2:]) for c in CITIES.values()] == [c.max_depth for c in CITIES.values()] == [9, 12, 9]


def test_clusterings():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(5 * k, 0.2, (60, 3)) for k in range(4)] + [rng.uniform(-30, 50, (15, 3))])
    truth = np.repeat(np.arange(4), 60)
    for labels in (clustering.hdbscan_labels(x, 12, 5), clustering.dbscan_labels(x, 1.0, 5), clustering.ward_labels(x[:240], 4)):
        for k in range(4):
            own = labels[:240][truth == k]
            top = np.bincount(own[own >= 0]).argmax()
            assert (own == top).mean() > 0.6 and not (labels[:240][truth != k] == top).any()
    assert (clustering.dbscan_labels(x, 1.0, 5)[240:] == -1).mean() > 0.8
    assert clustering.hdbscan_labels(x[:3], 12, 5).tolist() == [-1] * 3


def test_second_pass_labels_merge_unless_offset():
    first, second = lambda x: np.array([0, 0, -1, -1]), lambda x: np.array([0, -1])
    x = np.zeros((4, 1))
    assert clustering.two_pass(x, first, second, False).tolist() == [0, 0, 0, -1] and clustering.two_pass(x, first, second, True).tolist() == [0, 0, 1, -1]


def test_vote_tie_takes_the_smallest_label(spark):
    rows = [(0, -1, [0.0]), (1, 7, [1.0]), (2, 3, [-1.0]), (3, 7, [2.0]), (4, 3, [-2.0]), (5, 9, [3.0])]
    got = {r.pair_id: r.label for r in clustering.noise_votes(spark.createDataFrame(rows, "pair_id long, label int, vec array<double>")).collect()}
    assert got == {0: 3, 1: 7, 2: 3, 3: 7, 4: 3, 5: 9}


def planned(sizes, size):
    """(label, nth, batch, place) of every pair, as diverse_batches reads a schedule."""
    clusters = list(enumerate(sizes))
    rounds, whole, runs = batching.schedule(clusters, size)
    stream = sorted((n, a) for a, k in clusters for n in range(min(k, rounds)))[: whole * size]
    out = [(a, n, i // size, i % size) for i, (n, a) in enumerate(stream)]
    for label, start, take, times, batch, place, width in runs:
        out += [(label, start + k, batch + k // take, place + width * (k % take)) for k in range(take * times)]
    return sorted(out, key=lambda x: x[2:])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 9) | st.integers(1, 90), min_size=1, max_size=40), st.integers(2, 16))
def test_diverse_schedule(sizes, size):
    plan = planned(sizes, size)
    assert sorted((a, n) for a, n, _, _ in plan) == sorted((a, n) for a, k in enumerate(sizes) for n in range(k))
    left, batches = dict(enumerate(sizes)), 0
    for batch, own in itertools.groupby(plan, key=lambda x: x[2]):
        own = list(own)
        live = sum(v > 0 for v in left.values())
        assert batch == batches and [p for *_, p in own] == list(range(len(own)))
        if live >= size:
            assert len({a for a, *_ in own}) == len(own) == size
        for a, n, _, _ in sorted(own, key=lambda x: x[1]):
            assert n == sizes[a] - left[a]
            left[a] -= 1
        assert len(own) == size or not any(left.values())
        batches += 1


def test_diverse_schedule_is_short_for_long_clusters():
    assert len(batching.schedule([(k, 10**9 + k) for k in range(9)], 16)[2]) < 300


def test_diverse_batches(spark):
    sizes = [7, 1, 30, 4, 4, 9, 12]
    rows = [(i, label) for i, label in enumerate(x for label, n in enumerate(sizes) for x in [label] * n)]
    got = batching.diverse_batches(spark.createDataFrame(rows, "pair_id long, label int"), 4).collect()
    label = dict(rows)
    by = {}
    for r in got:
        by.setdefault(r.batch_id, []).append((r.pos, r.pair_id))
    assert sorted(p for r in by.values() for _, p in r) == list(range(len(rows))) and sorted(by) == list(range(len(by)))
    assert all([p for p, _ in sorted(v)] == list(range(len(v))) for v in by.values())
    assert len({label[p] for _, p in by[0]}) == 4 and sum(len(v) < 4 for v in by.values()) <= 1


@pytest.mark.parametrize("response,want", [
    ("Question 1: 0 0.95\nQuestion 2: 1 0.80", ([0, 1], [0.95, 0.8])), ("Question 2: 1 1.\nQuestion 1: 0 .5", ([0, 1], [0.5, 1.0])), ("Here you go\nQuestion 1: 0 0.9\nQuestion 2: 1 1", ([0, 1], [0.9, 1.0])),
    ("Question 1: 0 0.9　\nQuestion 2: 1 1", ([0, 1], [0.9, 1.0])), ("Question 1: 0 0.9", None), ("Question 1: 0 1\nQuestion 2: 0 1\nQuestion 3: 0 1", None), ("Question 1: 0 0.9\nQuestion 1: 0 0.9", None),
    ("Question 3: 0 0.9\nQuestion 2: 1 1", None), ("Question 1: 0 1.2\nQuestion 2: 1 1", None), ("Question 1: 0 .\nQuestion 2: 1 1", None), ("Question 1: 0 0.9.1\nQuestion 2: 1 1", None), ("Question 1: 2 0.9\nQuestion 2: 1 1", None), ("Question 1: 0  0.9\nQuestion 2: 1 1", None), (None, None),
])
def test_answers(spark, response, want):
    got = spark.createDataFrame([(response,)], "r string").select(prompting.parsed(F.col("r"), F.lit(2)).alias("p")).first().p
    assert (got and ([x.ans for x in got], [x.conf for x in got])) == want
    assert responding.valid(response, 2) == (want is not None)


@pytest.mark.parametrize("total", [0, 1, 500, 1_000_003, 1_000_900])
def test_places_of_the_shuffle_without_a_sort(spark, total):
    """contiguous pair_ids find their batches by arithmetic, and keep other columns."""
    rows = spark.range(total).select(F.col("id").alias("pair_id"), F.lit("a").alias("l_id"), (F.col("id") % 3).alias("label"))
    got = batching.random_batches(rows, 16, 5, total=total)
    assert got.columns == ["batch_id", "pos", "pair_id", "l_id"] and got.count() == total
    want = batching.random_batches(rows, 16, 5)
    assert got.select(want.columns).exceptAll(want).count() == 0
    assert not re.search("Sort |hashpartitioning|rangepartitioning", got._jdf.queryExecution().executedPlan().toString())


def test_pairs_are_numbered_and_joined_without_shuffles(spark):
    """by lists of a left record's pairs; records come by broadcasts, with texts or numbers of texts, or by shuffles, with the same result."""
    r = random.Random(4)
    rows = [(str(a) if a else None, str(b), r.random(), a * b) for a in range(30) for b in r.sample(range(50), r.randrange(1, 9))]
    pairs = spark.createDataFrame(rows, "l_id string, r_id string, sim double, dist_m long")
    want = [(i, *x) for i, x in enumerate(sorted(rows, key=lambda x: (x[0] is not None, x[0] or "", x[1])))]
    for most in (1000, 3):
        got = candidates.numbered(pairs, most)
        assert got.columns == ["pair_id", *pairs.columns] and sorted(map(tuple, got.collect())) == want
    got = candidates.numbered(pairs.select("r_id", "l_id"))
    assert got.columns == ["pair_id", "r_id", "l_id"] and [tuple(x) for x in got.orderBy("pair_id").collect()] == [(i, b, a) for i, a, b, *_ in want]
    p = spark.createDataFrame([(b, str(i), f"n {i % 4}" if i % 5 else None, "c", f"a {i % 3}", float(i), float(b)) for b in (0, 1) for i in range(50)], "belong int, id string, name string, category string, address string, longitude double, latitude double")
    ways = [features.joined(got, p, (), *bounds) for bounds in ((100, 200), (10, 200), (10, 20))]
    joins = [w._jdf.queryExecution().sparkPlan().toString() for w in ways]
    assert "BroadcastHashJoin [l_id" in joins[1] and "BroadcastHashJoin [_t" in joins[1] and "BroadcastHashJoin [_t" not in joins[0]
    all_ = [sorted(map(repr, w.select(*sorted(w.columns)).collect())) for w in ways]
    assert all_[0] == all_[1] == all_[2] and len(all_[0]) == len([x for x in rows if x[0]])


def test_prompts_get_their_texts_after_the_shuffle(spark, monkeypatch):
    """pairs are dealt by batch as ids only; the prompts are those of batches that meet the joined pairs."""
    monkeypatch.setattr(prompting, "DEALT", 30)
    p = inputs.pois(spark, SF)
    pairs = spark.createDataFrame([(k, str(k), str(k % 7)) for k in range(100)], "pair_id long, l_id string, r_id string")
    b = batching.random_batches(pairs, total=100)
    got = prompting.dealt_bodies(b, p, 100)
    plan = got._jdf.queryExecution().executedPlan().toString()  # parents come before their children
    shuffles = [m.start() for m in re.finditer(r"Exchange hashpartitioning", plan)]
    assert len(shuffles) == 1 and shuffles[0] > max(plan.index("BroadcastHashJoin [l_id"), plan.index("BroadcastHashJoin [r_id")) and "SortMergeJoin" not in plan
    assert sorted(got.collect()) == sorted(prompting.batch_bodies(b.select("batch_id", "pos", "pair_id"), features.joined(pairs, p)).collect())


def test_prompt_round_trip(spark):
    p = inputs.pois(spark, SF)
    pairs = spark.createDataFrame([(k, str(k), str(k % 5)) for k in range(20)], "pair_id long, l_id string, r_id string")
    full = features.joined(pairs, p)
    batches = batching.similar_batches(spark.createDataFrame([(k, k % 3) for k in range(20)], "pair_id long, label int"))
    prompts = prompting.batch_prompts(batches, full)
    first = prompts.orderBy("batch_id").first()
    assert first.n == 16 and "Question 16:\nFirst record = Name: " in first.prompt and "The last line is for Question 16." in first.prompt
    answers = responding.answered(prompts)
    assert {r.status for r in answers.collect()} == {"ok"} and responding.flattened(batches, answers).count() == 20
    assert "Question" not in prompting.batch_prompts(batches, full, has_category=False).first().prompt.split("Category")[0][:20]


def test_dealt_prompts_are_not_shuffled(spark):
    """prompts that lie in tasks already go to no more senders than asked for, without a shuffle; batches keep their other columns."""
    prompts = spark.createDataFrame([(i, 1, "p") for i in range(40)], "batch_id int, n int, prompt string").repartition(8, "batch_id")
    got = responding.answered(prompts, lambda p: "Question 1: 1 0.5", partitions=3, dealt=True)
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1 and "Coalesce 3" in got._jdf.queryExecution().executedPlan().toString()
    batches = spark.createDataFrame([(i, 0, i, f"l{i}") for i in range(41)], "batch_id int, pos int, pair_id long, l_id string")
    assert sorted(map(tuple, responding.flattened(batches, got).collect())) == [(i, f"l{i}", int(i < 40), 0.5 * (i < 40)) for i in range(41)]


def test_invalid_answers_are_sent_again_and_counted(spark):
    prompts = spark.createDataFrame([(0, 2, "good"), (1, 2, "bad")], "batch_id int, n int, prompt string")
    good = "Question 1: 0 1\nQuestion 2: 1 1"
    got = {r.batch_id: (r.attempt, r.status) for r in responding.answered(prompts, lambda p: good if p == "good" else "no", attempts=3).collect()}
    assert got == {0: (1, "ok"), 1: (3, "invalid")}
    with pytest.raises(Exception, match="no valid answer"):
        responding.answered(prompts, lambda p: "no", attempts=1, strict=True).collect()

    def broken(prompt):
        raise OSError("down")

    assert responding.called(broken, "x", 1, lambda s: None) == (None, "error: OSError: down")
    with pytest.raises(ValueError):
        responding.routed("nothing")


def kept(spark, edges, **options):
    rows = [(i, a, b, 1, float(w)) for i, (a, b, w) in enumerate(edges)]
    df = spark.createDataFrame(rows, "pair_id long, l_id string, r_id string, answer int, confidence double")
    return {r.pair_id for r in resolving.one_to_one(df, **options).where("kept = 1").collect()}


@pytest.mark.parametrize("edges,want", [
    ([("a1", "b1", 0.6), ("a1", "b2", 1.0), ("a2", "b2", 0.1)], {0, 2}), ([("a1", "b1", 0.9), ("a1", "b2", 0.8)], {0}), ([("a1", "b1", 0.3), ("a1", "b1", 0.7)], {1}), ([("a1", "b1", 0.0)], {0}),
])
def test_matching_cases(spark, edges, want):
    assert kept(spark, edges) == want


def test_matching_without_bonus(spark):
    assert kept(spark, [("a1", "b1", 0.4), ("a1", "b2", 1.0), ("a2", "b2", 0.1)], bonus=0.0) == {1}
    assert resolving.one_to_one(spark.createDataFrame([(0, "a", "b", 0, 0.5)], "pair_id long, l_id string, r_id string, answer int, confidence double")).first().kept == 0


@settings(max_examples=150)
@given(st.integers(1, 5), st.integers(1, 5), st.randoms())
def test_assignment_is_optimal(n, m, rng):
    w = np.array([[rng.random() + 1 if rng.random() < 0.6 else 0.0 for _ in range(m)] for _ in range(n)])
    got = resolving.assignment(w)
    assert len({a for a, _ in got}) == len({b for _, b in got}) == len(got)
    side = w if n <= m else w.T
    best = max(sum(side[i, p[i]] for i in range(side.shape[0])) for p in itertools.permutations(range(side.shape[1]), side.shape[0]))
    assert sum(w[a, b] for a, b in got) == pytest.approx(best)


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    from placeloom.operators.components import components

    rng = random.Random(seed)
    ids = list(range(500))
    rng.shuffle(ids)
    edges = list(zip(ids[:299], ids[1:300], strict=True)) if seed else [(i, i + 1) for i in range(299)]  # a long path, in and out of order
    edges += [(ids[300], i) for i in ids[301:350]] + [(5, 5)]
    up = list(range(500))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        up[y] = x
    got = components(spark.range(500), spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.id: r.component for r in got} == {i: top(i) for i in range(500)}


def test_refining(spark):
    rng = random.Random(3)
    pairs = sorted({(f"n{i}", f"n{j}") for i, j in ((rng.randrange(9), rng.randrange(9)) for _ in range(45)) if i != j})
    listed = [(a, b, rng.choice([0, 0, 0, 1, 2])) for a, b in pairs]
    chain = 50  # n0 same as all, and each pair of neighbours is listed without a label
    listed += [(f"c{k}", f"c{k + 1}", 1) for k in range(chain)] + [("c0", f"c{k}", 0) for k in range(2, chain + 1)] + [("d", "e", 2), ("d", "c0", 1)] + [(f"c{k}", "e", 0) for k in range(chain + 1)] + [("d", f"c{k}", 0) for k in range(1, chain + 1)]
    same, inside = ({(a, b) for a, b, v in listed if v == k} for k in (1, 2))
    names = {(a, b) for a, b, _ in listed}
    while True:
        either = same | {(b, a) for a, b in same}
        more_in = {(z, y) for x, y in inside for x2, z in either if x == x2} & names
        like = {(y, z) for x, y in same for x2, z in either if x == x2 and y != z}
        more_same = (like | {(b, a) for a, b in like}) & names
        if more_in <= inside and more_same <= same:
            break
        inside, same = inside | more_in, same | more_same
    got = {(r.a, r.b): r.label for r in refining.extended(spark.createDataFrame(listed, "a string, b string, label int")).collect()}
    assert got == {p: 2 if p in inside else 1 if p in same else 0 for p in names} and got["d", f"c{chain}"] == 1 and got[f"c{chain}", "e"] == 2
    p = spark.createDataFrame([("a", "x", 2, 0.9), ("a", "y", 2, 0.65), ("a", "z", 2, 0.85), ("b", "x", 2, 0.5), ("a", "w", 1, 0.1)], "a string, b string, label int, prob double")
    assert {(r.a, r.b) for r in refining.repaired(p).where("label = 0").collect()} == {("a", "y")}


def client(answers, **extra):
    def call(payload):
        a = answers.pop(0) if answers else "ok"
        if a == "fail":
            raise OSError("down")
        return {"choices": [{"message": {"content": a}}], "usage": {"total_tokens": 10}, "data": [{"embedding": [1.0, 2.0]}]}

    return {"provider": "p", "call": call, **extra}


def test_balancer():
    now = [0.0]
    b = balancing.Balancer([client([], rate_limit=2), client(["fail"] * 9, rate_limit=9)], clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s))
    assert b.generate("q") == "ok" and b.embedding("t") == [1.0, 2.0]
    assert sum(c["requests"] for c in b.stats()["p"]) == 2
    with pytest.raises(ValueError):
        b.request({}, retry="once")
    one = balancing.Balancer([client([], rate_limit=5)], clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s))
    for _ in range(5):
        one.generate("q")
    with pytest.raises(LookupError):
        one.best()
    now[0] += 60
    assert one.generate("q") == "ok"
    bad = balancing.Balancer([client(["fail"] * 9)], clock=lambda: now[0], sleep=lambda s: None)
    for _ in range(2):
        with pytest.raises((OSError, LookupError)):
            bad.generate("q")
    assert not bad.clients[0]["active"] and bad.clients[0]["errors"] == 4
    bad.health_check()
    assert bad.clients[0]["active"]
    assert balancing.timed(balancing.Balancer([client([], rate_limit=100)]), ["q"] * 8)["parallel"]["failed"] == 0


def test_settings(spark):
    base = {"llm": {"use": "a, b", "a": {"api_key": "k", "model": "m"}, "b": [{"api_key": "1"}, {"api_key": "2", "rate_limit": 9}]}}
    clients = client_settings.parsed_settings(json.dumps(base))
    assert [c["provider"] for c in clients] == ["a", "b", "b"]
    assert client_settings.settings_table(spark, clients).where("rate_limit = 9").count() == 1
    for broken in ({}, {"llm": {}}, {"llm": {"a": 1}}, {"llm": {"use": "z"}}):
        with pytest.raises(ValueError):
            client_settings.parsed_settings(json.dumps(broken))


def test_sources(spark, tmp_path):
    left, right = tmp_path / "l.csv", tmp_path / "r.csv"
    left.write_text('shop_id,name,address,big_category,small_category,longitude,latitude\n4640190.0,"A ""x"", b",,food,,118.8,31.94\n', encoding="utf-8")
    right.write_text("id,name,address,category,lng,lat\nz9,店,addr,美食,118.8,bad\n", encoding="utf-8")
    rows = sorted(poi_source.read_pois(spark, "nj", str(left), str(right)).collect(), key=lambda r: r.belong)
    assert rows[0].id == "4640190" and rows[0].name == 'A "x", b' and rows[0].address is None and rows[0].category == "food nan" and rows[0].x == pytest.approx(13224755.5, abs=1)
    assert rows[1].id == "z9" and rows[1].latitude is None and rows[1].category == "美食"
    assert [r.aoi_ord for r in poi_source.read_areas(spark, "nj", str(left)).collect()] == [0]
    v = tmp_path / "v.txt"
    v.write_text("the 0.5 1\ncat -1 2e-1\n")
    assert {r.word: r.vec for r in poi_source.read_word_vectors(spark, str(v)).collect()} == {"the": [0.5, 1.0], "cat": [-1.0, 0.2]}
    labelled = tmp_path / "c.csv"
    labelled.write_text(",e_name,e_category,e_type\n0,a,b,1\n")
    assert tuple(poi_source.read_labelled(spark, str(labelled)).first()) == ("a", "b", 1)
    poi_source.save(spark.range(3), str(tmp_path / "p"))
    poi_source.save_report(spark.range(1), str(tmp_path / "j"))
    assert poi_source.load(spark, str(tmp_path / "p")).count() == 3


def test_resolution_end_to_end(spark):
    p, a = inputs.pois(spark, SF, "nj"), inputs.areas(spark, SF, "nj")
    out = resolution.matched(p, a, CITIES["nj"], options=Options(matching_bonus=1.0)).collect()
    assert out and len({r.pair_id for r in out}) == len(out)
    for side in ("l_id", "r_id"):
        ids = [getattr(r, side) for r in out if r.kept]
        assert len(set(ids)) == len(ids)


def test_plans_have_no_nested_loops(spark):
    p, m = inputs.pois(spark, SF), inputs.members(spark, SF)
    plan = candidates.candidates(p, quadtree.leaves(p, m, projected_box(CITIES["nj"])), m, CITIES["nj"])._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_word_features(spark):
    df = spark.createDataFrame([("big_cafe x", "food", 1)], "e_name string, e_category string, e_type int")
    r = classifying.text_input(df, 8).first()
    assert r.s == "COL name VAL big_cafe x COL category VAL food " and len(r.tokens) == 8 and r.tokens[0] == "[CLS]"
    assert classifying.token_input(df, 4).first().words == ["big cafe", "x", "food", "padding"]


def test_streaming_limiter(spark, tmp_path):
    from placeloom.streaming import limiter

    events = spark.createDataFrame([(i, "c", f"2024-01-01 00:00:{i:02d}") for i in range(8)] + [(8, "c", "2024-01-01 00:01:01")], "event_id long, client string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    events.coalesce(1).write.parquet(str(tmp_path / "e"))
    for name, make in (("a", limiter.admitted), ("w", limiter.windowed_requests)):
        stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
        q = make(stream).writeStream.format("memory").queryName(f"limiter_{name}").outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = {r.event_id: r.available for r in spark.table("limiter_a").collect()}
    assert got == {i: i < 5 for i in range(8)} | {8: True}


@pytest.mark.parametrize("method", ["hdbscan", "dbscan"])
def test_noise_that_is_left_goes_to_a_cluster(spark, method):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(0, 0.01, (40, 2)), rng.normal(5, 0.01, (40, 2)), rng.uniform(0, 5, (30, 2))])
    f = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "pair_id long, f0 double, f1 double")
    without = {r.pair_id: r.label for r in clustering.clustered(f, ["f0", "f1"], method, votes=False).collect()}
    got = {r.pair_id: r.label for r in clustering.clustered(f, ["f0", "f1"], method).collect()}
    assert -1 in without.values() and len(got) == len(x) and -1 not in got.values()

    def vote(i):
        five = sorted((j for j in without if without[j] >= 0), key=lambda j: (round(((x[j] - x[i]) ** 2).sum(), 12), j))[:5]
        labels = [without[j] for j in five]
        return min(labels, key=lambda v: (-labels.count(v), v))

    assert all(got[i] == (v if v >= 0 else vote(i)) for i, v in without.items())


def test_all_senders_together_keep_the_rate(spark, monkeypatch):
    class Clock:
        now = 0.0

    calls = []

    def send(prompt):
        calls.append(Clock.now)
        if prompt.endswith("7"):
            raise OSError("busy")
        return "Question 1: 0 1"

    waits = []
    bucket = responding.Bucket(1, clock=lambda: Clock.now, sleep=lambda s: (waits.append(s), setattr(Clock, "now", Clock.now + s)))
    for k in range(6):  # failing calls and their repetitions pass the bucket too
        responding.called(send, f"p{k if k else 7}", 3, pause=lambda s: None, before=bucket.wait)
    assert len(calls) == 9 and all(b - a >= 60 for a, b in zip(calls, calls[1:]))
    # at most as many senders as calls a minute, each with a whole part of them
    seen = []
    monkeypatch.setattr(type(spark.range(1)), "repartition", lambda self, n, *c, f=type(spark.range(1)).repartition: seen.append(n) or f(self, n, *c))
    responding.answered(spark.createDataFrame([(1, 1, "p")], "batch_id int, n int, prompt string"), model=responding.ModelConfig("m", 9, 4))
    assert seen == [4]


def test_blocks_are_made_without_a_shuffle_of_their_rows(spark):
    leaf = spark.createDataFrame([(0, "a", "1", 1), (1, "b", "1", 1), (0, "c", "20", 2), (0, "d", "", 0)], "belong int, poi_id string, leaf string, level int")
    mem = spark.createDataFrame([("x", 0, "a"), ("y", 0, "a"), ("x", 0, "c"), ("y", 0, "c"), ("z", 0, "c"), ("z", 1, "e"), ("y", 0, "d"), ("y", 0, "d")], "aoi_id string, belong int, poi_id string")
    got = quadtree.blocks(leaf, mem)
    want = [("", "d", True), ("1", "a", True), ("1", "b", True), ("1", "c", False), ("1", "d", False), ("20", "a", False), ("20", "c", True), ("20", "d", False), ("20", "e", False)]
    assert sorted((r.leaf, r.poi_id, r.internal) for r in got.collect()) == want
    assert "Aggregate" not in got._jdf.queryExecution().sparkPlan().toString().split("Join")[0]
