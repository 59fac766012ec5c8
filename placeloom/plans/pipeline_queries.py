"""Queries of blocking, clustering, batching, prompting, resolution, evaluation and the client accounts."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from placeloom.config import CITIES
from placeloom.functions import vectors
from placeloom.functions.spatial import projected_box
from placeloom.operators import areas as area_ops
from placeloom.operators import balancing, batching, candidates, classifying, clustering, evaluating, features, prompting, quadtree, refining, resolving, responding
from placeloom.operators.components import settled

from . import inputs
from .inputs import sql_chars, sql_clean, sql_haversine, sql_rounded, table
from .registry import query
from .scalar_queries import sql_encoded, sql_likenesses, sql_serialized


def _tree_sql(city: str, most: int = 2) -> str:
    """Paths ey recursion, one level a step; then split prefixes, leaves and blocks."""
    c = CITIES[city]
    x, y, w, h = projected_box(c)
    depth = quadtree.depth_of(w, h)
    return f"""WITH RECURSIVE {inputs.sql(city)},
walk AS (SELECT belong, id, x, y, 0 AS n, {x!r}::double AS ex, {y!r}::double AS ey, {w!r}::double AS ew, {h!r}::double AS eh, '' AS path FROM pois
  WHERE x BETWEEN {x!r}::double AND {x!r}::double + {w!r}::double AND y BETWEEN {y!r}::double AND {y!r}::double + {h!r}::double
 UNION ALL
 SELECT belong, id, x, y, n + 1, CASE WHEN d IN ('0', '3') THEN ex + ew / 2 ELSE ex END, CASE WHEN d IN ('2', '3') THEN ey + eh / 2 ELSE ey END, ew / 2, eh / 2, path || d FROM (
  SELECT *, CASE WHEN x <= ex + ew / 2 AND y < ey + eh / 2 THEN '1' WHEN x < ex + ew / 2 AND y >= ey + eh / 2 THEN '2' WHEN x >= ex + ew / 2 AND y > ey + eh / 2 THEN '3' ELSE '0' END AS d FROM walk WHERE n < {depth})),
splits AS (SELECT path FROM walk JOIN members m ON m.belong = walk.belong AND m.poi_id = walk.id WHERE n > 0 AND n < {depth} GROUP BY path HAVING count(DISTINCT aoi_id) > {most}
 UNION ALL SELECT '' WHERE (SELECT count(DISTINCT aoi_id) FROM members) > {most}),
levels AS (SELECT w.belong, w.id AS poi_id, count(s.path)::int AS level FROM walk w LEFT JOIN splits s ON s.path = w.path AND w.n < {depth} GROUP BY ALL),
leaves AS (SELECT l.belong, l.poi_id, w.path AS leaf, l.level FROM levels l JOIN walk w ON w.belong = l.belong AND w.id = l.poi_id AND w.n = l.level),
drawn AS (SELECT DISTINCT l.leaf, b.belong, b.poi_id FROM leaves l JOIN members m USING (belong, poi_id) JOIN members b ON b.aoi_id = m.aoi_id WHERE l.level > 0),
blocks AS (SELECT leaf, belong, poi_id, max(own) = 1 AS internal FROM (SELECT leaf, belong, poi_id, 1 AS own FROM leaves UNION ALL SELECT leaf, belong, poi_id, 0 FROM drawn) GROUP BY leaf, belong, poi_id)"""


def _candidates_sql(city: str) -> str:
    c = CITIES[city]
    clean_left = c.clean_side == "left"
    lc, rc = ("l_clean", "r_name") if clean_left else ("l_name", "r_clean")
    within = "list_has_all(lc, rn) OR list_has_all(rn, lc)" if clean_left else "list_has_all(lc, rc) OR list_has_all(rn, lc)"
    right = "rn" if clean_left else "rc"
    sim = f"len(list_intersect(lc, {right})) / len(list_distinct(list_concat(lc, {right})))::double" if c.measure == "jaccard" else f"1 - levenshtein(lower({lc if clean_left else 'l_name'}), lower(r_name)) / greatest(length({lc if clean_left else 'l_name'}), length(r_name))::double"
    return _tree_sql(city) + f""",
named AS (SELECT *, {sql_clean("name")} AS clean FROM pois),
charred AS (SELECT *, {sql_chars("name")} AS chars, {sql_chars("clean")} AS clean_chars FROM named),
duo AS (SELECT DISTINCT l.poi_id AS l_id, r.poi_id AS r_id FROM blocks l JOIN blocks r ON l.leaf = r.leaf AND l.belong = 0 AND r.belong = 1),
far AS (SELECT l_id, r_id, a.name AS l_name, a.clean AS l_clean, b.name AS r_name, {"a.clean_chars" if clean_left else "a.chars"} AS lc, b.chars AS rn, b.clean_chars AS rc, {sql_rounded("a.latitude", "a.longitude", "b.latitude", "b.longitude")} AS dist_m
 FROM duo JOIN charred a ON a.belong = 0 AND a.id = l_id JOIN charred b ON b.belong = 1 AND b.id = r_id),
judged AS (SELECT l_id, r_id, dist_m, CASE WHEN {within} THEN 1 ELSE {sim} END AS sim FROM far WHERE dist_m <= {c.distance}),
candidates AS (SELECT l_id, r_id, sim, dist_m FROM judged WHERE sim >= {c.likeness})"""


def blocks(spark, sf_dir, city="nj"):
    p, m, box = inputs.pois(spark, sf_dir, city), inputs.members(spark, sf_dir, city), projected_box(CITIES[city])
    return quadtree.blocks(quadtree.leaves(p, m, box), m)


def candidate_pairs(spark, sf_dir, city="nj"):
    p, m = inputs.pois(spark, sf_dir, city), inputs.members(spark, sf_dir, city)
    return candidates.candidates(p, quadtree.leaves(p, m, projected_box(CITIES[city])), m, CITIES[city])


@query("quadtree_leaves", _tree_sql("nj") + " SELECT belong, poi_id, leaf, level FROM leaves")
def quadtree_leaves(spark, sf_dir):
    return quadtree.leaves(inputs.pois(spark, sf_dir), inputs.members(spark, sf_dir), projected_box(CITIES["nj"]))


@query("quadtree_blocks", _tree_sql("nj") + " SELECT leaf, belong, poi_id, internal FROM blocks")
def quadtree_blocks(spark, sf_dir):
    return blocks(spark, sf_dir)


_SIDE = projected_box(CITIES["nj"])


@query("quadtree_measures", _tree_sql("nj") + f" SELECT l.leaf, count(DISTINCT (l.belong, l.poi_id)) AS points, count(DISTINCT m.aoi_id) AS areas, round(sqrt(pow({_SIDE[2]!r}::double / pow(2, l.level), 2) + pow({_SIDE[3]!r}::double / pow(2, l.level), 2)), 4) AS diagonal, round(1e6 * count(DISTINCT (l.belong, l.poi_id)) / ({_SIDE[2] * _SIDE[3]!r}::double / pow(4, l.level)), 4) AS density FROM leaves l LEFT JOIN members m USING (belong, poi_id) GROUP BY l.leaf, l.level")
def quadtree_measures(spark, sf_dir):
    p, m, box = inputs.pois(spark, sf_dir), inputs.members(spark, sf_dir), projected_box(CITIES["nj"])
    d = quadtree.measures(quadtree.leaves(p, m, box), m, box)
    return d.select("leaf", "points", "areas", F.round("diagonal", 4).alias("diagonal"), F.round(F.col("density") * 1e6, 4).alias("density"))


def _candidates_query(city):
    def run(spark, sf_dir):
        return candidate_pairs(spark, sf_dir, city).select("l_id", "r_id", F.round("sim", 6).alias("sim"), "dist_m")

    query(f"candidates_{city}", _candidates_sql(city) + " SELECT l_id, r_id, round(sim, 6)::double AS sim, dist_m FROM candidates")(run)


for _city in CITIES:
    _candidates_query(_city)


@query("blocking_metrics", _candidates_sql("nj") + ", n AS (SELECT count(*) AS pairs, count(t.l_id) AS hits FROM candidates LEFT JOIN truth t USING (l_id, r_id)) SELECT pairs, hits, round(hits / (SELECT count(*) FROM truth)::double, 6) AS completeness, round(hits / pairs::double, 6) AS quality, round(1 - pairs / ((SELECT count(*) FROM pois WHERE belong = 0)::double * (SELECT count(*) FROM pois WHERE belong = 1)), 6) AS reduction FROM n")
def blocking_metrics(spark, sf_dir):
    p = inputs.pois(spark, sf_dir)
    sizes = p.agg(F.sum((F.col("belong") == 0).cast("double")).alias("n_left"), F.sum((F.col("belong") == 1).cast("double")).alias("n_right"))
    q = candidates.blocking_quality(settled(candidate_pairs(spark, sf_dir)), inputs.truth(spark, sf_dir), F.col("n_left"), F.col("n_right"), sizes)
    return q.select("pairs", "hits", *[F.round(c, 6).alias(c) for c in ("completeness", "quality", "reduction")])


@query("numbered_pairs", _candidates_sql("nj") + " SELECT row_number() OVER (ORDER BY l_id, r_id) - 1 AS pair_id, l_id, r_id FROM candidates")
def numbered_pairs(spark, sf_dir):
    return candidates.numbered(candidate_pairs(spark, sf_dir).select("l_id", "r_id"))


@query("aoi_claims")
def aoi_claims(spark, sf_dir):
    return area_ops.claims(inputs.pois(spark, sf_dir), inputs.areas(spark, sf_dir), CITIES["nj"].eps, CITIES["nj"].min_points)


@query("aoi_of_poi", f"WITH {inputs.sql()} SELECT belong, poi_id, array_to_string(list_sort(list(DISTINCT aoi_id)), ',') AS areas FROM members GROUP BY belong, poi_id")
def aoi_of_poi(spark, sf_dir):
    return area_ops.inverted(inputs.members(spark, sf_dir)).select("belong", "poi_id", F.array_join("areas", ",").alias("areas"))


@query("aoi_coverage", f"WITH {inputs.sql()} SELECT count(DISTINCT (belong, poi_id)) AS covered, (SELECT count(*) FROM pois) - count(DISTINCT (belong, poi_id)) AS outliers, count(DISTINCT aoi_id) AS areas FROM members")
def aoi_coverage(spark, sf_dir):
    return area_ops.coverage(inputs.pois(spark, sf_dir), inputs.members(spark, sf_dir))


@query("aoi_gt_coverage", f"WITH {inputs.sql()} SELECT count(DISTINCT (l_id, r_id)) AS shared FROM truth JOIN members a ON a.belong = 0 AND a.poi_id = l_id JOIN members b ON b.belong = 1 AND b.poi_id = r_id AND b.aoi_id = a.aoi_id")
def aoi_gt_coverage(spark, sf_dir):
    return area_ops.truth_in_areas(inputs.truth(spark, sf_dir), inputs.members(spark, sf_dir))


def _pair_table(spark, sf_dir):
    """All candidate pairs of the blocking, numbered: pair_id, l_id, r_id."""
    return settled(candidates.numbered(candidate_pairs(spark, sf_dir).select("l_id", "r_id")))


_PAIRS = _candidates_sql("nj") + ", pairs AS (SELECT row_number() OVER (ORDER BY l_id, r_id) - 1 AS pair_id, l_id, r_id FROM candidates)"


_FULL = _PAIRS + f", full_pairs AS (SELECT pair_id, {', '.join(f'{t}.{c} AS {p}_{c}' for t, p in (('a', 'l'), ('b', 'r')) for c in ('name', 'category', 'address'))}, {sql_haversine('a.longitude', 'a.latitude', 'b.longitude', 'b.latitude')} AS metres FROM pairs JOIN pois a ON a.belong = 0 AND a.id = l_id JOIN pois b ON b.belong = 1 AND b.id = r_id)"
_LIKE = f"{_FULL}, {sql_likenesses('full_pairs', 'pair_id')}"
_SCALED = lambda c: f"round(({c} - quantile_cont({c}, 0.5) OVER ()) / CASE WHEN quantile_cont({c}, 0.75) OVER () = quantile_cont({c}, 0.25) OVER () THEN 1 ELSE quantile_cont({c}, 0.75) OVER () - quantile_cont({c}, 0.25) OVER () END, 6) AS {c}"


@query("pair_features", _LIKE + f", f AS (SELECT pair_id, name_sim, category_sim, address_sim, -metres AS dist_sim FROM likenesses JOIN full_pairs USING (pair_id)) SELECT pair_id, {', '.join(map(_SCALED, ('name_sim', 'category_sim', 'address_sim', 'dist_sim')))} FROM f")
def pair_features(spark, sf_dir):
    f = features.fused(features.joined(_pair_table(spark, sf_dir), inputs.pois(spark, sf_dir)))
    return f.select("pair_id", *[F.round(c, 6).alias(c) for c in f.columns if c != "pair_id"])


@query("pair_features_raw", _LIKE + " SELECT pair_id, round(name_sim, 6) AS name_sim, round(category_sim, 6) AS category_sim, round(address_sim, 6) AS address_sim FROM likenesses")
def pair_features_raw(spark, sf_dir):
    f = features.extract(features.joined(_pair_table(spark, sf_dir), inputs.pois(spark, sf_dir)), "properties")
    return f.select("pair_id", *[F.round(c, 6).alias(c) for c in f.columns if c != "pair_id"])


@query("pair_embeddings", _FULL + f", said AS (SELECT pair_id AS key, {sql_serialized('l')} || ' [SEP] ' || {sql_serialized('r')} AS s FROM full_pairs), {sql_encoded('said')} SELECT p.key AS pair_id, string_agg(coalesce(round(v, 6), 0)::double::varchar, ',' ORDER BY n) AS vec FROM (SELECT key, unnest(range(64)) AS n FROM said) p LEFT JOIN coded c ON c.key = p.key AND c.i = p.n GROUP BY p.key")
def pair_embeddings(spark, sf_dir):
    pairs = candidates.numbered(candidate_pairs(spark, sf_dir).select("l_id", "r_id"))
    return features.semantic_by_value(pairs, inputs.pois(spark, sf_dir), finish=vectors.written)


_COSINE = "greatest(-1, least(1, coalesce(dots.{0}, 0)))"


@query("pair_features_encoded", _FULL + ", said AS (" + " UNION ALL ".join(f"SELECT pair_id::varchar || '{p}{c}' AS key, {p}_{c} AS s FROM full_pairs" for p in "lr" for c in ("name", "category", "address")) + f"), {sql_encoded('said')}, dots AS (SELECT pair_id, " + ", ".join(f"(SELECT sum(x.v * y.v) FROM coded x JOIN coded y USING (i) WHERE x.key = pair_id::varchar || 'l{c}' AND y.key = pair_id::varchar || 'r{c}') AS {c}" for c in ("name", "category", "address")) + " FROM full_pairs) SELECT pair_id, " + ", ".join(f"round({_COSINE.format(c)}, 6)::double AS {c}_sim" for c in ("name", "category", "address")) + " FROM dots")
def pair_features_encoded(spark, sf_dir):
    f = features.extract(features.joined(_pair_table(spark, sf_dir), inputs.pois(spark, sf_dir)), "properties_encoded")
    return f.select("pair_id", *[F.round(c, 6).alias(c) for c in f.columns if c != "pair_id"])


def _clustered(spark, sf_dir, method):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pair_id"), *[F.col("embedding")[i].cast("double").alias(f"f{i}") for i in range(64)])
    return clustering.clustered(e, [f"f{i}" for i in range(64)], method)


for _method in ("hdbscan", "dbscan", "agglomerative", "kmeans"):
    query(f"cluster_{_method}")(lambda spark, sf_dir, m=_method: _clustered(spark, sf_dir, m))

#: Labels for votes and reports: of ten labels, those of every fourth vector are taken for noise.
_NOISY = "n AS (SELECT vec_id AS pair_id, CASE WHEN vec_id % 4 = 0 THEN -1 ELSE label END AS label, embedding::double[] AS v FROM embeddings)"


def _noisy(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pair_id"), F.when(F.col("vec_id") % 4 == 0, -1).otherwise(F.col("label")).cast("int").alias("label"), F.col("embedding").alias("vec"))


@query("knn_vote", f"WITH {_NOISY}, d AS (SELECT a.pair_id, b.label, row_number() OVER (PARTITION BY a.pair_id ORDER BY round(list_sum(list_transform(list_zip(a.v, b.v), lambda x: (x[1] - x[2]) ** 2)), 12), b.pair_id) AS r FROM n a JOIN n b ON a.label = -1 AND b.label <> -1), c AS (SELECT pair_id, label, count(*) AS k FROM d WHERE r <= 5 GROUP BY ALL), v AS (SELECT pair_id, label, row_number() OVER (PARTITION BY pair_id ORDER BY k DESC, label) AS r FROM c) SELECT n.pair_id, coalesce(v.label, n.label) AS label FROM n LEFT JOIN v ON v.pair_id = n.pair_id AND v.r = 1")
def knn_vote(spark, sf_dir):
    return clustering.noise_votes(_noisy(spark, sf_dir))


@query("cluster_mapping", f"WITH {_NOISY} SELECT pair_id, CASE WHEN label = -1 THEN (SELECT max(label) + 1 FROM n) ELSE label END AS label FROM n")
def cluster_mapping(spark, sf_dir):
    return clustering.mapped(_noisy(spark, sf_dir).select("pair_id", "label"))


@query("cluster_report", f"WITH {_NOISY}, s AS (SELECT label, count(*) AS k FROM n WHERE label >= 0 GROUP BY label), r AS (SELECT max(label) + 1 AS c, max(k) AS m, sum(k) AS t, sum(k * k) AS t2 FROM s) SELECT (SELECT count(*) FROM n) AS rows, c::bigint AS clusters, round((SELECT count(*) FROM n WHERE label = -1) / (SELECT count(*) FROM n)::double, 6) AS noise_part, m AS largest, round(t / c::double, 6)::double AS mean_size, round(sqrt(t2 / c::double - (t / c::double) ** 2), 6)::double AS size_deviation FROM r")
def cluster_report(spark, sf_dir):
    r = clustering.report(_noisy(spark, sf_dir).select("pair_id", "label"))
    return r.select("rows", "clusters", F.round("noise_part", 6).alias("noise_part"), "largest", F.round("mean_size", 6).alias("mean_size"), F.round("size_deviation", 6).alias("size_deviation"))


#: Pairs with a cluster by arithmetic.
_CLUSTERS = _PAIRS + ", clusters AS (SELECT pair_id, (pair_id * 37 % 101 % 23)::int AS label FROM pairs)"


def _clusters(spark, sf_dir):
    return _labelled(_pair_table(spark, sf_dir))


def _labelled(pairs):
    return pairs.select("pair_id", (F.col("pair_id") * 37 % 101 % 23).cast("int").alias("label"))


_CHUNK = "SELECT (n // 16)::int AS batch_id, (n % 16)::int AS pos, pair_id FROM o"


@query("random_batches", _CLUSTERS + f", o AS (SELECT pair_id, row_number() OVER (ORDER BY pair_id * 7919 % 1000003, pair_id) - 1 AS n FROM clusters) {_CHUNK}")
def random_batches(spark, sf_dir):
    return batching.random_batches(_clusters(spark, sf_dir))


@query("similar_batches", _CLUSTERS + f", f AS (SELECT *, min(pair_id) OVER (PARTITION BY label) AS first FROM clusters), o AS (SELECT pair_id, row_number() OVER (ORDER BY first, pair_id) - 1 AS n FROM f) {_CHUNK}")
def similar_batches(spark, sf_dir):
    return batching.similar_batches(_clusters(spark, sf_dir))


@query("diverse_batches")
def diverse_batches(spark, sf_dir):
    return batching.diverse_batches(_clusters(spark, sf_dir))


_ONE = "'Name: ' || {0}.name || ', Category: ' || {0}.category || ', Address: ' || coalesce({0}.address, 'nan')"
_METRES = "regexp_replace(printf('%.2f', round(" + sql_haversine("a.longitude", "a.latitude", "b.longitude", "b.latitude") + ", 2)), '(\\.\\d)0$', '\\1')"
_BOTH = "pairs JOIN pois a ON a.belong = 0 AND a.id = l_id JOIN pois b ON b.belong = 1 AND b.id = r_id"


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


@query("render_prompt", _CLUSTERS + f", o AS (SELECT pair_id, row_number() OVER (ORDER BY pair_id * 7919 % 1000003, pair_id) - 1 AS n FROM clusters), b AS ({_CHUNK}), t AS (SELECT pair_id, {_ONE.format('a')} AS l, {_ONE.format('b')} AS r, {_METRES} AS m FROM {_BOTH}), q AS (SELECT batch_id, pos, 'Question ' || (pos + 1)::varchar || ':' || chr(10) || 'First record = ' || l || chr(10) || 'Second record = ' || r || chr(10) || 'Metres apart = ' || m || chr(10) || chr(10) AS q FROM b JOIN t USING (pair_id)) SELECT batch_id, count(*)::int AS n, md5({_sql_text(prompting.TASK)} || string_agg(q, '' ORDER BY pos) || replace({_sql_text(prompting.WITH_CONFIDENCE)}, '{{n}}', count(*)::varchar)) AS digest, md5({_sql_text(prompting.TASK)} || string_agg(q, '' ORDER BY pos) || replace({_sql_text(prompting.WITHOUT_CONFIDENCE)}, '{{n}}', count(*)::varchar)) AS plain FROM q GROUP BY batch_id")
def render_prompt(spark, sf_dir):
    pairs = candidates.numbered(candidate_pairs(spark, sf_dir).select("l_id", "r_id"))
    total = pairs.count()
    return prompting.dealt_bodies(batching.random_batches(pairs, total=total), inputs.pois(spark, sf_dir), total).select("batch_id", "n", F.md5(prompting.batch_prompt()).alias("digest"), F.md5(prompting.batch_prompt(confidence=False)).alias("plain"))


_AT = "' @ ' || printf('%.6f', {0}.latitude) || ' ' || printf('%.6f', {0}.longitude)"


@query("render_pair_prompt", _PAIRS + f" SELECT pair_id, {_sql_text(prompting.ONE_PAIR)} || 'First record = ' || {_ONE.format('a')} || {_AT.format('a')} || chr(10) || 'Second record = ' || {_ONE.format('b')} || {_AT.format('b')} || chr(10) || {_sql_text(prompting.ONE_ANSWER)} AS prompt FROM {_BOTH}")
def render_pair_prompt(spark, sf_dir):
    return prompting.pair_prompts(features.joined(_pair_table(spark, sf_dir), inputs.pois(spark, sf_dir)))


@query("render_choice_prompt", _PAIRS + f", t AS (SELECT r_id, pair_id, {_ONE.format('b')} AS given, 'Option ' || pair_id::varchar || ' = ' || {_ONE.format('a')} || ', metres away = ' || {_METRES} || chr(10) AS t FROM {_BOTH}) SELECT r_id AS id, count(*)::int AS n, md5({_sql_text(prompting.CHOOSE)} || 'Sought = ' || any_value(given) || chr(10) || string_agg(t, '' ORDER BY pair_id) || {_sql_text(prompting.CHOICE_ANSWER)}) AS digest FROM t GROUP BY r_id")
def render_choice_prompt(spark, sf_dir):
    full = features.joined(_pair_table(spark, sf_dir), inputs.pois(spark, sf_dir))
    return prompting.choice_prompts(full, "r").select("id", "n", F.md5("prompt").alias("digest"))


#: Responses of many shapes, by event: good, reordered, with chatter, short, doubled, out of range, odd numbers.
_SHAPES = ["Question 1: 0 0.95\nQuestion 2: 1 0.80", "Question 2: 1 1.\nQuestion 1: 0 .5", "Here you go\nQuestion 1: 0 0.9\nQuestion 2: 1 1", "Question 1: 1 0.5", "Question 1: 0 0.9\nQuestion 1: 1 0.9", "Question 3: 0 0.9\nQuestion 2: 1 0.9", "Question 1: 0 1.2\nQuestion 2: 1 0.9", "Question 1: 0 .\nQuestion 2: 1 0.9", "Question 1: 2 0.3\nQuestion 2: 1 0.9", "Question 1: 0\nQuestion 2: 1", "  Question 1: 1 0.25  \nQuestion 2: 0 1.0"]
_SHAPE_SQL = "(list_value(" + ", ".join("'" + s.replace("\n", "' || chr(10) || '") + "'" for s in _SHAPES) + f"))[(event_id % {len(_SHAPES)} + 1)::int]"


def _responses(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.element_at(F.array(*[F.lit(s) for s in _SHAPES]), (F.col("event_id") % len(_SHAPES) + 1).cast("int")).alias("r"))


@query("parse_answers", f"WITH e AS (SELECT event_id, trim({_SHAPE_SQL}) AS r FROM events), m AS (SELECT event_id, regexp_extract_all(r, '(?m)^Question\\s+(\\d+):\\s([01])\\s([0-9.]+)\\s*$', 1) AS q, regexp_extract_all(r, '(?m)^Question\\s+(\\d+):\\s([01])\\s([0-9.]+)\\s*$', 2) AS a, regexp_extract_all(r, '(?m)^Question\\s+(\\d+):\\s([01])\\s([0-9.]+)\\s*$', 3) AS c FROM e), s AS (SELECT event_id, list_sort(list_transform(list_zip(q, a, c), lambda x: {{'q': try_cast(x[1] AS bigint), 'a': x[2], 'c': try_cast(x[3] AS double)}})) AS rows FROM m), v AS (SELECT event_id, rows, len(rows) = 2 AND list_transform(rows, lambda x: x.q) = [1, 2] AND len(list_filter(rows, lambda x: coalesce(x.c BETWEEN 0 AND 1, false))) = 2 AS fine FROM s) SELECT event_id, CASE WHEN fine THEN array_to_string(list_transform(rows, lambda x: x.a), ',') END AS answers, CASE WHEN fine THEN round(rows[1].c, 4) END AS first, CASE WHEN fine THEN round(rows[2].c, 4) END AS second FROM v")
def parse_answers(spark, sf_dir):
    a = _responses(spark, sf_dir).select("event_id", prompting.parsed(F.col("r"), F.lit(2)).alias("p"))
    return a.select("event_id", F.array_join(F.transform("p", lambda x: x["ans"].cast("string")), ",").alias("answers"), F.round(F.get("p", F.lit(0))["conf"], 4).alias("first"), F.round(F.get("p", F.lit(1))["conf"], 4).alias("second"))


@query("parse_plain", f"WITH e AS (SELECT event_id, trim({_SHAPE_SQL}) AS r FROM events), s AS (SELECT event_id, list_sort(list_transform(list_zip(regexp_extract_all(r, '(?m)^Question\\s+(\\d+):\\s*([01])$', 1), regexp_extract_all(r, '(?m)^Question\\s+(\\d+):\\s*([01])$', 2)), lambda x: {{'q': x[1]::bigint, 'a': x[2]}})) AS rows FROM e) SELECT event_id, CASE WHEN list_transform(rows, lambda x: x.q) = [1, 2] THEN array_to_string(list_transform(rows, lambda x: x.a), ',') END AS answers FROM s")
def parse_plain(spark, sf_dir):
    return _responses(spark, sf_dir).select("event_id", F.array_join(F.transform(prompting.parsed_plain(F.col("r"), F.lit(2)), lambda x: x.cast("string")), ",").alias("answers"))


@query("parse_index", "SELECT event_id, CASE WHEN event_id % 3 = 0 AND event_id % 10 IN (1, 4, 7) THEN (event_id % 10)::varchar END AS choice FROM events")
def parse_index(spark, sf_dir):
    r = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" "), (F.col("event_id") % 10).cast("string"), F.lit("\n"))).otherwise(F.concat(F.lit("Index: "), (F.col("event_id") % 10).cast("string")))
    return table(spark, sf_dir, "events").select("event_id", prompting.parsed_choice(r, F.array(*[F.lit(x).cast("bigint") for x in (1, 4, 7)])).cast("string").alias("choice"))


@query("parse_list", "SELECT event_id, CASE WHEN event_id % 4 < 2 THEN (event_id % 2)::varchar || ',1' END AS answers FROM events")
def parse_list(spark, sf_dir):
    items = F.array(F.concat(F.lit(" "), (F.col("event_id") % 4).cast("string")), F.lit("1 "))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(F.transform(prompting.parsed_list(items, F.lit(2)), lambda x: x.cast("string")), ",").alias("answers"))


#: The stand-in's rule: 1 if the names' first words agree, and a confidence from the distance; lines are read back by the strict parser.
@query("mock_answers", _PAIRS + f", t AS (SELECT pair_id, a.name AS l, b.name AS r, {_METRES}::double AS m FROM {_BOTH}) SELECT pair_id, (split_part(l, ' ', 1) = split_part(r, ' ', 1))::int AS answer, printf('%.2f', greatest(0, 1 - m / 1000))::double AS confidence FROM t")
def mock_answers(spark, sf_dir):
    pairs = _pair_table(spark, sf_dir)
    b = settled(batching.similar_batches(_labelled(pairs)))
    return responding.flattened(b, settled(responding.answered(prompting.batch_prompts(b, features.joined(pairs, inputs.pois(spark, sf_dir))))))


#: Answered pairs by arithmetic, with conflicts on both sides.
_ANSWERS = "answers AS (SELECT o_orderkey AS pair_id, (o_orderkey % 997)::varchar AS l_id, (o_custkey % 499)::varchar AS r_id, (o_orderkey % 3 = 0)::int AS answer, (o_orderkey * 31 % 1000) / 1000.0::double AS confidence FROM orders)"


def _answers(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k.alias("pair_id"), (k % 997).cast("string").alias("l_id"), (F.col("o_custkey") % 499).cast("string").alias("r_id"), (k % 3 == 0).cast("int").alias("answer"), ((k * 31 % 1000) / F.lit(1000.0)).alias("confidence"))


@query("conflict_groups", f"WITH {_ANSWERS} SELECT l_id AS id, array_to_string(list(pair_id ORDER BY pair_id), ',') AS pairs FROM answers WHERE answer = 1 GROUP BY l_id HAVING count(*) > 1")
def conflict_groups(spark, sf_dir):
    return resolving.conflicts(_answers(spark, sf_dir)).select("id", F.array_join("pairs", ",").alias("pairs"))


@query("resolve_left_right", f"WITH {_ANSWERS}, l AS (SELECT *, CASE WHEN answer = 1 AND row_number() OVER (PARTITION BY l_id, answer ORDER BY confidence DESC, pair_id) = 1 THEN 1 ELSE 0 END AS k FROM answers) SELECT pair_id, CASE WHEN k = 1 AND row_number() OVER (PARTITION BY r_id, k ORDER BY confidence DESC, pair_id) = 1 THEN 1 ELSE 0 END AS kept FROM l")
def resolve_left_right(spark, sf_dir):
    return resolving.two_passes(_answers(spark, sf_dir)).select("pair_id", "kept")


#: Components of at most two by two: the best matching has a closed form.
_SMALL = "a AS (SELECT o_orderkey AS pair_id, (o_orderkey // 4) AS g, ((o_orderkey % 4) // 2)::int AS i, (o_orderkey % 2)::int AS j, (o_orderkey * 37 % 5 < 4)::int AS answer, (o_orderkey * o_orderkey % 1009) / 1009.0::double AS confidence FROM orders)"


@query("assignment", f"WITH {_SMALL}, w AS (SELECT g, coalesce(sum(1 + confidence) FILTER (answer = 1 AND i = j), 0) AS d, coalesce(sum(1 + confidence) FILTER (answer = 1 AND i <> j), 0) AS o FROM a GROUP BY g) SELECT pair_id, CASE WHEN answer = 1 AND ((i = j) = (d > o)) THEN 1 ELSE 0 END AS kept FROM a JOIN w USING (g)")
def assignment(spark, sf_dir):
    k = F.col("o_orderkey")
    g = F.floor(k / 4).cast("string")
    a = table(spark, sf_dir, "orders").select(k.alias("pair_id"), F.concat(g, F.lit("-"), F.floor(k % 4 / 2).cast("string")).alias("l_id"), F.concat(g, F.lit("-"), (k % 2).cast("string")).alias("r_id"), (k * 37 % 5 < 4).cast("int").alias("answer"), ((k * k % 1009) / F.lit(1009.0)).alias("confidence"))
    return resolving.one_to_one(a).select("pair_id", "kept")


@query("assignment_large")
def assignment_large(spark, sf_dir):
    return resolving.one_to_one(_answers(spark, sf_dir)).select("pair_id", "kept")


_PRF = "round(tp / (tp + fp)::double, 6) AS precision, round(tp / (tp + fn)::double, 6) AS recall, round(2 * tp / (2 * tp + fp + fn)::double, 6) AS f1"


@query("match_metrics", f"WITH {_ANSWERS}, t AS (SELECT DISTINCT l_id, r_id FROM answers WHERE pair_id % 2 = 0), c AS (SELECT (SELECT count(*) FROM answers a SEMI JOIN t ON a.l_id = t.l_id AND a.r_id = t.r_id WHERE answer = 1) AS tp, (SELECT count(*) FROM answers WHERE answer = 1) AS y, (SELECT count(*) FROM t) AS n), d AS (SELECT tp, y - tp AS fp, n - tp AS fn FROM c) SELECT *, {_PRF} FROM d")
def match_metrics(spark, sf_dir):
    a = _answers(spark, sf_dir)
    m = evaluating.match_quality(a, a.where("pair_id % 2 = 0").select("l_id", "r_id"))
    return m.select("tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("binary_prf", f"WITH d AS (SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS tp, count(*) FILTER (quality = 1 AND toxic = 0) AS fp, count(*) FILTER (quality = 0 AND toxic = 1) AS fn FROM labels) SELECT *, {_PRF} FROM d")
def binary_prf(spark, sf_dir):
    m = evaluating.label_quality(table(spark, sf_dir, "labels"), F.col("quality"), F.col("toxic"))
    return m.select("tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


#: Client accounts from events: users are clients, errors are failures.
_EVENTS = "e AS (SELECT event_id, user_id::varchar AS client, event_type AS provider, ts, (props->>'k')::bigint AS tokens, event_type <> 'error' AS ok FROM events)"


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("string").alias("client"), F.col("event_type").alias("provider"), "ts", F.get_json_object("props", "$.k").cast("bigint").alias("tokens"), (F.col("event_type") != "error").alias("ok"))


@query("rate_limit_window", f"WITH {_EVENTS} SELECT event_id, client, coalesce(epoch_us(ts) - epoch_us(lag(ts, 5) OVER (PARTITION BY client ORDER BY ts, event_id)) >= 36000000000, true) AS available FROM e")
def rate_limit_window(spark, sf_dir):
    return balancing.rate_limited(_events(spark, sf_dir), window_s=36000).select("event_id", "client", "available")


@query("client_usage", f"WITH {_EVENTS} SELECT event_id, client, count(*) OVER w AS requests, (sum(tokens) OVER w)::bigint AS total_tokens, (sum(tokens) OVER w) > 0.8 * 2000 AS near_quota FROM e WINDOW w AS (PARTITION BY client ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def client_usage(spark, sf_dir):
    return balancing.usage(_events(spark, sf_dir), 2000).select("event_id", "client", "requests", "total_tokens", "near_quota")


@query("error_trip", f"WITH {_EVENTS}, k AS (SELECT client, ts, row_number() OVER (PARTITION BY client ORDER BY ts, event_id) AS k FROM e WHERE NOT ok) SELECT c.client, coalesce(max(k), 0) AS errors, min(ts) FILTER (k = 4) AS tripped_at FROM (SELECT DISTINCT client FROM e) c LEFT JOIN k ON k.client = c.client GROUP BY c.client")
def error_trip(spark, sf_dir):
    return balancing.error_trips(_events(spark, sf_dir))


@query("client_stats", f"WITH {_EVENTS} SELECT provider, client, count(*) FILTER (ok) AS requests, coalesce(sum(tokens) FILTER (ok), 0)::bigint AS tokens, count(*) FILTER (NOT ok) AS errors, count(*) FILTER (NOT ok) <= 3 AS is_active FROM e GROUP BY provider, client")
def client_stats(spark, sf_dir):
    return balancing.client_stats(_events(spark, sf_dir))


@query("best_client", f"WITH {_EVENTS}, r AS (SELECT *, row_number() OVER (PARTITION BY client ORDER BY ts DESC, event_id DESC) AS k FROM e), s AS (SELECT client, CASE WHEN count(*) FILTER (NOT ok) > 3 THEN 0 ELSE count(*) FILTER (NOT ok) END AS errors, least(count(*), 5) AS queued, max(ts) AS last_used, coalesce(bool_or(timestamp '2024-02-01' - ts >= interval 60 second) FILTER (k = 5), true) AS free FROM r GROUP BY client) SELECT client FROM s WHERE free ORDER BY errors, queued, last_used, client LIMIT 1")
def best_client(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("provider", F.lit("p"))
    states = balancing.client_state(e, F.lit("2024-02-01 00:00:00").cast("timestamp"))
    return balancing.best_client(balancing.reactivated(states))


@query("parse_response_json", "SELECT conv_id, turn, text AS content, len(text)::bigint AS tokens FROM conversations")
def parse_response_json(spark, sf_dir):
    body = F.to_json(F.struct(F.array(F.struct(F.struct("role", F.col("text").alias("content")).alias("message"))).alias("choices"), F.struct(F.length("text").alias("total_tokens")).alias("usage")))
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", body.alias("j"))
    return c.select("conv_id", "turn", balancing.response_content(F.col("j")).alias("content"), balancing.response_tokens(F.col("j")).alias("tokens"))


@query("chat_requests", "SELECT conv_id, to_json({'model': 'm', 'messages': list({'role': role, 'content': text} ORDER BY turn)})::varchar AS body FROM conversations GROUP BY conv_id")
def chat_requests(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    return c.select("conv_id", balancing.chat_request(F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))), F.lit("m"), {"temperature": F.lit(1.0)}).alias("body"))


#: Relations between areas by arithmetic.
_RELATIONS = "rel AS (SELECT l_orderkey::varchar AS a, 'p' || l_partkey::varchar AS b, 2 AS label, max(l_quantity) / 50.0 AS prob FROM lineitem GROUP BY l_orderkey, l_partkey)"


@query("repair", f"WITH {_RELATIONS} SELECT a, b, CASE WHEN max(prob) OVER (PARTITION BY a) - prob > 0.1 AND prob < 0.7 THEN 0 ELSE label END AS label FROM rel")
def repair(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey").agg((F.max("l_quantity") / 50.0).alias("prob"))
    rel = r.select(F.col("l_orderkey").cast("string").alias("a"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("b"), F.lit(2).alias("label"), "prob")
    return refining.repaired(rel).select("a", "b", "label")


#: For each supplier: what is listed (left, right, label) and what follows, by the two rules.
_LISTED = [(0, 1, 2), (4, 0, 1), (4, 1, 0), (1, 4, 0), (2, 3, 1), (5, 2, 1), (3, 5, 0), (2, 6, 1), (3, 6, 0), (5, 6, 2), (7, 8, 0)]
_FOUND = {(4, 1): 2, (3, 6): 2, (2, 6): 2, (3, 5): 1}


@query("extend", f"SELECT (s_suppkey * 10 + i)::varchar AS a, (s_suppkey * 10 + j)::varchar AS b, v AS label FROM supplier, (VALUES {', '.join(str((i, j, _FOUND.get((i, j), v))) for i, j, v in _LISTED)}) t(i, j, v)")
def extend(spark, sf_dir):
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(v).alias("label")) for i, j, v in _LISTED])).alias("x")
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), each)
    return refining.extended(s.select((F.col("k") * 10 + F.col("x.i")).cast("string").alias("a"), (F.col("k") * 10 + F.col("x.j")).cast("string").alias("b"), "x.label"))


@query("classify")
def classify(spark, sf_dir):
    p = inputs.pois(spark, sf_dir).where("belong = 0").select("id", "k", F.col("name").alias("e_name"), F.col("category").alias("e_category"), F.col("name").contains("ring").cast("int").alias("e_type"))
    m = classifying.selected(p.where("k % 5 < 3"), p.where("k % 5 = 3"))
    return classifying.predicted(m, p.where("k % 5 = 4")).select("id", F.col("prediction").cast("int").alias("predicted"), F.col("e_type").cast("int").alias("e_type"))


@query("word_vectors", "SELECT vec_id % 50 AS w, i, round(avg(v), 6) AS v FROM (SELECT vec_id, unnest(range(1, 65)) AS i, unnest(embedding)::double AS v FROM embeddings) GROUP BY ALL")
def word_vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 50).alias("w"), F.concat(F.lit("w"), F.col("vec_id").cast("string")).alias("word"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    words = e.groupBy("w").agg(F.collect_list("word").alias("words"))
    got = classifying.looked_up(words, e.select("word", "vec"), "w", 64)
    return got.select("w", F.posexplode("embedded").alias("i", "v")).select("w", (F.col("i") + 1).cast("bigint").alias("i"), F.round("v", 6).alias("v"))


@query("resolution_pipeline")
def resolution_pipeline(spark, sf_dir):
    from .resolution import matched

    return matched(inputs.pois(spark, sf_dir), inputs.areas(spark, sf_dir), CITIES["nj"]).select("l_id", "r_id", "kept")
