"""Queries of the scalar functions and vector arithmetic."""

from __future__ import annotations

from pyspark.sql import functions as F

from placeloom.functions import likeness, text, vectors
from placeloom.functions.spatial import haversine, rounded_distance, time_parts, web_mercator_x, web_mercator_y
from placeloom.operators import areas as area_ops
from placeloom.operators import clustering, features, valued
from placeloom.sources.pois import plain_id

from . import inputs
from .inputs import sql_chars, sql_clean, sql_haversine, sql_rounded, sql_tokens, table
from .registry import query

CTE = f"WITH {inputs.sql()} "
#: All pairs of suppliers and customers that lie within the blocking's distance of each other.
_REACH = 400.0
PAIRS = CTE + f", pairs AS (SELECT l.id AS l_id, r.id AS r_id, l.name AS l_name, r.name AS r_name, l.category AS l_category, r.category AS r_category, l.address AS l_address, r.address AS r_address, l.longitude AS l_lon, l.latitude AS l_lat, r.longitude AS r_lon, r.latitude AS r_lat FROM pois l JOIN pois r ON l.belong = 0 AND r.belong = 1 AND abs(l.latitude - r.latitude) < 0.0037 WHERE {sql_haversine('r.longitude', 'r.latitude', 'l.longitude', 'l.latitude')} < {_REACH}) "


def sides(spark, sf_dir, *columns):
    """(left, right): id, coordinates and these columns of the records."""
    p = inputs.pois(spark, sf_dir)
    return [p.where(F.col("belong") == b).select("id", "longitude", "latitude", *columns) for b in (0, 1)]


def met(left, right, alike=None):
    """Pairs within reach, with the columns of both sides as l_ and r_ (coordinates as lon, lat), and their distance. alike: a column of
    both sides by which the pairs lie."""
    p = area_ops.meeting(right, left, _REACH, alike=alike and ([alike], [alike]))
    short = {"longitude": "lon", "latitude": "lat"}
    return p.toDF(*[x if x == "metres" else {"a": "r_", "b": "l_"}[x[0]] + short.get(x[2:], x[2:]) for x in p.columns])


def pairs(spark, sf_dir):
    return met(*sides(spark, sf_dir, "name", "category", "address"))


def measured(spark, sf_dir, columns, **measures):
    """l_id, r_id and measures of the records' columns (name=(column, column, measure))."""
    v = valued.Valued(*sides(spark, sf_dir, *columns), {k: (*m, None) for k, m in measures.items()})
    return v.onto(met(v.left, v.right), "l", "r").select("l_id", "r_id", *measures)


@query("web_mercator", CTE + "SELECT belong, id, round(x, 4) AS x, round(y, 4) AS y FROM pois")
def web_mercator(spark, sf_dir):
    p = inputs.pois(spark, sf_dir)
    return p.select("belong", "id", F.round(web_mercator_x(F.col("longitude")), 4).alias("x"), F.round(web_mercator_y(F.col("latitude")), 4).alias("y"))


@query("haversine_pairs", PAIRS + f"SELECT l_id, r_id, round({sql_haversine('l_lon', 'l_lat', 'r_lon', 'r_lat')}, 4) AS metres FROM pairs")
def haversine_pairs(spark, sf_dir):
    return pairs(spark, sf_dir).select("l_id", "r_id", F.round(haversine(F.col("l_lon"), F.col("l_lat"), F.col("r_lon"), F.col("r_lat")), 4).alias("metres"))


@query("compute_dist", PAIRS + f"SELECT l_id, r_id, CASE WHEN l_id::int % 50 = 0 THEN -1 ELSE {sql_rounded('l_lat', 'l_lon', 'r_lat', 'r_lon')} END AS dist_m FROM pairs")
def compute_dist(spark, sf_dir):
    lat = F.when(F.col("l_id").cast("int") % 50 == 0, "abc").otherwise(F.col("l_lat").cast("string"))
    return pairs(spark, sf_dir).select("l_id", "r_id", rounded_distance(lat, F.col("l_lon"), F.col("r_lat"), F.col("r_lon")).alias("dist_m"))


@query("bbox_filter", CTE + "SELECT belong, id FROM pois WHERE x BETWEEN 13223700 AND 13225700 AND y BETWEEN -3756300 AND -3755000")
def bbox_filter(spark, sf_dir):
    from placeloom.functions.spatial import in_box

    return inputs.pois(spark, sf_dir).where(in_box(F.col("x"), F.col("y"), 13223700.0, -3756300.0, 2000.0, 1300.0)).select("belong", "id")


@query("time_parts", "SELECT event_id, floor(value / 60)::bigint AS minutes, floor(value % 60)::bigint AS seconds, floor((value % 1) * 1000)::bigint AS millis FROM events")
def break_down_time(spark, sf_dir):
    m, s, ms = time_parts(F.col("value"))
    return table(spark, sf_dir, "events").select("event_id", m.alias("minutes"), s.alias("seconds"), ms.alias("millis"))


@query("plain_ids", "SELECT c_custkey, c_custkey::varchar AS plain FROM customer")
def plain_ids(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", plain_id(F.col("c_custkey").cast("double").cast("decimal(20,1)").cast("string")).alias("plain"))


@query("describe_entity", CTE + "SELECT belong, id, 'Name: ' || name || ', Category: ' || category || ', Address: ' || coalesce(address, 'nan') AS s, 'Name: ' || name || ', Address: ' || coalesce(address, 'nan') AS short FROM pois")
def describe_entity(spark, sf_dir):
    c = [F.col(x) for x in ("name", "category", "address")]
    return inputs.pois(spark, sf_dir).select("belong", "id", text.described(*c).alias("s"), text.described(*c, has_category=False).alias("short"))


@query("remove_brackets", CTE + f"SELECT belong, id, {sql_clean('name')} AS clean FROM pois")
def remove_brackets(spark, sf_dir):
    return inputs.pois(spark, sf_dir).select("belong", "id", text.without_brackets(F.col("name")).alias("clean"))


@query("remove_brackets_documents", f"SELECT doc_id, md5({sql_clean('text')}) AS digest FROM documents")
def remove_brackets_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.without_brackets(F.col("text"))).alias("digest"))


@query("char_jaccard", PAIRS + f", c AS (SELECT l_id, r_id, {sql_chars('l_name')} AS a, {sql_chars('r_name')} AS b FROM pairs) SELECT l_id, r_id, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::double, 6) AS sim FROM c")
def char_jaccard(spark, sf_dir):
    return measured(spark, sf_dir, ["name"], sim=("name", "name", lambda a, b: F.round(text.set_likeness(text.characters(a), text.characters(b)), 6)))


@query("char_containment", PAIRS + f", c AS (SELECT l_id, r_id, {sql_chars('l_name')} AS a, {sql_chars(sql_clean('r_name'))} AS b FROM pairs) SELECT l_id, r_id, list_has_all(a, b) OR list_has_all(b, a) AS within FROM c")
def char_containment(spark, sf_dir):
    return measured(spark, sf_dir, ["name"], within=("name", "name", lambda a, b: text.contained(a, text.without_brackets(b))))


@query("levenshtein_sim", PAIRS + "SELECT l_id, r_id, round(1 - levenshtein(lower(l_name), lower(r_name)) / greatest(length(l_name), length(r_name))::double, 6) AS sim FROM pairs")
def levenshtein_sim(spark, sf_dir):
    return measured(spark, sf_dir, ["name"], sim=("name", "name", lambda a, b: F.round(text.edit_likeness(a, b), 6)))


@query("process_alphanumeric", CTE + "SELECT belong, id, lower(regexp_replace('A00' || (k % 10)::varchar || ' ' || name, '([A-Za-z])0+([1-9])', '\\1\\2', 'g')) AS plain FROM pois")
def process_alphanumeric(spark, sf_dir):
    return inputs.pois(spark, sf_dir).select("belong", "id", text.plain_code(F.concat(F.lit("A00"), (F.col("k") % 10).cast("string"), F.lit(" "), F.col("name"))).alias("plain"))


_CATEGORY_IN = "category || CASE k % 4 WHEN 0 THEN '/其他美食' WHEN 1 THEN '、亲子 更多亲子服务' WHEN 2 THEN ' 豪华型' ELSE '干锅＆香锅+' END"


def _category_sql(s: str) -> str:
    return f"trim(regexp_replace(regexp_replace(regexp_replace({s}, '{text.CATEGORY_BREAKS}', ' ', 'g'), '{'|'.join(text.CATEGORY_STOPWORDS)}', ' ', 'g'), '\\s+', ' ', 'g'))"


_CATEGORY_SQL = _category_sql(_CATEGORY_IN)


def _category():
    tail = F.when(F.col("k") % 4 == 0, "/其他美食").when(F.col("k") % 4 == 1, "、亲子 更多亲子服务").when(F.col("k") % 4 == 2, " 豪华型").otherwise("干锅＆香锅+")
    return F.concat("category", tail)


@query("normalize_category", CTE + f"SELECT belong, id, {_CATEGORY_SQL} AS plain FROM pois")
def normalize_category(spark, sf_dir):
    return inputs.pois(spark, sf_dir).select("belong", "id", text.plain_category(_category()).alias("plain"))


_ADDRESS_IN = "CASE k % 5 WHEN 0 THEN '南京市江宁区双龙大道旁边' WHEN 1 THEN '经济技术开发区胜太路' WHEN 2 THEN '斜对面3号' WHEN 3 THEN '文靖路向北80米' ELSE coalesce(address, 'nan') END"


def _address():
    a = ["南京市江宁区双龙大道旁边", "经济技术开发区胜太路", "斜对面3号", "文靖路向北80米"]
    c = F.when(F.col("k") % 5 == 0, a[0])
    for i in (1, 2, 3):
        c = c.when(F.col("k") % 5 == i, a[i])
    return c.otherwise(F.coalesce("address", F.lit("nan")))


def _address_sql(s: str) -> str:
    for w in text.ADDRESS_DELETED:
        s = f"replace({s}, '{w}', '')"
    return f"trim({s})"


@query("normalize_address", CTE + f"SELECT belong, id, {_address_sql(_ADDRESS_IN)} AS plain FROM pois")
def normalize_address(spark, sf_dir):
    return inputs.pois(spark, sf_dir).select("belong", "id", text.plain_address(_address()).alias("plain"))


def _ordered_sql(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1 WHEN len({a}) = 0 OR len({b}) = 0 THEN 0 ELSE pow(0.9::double, len({a}) - len(list_filter(range(1, least(len({a}), len({b})) + 1), lambda i: {a}[i] = {b}[i]))) * len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) END"


@query("ordered_jaccard", PAIRS + f", t AS (SELECT l_id, r_id, {sql_tokens('l_name')} AS a, {sql_tokens('r_name')} AS b FROM pairs) SELECT l_id, r_id, round({_ordered_sql('a', 'b')}, 6) AS sim FROM t")
def ordered_jaccard(spark, sf_dir):
    return measured(spark, sf_dir, ["name"], sim=("name", "name", lambda a, b: F.round(text.ordered_likeness(a, b), 6)))


@query("jaro_winkler", PAIRS + "SELECT l_id, r_id, round(jaro_winkler_similarity(l_name, r_name), 6) AS sim FROM pairs")
def jaro_winkler(spark, sf_dir):
    return measured(spark, sf_dir, ["name"], sim=("name", "name", lambda a, b: F.round(likeness.jaro_winkler_likeness(a, b), 6)))


# The table of the longest common subsequence, row by row: each row is a list, made from the row before.
_LCS = "list_last(list_reduce(list_prepend(list_transform(range(0, length(b) + 1), lambda i: 0), list_transform(range(1, length(a) + 1), lambda i: [i])), lambda row, c: list_reduce(list_prepend([0], list_transform(range(1, length(b) + 1), lambda j: [j])), lambda done, j: list_append(done, CASE WHEN a[c[1]] = b[j[1]] THEN row[j[1]] + 1 ELSE greatest(row[j[1] + 1], list_last(done)) END))))"


@query("lcs", PAIRS + f", d AS (SELECT DISTINCT l_name AS a, r_name AS b FROM pairs) SELECT a, b, {_LCS}::int AS lcs FROM d")
def lcs(spark, sf_dir):
    return pairs(spark, sf_dir).select(F.col("l_name").alias("a"), F.col("r_name").alias("b")).distinct().select("a", "b", likeness.lcs(F.col("a"), F.col("b")).alias("lcs"))


def sql_likenesses(source: str, key: str) -> str:
    """CTEs over source (key columns, l_ and r_ name, category, address), the last of them likenesses (key, name_sim, category_sim, address_sim)."""
    sides = lambda f: ", ".join(f(s) for s in "lr")
    ordered = _ordered_sql(sql_tokens("l_plain"), sql_tokens("r_plain"))
    return f"""ready AS (SELECT {key}, {sides(lambda s: f"coalesce({s}_name, '') AS {s}_name, {sql_clean(f"coalesce({s}_name, '')")} AS {s}_short, coalesce({s}_category, '') AS {s}_category, {_category_sql(f"coalesce({s}_category, '')")} AS {s}_plain, {_address_sql(sql_clean(f"coalesce({s}_address, 'nan')"))} AS {s}_way")} FROM {source}),
each AS (SELECT {key}, 'n' AS kind, l_name = '' AS no_a, r_name = '' AS no_b, l_short AS a, r_short AS b, 0::double AS other FROM ready
 UNION ALL SELECT {key}, 'c', l_category = '', r_category = '', replace(l_plain, ' ', ''), replace(r_plain, ' ', ''), {ordered} FROM ready
 UNION ALL SELECT {key}, 'a', l_way = '', r_way = '', l_way, r_way, 0 FROM ready),
unlike AS (SELECT a, b, {_LCS} AS k FROM (SELECT DISTINCT a, b FROM each) WHERE NOT (list_has_all({sql_chars("a")}, {sql_chars("b")}) OR list_has_all({sql_chars("b")}, {sql_chars("a")}))),
judged_each AS (SELECT {key}, kind, CASE WHEN no_a AND no_b THEN 1 WHEN no_a OR no_b THEN 0 WHEN k IS NULL THEN 1 ELSE greatest(other, jaro_winkler_similarity(a, b), jaro_winkler_similarity(b, a), 2 * k / (length(a) + length(b))::double, k / greatest(length(a), length(b))::double) END AS sim FROM each LEFT JOIN unlike USING (a, b)),
likenesses AS (SELECT {key}, max(sim) FILTER (kind = 'n') AS name_sim, max(sim) FILTER (kind = 'c') AS category_sim, max(sim) FILTER (kind = 'a') AS address_sim FROM judged_each GROUP BY {key})"""


@query("attribute_likeness", PAIRS + f", {sql_likenesses('pairs', 'l_id, r_id')} SELECT l_id, r_id, round(name_sim, 6) AS name_sim, round(category_sim, 6) AS category_sim, round(address_sim, 6) AS address_sim FROM likenesses")
def attribute_likeness(spark, sf_dir):
    of = lambda c, f: (c, c, lambda a, b: F.round(f(a, b), 6))
    return measured(spark, sf_dir, ["name", "category", "address"], name_sim=of("name", likeness.name_likeness), category_sim=of("category", likeness.category_likeness), address_sim=of("address", likeness.address_likeness))


_SERIAL = f"'[COL] name [VAL] ' || {sql_clean('name')} || ' [COL] category [VAL] ' || replace({_CATEGORY_SQL}, ' ', '/') || ' [COL] address [VAL] ' || " + _address_sql(sql_clean(f"lower(regexp_replace({_ADDRESS_IN}, '([A-Za-z])0+([1-9])', '\\1\\2', 'g'))"))


def sql_serialized(side: str) -> str:
    """The serialised record of one side (l or r) of a pair."""
    n, c, a = (f"coalesce({side}_{x}, 'nan')" for x in ("name", "category", "address"))
    way = _address_sql(sql_clean(f"lower(regexp_replace({a}, '([A-Za-z])0+([1-9])', '\\1\\2', 'g'))"))
    return f"('[COL] name [VAL] ' || {sql_clean(n)} || ' [COL] category [VAL] ' || replace({_category_sql(c)}, ' ', '/') || ' [COL] address [VAL] ' || {way})"


#: CRC-32 of an ASCII word, bit by bit.
_CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(w) + 1), lambda i: ascii(w[i])::bigint)), lambda c, x: list_reduce(list_prepend(xor(c, x), list_transform(range(8), lambda i: i)), lambda d, i: CASE WHEN d % 2 = 1 THEN xor(d // 2, 3988292384) ELSE d // 2 END)), 4294967295)"


def sql_encoded(source: str) -> str:
    """CTEs over source (key, s), the last of them coded (key, i, v): what is not 0 of the default encoder's vector of s."""
    return f"""worded AS (SELECT key, unnest({sql_tokens("s")}) AS w FROM {source}),
numbered_words AS (SELECT w, {_CRC} AS h FROM (SELECT DISTINCT w FROM worded)),
signed AS (SELECT key, h % 64 AS i, sum(CASE WHEN h >= 2147483648 THEN 1 ELSE -1 END)::double AS v FROM worded JOIN numbered_words USING (w) GROUP BY ALL),
coded AS (SELECT key, i, v / sqrt(sum(v * v) OVER (PARTITION BY key)) AS v FROM signed WHERE v <> 0)"""


@query("serialize_entity", CTE + f"SELECT belong, id, {_SERIAL} AS s FROM pois")
def serialize_entity(spark, sf_dir):
    return inputs.pois(spark, sf_dir).select("belong", "id", text.serialized(F.col("name"), _category(), _address()).alias("s"))


@query("serialize_pair", PAIRS + "SELECT l_id, r_id, l_name || ' [SEP] ' || r_name AS s FROM pairs")
def serialize_pair(spark, sf_dir):
    return pairs(spark, sf_dir).select("l_id", "r_id", text.serialized_pair(F.col("l_name"), F.col("r_name")).alias("s"))


@query("textualize", CTE + "SELECT belong, id, 'COL name VAL ' || name || ' COL category VAL ' || category || ' ' AS s FROM pois")
def textualize(spark, sf_dir):
    return inputs.pois(spark, sf_dir).select("belong", "id", text.labelled_values([("e_name", F.col("name")), ("e_category", F.col("category"))]).alias("s"))


@query("token_pad", CTE + f", t AS (SELECT belong, id, list_transform(list_concat({sql_tokens('name')}, {sql_tokens('category')}), lambda w: replace(w, '_', ' ')) AS w FROM pois) SELECT belong, id, array_to_string(list_concat(w, list_transform(range(0, 16), lambda i: 'padding'))[1:16], '|') AS words FROM t")
def token_pad(spark, sf_dir):
    from placeloom.operators.classifying import token_input

    p = inputs.pois(spark, sf_dir).select("belong", "id", F.col("name").alias("e_name"), F.col("category").alias("e_category"))
    return token_input(p).select("belong", "id", F.array_join("words", "|").alias("words"))


@query("pad_single", CTE + f", t AS (SELECT belong, id, {sql_tokens('name')}[1:4] AS w FROM pois) SELECT belong, id, array_to_string(list_concat(['[CLS]'], w, ['[SEP]'], list_transform(range(0, 6), lambda i: '[PAD]'))[1:6], ' ') AS tokens, list_sum(list_transform(range(1, 7), lambda i: (i <= len(w) + 2)::int))::bigint AS mask FROM t")
def pad_single(spark, sf_dir):
    f = text.framed_single(text.tokens(F.col("name")), 6)
    return inputs.pois(spark, sf_dir).select("belong", "id", F.array_join(f["tokens"], " ").alias("tokens"), F.aggregate(f["mask"], F.lit(0).cast("bigint"), lambda s, x: s + x).alias("mask"))


_PAIR_SQL = f""", t AS (SELECT l_id, r_id, {sql_tokens("coalesce(l_address, 'nan') || ' ' || l_name")} AS a, {sql_tokens("r_address || ' ' || r_name")} AS b FROM pairs),
m AS (SELECT *, len(a) + len(b) + 3 - 12 AS more FROM t),
k AS (SELECT l_id, r_id, CASE WHEN more <= 0 OR more < len(b) THEN a WHEN more < len(a) THEN a[1:len(a) - more] ELSE a[1:50] END AS a, CASE WHEN more <= 0 THEN b WHEN more < len(b) THEN b[1:len(b) - more] WHEN more < len(a) THEN b ELSE b[1:50] END AS b FROM m)
SELECT l_id, r_id, array_to_string(list_concat(['[CLS]'], a, ['[SEP]'], b, ['[SEP]'], list_transform(range(0, 12), lambda i: '[PAD]'))[1:12], ' ') AS tokens, (len(b) + 1)::bigint AS second FROM k"""


@query("pad_pair", PAIRS + _PAIR_SQL)
def pad_pair(spark, sf_dir):
    left, right = sides(spark, sf_dir, "name", "address")
    words = lambda d, c: d.withColumn("words", text.tokens(F.concat(c, F.lit(" "), "name"))).drop("name", "address")  # noqa: E731  once a record
    p = met(words(left, F.coalesce("address", F.lit("nan"))), words(right, F.col("address")), "words")
    f = text.framed_pair(F.col("l_words"), F.col("r_words"), 12)
    return p.select("l_id", "r_id", F.array_join(f["tokens"], " ").alias("tokens"), f["second"].cast("bigint").alias("second"))


_VECTOR_PAIRS = "SELECT a.vec_id AS i, b.vec_id AS j, a.embedding::double[] AS a, b.embedding::double[] AS b FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id"


@query("cosine_pairs", f"WITH p AS ({_VECTOR_PAIRS}) SELECT i, j, round(list_cosine_similarity(a, b), 6) AS cosine FROM p")
def cosine_pairs(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("by"), F.col("vec_id").alias("i"), F.col("embedding").alias("v"))
    return vectors.pair_cosines(e).select("i", "j", F.round("cosine", 6).alias("cosine"))


@query("mean_pooling", "WITH x AS (SELECT label, unnest(embedding)::double AS v, unnest(range(1, 65)) AS i, vec_id FROM embeddings) SELECT label, i, round(avg(v) FILTER (vec_id % 3 <> 0), 6) AS v, round(max(v) FILTER (vec_id = f), 6) AS first FROM x JOIN (SELECT label, min(vec_id) AS f FROM embeddings GROUP BY label) USING (label) GROUP BY label, i")
def mean_pooling(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("label", F.struct("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v")).alias("s"))
    g = e.groupBy("label").agg(F.array_sort(F.collect_list("s")).alias("s")).select("label", F.transform("s", lambda x: x["v"]).alias("m"), F.transform("s", lambda x: (x["vec_id"] % 3 != 0).cast("double")).alias("mask"))
    p = g.select("label", vectors.masked_mean(F.col("m"), F.col("mask"), 64).alias("p"), vectors.first_vector(F.col("m")).alias("f"))
    return p.select("label", F.posexplode(F.arrays_zip("p", "f")).alias("i", "x")).select("label", (F.col("i") + 1).cast("bigint").alias("i"), F.round("x.p", 6).alias("v"), F.round("x.f", 6).alias("first"))


@query("check_vectors", "SELECT vec_id, len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) > 0 OR list_sum(list_transform(embedding, lambda x: x * x)) = 0 AS unusable FROM embeddings")
def check_vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", vectors.unusable(F.col("embedding")).alias("unusable"))


@query("distance_similarity", PAIRS + f", d AS (SELECT l_id, r_id, {sql_haversine('l_lon', 'l_lat', 'r_lon', 'r_lat')} AS d FROM pairs) SELECT l_id, r_id, round(1 - d / (SELECT max(d) FROM d), 6) AS dist_sim FROM d")
def distance_similarity(spark, sf_dir):
    p = pairs(spark, sf_dir).select("l_id", "r_id", haversine(F.col("l_lon"), F.col("l_lat"), F.col("r_lon"), F.col("r_lat")).alias("metres"))
    return features.distance_likeness(p).select("l_id", "r_id", F.round("dist_sim", 6).alias("dist_sim"))


@query("robust_scale", "WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS m, quantile_cont(value, 0.75) AS b FROM events) SELECT event_id, round((value - m) / CASE WHEN b = a THEN 1 ELSE b - a END, 6) AS scaled FROM events, q")
def robust_scale(spark, sf_dir):
    return features.robust_scaled(table(spark, sf_dir, "events").select("event_id", F.col("value").alias("scaled")), ["scaled"]).select("event_id", F.round("scaled", 6).alias("scaled"))


@query("feature_stats", "SELECT 'value' AS feature, round(avg(value), 4) AS mean, round(var_pop(value), 4) AS variance, count(*) FILTER (value IS NULL)::bigint AS unusable FROM events")
def feature_stats(spark, sf_dir):
    s = features.statistics(table(spark, sf_dir, "events"), ["value"])
    return s.select("feature", F.round("mean", 4).alias("mean"), F.round("variance", 4).alias("variance"), "unusable")


@query("eps_neighbors_aoi", CTE + f"SELECT a.id AS aoi_id, p.belong, p.id AS poi_id, round({sql_haversine('a.longitude', 'a.latitude', 'p.longitude', 'p.latitude')}, 3) AS metres FROM areas a, pois p WHERE {sql_haversine('a.longitude', 'a.latitude', 'p.longitude', 'p.latitude')} < 120")
def eps_neighbors_aoi(spark, sf_dir):
    n = area_ops.near(inputs.areas(spark, sf_dir), inputs.pois(spark, sf_dir), 120.0)
    return n.select(F.col("a_id").alias("aoi_id"), F.col("b_belong").alias("belong"), F.col("b_id").alias("poi_id"), F.round("metres", 3).alias("metres"))


_NEAR = sql_haversine("a.longitude", "a.latitude", "b.longitude", "b.latitude")


@query("eps_neighbors_poi", CTE + f"SELECT a.id AS a_id, b.id AS b_id, round({_NEAR}, 3) AS metres FROM pois a JOIN pois b ON a.belong = 1 AND b.belong = 0 AND a.id <> b.id AND abs(a.latitude - b.latitude) < 0.0004 WHERE {_NEAR} < 38.54")
def eps_neighbors_poi(spark, sf_dir):
    p = inputs.pois(spark, sf_dir)
    n = area_ops.near(p.where("belong = 1"), p.where("belong = 0"), 38.54)
    return n.where("a_id <> b_id").select("a_id", "b_id", F.round("metres", 3).alias("metres"))


@query("eps_percentile", "WITH s AS (SELECT vec_id, embedding::double[] AS v FROM embeddings), d AS (SELECT list_distance(a.v, b.v) AS d FROM s a JOIN s b ON a.vec_id < b.vec_id) SELECT round(quantile_cont(d, 0.05), 6) AS eps FROM d")
def eps_percentile(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return clustering.distance_percentile(e, "embedding", 5).select(F.round("eps", 6).alias("eps"))
