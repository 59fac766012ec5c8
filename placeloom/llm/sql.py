"""DuckDB SQL of the text operators that SQL can express whole: op3 and op10. The others hold models, a tokenizer or hash
functions that DuckDB lacks; how tests/llm checks each is in the README."""

from .secret_scan import ADDED, KINDS


def secrets() -> str:
    def one(order: int, kind: str, pattern: str, least: int) -> str:
        p = "'" + pattern.replace("'", "''") + "'"
        return f"SELECT r, '{kind}' AS kind, {order} AS o, {least} AS least, regexp_split_to_array(t, {p}) AS g, regexp_extract_all(t, {p}, 2) AS v, regexp_extract_all(t, {p}, 1) AS h FROM d WHERE regexp_matches(t, {p})"

    found = "\nUNION ALL ".join(one(i, *k) for i, k in enumerate((*KINDS, ADDED)))
    size = lambda a: f"coalesce(list_sum(list_transform({a}, lambda x: length(x))), 0)"
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, coalesce(source, '') AS owner, coalesce(source, '') || chr(1) || coalesce(lang, '') AS repository FROM documents),
f AS ({found}),
i AS (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM f),
s AS (SELECT r, kind, o, v[i] AS value, ({size("g[1:i]")} + {size("h[1:i - 1]")} + {size("v[1:i - 1]")})::bigint AS a, length(h[i]) + length(v[i]) AS n FROM i
 WHERE length(v[i]) >= least AND (kind <> '{ADDED[0]}' OR (regexp_matches(v[i], '[0-9]') AND regexp_matches(v[i], '[A-Z]') AND regexp_matches(v[i], '[a-z]')))),
held AS (SELECT value, count(DISTINCT owner) AS owners FROM s JOIN d USING (r) GROUP BY value),
j AS (SELECT r, kind, o, a, kind || ':' || a || ':' || (a + n) AS text, owners <= 2 AS live FROM s JOIN held USING (value) WHERE owners <= 2 OR kind <> '{ADDED[0]}')
SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{k[0]}') AS n_{k[0]}" for k in KINDS)}, sha256(coalesce(string_agg(text, ',' ORDER BY a, o) FILTER (kind <> '{ADDED[0]}'), '')) AS base_sha256, coalesce(string_agg(text, ',' ORDER BY a, o), '') AS spans, count(*) FILTER (live) AS n_live
FROM d LEFT JOIN j USING (r) GROUP BY r, doc_id"""


def near_dedup(percent: int = 85) -> str:
    return f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, len(s)::bigint AS n FROM l),
s AS (SELECT doc_id, unnest(s) AS s FROM l),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b USING (s) WHERE a.doc_id < b.doc_id GROUP BY ALL),
k AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= {percent} * (x.n + y.n - common)),
e AS (SELECT a, b FROM k UNION ALL SELECT b, a FROM k),
reach AS (SELECT doc_id AS d, doc_id AS m FROM n UNION SELECT reach.d, e.b FROM reach JOIN e ON reach.m = e.a)
SELECT n.doc_id, n.n AS n_shingles, min(m) AS component_id, min(m) = n.doc_id AS kept FROM n JOIN reach ON d = n.doc_id GROUP BY n.doc_id, n.n"""
