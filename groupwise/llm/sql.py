"""SQL for DuckDB that gives the rows of the queries that SQL can express, by brute force.

op1's model, the tokens of op4, op7 and op9, op6's propagation and op8's mixtures are no SQL; tests
hold these against plain versions, and op1's host, path and rule against SPLIT_SQL.
"""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
USABLE = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
#: Smallest node reachable by links l (x, y), both ways, from each node x of a table.
REACH = "reach(x, c) AS (SELECT x, x FROM {nodes} UNION SELECT l.y, r.c FROM reach r JOIN l ON l.x = r.x WHERE r.c < l.y), comp AS (SELECT x, min(c) AS c FROM reach GROUP BY x)"

OP2 = f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS u, vec_id, list_transform(embedding, lambda x: floor(256 * cast(x AS DOUBLE))) AS q FROM embeddings WHERE vec_id IS NOT NULL AND {USABLE}),
s AS (SELECT a.u, a.vec_id AS query_id, b.vec_id, cast(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.u <> b.u AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY score DESC, vec_id) AS place FROM s)
SELECT query_id, cast(place AS INTEGER) AS rank, vec_id, score FROM r WHERE place <= 5
"""

# documents without null or repeated ids, as the tables have them
OP3 = """
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, c, h[2 * c + 1 : 2 * c + 1122] AS p FROM (SELECT doc_id, h, unnest(range(0, greatest(0, len(h) // 2 - 49), 512)) AS c FROM d)),
w AS (SELECT doc_id, c + i AS i, p[2 * i + 1 : 2 * i + 100] AS s FROM (SELECT doc_id, c, p, unnest(range(0, least(512, len(p) // 2 - 49))) AS i FROM c)),
taken AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS first FROM w) WHERE first < doc_id),
marked AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS begins FROM taken),
numbered AS (SELECT doc_id, i, sum(begins) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM marked),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM numbered GROUP BY doc_id, span),
pieces AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM spans),
gone AS (SELECT p.doc_id, sum(b - a) AS n, count(*) AS spans, string_agg(d.h[2 * since + 1 : 2 * a], '' ORDER BY a) AS head, max(b) AS last FROM pieces p JOIN d USING (doc_id) GROUP BY p.doc_id)
SELECT d.doc_id, cast(len(h) // 2 AS BIGINT) AS n_bytes, cast(coalesce(n, 0) AS BIGINT) AS n_removed, cast(coalesce(spans, 0) AS BIGINT) AS n_spans,
sha256(unhex(CASE WHEN n IS NULL THEN h ELSE head || h[2 * last + 1 :] END)) AS kept_sha256 FROM d LEFT JOIN gone USING (doc_id)
"""

OP5 = f"""
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id AS x, label, cast(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND {USABLE} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.x, b.x AS y FROM v a JOIN v b ON a.label = b.label AND a.x <> b.x AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
{REACH.format(nodes="v")},
n AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT vec_id, coalesce(n.n, 0) AS n_links, coalesce(c, vec_id) AS component_id, coalesce(c, vec_id) = vec_id AS kept FROM embeddings LEFT JOIN comp ON comp.x = vec_id LEFT JOIN n ON n.x = vec_id
"""

OP10 = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id AS x, unnest(list_distinct(CASE WHEN len(w) < 3 THEN CASE WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END)) AS s FROM w),
n AS MATERIALIZED (SELECT x, count(*) AS n FROM s GROUP BY x),
t AS MATERIALIZED (SELECT x, n, s FROM s JOIN n USING (x)),
p AS (SELECT a.x, b.x AS y FROM t a JOIN t b ON a.s = b.s AND a.x < b.x AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n GROUP BY a.x, b.x, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
l AS MATERIALIZED (SELECT x, y FROM p UNION ALL SELECT y, x FROM p),
{REACH.format(nodes="n")}
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, doc_id) AS component_id FROM documents LEFT JOIN n ON n.x = doc_id LEFT JOIN comp ON comp.x = doc_id
"""

#: page_id, host, path and rule of every page.
SPLIT_SQL = f"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u),
r AS (SELECT * FROM (VALUES ('com', '/'), ('example.com', '/en/'), ('www.example.com', '/en/'), ('net', '/es/'), ('net', '/fr/')) AS t(rule_host, rule_path))
SELECT page_id, host, path, (SELECT max_by(rule_host || rule_path, length(rule_host || rule_path)) FROM r WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)) AS rule FROM h
"""

SQL = {"op2_topk": OP2, "op3_suffix_dedup": OP3, "op5_vector_dedup": OP5, "op10_jaccard_join": OP10}


def oracle_sql() -> dict[str, str]:
    return {name: " ".join(sql.split()) for name, sql in SQL.items()}
