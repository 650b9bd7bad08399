"""DuckDB SQL of the corpus queries that SQL can express, written from their definitions."""

from __future__ import annotations

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(table: str) -> str:
    return f"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS words FROM {table}"


def nearest(k: int) -> str:
    """a<k>: vec_id, v, cluster and d2 of every vector, by the centroids c<k> (k, c)."""
    each = "SELECT vec_id, v, k, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d2"
    return f"""a{k} AS MATERIALIZED (SELECT vec_id, v, k AS cluster, CAST(d2 AS BIGINT) AS d2 FROM ({each} FROM kept, c{k}) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d2, k) = 1)"""


def moved(k: int) -> str:
    """c<k>: means of the assignment before, cut down; empty clusters stay."""
    mean = "CAST(sum(x) AS BIGINT) AS s, count(*) AS n"
    return f"""c{k} AS MATERIALIZED (SELECT b.k, coalesce(m.c, b.c) AS c FROM c{k - 1} b LEFT JOIN (
  SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY pos) AS c FROM (
    SELECT cluster, pos, {mean} FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM a{k - 1}) GROUP BY 1, 2) GROUP BY 1) m ON m.cluster = b.k)"""


def clusters(k: int, rounds: int) -> str:
    steps = ",\n".join([nearest(0), *(s for i in range(1, rounds + 1) for s in (moved(i), nearest(i)))])
    return f"""WITH kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS k, v AS c FROM kept ORDER BY 1 LIMIT {k}),
{steps}
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, d2 AS distance, CAST(sum(d2) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(d2) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} ON k = cluster"""


CRC = f"""tb AS MATERIALIZED (SELECT list_transform(range(0, 256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
v AS (SELECT DISTINCT w FROM (SELECT unnest(words) AS w FROM d UNION ALL SELECT unnest(words) FROM b)),
h AS (SELECT w, list_transform(range(0, octet_length(encode(w))), lambda i: CAST('0x' || substr(hex(encode(w)), 2 * i + 1, 2) AS BIGINT)) AS bytes FROM v),
k AS MATERIALIZED (SELECT w, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM h, tb)"""


SQL = {
    "op11_centroids": clusters(40, 5),
    "op12_warc": """WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY html) ELSE page_id END AS first FROM p)
SELECT page_id, (SELECT any_value(url) FROM pages q WHERE q.page_id = f.page_id) AS url, CAST(n AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest,
  CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM f""",
    "op13_resampling": f"""WITH d AS MATERIALIZED (SELECT doc_id, {words("documents")}), b AS (SELECT {words("benchmark")}),
{CRC},
s AS (SELECT bucket, count(*) AS s FROM (SELECT unnest(words) AS w FROM d) JOIN k USING (w) GROUP BY 1),
t AS (SELECT bucket, count(*) AS t FROM (SELECT unnest(words) AS w FROM b) JOIN k USING (w) GROUP BY 1),
n AS (SELECT CAST((SELECT sum(s) FROM s) AS DOUBLE) AS s_all, CAST((SELECT sum(t) FROM t) AS DOUBLE) AS t_all),
g AS (SELECT i AS bucket, CAST(floor(1000 * ln(((CAST(coalesce(t, 0) AS DOUBLE) + 1) * (s_all + 10000)) / ((CAST(coalesce(s, 0) AS DOUBLE) + 1) * (t_all + 10000)))) AS BIGINT) AS gain
  FROM range(0, 10000) r(i) LEFT JOIN s ON s.bucket = i LEFT JOIN t ON t.bucket = i, n),
w AS (SELECT doc_id, CAST(sum(gain) AS BIGINT) AS weight FROM (SELECT doc_id, unnest(words) AS w FROM d) JOIN k USING (w) JOIN g USING (bucket) GROUP BY 1),
z AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(('0x' || substr(sha256('2024:' || doc_id), 1, 8)) AS BIGINT) + CAST(0.5 AS DOUBLE)) / 4294967296))) AS BIGINT) AS score FROM d LEFT JOIN w USING (doc_id)),
o AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place FROM z)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= (SELECT count(*) FROM z WHERE n_features >= 20) * 10 // 100 THEN place END AS rank FROM o""",
}
