"""SQL for DuckDB with the results of those queries here that SQL can express."""

from __future__ import annotations

# The rules' intervals are few enough here to test each against each page.
OP2 = """
WITH rules(host, path, verdict) AS (VALUES
  ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
parts AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
fits AS (
  SELECT p.page_id, p.host, p.path, r.host || r.path AS rule, r.verdict,
    row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) AS k
  FROM parts p LEFT JOIN rules r
    ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE k = 1
"""


# Every vector is compared with every centroid; a round is an assignment and the floors of the means.
_ROUND = """
a{i} AS MATERIALIZED (
  SELECT r, vec_id, x, k, d FROM (
    SELECT v.r, v.vec_id, v.x, c.k, list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d
    FROM v CROSS JOIN c{i} c)
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, k) = 1)"""
_MOVE = """,
m{i} AS MATERIALIZED (
  SELECT k, list((s - ((s % n + n) % n)) // n ORDER BY i) AS x FROM (
    SELECT k, i, sum(x[i])::HUGEINT AS s, count(*)::HUGEINT AS n FROM a{i}, range(1, 65) t(i) GROUP BY k, i) GROUP BY k),
c{j} AS MATERIALIZED (SELECT c.k, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN m{i} m USING (k)),"""
OP11 = (
    """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda c: floor(64 * c::DOUBLE)::HUGEINT) AS x
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS k, x FROM (SELECT sha256('1:' || vec_id) AS h, x FROM v ORDER BY h, x LIMIT 16)),"""
    + "".join(_ROUND.format(i=i) + _MOVE.format(i=i, j=i + 1) for i in range(3))
    + _ROUND.format(i=3)
    + """
SELECT vec_id, a.k::INTEGER AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY a.k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a3 a JOIN c3 c USING (k)
"""
)


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filters": OP2, "op11_centroid_clustering": OP11}
