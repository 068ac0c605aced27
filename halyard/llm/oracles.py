"""DuckDB SQL of the training-data queries that SQL can state."""

from __future__ import annotations

from halyard.llm import kmeans, secrets

_KEYWORDS = ("password", "passwd", "secret", "token")


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" for c in word)


def _assign() -> str:
    words = "|".join([*map(_either_case, _KEYWORDS), f"{_either_case('api')}_?{_either_case('key')}"])
    return rf"""({words})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def op11_secret_scan() -> str:
    """Matches and the pieces between them give the places of each kind."""
    patterns = {"assign": (_assign(), 2), "access": (r"AKIA[A-Z0-9]{16,}", 0), "hex": (r"[0-9a-f]{24,}", 0), "loose": (r"[A-Za-z0-9+/_-]{20,}", 0)}
    raw = " UNION ALL ".join(
        f"SELECT r, repo, t, '{kind}' AS kind, {k} AS k, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {group}) AS v, string_split_regex(t, '{p}') AS p FROM d"
        for k, (kind, (p, group)) in enumerate(patterns.items())
    )
    words = " AND ".join(f"NOT contains(lower(value), '{w}')" for w in secrets.PLACEHOLDERS)
    n = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in secrets.KINDS)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, source AS repo FROM documents),
raw AS ({raw}),
each AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM raw),
places AS (SELECT r, repo, kind, k, m[i] AS match, v[i] AS value,
    CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s FROM each),
hits AS (SELECT r, repo, kind, k, value, s, s + length(match) AS e FROM places WHERE kind <> 'assign' OR length(value) >= 6),
base AS (SELECT * FROM hits WHERE kind <> 'loose'),
loose AS (SELECT * FROM hits h WHERE kind = 'loose' AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]')
    AND NOT EXISTS (SELECT 1 FROM base b WHERE b.r = h.r AND b.s < h.e AND b.e > h.s)),
seen AS (SELECT DISTINCT r, repo, value, e - length(value) AS s, e FROM (SELECT * FROM base UNION ALL SELECT * FROM loose)),
owners AS (SELECT value, count(DISTINCT coalesce('x' || split_part(repo, '/', 1), '')) AS n FROM seen GROUP BY value),
judged AS (SELECT r, s, e, n >= {secrets.WIDE_OWNERS} AS copied, n < {secrets.WIDE_OWNERS} AND len(list_distinct(string_split(value, ''))) >= {secrets.LIVE_CHARACTERS} AND regexp_matches(value, '[0-9]') AND {words} AS live
    FROM seen JOIN owners USING (value)),
spans AS (SELECT r, kind, k, s, e FROM base UNION ALL SELECT r, '{secrets.LIVE}', 9, s, e FROM judged WHERE live),
shown AS (SELECT r, {n}, count(*) FILTER (kind = '{secrets.LIVE}') AS n_live,
    coalesce(string_agg(concat_ws(':', kind, s, e), ',' ORDER BY s, k, e) FILTER (k < 9), '') AS base,
    string_agg(concat_ws(':', kind, s, e), ',' ORDER BY s, k, e) AS spans FROM spans GROUP BY r),
copies AS (SELECT r, count(*) FILTER (copied) AS n_copied FROM judged GROUP BY r)
SELECT doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in secrets.KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
    coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
FROM d LEFT JOIN shown USING (r) LEFT JOIN copies USING (r)"""


def op13_centroids() -> str:
    """Each round as one step of assignment and one of averages."""
    size, k = kmeans.SIZE, kmeans.CLUSTERS
    gap = "list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    steps = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({kmeans.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT v, sha256('{kmeans.SEED}:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h FROM kept ORDER BY h, v LIMIT {k}))",
    ]
    for i in range(kmeans.ROUNDS + 1):
        steps.append(f"d{i} AS MATERIALIZED (SELECT a.r, a.vec_id, a.v, b.c, {gap} AS d FROM kept a, c{i} b), a{i} AS MATERIALIZED (SELECT * FROM d{i} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)")
        if i < kmeans.ROUNDS:
            steps.append(
                f"""m{i} AS MATERIALIZED (SELECT c, list(x ORDER BY j) AS v FROM (SELECT c, j, CAST(floor(sum(x) / count(*)) AS BIGINT) AS x FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM a{i}) GROUP BY c, j) GROUP BY c),
c{i + 1} AS MATERIALIZED (SELECT c{i}.c, coalesce(m{i}.v, c{i}.v) AS v FROM c{i} LEFT JOIN m{i} USING (c))"""
            )
    last = kmeans.ROUNDS
    return f"""WITH {', '.join(steps)},
sums AS (SELECT c, sum(d) AS s FROM a{last} GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(s AS BIGINT) AS cluster_inertia, CAST((SELECT sum(d) FROM a{last}) AS BIGINT) AS inertia,
    sha256(array_to_string(c{last}.v, ',')) AS centroid_sha256
FROM a{last} JOIN sums USING (c) JOIN c{last} USING (c)"""


def all_oracles() -> dict[str, str]:
    return {f.__name__: f() for f in (op11_secret_scan, op13_centroids)}
