"""DuckDB SQL for the operators whose whole rows SQL can express (the driver's oracle)."""

#: CTEs ``steps`` (CRC-32 step table of the reflected polynomial 0xEDB88320) and, for a CTE ``named(f)`` of
#: distinct texts, ``crcs(f, crc)``: the unsigned CRC-32 of their UTF-8 bytes.
_STEPS = """steps AS MATERIALIZED (
  SELECT list(v ORDER BY b) AS step FROM (
    SELECT b, list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v
    FROM range(256) t(b)))"""
_CRCS = """crcs AS MATERIALIZED (
  SELECT f, xor(list_reduce(list_transform(range(1, length(h), 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT),
                            lambda a, x: xor(a >> 8, step[(xor(a, x) & 255) + 1]), 4294967295), 4294967295) AS crc
  FROM (SELECT f, hex(encode(f)) AS h FROM named), steps)"""

RESAMPLE = rf"""
WITH {_STEPS},
cut AS MATERIALIZED (
  SELECT side, row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                               '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT 's' AS side, row_number() OVER () AS row, doc_id, text FROM documents
        UNION ALL SELECT 't', row_number() OVER (), NULL, text FROM benchmark)),
runs AS MATERIALIZED (
  SELECT side, row, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM cut),
named AS (SELECT DISTINCT f FROM runs),
{_CRCS},
featured AS MATERIALIZED (SELECT side, row, crc % 10000 AS bucket FROM runs JOIN crcs USING (f)),
totals AS (SELECT bucket, count(*) FILTER (side = 's') AS s, count(*) FILTER (side = 't') AS t FROM featured GROUP BY bucket),
whole AS (SELECT sum(s)::BIGINT AS all_s, sum(t)::BIGINT AS all_t FROM totals),
gained AS (SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (all_s + 10000)) / ((s + 1)::DOUBLE * (all_t + 10000))))::BIGINT AS gain FROM totals, whole),
weighed AS (SELECT row, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM featured JOIN gained USING (bucket) WHERE side = 's' GROUP BY row),
scored AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM cut LEFT JOIN weighed USING (row) WHERE side = 's'),
ranked AS (SELECT *, CASE WHEN n_words >= 20 THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) END AS place FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT 25 * count(*) // 100 FROM scored WHERE n_words >= 20) THEN place END AS rank, n_words
FROM ranked
"""


def centroids(count: int = 40, rounds: int = 5, components: int = 64) -> str:
    """Rounds of assignment and exact floored means, one CTE each."""
    ctes = [f"""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE len(embedding) = {components} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {components})""",
            f"""at0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h) - 1 AS c, v FROM (SELECT sha256('2:' || vec_id) AS h, v FROM kept ORDER BY h LIMIT {count}))"""]
    for r in range(rounds + 1):
        ctes.append(f"""own{r} AS MATERIALIZED (
  SELECT row, arg_min(c, d * 1000 + c) AS c, min(d) AS d
  FROM (SELECT row, c, list_sum(list_transform(list_zip(k.v, a.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM kept k, at{r} a) GROUP BY row)""")
        if r < rounds:
            ctes.append(f"""at{r + 1} AS MATERIALIZED (
  SELECT a.c, coalesce(m.v, a.v) AS v FROM at{r} a LEFT JOIN (
    SELECT c, list(CASE WHEN s >= 0 THEN s // n ELSE -((-s + n - 1) // n) END ORDER BY i) AS v FROM (
      SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, unnest(range(1, {components + 1})) AS i FROM kept JOIN own{r} USING (row)) GROUP BY c, i)
    GROUP BY c) m ON m.c = a.c)""")
    return "WITH " + ",\n".join(ctes) + f"""
SELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, digest AS centroid_sha256
FROM own{rounds} JOIN kept USING (row) JOIN (SELECT c, sha256(array_to_string(v, ',')) AS digest FROM at{rounds}) USING (c)
"""
