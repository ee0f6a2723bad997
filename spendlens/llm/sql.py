"""DuckDB SQL that states the rows of operators' queries."""

from __future__ import annotations

from . import resampling as R
from . import vector_codes as V


def resampling() -> str:
    """op11: every feature spelt out and its CRC-32 taken byte by byte."""
    upper, lower = "".join(map(chr, range(65, 91))), "".join(map(chr, range(97, 123)))
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    b = R.BUCKETS
    return f"""WITH step AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
    lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, {R.POLYNOMIAL}) ELSE c >> 1 END)) AS t),
texts AS MATERIALIZED (
  SELECT own, row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '{word}') AS w
  FROM (SELECT 'd' AS own, doc_id, text FROM documents UNION ALL SELECT 'b', NULL, text FROM benchmark)),
feats AS MATERIALIZED (
  SELECT own, k, f, count(*) AS n FROM (
    SELECT own, k, unnest(w) AS f FROM texts UNION ALL
    SELECT own, k, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM texts)
  GROUP BY own, k, f),
hashed AS MATERIALIZED (
  SELECT f, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(CAST(octet_length(x) AS BIGINT)), lambda i: CAST('0x' || substr(hex(x), 2 * i + 1, 2) AS BIGINT))),
    lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295) % {b} AS bucket
  FROM (SELECT DISTINCT f, encode(f) AS x FROM feats), step),
counts AS (
  SELECT bucket, CAST(sum(CASE WHEN own = 'd' THEN n ELSE 0 END) AS DOUBLE) AS s, CAST(sum(CASE WHEN own = 'b' THEN n ELSE 0 END) AS DOUBLE) AS t
  FROM feats JOIN hashed USING (f) GROUP BY bucket),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln((t + 1) * ((SELECT coalesce(sum(s), 0) FROM counts) + {b}) / ((s + 1) * ((SELECT coalesce(sum(t), 0) FROM counts) + {b})))) AS BIGINT) AS gain
  FROM counts),
weights AS (
  SELECT k, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS total
  FROM feats JOIN hashed USING (f) JOIN gains USING (bucket) WHERE own = 'd' GROUP BY k),
scored AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features,
    CASE WHEN n_features > 0 THEN (total - ((total % n_features) + n_features) % n_features) // n_features ELSE 0 END AS weight,
    CAST('0x' || substr(sha256('{R.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
  FROM texts LEFT JOIN weights USING (k) WHERE own = 'd'),
final AS (
  SELECT *, CAST(weight + CAST(floor(-1000 * ln(-ln((h + CAST(0.5 AS DOUBLE)) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS BIGINT) AS score FROM scored),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= {R.LEAST_WORDS} ORDER BY score DESC, doc_id NULLS LAST) AS place,
    count(*) OVER (PARTITION BY n_words >= {R.LEAST_WORDS}) AS n FROM final)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, score,
  CAST(CASE WHEN n_words >= {R.LEAST_WORDS} AND place <= ({R.PERCENT} * n) // 100 THEN place END AS BIGINT) AS rank
FROM placed"""


def vector_codes() -> str:
    """op12: the rounds one after another."""
    p, e = V.PARTS, V.ENTRIES
    far = "CAST(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"
    steps = [f"""kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {V.SCALE}) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
parts AS MATERIALIZED (
  SELECT vec_id, label, p, v[p * len(v) // {p} + 1 : (p + 1) * len(v) // {p}] AS x FROM kept, (SELECT unnest(range({p})) AS p)),
book0 AS MATERIALIZED (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM parts QUALIFY e < {e})"""]
    for k in range(V.ROUNDS + 1):
        steps.append(f"""at{k} AS MATERIALIZED (
  SELECT vec_id, any_value(label) AS label, p, any_value(x) AS x, arg_min(e, d * {e} + e) AS e, min(d) AS d
  FROM (SELECT vec_id, label, p, x, e, {far} AS d FROM parts JOIN book{k} USING (p)) GROUP BY vec_id, p)""")
        if k < V.ROUNDS:
            steps.append(f"""book{k + 1} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN (
    SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY j) AS c FROM (
      SELECT p, e, j, CAST(sum(y) AS BIGINT) AS s, count(*) AS n FROM (SELECT p, e, unnest(x) AS y, unnest(range(len(x))) AS j FROM at{k}) GROUP BY p, e, j)
    GROUP BY p, e) m ON b.p = m.p AND b.e = m.e)""")
    last = V.ROUNDS
    return "WITH " + ",\n".join(steps) + f""",
codes AS (
  SELECT vec_id, any_value(label) AS label, string_agg(lower(format('{{:02x}}', e)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM at{last} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY p, e, j)) FROM (SELECT p, e, unnest(c) AS y, unnest(range(len(c))) AS j FROM book{last})) AS codebooks_sha256
FROM codes"""
