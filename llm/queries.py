"""The queries of this folder and their SQL."""

from __future__ import annotations

from llm import bpe, centroids, divergence, extraction, fingerprint, language, mixing, neardup, neighbours, packing, sharding, suffixes, toxicity

QUERIES = {
    "op1_fingerprint": fingerprint.op1_fingerprint,
    "op2_suffixes": suffixes.op2_suffixes,
    "op3_extraction": extraction.op3_extraction,
    "op4_packing": packing.op4_packing,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_bpe": bpe.op6_bpe,
    "op7_neighbours": neighbours.op7_neighbours,
    "op8_sharding": sharding.op8_sharding,
    "op9_neardup": neardup.op9_neardup,
    "op10_language": language.op10_language,
    "op11_divergence": divergence.op11_divergence,
    "op12_mixing": mixing.op12_mixing,
    "op13_centroids": centroids.op13_centroids,
}


def lloyd(k: int, rounds: int, dim: int, scale: int, seed: int) -> str:
    """SQL of `centroids.cluster`: one pair of expressions a round, every vector against every centroid."""
    first = f"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS x, embedding FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: isfinite(x))) = {dim}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), embedding) - 1 AS c, x FROM v QUALIFY c < {k})"""
    nearest = """a{n} AS MATERIALIZED (
  SELECT r, c, d FROM (SELECT v.r, c.c, list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, c{n} c)
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)"""
    means = """c{m} AS MATERIALIZED (
  SELECT c.c, coalesce(m.x, c.x) AS x FROM c{n} c LEFT JOIN (
    SELECT c, list(mean ORDER BY j) AS x FROM (
      SELECT c, j, ((sum(y) - ((sum(y) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS mean
      FROM (SELECT a.c, unnest(v.x) AS y, generate_subscripts(v.x, 1) AS j FROM a{n} a JOIN v USING (r)) GROUP BY c, j) GROUP BY c) m ON m.c = c.c)"""
    parts = [first, *(t.format(n=n, m=n + 1) for n in range(rounds) for t in (nearest, means)), nearest.format(n=rounds)]
    return "WITH " + ",\n".join(parts) + f"""
SELECT v.vec_id, a.c::INTEGER AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{rounds} a JOIN v USING (r) JOIN c{rounds} c ON c.c = a.c"""


#: Brute force where SQL can say it; the others have no SQL form and are held against brute force in tests.
ORACLES = {
    "op11_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 10),
n AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
size AS (SELECT g.lang, g.source, coalesce(sum(n.n), 0) AS total FROM g LEFT JOIN n USING (lang, source) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v, sum(total) AS total FROM k GROUP BY lang),
p AS (SELECT lang, source, term, coalesce(n.n, 0) AS n, 1 + ((1000000000::HUGEINT * (coalesce(n.n, 0) + 2)) // (size.total + 2 * v.v))::BIGINT AS p
  FROM size JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN n USING (lang, source, term)),
q AS (SELECT lang, term, 1 + ((1000000000::HUGEINT * (k.total + 2)) // (v.total + 2 * v.v))::BIGINT AS q FROM k JOIN v USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
every AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pairs.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM every
QUALIFY part = 'pair' OR rank <= 10""",
    "op12_mixing": r"""
WITH q AS (SELECT doc_id, avg(quality) AS quality FROM labels GROUP BY doc_id),
d AS (SELECT documents.doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(text, '')) AS digest,
    coalesce(greatest(0.25, least(4.0, 0.5 + 1.5 * quality)), 1.0) AS weight
  FROM documents LEFT JOIN q USING (doc_id)),
e AS (SELECT *, row_number() OVER () AS r, -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || digest), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496) / weight::DOUBLE AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size, 2.0::DOUBLE * sum(size)::DOUBLE AS cap, [3.0::DOUBLE, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1] AS w,
    row_number() OVER (ORDER BY source NULLS LAST) AS place FROM e GROUP BY source),
f AS (SELECT *, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS total,
    coalesce(sum(cap) OVER (ORDER BY cap / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS paid,
    sum(w) OVER (ORDER BY cap / w, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM s),
g AS (SELECT *, cap <= (total - paid) * w / weights AS is_full FROM f),
t AS (SELECT source, source_size, CASE WHEN is_full THEN cap ELSE
    (total - sum(CASE WHEN is_full THEN cap ELSE 0::DOUBLE END) OVER ()) * w / sum(CASE WHEN is_full THEN 0::DOUBLE ELSE w END) OVER () END AS target FROM g),
p AS (SELECT e.*, t.source_size, t.target, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs,
    coalesce(sum(size) OVER (PARTITION BY e.source ORDER BY key, doc_id, digest, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM e JOIN t ON e.source IS NOT DISTINCT FROM t.source),
u AS (SELECT *, target - epochs * source_size AS rest, before + size <= target - epochs * source_size AS fits FROM p),
h AS (SELECT *, max(rest) OVER x - coalesce(sum(size) FILTER (fits) OVER x, 0) AS gap FROM u WINDOW x AS (PARTITION BY source)),
c AS (SELECT r FROM h WHERE NOT fits AND abs(gap - size) < gap QUALIFY row_number() OVER (PARTITION BY source ORDER BY abs(gap - size), key, before) = 1)
SELECT doc_id, size, source_size, target, (size * (epochs + CASE WHEN fits OR c.r IS NOT NULL THEN 1 ELSE 0 END))::BIGINT AS taken
FROM h LEFT JOIN c ON c.r = h.r""",
    "op13_centroids": lloyd(centroids.K, centroids.ROUNDS, centroids.DIM, centroids.SCALE, centroids.SEED),
    "op9_neardup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN []::VARCHAR[] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b USING (shingle) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * shared >= 75 * (nx.n + ny.n - shared)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
c AS (SELECT x, min(y) AS least FROM r GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(c.least, d.doc_id)) AS component_id,
  d.doc_id = least(d.doc_id, coalesce(c.least, d.doc_id)) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.x = d.doc_id""",
}
