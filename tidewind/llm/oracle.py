"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

OP1 = """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.rid, q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.rid <> c.rid WHERE q.vec_id % 20 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id NULLS LAST)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

OP3 = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(words), 0)::BIGINT AS size,
    coalesce(greatest(length(regexp_replace(text, '[^\p{L}]+', '', 'g')) /
      nullif(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')), 0) * varied * varied, 0.1), 0.1) AS weight
  FROM (SELECT *, CASE WHEN len(words) > 1 THEN ln(len(list_distinct(words))) / ln(len(words)) ELSE 1.0::DOUBLE END AS varied
    FROM (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM documents))
), k AS (
  SELECT *, -ln((('0x' || substr(md5(concat_ws('|', '42', coalesce(doc_id::VARCHAR, '-'), size::VARCHAR)), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE) / weight AS key
  FROM d
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT]::DOUBLE AS w
  FROM k GROUP BY source
), c AS (
  SELECT *, 2.0 * source_size::DOUBLE AS cap, 2.0 * source_size::DOUBLE / w AS ratio FROM s
), l AS (
  SELECT *, (1.5 * sum(source_size) OVER ()::DOUBLE - (sum(cap) OVER o - cap)) / (sum(w) OVER () - sum(w) OVER o + w) AS level
  FROM c WINDOW o AS (ORDER BY ratio, source IS NULL, source)
), t AS (
  SELECT source, source_size, least(cap, w * coalesce(max(CASE WHEN level <= ratio THEN level END) OVER (), 'infinity'::DOUBLE)) AS target FROM l
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM t
), p AS (
  SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
    sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS UNBOUNDED PRECEDING) AS upto
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size, source_size, target,
  (size * (epochs + CASE WHEN rest > 0 AND upto - size / 2.0 <= rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM p
"""
OP12 = r"""
WITH t AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), k AS (SELECT doc_id, max(quality) AS good, max(toxic) AS toxic FROM labels GROUP BY 1
), m AS (
  SELECT part, coalesce(good = 1, false) AS good, coalesce(toxic = 1, false) AS toxic,
    (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
    + 4 * (100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 3 * length(text))::INT + 8 * regexp_matches(text, '[#$%&*|]')::INT
    + 16 * (coalesce(doc_id, 9223372036854775807) > min(coalesce(doc_id, 9223372036854775807)) OVER (PARTITION BY text))::INT AS mask
  FROM t LEFT JOIN k USING (doc_id)
), n AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY ALL
), l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c, unnest([1, 2, 4, 8, 16]) AS bit
), o AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM l a, l b, l c, l d, l e
  WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31
), s AS (SELECT filter_order, step::INT AS step, bits[step] AS bit, coalesce(list_sum(bits[1 : step - 1]), 0)::INT AS before FROM o, (SELECT unnest(range(1, 6)) AS step)
)
SELECT part, filter_order, step,
  coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0)::BIGINT AS kept,
  coalesce(sum(n) FILTER (mask & bit > 0 AND mask & before = 0), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (mask & bit > 0 AND mask & before > 0), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (mask & bit > 0 AND mask & before = 0), 0)::BIGINT AS good_lost,
  coalesce(sum(toxic) FILTER (mask & bit > 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost,
  coalesce(sum(n * 120 // greatest(bit_count(mask), 1)) FILTER (mask & bit > 0), 0)::BIGINT AS shapley
FROM n, s GROUP BY ALL
"""

OP13_ROUND = """, a{r} AS MATERIALIZED (
  SELECT rid, p, min(struct_pack(d := list_dot_product(v, v) - 2 * list_dot_product(v, c) + list_dot_product(c, c), j := j)) AS m FROM x JOIN b{r} USING (p) GROUP BY ALL
), m{r} AS (
  SELECT p, j, list(y ORDER BY k) AS c FROM (
    SELECT p, j, k, floor(sum(y) / count(*)) AS y FROM (SELECT p, a.m.j AS j, unnest(v) AS y, generate_subscripts(v, 1) AS k FROM a{r} a JOIN x USING (rid, p)) GROUP BY ALL)
  GROUP BY ALL
), b{n} AS MATERIALIZED (SELECT p, j, coalesce(m.c, b.c) AS c FROM b{r} b LEFT JOIN m{r} m USING (p, j))
"""

OP13 = (
    """
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), x AS MATERIALIZED (SELECT rid, p, e[p * len(e) // 4 + 1 : (p + 1) * len(e) // 4] AS v FROM kept, (SELECT unnest(range(4)) AS p)
), b0 AS MATERIALIZED (SELECT p, rid - 1 AS j, v AS c FROM x WHERE rid <= 256)"""
    + "".join(OP13_ROUND.format(r=r, n=r + 1) for r in range(4))
    + """, a4 AS MATERIALIZED (
  SELECT rid, p, min(struct_pack(d := list_dot_product(v, v) - 2 * list_dot_product(v, c) + list_dot_product(c, c), j := j)) AS m FROM x JOIN b4 USING (p) GROUP BY ALL
), f AS (SELECT rid, string_agg(format('{:02x}', a4.m.j), '' ORDER BY p) AS code, sum(a4.m.d)::BIGINT AS error FROM a4 GROUP BY 1
), g AS (SELECT sha256(string_agg(y::BIGINT::VARCHAR, ',' ORDER BY p, j, k)) AS sha FROM (SELECT p, j, unnest(c) AS y, generate_subscripts(c, 1) AS k FROM b4))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, sha AS codebooks_sha256 FROM f JOIN kept USING (rid), g
"""
)


def oracle_sql() -> dict[str, str]:
    return {"op1_top_k": OP1, "op3_mixing": OP3, "op12_filter_audit": OP12, "op13_codes": OP13}
