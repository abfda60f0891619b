"""SQL for the llm queries that SQL can express. The others need XXH64, tokenizers or trained models."""

from __future__ import annotations

_EMBEDDINGS = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
g AS (SELECT * FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS i, b.vec_id AS j FROM g a JOIN g b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS i, vec_id AS j FROM v UNION SELECT reach.i, p.j FROM reach JOIN p ON reach.j = p.i),
c AS (SELECT i, min(j) AS component_id FROM reach GROUP BY i),
n AS (SELECT i, count(*) AS n_links FROM p GROUP BY i)
SELECT v.vec_id, coalesce(n_links, 0) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN c ON v.vec_id = c.i LEFT JOIN n ON v.vec_id = n.i"""

_MIXING = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size, md5('42:' || coalesce(doc_id::VARCHAR, '')) AS key, md5(coalesce(text, '')) AS tie FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM d GROUP BY source),
l AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS total,
  coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
  sum(weight) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM s),
m AS (SELECT arg_min((total - capped) / rest, cap / weight) AS level FROM l WHERE (total - capped) / rest * weight <= cap),
t AS (SELECT source, source_size, CASE WHEN level IS NULL THEN cap ELSE least(cap, level * weight) END AS target FROM l, m),
e AS (SELECT source, source_size, target, least(round(target), floor(2.0 * source_size))::BIGINT AS ends FROM t),
x AS (SELECT d.*, e.source_size, e.target, e.ends, (sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size, tie, rid) - size)::BIGINT AS start FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source),
b AS (SELECT greatest(1, ceil(sum(target) / 131072))::BIGINT AS block, sum(target) AS total, ceil(sum(target) / greatest(1, ceil(sum(target) / 131072)))::BIGINT AS n FROM t),
u AS (SELECT source, coalesce(sum(target) OVER (ORDER BY source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) / total, 0) AS u FROM t, b WHERE target > 0),
v AS (SELECT i AS slot, (i + 0.5::DOUBLE) * 0.6180339887498949::DOUBLE - floor((i + 0.5::DOUBLE) * 0.6180339887498949::DOUBLE) AS u FROM (SELECT unnest(range(n)) AS i FROM b)),
drawn AS (SELECT slot, source, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS rank FROM (SELECT v.slot, u.source FROM v ASOF JOIN u ON v.u >= u.u)),
need AS (SELECT source, ceil(ends / block)::BIGINT AS slots FROM e, b),
have AS (SELECT need.source, slots, count(drawn.slot) AS n FROM need LEFT JOIN drawn ON need.source IS NOT DISTINCT FROM drawn.source GROUP BY need.source, slots),
late AS (SELECT b.n + row_number() OVER (ORDER BY rank, source NULLS LAST) - 1 AS slot, source, rank FROM (SELECT source, unnest(range(n, slots)) AS rank FROM have), b),
plan AS (SELECT slot, drawn.source, rank FROM drawn JOIN need ON drawn.source IS NOT DISTINCT FROM need.source WHERE rank < slots UNION ALL SELECT slot, source, rank FROM late),
span AS (SELECT rid, source, start + pass * source_size AS lo, least(start + pass * source_size + size, ends) AS hi FROM x, (SELECT unnest([0, 1]) AS pass) WHERE size > 0),
piece AS (SELECT rid, source, lo, hi, unnest(range(lo // block, (hi - 1) // block + 1)) AS rank FROM span, b WHERE lo < hi),
took AS (SELECT rid, sum(least(hi, (piece.rank + 1) * block) - greatest(lo, piece.rank * block)) AS taken, min(slot) AS first_slot, count(*) AS n_pieces
  FROM piece JOIN plan ON piece.source IS NOT DISTINCT FROM plan.source AND piece.rank = plan.rank, b GROUP BY rid)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken, first_slot, coalesce(n_pieces, 0) AS n_pieces FROM x LEFT JOIN took USING (rid)"""

_RESAMPLING = """
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS tab),
lower_case AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
aims AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word FROM benchmark),
docs AS (SELECT rid, unnest(words) AS word FROM lower_case),
bytes AS (SELECT word, list_transform(range(1, len(hex(word)), 2), lambda p: (instr('0123456789ABCDEF', substr(hex(word), p, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(hex(word), p + 1, 1)) - 1) AS b FROM (SELECT word FROM docs UNION SELECT word FROM aims)),
buckets AS (SELECT word, xor(list_reduce(list_prepend(4294967295, b)::BIGINT[], lambda c, x: xor(tab[xor(c & 255, x) + 1], c // 256)), 4294967295) % 10000 AS bucket FROM bytes, crc),
s AS (SELECT bucket, count(*) AS n FROM docs JOIN buckets USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM aims JOIN buckets USING (word) GROUP BY bucket),
gain AS (SELECT s.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1.0::DOUBLE) * ((SELECT sum(n) FROM s)::DOUBLE + 10000) / ((s.n + 1.0::DOUBLE) * (coalesce((SELECT sum(n) FROM t), 0)::DOUBLE + 10000))))::BIGINT AS g FROM s LEFT JOIN t USING (bucket)),
sums AS (SELECT rid, sum(g)::BIGINT AS g, count(*) AS n FROM docs JOIN buckets USING (word) JOIN gain USING (bucket) GROUP BY rid),
w AS (SELECT rid, doc_id, len(words)::BIGINT AS n_features, coalesce((g - ((g % n) + n) % n) // n, 0)::BIGINT AS weight, list_reduce(list_prepend(0, list_transform(range(1, 9), lambda p: instr('0123456789abcdef', substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), p, 1)) - 1))::BIGINT[], lambda c, x: c * 16 + x) AS h
  FROM lower_case LEFT JOIN sums USING (rid)),
x AS (SELECT *, (weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score FROM w),
r AS (SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank, count(*) OVER () AS n FROM x WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM x LEFT JOIN r USING (rid)"""

_EXACT = """
WITH d AS (SELECT doc_id, coalesce(length(text), 0) AS n, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g') AS t FROM documents),
g AS (SELECT t, count(*) AS group_size, first(doc_id ORDER BY n DESC, doc_id NULLS LAST) AS keep_id FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)"""

_SEARCH = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM documents WHERE text IS NOT NULL),
q AS (SELECT row_number() OVER () AS q, item_id, list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS terms FROM benchmark WHERE text IS NOT NULL),
a AS (SELECT count(*)::BIGINT AS N, sum(len(terms))::BIGINT AS L FROM d WHERE len(terms) > 0),
m AS (SELECT rid, doc_id, 100 - 50 + (50 * len(terms)::BIGINT * N) // L AS m FROM d, a WHERE len(terms) > 0),
p AS (SELECT rid, term, count(*)::BIGINT AS tf FROM (SELECT rid, unnest(terms) AS term FROM d) GROUP BY rid, term),
w AS (SELECT term, floor(1000 * ln((2 * N + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), a),
s AS (SELECT q, item_id, rid, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM (SELECT q, item_id, unnest(terms) AS term FROM q) JOIN p USING (term) JOIN w USING (term) JOIN m USING (rid) GROUP BY q, item_id, rid, doc_id),
r AS (SELECT item_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 50"""

ORACLE = {"op5_embedding_dups": _EMBEDDINGS.strip(), "op7_mixing": _MIXING.strip(), "op11_search": _SEARCH.strip(), "op12_resampling": _RESAMPLING.strip(), "op13_exact_dedup": _EXACT.strip()}
