"""DuckDB SQL for the operators that SQL can state, over the same tables."""

NEAR_VECTORS = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x, CASE WHEN embedding IS NULL OR len(embedding) = 0 OR label IS NULL THEN 0.0
         ELSE list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) END AS square
  FROM embeddings
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE a.square > 0 AND b.square > 0 AND list_dot_product(a.x, b.x) / sqrt(a.square) / sqrt(b.square) >= 0.93
), reach(vec_id, other) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON l.a = r.other
), least AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT v.vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links, least.component_id, v.vec_id = least.component_id AS kept
FROM v JOIN least USING (vec_id) LEFT JOIN n USING (vec_id)
"""

# crc32 by its table; rows after damage numbered; cheapest and then least audit of each state, row by row
CONVERSATIONS = r"""
WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
         lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), picked AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce([4294967295] || list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda s: ord(s)::BIGINT),
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS pick
  FROM conversations, crc_table
), hurt AS (
  SELECT conv_id, turn, CASE WHEN pick = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN pick = 1 THEN '' WHEN pick = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM picked, (VALUES (1), (2)) AS copies(k) WHERE pick <> 0 AND (k = 1 OR pick = 3)
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i FROM hurt
), seen AS (
  SELECT *, rtrim(text, E' \t\n\x0b\x0c\r') AS body, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth FROM numbered
), faulty AS (
  SELECT *, CASE WHEN body = '' THEN 1 WHEN nth > 1 THEN 2 WHEN right(body, 1) IN ('.', '!', '?') THEN 0 ELSE 3 END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM seen
), follow(s, made, nxt) AS (VALUES (0, 'user', 2), (1, 'user', 2), (2, 'assistant', 3), (3, 'user', 2)),
inserts AS (
  SELECT s AS s0, s, 0 AS price, '' AS letters, '' AS made FROM follow
  UNION ALL SELECT s, nxt, 2, 'I', E'\n' || made || ':' FROM follow
  UNION ALL SELECT a.s, b.nxt, 4, 'II', E'\n' || a.made || E':\n' || b.made || ':' FROM follow a JOIN follow b ON b.s = a.nxt
), kinds(edit) AS (VALUES ('D'), ('K'), ('R')),
moves AS (
  SELECT s0, edit, letters || edit AS letters, i.made, price + CASE edit WHEN 'D' THEN 3 WHEN 'R' THEN 2 ELSE 0 END AS price,
    CASE edit WHEN 'D' THEN i.s ELSE f.nxt END AS s1, f.made AS role, i.s AS mid FROM inserts i JOIN follow f ON f.s = i.s, kinds
  UNION ALL SELECT s0, 'K', letters || 'K', made, price, 1, 's', s FROM inserts WHERE s = 0
), paths(conv_id, i, s, best) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, 0, {'cost': 0, 'audit': '', 'made': ''} FROM faulty
  UNION ALL
  SELECT p.conv_id, r.i, m.s1, min({'cost': p.best.cost + m.price + CASE WHEN r.fault = 3 AND m.edit <> 'D' THEN 1 ELSE 0 END,
      'audit': p.best.audit || m.letters,
      'made': p.best.made || m.made || CASE m.edit WHEN 'D' THEN '' WHEN 'K' THEN E'\n' || r.role || ':' || r.text ELSE E'\n' || m.role || ':' || r.text END})
  FROM paths p JOIN faulty r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i + 1
  JOIN moves m ON m.s0 = p.s AND (m.edit = 'D' OR r.fault NOT IN (1, 2) AND (m.edit = 'R' OR left(r.role, 1) = left(m.role, 1)))
  GROUP BY p.conv_id, r.i, m.s1
), ends AS (
  SELECT p.conv_id, min({'cost': p.best.cost + e.price, 'audit': p.best.audit || e.letters, 'made': p.best.made || e.made}) AS best
  FROM paths p JOIN inserts e ON e.s0 = p.s AND e.s IN (0, 3) JOIN (SELECT conv_id, max(i) AS n FROM faulty GROUP BY conv_id) l
    ON l.conv_id IS NOT DISTINCT FROM p.conv_id AND l.n = p.i GROUP BY p.conv_id
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank,
    count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faulty GROUP BY conv_id
)
SELECT c.conv_id, coalesce(n.gaps, 0)::BIGINT AS gaps, coalesce(n.blank, 0)::BIGINT AS blank, coalesce(n.duplicate, 0)::BIGINT AS duplicate,
  coalesce(n.truncated, 0)::BIGINT AS truncated, coalesce(n.illegal, 0)::BIGINT AS illegal, coalesce(e.best.cost, 0)::BIGINT AS cost,
  coalesce(e.best.audit, '') AS audit, sha256(coalesce(substr(e.best.made, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN counts n ON n.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""

# words with the blanks behind them, summed up to sentences; spans as in the operator's wide rule. Fifteen sentences have fifteen words.
SENTENCE_SPANS = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents
), listed AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+[\x20\x09-\x0D]*') AS words FROM t
), word AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM listed
), closed AS (
  SELECT *, (right(rtrim(word, E' \t\n\x0b\x0c\r'), 1) IN ('.', '!', '?') OR contains(word, chr(10)))::INT AS closes FROM word
), numbered AS (
  SELECT *, sum(closes) OVER (PARTITION BY doc_id ORDER BY i) - closes AS s FROM closed
), summed AS (
  SELECT doc_id, s, count(*) AS n, string_agg(word, '' ORDER BY i) AS whole FROM numbered GROUP BY doc_id, s
), sentence AS (
  SELECT *, rtrim(whole, E' \t\n\x0b\x0c\r') AS content, sum(n) OVER (PARTITION BY doc_id ORDER BY s) AS words,
    count(*) OVER (PARTITION BY doc_id) AS total FROM summed
), far AS (
  SELECT a.doc_id, a.s AS f, b.s + 1 AS l FROM sentence a JOIN sentence b
  ON a.doc_id = b.doc_id AND b.s BETWEEN a.s + 1 AND a.s + 15 AND b.words - a.words + a.n >= 15
), span AS (
  SELECT doc_id, f, min(l) AS l FROM far GROUP BY doc_id, f
  UNION SELECT doc_id, max(f), l FROM far GROUP BY doc_id, l
  UNION SELECT doc_id, s, s + 1 FROM sentence WHERE n >= 51 OR (total = 1 AND n >= 15)
), body AS (
  SELECT span.doc_id, f, l, string_agg(content, chr(1) ORDER BY s) AS body
  FROM span JOIN sentence ON span.doc_id = sentence.doc_id AND s >= f AND s < l GROUP BY span.doc_id, f, l
), later AS (
  SELECT doc_id, f, l FROM body QUALIFY row_number() OVER (PARTITION BY body ORDER BY doc_id, f) > 1
), gone AS (
  SELECT DISTINCT sentence.doc_id, s FROM later JOIN sentence ON later.doc_id = sentence.doc_id AND s >= f AND s < l
), told AS (
  SELECT doc_id, count(*) AS n_sentences, count(gone.s) AS n_removed,
    coalesce(string_agg(whole, '' ORDER BY sentence.s) FILTER (gone.s IS NULL), '') AS kept
  FROM sentence LEFT JOIN gone USING (doc_id, s) GROUP BY doc_id
)
SELECT t.doc_id, coalesce(n_sentences, 0)::BIGINT AS n_sentences, coalesce(n_removed, 0)::BIGINT AS n_removed,
  sha256(regexp_extract(text, '^[\x20\x09-\x0D]*') || coalesce(kept, '')) AS kept_sha256
FROM t LEFT JOIN told USING (doc_id)
"""

# distinct sets of five-word shingles, their exact similarities, and the sets that links lead to
NGRAM_JOIN = r"""
WITH RECURSIVE listed AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingled AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS shingles FROM listed
), marked AS MATERIALIZED (SELECT doc_id, shingles, md5(array_to_string(shingles, chr(10))) AS mark FROM shingled WHERE len(shingles) > 0
), sets AS MATERIALIZED (
  SELECT mark, count(*) AS copies, min(doc_id) AS least, any_value(shingles) AS shingles, len(any_value(shingles)) AS size FROM marked GROUP BY mark
), member AS (SELECT mark, size, hash(unnest(shingles)) AS shingle FROM sets
), links AS MATERIALIZED (
  SELECT a.mark AS a, b.mark AS b FROM member a JOIN member b ON a.shingle = b.shingle AND a.mark <> b.mark
  AND 5 * a.size >= 4 * b.size AND 5 * b.size >= 4 * a.size
  GROUP BY a.mark, b.mark, a.size, b.size HAVING 5 * count(*) >= 4 * (a.size + b.size - count(*))
), reach(mark, other) AS (
  SELECT mark, mark FROM sets UNION SELECT r.mark, l.b FROM reach r JOIN links l ON l.a = r.other
), class AS (SELECT reach.mark, min(least) AS class_id FROM reach JOIN sets ON sets.mark = reach.other GROUP BY reach.mark
), linked AS (SELECT a AS mark, sum(copies) AS n FROM links JOIN sets ON sets.mark = links.b GROUP BY a)
SELECT shingled.doc_id, coalesce(class_id, shingled.doc_id) AS class_id,
  (coalesce(copies, 1) - 1 + coalesce(n, 0))::BIGINT AS n_links
FROM shingled LEFT JOIN marked USING (doc_id) LEFT JOIN sets USING (mark) LEFT JOIN class USING (mark) LEFT JOIN linked USING (mark)
"""

# bytes as two hexadecimal digits each; every 100 bytes that stand earlier too, the bytes these cover, and the rest
REPEATED_BYTES = r"""
WITH t AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS digits FROM documents
), place AS (SELECT doc_id, digits, unnest(range(0, length(digits) // 2 - 99)) AS p FROM t
), string AS (SELECT doc_id, p, md5(substring(digits, 2 * p + 1, 200)) AS string FROM place
), later AS MATERIALIZED (
  SELECT doc_id, p FROM string QUALIFY row_number() OVER (PARTITION BY string ORDER BY doc_id, p) > 1
), stretch AS (
  SELECT doc_id, p, sum(CASE WHEN p <= before + 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS run
  FROM (SELECT *, lag(p, 1, -1000) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM later)
), span AS (SELECT doc_id, min(p) AS f, max(p) + 100 AS l FROM stretch GROUP BY doc_id, run
), gap AS (
  SELECT doc_id, f, l, coalesce(lag(l) OVER (PARTITION BY doc_id ORDER BY f), 0) AS since,
    row_number() OVER (PARTITION BY doc_id ORDER BY f DESC) = 1 AS last FROM span
), told AS (
  SELECT doc_id, sum(l - f) AS n_removed, count(*) AS n_spans,
    string_agg(substring(digits, 2 * since + 1, 2 * (f - since)) || CASE WHEN last THEN substring(digits, 2 * l + 1) ELSE '' END, '' ORDER BY f) AS kept
  FROM gap JOIN t USING (doc_id) GROUP BY doc_id
)
SELECT t.doc_id, (length(digits) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(kept, digits))) AS kept_sha256
FROM t LEFT JOIN told USING (doc_id)
"""
