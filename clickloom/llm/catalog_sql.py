"""Expected results of the operators that SQL can express, for DuckDB."""

WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP6 = rf"""
WITH docs AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
base AS (
  SELECT *, {WORDS.format('text')} AS w,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols FROM docs),
windows AS (
  SELECT doc_id, pos, array_to_string(list_slice(w, pos, pos + 7), ' ') AS win
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS pos FROM base WHERE len(w) >= 9)),
twice AS (SELECT doc_id, pos FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
repeats AS (
  SELECT doc_id, count(DISTINCT pos + k) AS n
  FROM twice CROSS JOIN (SELECT unnest(range(0, 8)) AS k) GROUP BY doc_id),
lines AS (
  SELECT doc_id, host, line, {WORDS.format(LOWER.format('line'))} AS lw
  FROM (SELECT doc_id, host, unnest(string_split(text, chr(10))) AS line FROM docs)),
worded AS (SELECT *, left(md5(array_to_string(lw, ' ')), 16) AS h FROM lines WHERE len(lw) > 0),
dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM worded GROUP BY doc_id),
own AS (SELECT doc_id, host, h, sum(len(lw)) AS words FROM worded GROUP BY ALL),
sets AS (SELECT doc_id, md5(string_agg(h, ',' ORDER BY h)) AS kind FROM own GROUP BY doc_id),
kinds AS (SELECT doc_id, host, coalesce(kind, '') AS kind FROM docs LEFT JOIN sets USING (doc_id)),
hosts AS (SELECT host, count(DISTINCT kind) AS docs FROM kinds GROUP BY host),
common AS (
  SELECT host, h FROM own JOIN kinds USING (doc_id, host) JOIN hosts USING (host)
  GROUP BY host, h, docs HAVING count(DISTINCT kind) > 10 AND count(DISTINCT kind) > 0.03 * docs),
lost AS (SELECT doc_id, sum(words) AS n FROM own JOIN common USING (host, h) GROUP BY doc_id),
facts AS (
  SELECT doc_id, len(w) AS n_words, list_sum(list_transform(w, lambda x: length(x))) AS chars, n_symbols,
    coalesce(dups.n, 0) AS n_dup_lines, coalesce(repeats.n, 0) AS n_repeat_words, coalesce(lost.n, 0) AS lost
  FROM base LEFT JOIN dups USING (doc_id) LEFT JOIN repeats USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, coalesce(chars, 0)::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words)
    AND NOT (lost > 0 AND (n_words - lost < 20 OR n_words - lost < 0.2 * n_words)) AS kept,
  (n_words - lost)::BIGINT AS rest_words
FROM facts
"""

OP1 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(LOWER.format("coalesce(text, '')"))} AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, pos, pos + 4), ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS pos FROM w WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM pairs JOIN size p ON p.doc_id = x JOIN size q ON q.doc_id = y
  WHERE 100 * pairs.n >= 75 * (p.n + q.n - pairs.n)),
both_ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach(doc_id, root) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT e.y, r.root FROM reach r JOIN both_ways e ON e.x = r.doc_id WHERE r.root < e.y),
found AS (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM found LEFT JOIN size USING (doc_id)
"""

OP10_KEYED = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
    sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (
  SELECT *, CASE WHEN payload_bytes >= 100
    THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""

ORACLE: dict[str, str] = {
    "op1_minhash_near_dedup": OP1,
    "op6_line_frequency_rules": OP6,
    "op10_warc_history": OP10_KEYED,
}
