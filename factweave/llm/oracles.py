"""SQL of corpus queries that is longer than their operators' own modules want."""

OP5_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(0, len(string_split(coalesce(text, ''), chr(10))))) AS ln FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(line, '[\x20\t\r\x0B\f]+'), lambda x: x <> '') AS ws FROM l),
d AS (SELECT ws, len(ws) AS n, array_to_string(ws, ' ') AS whole, min({'d': doc_id, 'l': ln}) AS f FROM w WHERE len(ws) >= 1 GROUP BY ws),
s AS (SELECT ws, n, f, i, array_to_string(list_concat(ws[1:i - 1], ws[i + 1:]), ' ') AS v FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM d WHERE n >= 5)),
low AS (SELECT v, n, i, min(f) AS f FROM s GROUP BY ALL),
near AS (
  SELECT s.ws FROM s JOIN low USING (v, n, i) WHERE s.f > low.f
  UNION SELECT s.ws FROM s JOIN d ON d.whole = s.v AND d.n = s.n - 1 AND d.n >= 5 WHERE s.f > d.f
  UNION SELECT d.ws FROM s JOIN d ON d.whole = s.v AND d.n = s.n - 1 AND d.n >= 5 WHERE d.f > s.f),
kept AS (SELECT w.doc_id, w.ln, w.line, len(w.ws) >= 1 AND (near.ws IS NOT NULL OR d.f <> {'d': w.doc_id, 'l': w.ln}) AS gone FROM w LEFT JOIN d ON d.ws = w.ws LEFT JOIN near ON near.ws = w.ws),
t AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed_lines, coalesce(string_agg(line, chr(10) ORDER BY ln) FILTER (WHERE NOT gone), '') AS kept FROM kept GROUP BY doc_id)
SELECT doc_id, n_removed_lines, length(kept) AS kept_chars, sha256(kept) AS kept_sha256 FROM t
"""

OP10_SQL = """
WITH d AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS s FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY s, n) AS last FROM d)
SELECT page_id, n AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(s, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31))::INTEGER, 1)), '') AS payload_digest,
  CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to
FROM m
"""

#: The crc32 is taken byte by byte from its table; runs are of code points under 256.
OP13_SQL = r"""
WITH RECURSIVE tab AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM (
  SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(0, 256)) AS i))),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
spelt AS (SELECT doc_id, run, count(*) AS k, flatten(list_transform(string_split(doc_id::VARCHAR || ':' || run, ''),
  lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)] END)) AS b FROM runs WHERE length(run) >= 7 GROUP BY doc_id, run),
hashed AS (SELECT run, k, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(b, lambda x: x::BIGINT)), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8))) AS h FROM spelt, tab),
words AS MATERIALIZED (SELECT word, sum(k)::BIGINT AS n FROM (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INTEGER) || substr(run, (h % length(run))::INTEGER + 2) ELSE run END AS word, k FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
cuts AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS v FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM cuts a JOIN cuts b ON a.v = b.v AND a.i = b.i AND a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cuts c JOIN words w ON c.v = w.word
  UNION SELECT w.word, c.word, c.n FROM cuts c JOIN words w ON c.v = w.word),
best AS (SELECT word, count(*) AS n_near, max(other_n) AS top FROM near GROUP BY word),
top_near AS (SELECT word, n_near, top, (SELECT min(other) FROM near WHERE near.word = best.word AND near.other_n = best.top) AS other FROM best),
forms AS MATERIALIZED (SELECT w.word, w.n, coalesce(f.n_near, 0) AS n_near, CASE WHEN f.top >= 10 * w.n THEN f.other END AS form, CASE WHEN f.top >= 10 * w.n THEN f.top END AS form_n FROM words w LEFT JOIN top_near f USING (word)),
chain AS (
  SELECT word, word AS root, 0 AS step FROM forms
  UNION ALL SELECT chain.word, forms.form, step + 1 FROM chain JOIN forms ON forms.word = chain.root WHERE forms.form IS NOT NULL)
SELECT word, form, (SELECT arg_max(root, step) FROM chain WHERE chain.word = forms.word) AS root, n, n_near, form_n FROM forms
"""
