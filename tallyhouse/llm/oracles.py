"""DuckDB SQL for the operators that SQL can express."""

_WS = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]"

SQL = {
    "op4_substring_dedup": rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
lists AS (SELECT r, doc_id, regexp_extract_all(text, '{_WORD}+') AS w FROM docs),
words AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM lists),
ids AS (SELECT word, row_number() OVER () AS id FROM (SELECT DISTINCT word FROM words)),
coded AS (SELECT r, i, id FROM words JOIN ids USING (word)),
windows AS (
  SELECT r, i, string_agg(id, ' ') OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING) AS run,
         count(*) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING) AS n
  FROM coded),
counted AS (SELECT r, i, count(*) OVER (PARTITION BY md5(run)) AS times FROM windows WHERE n = 35),
marked AS (
  SELECT words.r, words.i, words.word,
         max(CASE WHEN times > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY words.r ORDER BY words.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone
  FROM words LEFT JOIN counted USING (r, i)),
kept AS (SELECT r, count(*) AS n_words, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0) AS t FROM marked GROUP BY r)
SELECT doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (r)
""",
    "op5_exact_dedup": rf"""
WITH docs AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '{_WS}', '', 'g') AS norm FROM documents),
ranked AS (
  SELECT doc_id, norm, count(*) OVER (PARTITION BY norm) AS group_size,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id
  FROM docs)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM ranked
""",
    "op10_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
""",
    "op11_fill_in_middle": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || doc_id) AS x FROM documents),
h AS (SELECT doc_id, t, length(t) AS n, CAST('0x' || x[1:8] AS BIGINT) AS h1, CAST('0x' || x[9:16] AS BIGINT) AS h2, CAST('0x' || x[17:24] AS BIGINT) AS h3, CAST('0x' || x[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substring(t, 1, a) AS prefix, substring(t, a + 1, b - a) AS middle, substring(t, b + 1) AS suffix FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(b - a AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
""",
    "op13_source_mixing": rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_WORD}+')) AS BIGINT) AS size, CAST('0x' || sha256('13:' || doc_id)[1:8] AS BIGINT) AS draw FROM documents),
g AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS copies FROM d GROUP BY source),
w AS (SELECT *, list_extract([5.0, 2.0, 1.0], (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight, source_size * 2.0::DOUBLE AS most FROM g),
s AS (SELECT *, (sum(source_size) OVER ())::DOUBLE * 1.5 - coalesce(sum(most) OVER before, 0) AS remains, sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS open
  FROM w WINDOW before AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, most * open <= weight * remains AS filled FROM s),
l AS (SELECT *, (SELECT first(remains / open ORDER BY most / weight, source NULLS LAST) FROM f WHERE NOT filled) AS level FROM f),
t AS (SELECT *, CASE WHEN filled THEN most ELSE level * weight END AS target, CASE WHEN source_size = 0 THEN 0 WHEN filled THEN 2.0 ELSE level * weight / source_size END AS rate,
  CAST('0x' || sha256('13:' || coalesce(source, 'null'))[1:8] AS BIGINT) / 4294967296.0::DOUBLE AS offs FROM l),
p AS (SELECT d.*, source_size, target, rate, offs, row_number() OVER (PARTITION BY d.source ORDER BY draw % CAST(ceil(copies / 4096.0) AS BIGINT), size, doc_id) AS place
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * (floor(offs + rate * place) - floor(offs + rate * (place - 1))) AS BIGINT) AS taken FROM p
""",
}
