"""DuckDB SQL for the training-data queries that SQL can express, over whole tables."""

from __future__ import annotations

from plumbline.llm.quality import STOP_WORDS

_STOP = ", ".join(f"'{x}'" for s in STOP_WORDS for x in (s, s.capitalize()))

OP2 = rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
win AS (
  SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
keyed AS (SELECT doc_id, i, struct_pack(a := ws[i], b := ws[i + 1], c := ws[i + 2]) AS k FROM win),
twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM keyed) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
m AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
         len(list_filter(ws, lambda x: list_contains([{_STOP}], x))) AS n_stop,
         length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g')) AS n_upper, len(ls) AS n_lines,
         len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…) *$'))) AS n_ell,
         len(list_filter(ls, lambda x: regexp_matches(x, '^ *[-*•‣]'))) AS n_bul
  FROM w LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed
       AND word_chars >= 2 * n_words AND word_chars <= 15 * n_words
       AND n_symbols / n_words <= 0.10 AND n_stop / n_words >= 0.05 AND n_upper / word_chars <= 0.40
       AND coalesce(n_dup_lines / n_lines <= 0.40, true) AND coalesce(n_ell / n_lines <= 0.30, true)
       AND coalesce(n_bul / n_lines <= 0.90, true) AS kept
FROM f"""

_FOLD = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

OP5 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_FOLD.format('text')}, {_ALNUM}) AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all({_FOLD.format('text')}, {_ALNUM}) AS ws FROM benchmark),
sized AS (SELECT item_id, ws, least(13, len(ws)) AS size FROM b WHERE len(ws) > 0),
pat AS (
  SELECT DISTINCT item_id, size, array_to_string(ws[i:i + size - 1], ' ') AS w
  FROM (SELECT item_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM sized)),
lens AS (SELECT DISTINCT size FROM pat),
pos AS (
  SELECT doc_id, size, i, array_to_string(ws[i:i + size - 1], ' ') AS w
  FROM (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS i
        FROM d, lens WHERE len(ws) >= size)),
hit AS (SELECT doc_id, i, pos.size, item_id FROM pos JOIN pat ON pos.w = pat.w AND pos.size = pat.size),
words AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(words.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(items.n, 0) AS BIGINT) AS n_items, sha256(coalesce(items.s, '')) AS items_sha256,
       coalesce(words.n, 0) > 0 AND 20 * coalesce(words.n, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""

OP1 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, sha256(coalesce(html, '')) AS payload_digest,
         CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest, payload_bytes)
                     ELSE page_id END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM f"""

_DAY = "CAST(DATE '2024-01-01' + CAST({} AS INTEGER) AS DATE)"

OP8 = rf"""
WITH p AS (
  SELECT page_id, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '') AS host,
         {_DAY.format('page_id * 7919 % 730')} AS fetched
  FROM pages),
k AS (
  SELECT page_id, host, fetched, unnest(list_transform(range(1, greatest(len(l) - 1, 1) + 1),
         lambda i: array_to_string(l[i:], '.'))) AS key
  FROM (SELECT *, string_split(host, '.') AS l FROM p WHERE host IS NOT NULL)),
n AS (SELECT key, CAST(('0x' || substr(md5(key), 1, 4)) AS INTEGER) AS n FROM (SELECT DISTINCT key FROM k)),
e AS (
  SELECT key, ['ads', 'adult', 'malware'][n % 3 + 1] AS category, n % 600 AS a, n % 600 + 30 + n % 170 AS b,
         CASE WHEN n % 2 = 0 THEN n % 600 + 260 + n % 90 END AS c
  FROM n WHERE n % 3 = 0 OR n % 7 = 0),
v AS (
  SELECT key, category, {_DAY.format('a')} AS since, {_DAY.format('b')} AS until FROM e
  UNION ALL SELECT key, category, {_DAY.format('c')}, DATE '9999-12-31' FROM e WHERE c IS NOT NULL),
h AS (
  SELECT page_id, count(*) AS n_entries, array_to_string(list_sort(list(DISTINCT category)), ',') AS categories,
         max_by(v.key, lpad(CAST(length(v.key) AS VARCHAR), 6, '0') || v.key) AS matched
  FROM k JOIN v ON k.key = v.key AND since <= fetched AND fetched < until GROUP BY page_id)
SELECT page_id, host, fetched, h.page_id IS NOT NULL AS blocked, CAST(coalesce(n_entries, 0) AS BIGINT) AS n_entries,
       coalesce(categories, '') AS categories, matched
FROM p LEFT JOIN h USING (page_id)"""

ORACLES = {"op8_url_filter": OP8, "op1_warc": OP1, "op2_quality_rules": OP2, "op5_decontaminate": OP5}
