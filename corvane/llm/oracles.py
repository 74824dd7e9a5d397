"""DuckDB SQL for the queries that SQL can express, written independently of them."""

from __future__ import annotations

WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP2 = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, {WORDS} AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ln
  FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i, i + 7), ' ') AS g
  FROM d, unnest(range(1, greatest(len(w) - 6, 1))) AS u(i)
), rep AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1
), cov AS (
  SELECT doc_id, sum(least(8, gap)) AS n
  FROM (SELECT doc_id, i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), i - 8) AS gap FROM rep) GROUP BY doc_id
), m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(ln) - len(list_distinct(ln)))::BIGINT AS n_dup_lines,
         coalesce(n, 0)::BIGINT AS n_repeat_words, len(ln)::BIGINT AS n_lines,
         length(regexp_replace(t, '[^!]', '', 'g'))::BIGINT AS n_exclamations
  FROM d LEFT JOIN cov USING (doc_id)
), b AS (
  SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END
           + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
           + CASE WHEN n_words > 1000000 THEN 4 ELSE 0 END
           + CASE WHEN word_chars < 2 * n_words THEN 8 ELSE 0 END
           + CASE WHEN word_chars > 20 * n_words THEN 16 ELSE 0 END
           + CASE WHEN 10 * n_symbols > n_words THEN 32 ELSE 0 END
           + CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN 64 ELSE 0 END
           + CASE WHEN 5 * n_exclamations > n_words THEN 128 ELSE 0 END)::BIGINT AS failed_bits
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       failed_bits & 3 <> 0 AS base_failed,
       failed_bits & 167 = 0 AND (failed_bits >> 3 & 1) + (failed_bits >> 4 & 1) + (failed_bits >> 6 & 1) <= 1 AS kept,
       n_lines, n_exclamations, failed_bits
FROM b
"""


OP3 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(encode(coalesce(html, ''))) AS h FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, octet_length(b)::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, i // 4 * 5 + 1, 5))::INT >> (15 - i % 4 * 5)) & 31)::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id < top THEN top END AS refers_to
FROM q
"""

OP4 = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g
  FROM d, unnest(range(1, greatest(len(w) - 3, 2))) AS u(i) WHERE len(w) > 0
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pair AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), link AS (
  SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b
)
SELECT d.doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(b) AS component_id, d.doc_id = min(b) AS kept
FROM d JOIN reach ON reach.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""


ALNUM = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

OP8 = f"""
WITH d AS (SELECT doc_id, {ALNUM} AS w FROM documents),
b AS (SELECT item_id, {ALNUM} AS w FROM benchmark),
item AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, list_slice(w, i, i + least(len(w), 10) - 1) AS g
  FROM b, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS u(i) WHERE len(w) > 0
), occ AS (
  SELECT doc_id, i, k, item_id
  FROM (SELECT doc_id, i, k, list_slice(w, i, i + k - 1) AS g FROM d, (SELECT DISTINCT k FROM item) ks, unnest(range(1, greatest(len(w) - k + 2, 1))) AS u(i)) JOIN item USING (k, g)
), hit AS (
  SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT DISTINCT doc_id, i, k FROM occ), unnest(range(i, i + k)) AS u(j) GROUP BY doc_id
), of AS (
  SELECT doc_id, count(DISTINCT item_id) AS n, list_sort(list(DISTINCT item_id)) AS ids, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM occ GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(of.n, 0)::BIGINT AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, hit.n IS NOT NULL AS contaminated, coalesce(ids, []::BIGINT[]) AS item_ids
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN of USING (doc_id)
"""


def _crc_table() -> str:
    """The byte table of the reflected polynomial 0xEDB88320, from its rule."""
    table = []
    for k in range(256):
        for _ in range(8):
            k = k >> 1 ^ (0xEDB88320 if k & 1 else 0)
        table.append(k)
    return str(table)


OP9 = f"""
WITH d AS (
  SELECT doc_id, md5('17:' || coalesce(doc_id::VARCHAR, '')) AS k,
         md5(CASE WHEN source IS NULL THEN '17/-' ELSE '17/+' || source END) AS s,
         hex(encode(coalesce(text, ''))) AS h
  FROM documents
), r AS (
  SELECT *, (row_number() OVER (PARTITION BY s ORDER BY k, doc_id) - (cast('0x' || s[1:8] AS BIGINT) + 1) / 4294967296.0::DOUBLE)
            / count(*) OVER (PARTITION BY s) AS place
  FROM d
), p AS (
  SELECT *, row_number() OVER (ORDER BY place, k, s, doc_id) - 1 AS pos, count(*) OVER () AS n FROM r
), q AS (
  SELECT *, (pos * 8 // n)::INT AS shard FROM p
)
SELECT doc_id, (length(h) // 2 + 1)::BIGINT AS size,
       xor(list_reduce([4294967295::BIGINT] || list_transform(range(length(h) // 2), lambda i: cast('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)),
                       lambda c, b: xor(c >> 8, ({_crc_table()})[(xor(c, b) & 255) + 1])), 4294967295)::BIGINT AS text_crc32,
       'rows' AS law, shard, (pos - (shard * n + 7) // 8)::BIGINT AS slot, NULL::INT AS grown_shard
FROM q
"""

OP10 = r"""
WITH RECURSIVE p AS (
  SELECT page_id, url, html, regexp_extract(url, '^([^#]*)', 1) AS node FROM pages
), hit AS (
  SELECT node, url, regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*\bhref\s*=\s*["'']?([^"''\s>]+)', 1) AS t FROM p
  UNION ALL
  SELECT node, url, regexp_extract(html, '(?is)<link\b[^>]*\bhref\s*=\s*["'']?([^"''\s>]+)[^>]*\brel\s*=\s*["'']?canonical\b', 1) FROM p
  UNION ALL
  SELECT node, url, regexp_extract(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*\bcontent\s*=\s*["'']?[^"''>]*?url\s*=\s*([^"''\s>]+)', 1) FROM p
), e AS (
  SELECT DISTINCT node AS u, regexp_extract(CASE WHEN t LIKE '//%' THEN regexp_extract(url, '^([^:/?#]*:)//', 1) || t
    WHEN t LIKE '/%' THEN regexp_extract(url, '^([^:/?#]*://[^/?#]*)', 1) || t WHEN t LIKE '%://%' THEN t END, '^([^#]*)', 1) AS v
  FROM hit WHERE t <> ''
), sym AS (
  SELECT u, v FROM e WHERE v <> '' UNION SELECT v, u FROM e WHERE v <> '' UNION SELECT u, u FROM e WHERE v <> ''
), reach AS (
  SELECT u, v FROM sym UNION SELECT r.u, b.v FROM reach r JOIN sym b ON r.v = b.u
), parts AS (
  SELECT node, CASE WHEN contains(node, '://') THEN translate(regexp_extract(split_part_rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN contains(node, '://') THEN regexp_extract(split_part_rest, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM (SELECT node, substr(node, strpos(node, '://') + 3) AS split_part_rest FROM (SELECT coalesce(node, '') AS node FROM p UNION SELECT v FROM sym))
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule
  FROM parts
), said AS (
  SELECT r.u AS node, CASE WHEN bool_or(rule IN ('example.net/en/', 'org/fr/')) THEN 'allow' WHEN bool_or(rule IN ('net/', 'example.com/de/')) THEN 'block' END AS alias
  FROM reach r JOIN ruled ON ruled.node = r.v GROUP BY r.u
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' ELSE coalesce(alias, 'allow') END AS verdict,
       CASE WHEN rule IS NOT NULL THEN 'rule' WHEN alias IS NOT NULL THEN 'alias' ELSE 'default' END AS via
FROM p JOIN ruled ON ruled.node = coalesce(p.node, '') LEFT JOIN said ON said.node = p.node
"""

ORACLES: dict[str, str] = {"op2_quality_rules": OP2, "op3_warc": OP3, "op4_near_duplicates": OP4, "op8_decontamination": OP8, "op9_sharding": OP9, "op10_url_filter": OP10}
