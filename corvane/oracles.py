"""DuckDB SQL for the queries of `queries`, written independently of them."""

from __future__ import annotations

from corvane import constants as C
from corvane.constants import STOPWORDS

_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in STOPWORDS)

WORD_COUNT = "(len(regexp_extract_all(text, '[一-鿿]')) + len(regexp_extract_all(text, '[a-zA-Z]+')))::BIGINT"

DOCS = f"""
docs AS (
  SELECT d.doc_id, text, split_part(text, chr(10), 1) AS title, source AS site, {WORD_COUNT} AS word_count,
         CASE WHEN d.doc_id % 7 <> 0 THEN make_date(2010 + d.doc_id % 15, 1 + d.doc_id % 12, 1 + d.doc_id % 28) END AS published,
         CASE WHEN d.doc_id % 10 = 9 THEN 'raw' ELSE 'readability' END AS method,
         CASE WHEN d.doc_id % 23 = 5 THEN 'HTTP ' || (400 + d.doc_id % 4) END AS error,
         CASE quality WHEN 1 THEN 'likely' WHEN 0 THEN 'unlikely' END AS verdict, CASE quality WHEN 1 THEN 'high' WHEN 0 THEN 'low' END AS value
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
)"""

_PLAIN = r"""trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)\b[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<!--.*?-->|<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g'))"""

_HOST = r"regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:@]+)', 1)), '^www\.', '')"
_PATH = r"regexp_replace(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+([^?#]*)', 1), '/+$', '')"
_TRACK = r"^(utm_.*|fbclid|gclid|yclid|msclkid|ref|ref_?src|source|spm|share_?.*|from|_?from|vd_source|buvid|wfr|s_r|scene|clicktime|weibo_id|sr_share|utm)$"
_PARAMS = rf"list_sort(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(lower(split_part(p, '=', 1)), '{_TRACK}')))"

RESULTS = f"""
results AS (
  SELECT page_id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, substr({_PLAIN}, 1, 300) AS snippet, 'p' || (page_id % 4) AS provider, (page_id // 4)::INT AS rank,
         CASE WHEN page_id % 5 <> 0 THEN make_date(2015 + page_id % 10, 1 + page_id % 12, 1) END AS published,
         'https://' || {_HOST} || CASE WHEN {_PATH} = '' THEN '/' ELSE {_PATH} END || CASE WHEN len({_PARAMS}) > 0 THEN '?' || array_to_string({_PARAMS}, '&') ELSE '' END AS norm_url
  FROM pages
)"""

FUSED = f"""{RESULTS},
folded AS (
  SELECT * REPLACE (regexp_replace(regexp_replace(regexp_replace(regexp_replace(norm_url, '\\d(/)', '0\\1', 'g'), '\\d(\\.html)', '0\\1', 'g'), '\\d(\\?)', '0\\1', 'g'), '\\d$', '0') AS norm_url) FROM results
), fused AS (
  SELECT norm_url, arg_min(url, (provider, rank, page_id)) AS url, arg_min(title, (provider, rank, page_id)) AS title, arg_min(snippet, (provider, rank, page_id)) AS snippet,
         arg_min(rank, (provider, rank, page_id)) AS rank, arg_min(published, (provider, rank, page_id)) FILTER (published IS NOT NULL) AS published,
         list_sort(list(DISTINCT provider)) AS sources, len(list(DISTINCT provider))::INT AS hit_count
  FROM folded GROUP BY norm_url
)"""

VERDICT = """
said AS (
  SELECT *, contains(lower(title || ' ' || snippet), 'theheon') AS head, contains(lower(title || ' ' || snippet), 'thre')::INT + contains(lower(title || ' ' || snippet), 'ention')::INT AS hits,
         contains(lower(title || ' ' || snippet), 'ouheen') AS neg FROM {of}
), judged AS (
  SELECT *, CASE WHEN NOT head AND hits = 0 THEN 'unlikely' WHEN neg THEN 'uncertain' ELSE 'likely' END AS verdict,
         CASE WHEN NOT head AND hits = 0 THEN 0.05 WHEN neg THEN 0.35 WHEN NOT head THEN least(0.85, 0.55::DOUBLE + 0.1::DOUBLE * hits) ELSE 0.9 END::DOUBLE AS score,
         CASE WHEN (NOT head AND hits = 0) OR neg THEN NULL WHEN NOT head THEN 'related' ELSE 'direct' END AS match
  FROM said
)"""

TOKENS = rf"""
raw_tokens AS (
  SELECT doc_id, unnest(list_transform(regexp_extract_all(text, '[\p{{L}}\p{{N}}]+'), lambda w: lower(w))) AS word, generate_subscripts(regexp_extract_all(text, '[\p{{L}}\p{{N}}]+'), 1) AS nth
  FROM documents
), toks AS (
  SELECT doc_id, word, row_number() OVER (PARTITION BY doc_id ORDER BY nth) - 1 AS pos FROM raw_tokens
  WHERE length(word) BETWEEN 3 AND 20 AND NOT regexp_matches(word, '^[\d.]+$') AND word NOT IN ({_STOP})
)"""

TFIDF = f"""{TOKENS},
counts AS (SELECT doc_id, word, count(*) AS n FROM toks GROUP BY ALL),
total AS (SELECT doc_id, sum(n) AS words FROM counts GROUP BY ALL),
dfs AS (SELECT word, count(*) AS df FROM counts GROUP BY ALL),
scored AS (
  SELECT doc_id, word, df, (1 + ln(n) / ln(words + 1)) * (ln(((SELECT count(*) FROM documents) + 1) / (df + 1)) + 1) AS score
  FROM counts JOIN total USING (doc_id) JOIN dfs USING (word)
), kw AS (
  SELECT word, any_value(df) AS df, round(sum(score::DECIMAL(38, 12)), 4)::DOUBLE AS weight FROM scored
  WHERE df >= 2 GROUP BY word ORDER BY weight DESC, word LIMIT 60
)"""

_GRADE = """graded AS (
  SELECT *, CASE WHEN error IS NOT NULL OR method = 'raw' THEN 'snippet' WHEN length(trim(text, ' ')) >= 300 THEN 'full' WHEN length(trim(text, ' ')) >= 120 THEN 'thin' ELSE 'snippet' END AS grade FROM docs
), worth AS (
  SELECT *, grade = 'full' AND verdict IS DISTINCT FROM 'unlikely' AS worthy,
         CASE WHEN error IS NOT NULL THEN 'error: ' || error WHEN verdict IS NOT DISTINCT FROM 'unlikely' THEN 'not relevant' WHEN method = 'raw' THEN 'search snippet only'
              WHEN grade <> 'full' THEN 'short: ' || length(trim(text, ' ')) || ' characters' END AS reason FROM graded
)"""

GRADED = f"{DOCS}, {_GRADE}"


def _rank(order: str) -> str:
    of = VERDICT.format(of="fused")
    return f"""WITH {FUSED}, {of}, r AS (
  SELECT *, CASE WHEN length(url) % 3 > 0 THEN round(log10(1 + length(snippet)) + log10(1 + length(title) % 7), 9) ELSE 0 END AS magnitude,
         round(2 * hit_count + CASE WHEN published IS NULL THEN 0.25::DOUBLE ELSE 3 * pow(0.5::DOUBLE, greatest(date_diff('day', published, DATE '2026-01-01'), 0) / 30) END, 9) AS mixed
  FROM judged
) SELECT norm_url, row_number() OVER (ORDER BY {order} hit_count DESC, score DESC, rank, norm_url) AS place FROM r"""


_TASKS = "tasks AS (SELECT user_id AS job_id, event_id, ['queued', 'running', 'done', 'done', 'failed'][1 + event_id % 5] AS status, event_id AS bytes FROM events)"

ORACLES: dict[str, str] = {
    "tfidf_keywords": f"WITH {TFIDF} SELECT * FROM kw",
    "token_counts": f"WITH {TOKENS} SELECT doc_id, count(*) AS n_tokens, count(DISTINCT word) AS n_words, max(pos) AS last_pos FROM toks GROUP BY doc_id",
    "keyword_cooccurrence": f"""WITH {TFIDF}, hits AS (SELECT doc_id, pos, word FROM toks SEMI JOIN kw USING (word)), p AS (
  SELECT least(a.word, b.word) AS word_a, greatest(a.word, b.word) AS word_b, b.pos - a.pos AS d, count(*) AS n
  FROM hits a JOIN hits b ON a.doc_id = b.doc_id AND b.pos BETWEEN a.pos + 1 AND a.pos + 15 AND a.word <> b.word GROUP BY ALL)
SELECT word_a, word_b, round(sum((3 * n / (3 + d))::DECIMAL(38, 12)), 3)::DOUBLE AS weight FROM p GROUP BY ALL""",
    "contains_edges": f"WITH {TFIDF} SELECT doc_id, word, floor((1 + round(score, 9)) * 1000 + 0.5) / 1000 AS weight FROM scored SEMI JOIN kw USING (word)",
    "document_nodes": f"""WITH {DOCS}, {TFIDF}, n AS (SELECT doc_id, count(*) AS degree FROM scored SEMI JOIN kw USING (word) GROUP BY doc_id)
SELECT doc_id, floor(round(ln(1 + word_count) + coalesce(degree, 0) / 4, 9) * 1000 + 0.5) / 1000 AS weight, coalesce(degree, 0) AS degree FROM docs LEFT JOIN n USING (doc_id)""",
    "keyword_trend": f"""WITH {DOCS}, {TFIDF}, heads AS (SELECT word FROM kw ORDER BY weight DESC, word LIMIT 8), y AS (SELECT DISTINCT year(published) AS year FROM docs WHERE published IS NOT NULL),
c AS (SELECT word, year(published) AS year, count(*) AS n FROM scored SEMI JOIN heads USING (word) JOIN docs USING (doc_id) WHERE published IS NOT NULL GROUP BY ALL)
SELECT word, year, coalesce(n, 0) AS n FROM heads CROSS JOIN y LEFT JOIN c USING (word, year)""",
    "year_layers": f"""WITH {DOCS}, c AS (SELECT year(published) AS y, count(*) AS n FROM docs WHERE published IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (ORDER BY y DESC) AS k FROM c)
SELECT CASE WHEN k <= 10 THEN y END AS year, sum(n)::BIGINT AS n FROM r GROUP BY 1""",
    "url_normal_form": f"WITH {RESULTS} SELECT page_id, norm_url, substr(sha1(norm_url), 1, 16) AS result_id, {_HOST} AS domain FROM results",
    "url_facts": r"""WITH h AS (SELECT page_id, url, lower(regexp_extract(url, '://([^/?#:]+)', 1)) AS host FROM pages)
SELECT page_id, host = 'example.net' OR ends_with(host, '.example.net') AS in_net, 'web' AS site, 'article' AS kind,
       lower(nullif(regexp_extract(regexp_extract(url, '://[^/?#]+([^?#]*)', 1), '\.([A-Za-z0-9]{1,5})$', 1), '')) AS ext, regexp_extract(url, '^([^:]+://[^/?#]+)', 1) AS origin, true AS proxied FROM h""",
    "fused_results": f"WITH {FUSED} SELECT norm_url, url, title, rank, array_to_string(sources, ',') AS sources, hit_count, published FROM fused",
    "rank_relevant": _rank(""),
    "rank_quality": _rank("magnitude > 0 DESC, magnitude DESC,"),
    "rank_recent": _rank("published DESC NULLS LAST,"),
    "rank_mixed": _rank("mixed DESC,"),
    "lexical_relevance": f"WITH {RESULTS}, {VERDICT.format(of='results')} SELECT page_id, verdict, score, match FROM judged",
    "merged_relevance": f"""WITH {RESULTS}, {VERDICT.format(of='results')} SELECT page_id,
  CASE WHEN page_id % 4 > 1 OR verdict = 'unlikely' THEN verdict WHEN page_id % 4 = 0 THEN 'unlikely' WHEN verdict = 'likely' THEN 'likely' ELSE 'uncertain' END AS verdict,
  CASE WHEN page_id % 4 > 1 OR verdict = 'unlikely' THEN score WHEN page_id % 4 = 0 THEN 0.2::DOUBLE ELSE greatest(score, 0.7::DOUBLE) END AS score FROM judged""",
    "time_filtered": f"WITH {RESULTS} SELECT page_id, published FROM results WHERE published IS NULL OR published >= DATE '2024-06-15' - 365",
    "candidate_tiers": rf"""WITH {RESULTS}, c AS (SELECT page_id, trim(title) AS t, trim(snippet) AS s FROM results), r AS (SELECT *, list_filter([
  CASE WHEN regexp_matches(s, '(?i)not found') THEN 'junk snippet' END], lambda x: x IS NOT NULL) AS bad, list_filter([CASE WHEN length(t) < 4 AND length(s) < 30 THEN 'short' END, CASE WHEN length(s) < 60 THEN 'short snippet' END], lambda x: x IS NOT NULL) AS low FROM c)
SELECT page_id, CASE WHEN len(bad) > 0 THEN 'reject' WHEN len(low) > 0 THEN 'low' WHEN length(t) >= 8 AND length(s) >= 80 THEN 'high' ELSE 'usable' END AS tier, array_to_string(CASE WHEN len(bad) > 0 THEN bad ELSE low END, ',') AS reasons FROM r""",
    "avoided_results": f"""WITH {RESULTS}, v AS (SELECT *, CASE page_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' END AS value, lower(title || ' ' || snippet) AS t FROM results),
a AS (SELECT *, CASE WHEN value IS NOT DISTINCT FROM 'high' THEN NULL WHEN contains(t, 'whhe') THEN 'whhe' WHEN contains(t, 'eaux') THEN 'eaux' END AS avoid FROM v)
SELECT page_id, avoid, CASE WHEN avoid IS NOT NULL THEN 'low' ELSE value END AS value FROM a""",
    "interleaved_sites": "SELECT doc_id, source AS site, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS nth FROM documents",
    "upserted_results": f"""WITH {RESULTS}, new AS (SELECT norm_url, max_by(page_id, page_id) AS page_id, max_by('new ' || title, page_id) AS title FROM results WHERE page_id % 3 = 0 GROUP BY norm_url)
SELECT page_id, norm_url, title FROM new UNION ALL SELECT page_id, norm_url, title FROM results ANTI JOIN new USING (norm_url)""",
    "batches": f"WITH {DOCS}, t AS (SELECT doc_id FROM docs ORDER BY word_count DESC, doc_id LIMIT 120) SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 40 AS batch FROM t",
    "browser_budget": f"WITH {DOCS} SELECT doc_id, word_count FROM docs WHERE word_count < 60 ORDER BY doc_id LIMIT 8",
    "graded_documents": f"WITH {GRADED} SELECT doc_id, grade, worthy, reason FROM worth",
    "graph_admission": f"""WITH {DOCS}, u AS (SELECT error IS NULL AND method <> 'raw' AND word_count >= 30 AS useful, verdict IS NOT DISTINCT FROM 'unlikely' AS off FROM docs)
SELECT count(*) FILTER (useful AND NOT off) AS admitted, count(*) FILTER (NOT useful) AS useless, count(*) FILTER (useful AND off) AS off_topic FROM u""",
    "quality_summary": f"""WITH {GRADED} SELECT count(*) AS total, count(*) FILTER (grade = 'full') AS "full", count(*) FILTER (grade = 'thin') AS thin, count(*) FILTER (grade = 'snippet') AS snippet,
  count(*) FILTER (grade = 'full') / count(*) AS body_ratio, count(*) FILTER (worthy) AS packable, count(*) FILTER (grade = 'full' AND verdict = 'unlikely') AS irrelevant FROM worth""",
    "relevance_summary": f"WITH {DOCS} SELECT count(verdict) AS judged, count(*) FILTER (verdict = 'unlikely') AS unlikely FROM docs",
    "date_coverage": f"WITH {DOCS} SELECT count(published) AS known, count(*) AS total, count(published) / count(*) AS ratio, min(published) AS first, max(published) AS last FROM docs",
    "method_tally": f"WITH {DOCS} SELECT 0::BIGINT AS subtitle, 0::BIGINT AS api, count(*) FILTER (method = 'readability') AS readability, 0::BIGINT AS browser, count(*) FILTER (method = 'raw') AS raw FROM docs",
    "site_distribution": f"WITH {DOCS} SELECT site, count(*) AS n, count(*) FILTER (length(trim(text, ' ')) > 0) AS with_text, count(error) AS errors, count(error) > 0 OR count(*) FILTER (length(trim(text, ' ')) > 0) < count(*) AS note FROM docs GROUP BY site",
    "kind_breakdown": "SELECT 'article' AS kind, count(*) AS n FROM pages",
    "excluded_reasons": rf"WITH {GRADED} SELECT regexp_replace(coalesce(reason, 'other'), ':? ?\d+.*$', '') AS reason, count(*) AS n FROM worth WHERE NOT worthy GROUP BY 1",
    "failure_reasons": f"WITH {DOCS} SELECT substr(error, 1, 40) AS error, count(*) AS n FROM docs WHERE error IS NOT NULL GROUP BY 1",
    "value_groups": f"WITH {DOCS}, g AS (SELECT coalesce(value, '未分类') AS name, count(*) AS n FROM docs GROUP BY 1) SELECT *, row_number() OVER (ORDER BY name = '未分类', n DESC, name) AS place FROM g",
    "provider_coverage": f"WITH {RESULTS} SELECT provider, count(*) AS total, count(published) AS known, min(rank) AS best_rank FROM results GROUP BY provider",
    "package_manifest": f"WITH {GRADED} SELECT doc_id, 'articles/' || doc_id || '.md' AS path FROM worth WHERE worthy",
    "text_facts": rf"""SELECT doc_id, {WORD_COUNT} AS words, CASE WHEN trim(substr(text, 1, 1000)) = '' THEN 'unknown' WHEN len(regexp_extract_all(substr(text, 1, 1000), '[一-鿿]')) / length(substr(text, 1, 1000)) > 0.15 THEN 'zh' ELSE 'en' END AS lang_found,
  substr(text, 1, 200) AS excerpt,
  CASE WHEN length(substr(text, 1, 3000)) < 40 THEN false WHEN len(regexp_extract_all(substr(text, 1, 3000), '[\p{{L}}\p{{N}}\s]')) / length(substr(text, 1, 3000)) > 0.75 THEN false
       WHEN len(regexp_extract_all(substr(text, 1, 3000), '[{{}};=<>]|=>|::')) / length(substr(text, 1, 3000)) > 0.05 THEN true ELSE regexp_matches(substr(text, 1, 3000), 'function\s*\(|\bvar\s+\w+\s*=') END AS code,
  NULL::VARCHAR AS boilerplate FROM documents""",
    "html_facts": f"WITH p AS (SELECT page_id, html, {_PLAIN} AS t FROM pages) SELECT page_id, md5(t) AS text_md5, length(t)::BIGINT AS n_chars, length(t) < 200 AND len(list_reduce(list_prepend('', regexp_extract_all(html, '(?is)<script\\b.*?</script>')), lambda a, b: a || b)) / length(html) > 0.5 AS shell FROM p",
    "formatted_numbers": r"""WITH n AS (SELECT doc_id, n_chars AS s, n_chars * 37 AS c FROM documents)
SELECT doc_id, CASE WHEN c < 1000 THEN c::VARCHAR WHEN c < 10000 THEN regexp_replace(printf('%.1f', floor(c / 1000 * 10 + 0.5) / 10), '\.0$', '') || 'k' WHEN c < 100000000 THEN regexp_replace(printf('%.1f', floor(c / 10000 * 10 + 0.5) / 10), '\.0$', '') || '万' ELSE regexp_replace(printf('%.1f', floor(c / 100000000 * 10 + 0.5) / 10), '\.0$', '') || '亿' END AS count,
  CASE WHEN s >= 3600 THEN printf('%d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) ELSE printf('%d:%02d', s // 60, s % 60) END AS clock, s AS seconds FROM n""",
    "industry_matches": "SELECT doc_id, array_to_string(list_filter([CASE WHEN contains(lower(text), 'the') THEN 'the' END, CASE WHEN contains(lower(text), 'eaux') THEN 'eaux' END, CASE WHEN contains(lower(text), 'ción') THEN 'ción' END], lambda x: x IS NOT NULL), ',') AS matched, round((contains(lower(text), 'the')::INT + contains(lower(text), 'eaux')::INT + contains(lower(text), 'ción')::INT) / 3, 6) AS score FROM documents",
    "term_matches": "SELECT doc_id, regexp_matches(text, '(?i)(^|[^A-Za-z0-9])the($|[^A-Za-z0-9])') AS the, contains(lower(text), 'ción') AS cion FROM documents",
    "parsed_dates": """SELECT event_id, CASE event_id % 6 WHEN 0 THEN epoch_ms(date_trunc('second', ts)) WHEN 1 THEN epoch_ms(date_trunc('day', ts)) WHEN 2 THEN epoch_ms(date_trunc('day', ts)) WHEN 3 THEN epoch_ms(date_trunc('minute', ts)) END AS ms FROM events""",
    "planned_tasks": """WITH t AS (SELECT doc_id, text, doc_id % 10 = 9 AS raw, doc_id % 5 = 0 AS video, doc_id % 4 = 0 AS pictures FROM documents)
SELECT doc_id, 'article' AS kind FROM t WHERE NOT raw AND text <> '' UNION ALL SELECT doc_id, 'transcript' FROM t WHERE video AND text <> '' UNION ALL SELECT doc_id, 'image' FROM t WHERE pictures UNION ALL SELECT doc_id, 'media' FROM t WHERE video""",
    "job_summary": f"""WITH {_TASKS}, s AS (SELECT job_id, count(*) AS total, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status IN ('queued', 'running', 'paused')) AS remaining, sum(bytes)::BIGINT AS bytes
  FROM tasks GROUP BY job_id)
SELECT *, CASE WHEN remaining > 0 THEN 'running' WHEN failed = 0 THEN 'done' WHEN done = 0 THEN 'failed' ELSE 'partial' END AS outcome FROM s""",
    "latest_state": "SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, count(*) AS n FROM events GROUP BY user_id",
    "resumed_tasks": f"WITH {_TASKS} SELECT CASE WHEN status IN ('running', 'paused', 'failed') THEN 'queued' ELSE status END AS status, count(*) AS n FROM tasks GROUP BY 1",
    "stalled_minutes": "SELECT user_id, epoch(date_trunc('minute', ts))::BIGINT AS start_s, sum(event_id)::BIGINT AS moved FROM events GROUP BY ALL HAVING sum(event_id) < 8192",
    "event_windows": "SELECT epoch(date_trunc('hour', ts))::BIGINT AS start_s, event_type, count(*) AS n, sum(event_id)::BIGINT AS value FROM events GROUP BY ALL",
    "visible_edges": """WITH n AS (SELECT doc_id AS id FROM documents WHERE source NOT IN ('src1', 'src2')), e AS (SELECT doc_id AS src, doc_id + 1 AS dst, CASE WHEN quality = 1 THEN 'cooccur' ELSE 'relation' END AS kind FROM labels)
SELECT src, dst, kind FROM e WHERE kind <> 'relation' AND src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)""",
    "conversation_text": "SELECT conv_id, count(*) AS n_turns, md5(string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS text_md5 FROM conversations GROUP BY conv_id",
}

_GRAPH = f"""{DOCS}, {TFIDF}, con AS (SELECT doc_id, word, floor((1 + round(score, 9)) * 1000 + 0.5) / 1000 AS w FROM scored SEMI JOIN kw USING (word)),
cl AS (SELECT word, 'c' || (ascii(word) % 4) AS cluster FROM kw), part AS (
  SELECT doc_id, cluster, sum((kw.weight * con.w)::DECIMAL(38, 6)) AS part FROM con JOIN kw USING (word) JOIN cl USING (word) GROUP BY ALL
), shares AS (SELECT doc_id, cluster, round(part::DOUBLE / sum(part) OVER (PARTITION BY doc_id)::DOUBLE, 6) AS share FROM part)"""

ORACLES |= {
    "cluster_summaries": f"WITH {_GRAPH}, l AS (SELECT cluster, list(word ORDER BY weight DESC, word) AS a FROM kw JOIN cl USING (word) GROUP BY cluster) SELECT cluster, len(a) AS size, array_to_string(a[1:3], ' · ') AS label, array_to_string(a[1:5], ',') AS top_terms FROM l",
    "cluster_shares": f"WITH {_GRAPH} SELECT * FROM shares",
    "cluster_documents": f"WITH {_GRAPH}, r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY share DESC, doc_id) AS nth, count(*) OVER (PARTITION BY cluster) AS n FROM shares WHERE share >= 0.2) SELECT cluster, doc_id, share, nth, n FROM r WHERE nth <= 10",
    "document_clusters": f"""WITH {_GRAPH}, e AS (SELECT doc_id, word, min(pos) AS pos FROM toks GROUP BY ALL), t AS (SELECT doc_id, cluster, count(*) AS n, min(pos) AS pos FROM e JOIN cl USING (word) GROUP BY ALL),
b AS (SELECT doc_id, arg_min(cluster, (-n, pos)) AS cluster FROM t GROUP BY doc_id) SELECT doc_id, coalesce(cluster, 'c0') AS cluster FROM documents LEFT JOIN b USING (doc_id)""",
    "cluster_links": f"""WITH {_GRAPH}, hits AS (SELECT doc_id, pos, word FROM toks SEMI JOIN kw USING (word)), e AS (
  SELECT DISTINCT least(a.word, b.word) AS wa, greatest(a.word, b.word) AS wb FROM hits a JOIN hits b ON a.doc_id = b.doc_id AND b.pos BETWEEN a.pos + 1 AND a.pos + 15 AND a.word <> b.word)
SELECT least(x.cluster, y.cluster) AS cluster_a, greatest(x.cluster, y.cluster) AS cluster_b, count(*) AS n FROM e JOIN cl x ON x.word = wa JOIN cl y ON y.word = wb WHERE x.cluster <> y.cluster GROUP BY ALL ORDER BY n DESC, cluster_a, cluster_b LIMIT 16""",
    "top_concepts": f"WITH {_GRAPH}, c AS (SELECT year(published) AS year, word, count(*) AS n FROM con JOIN docs USING (doc_id) WHERE published IS NOT NULL GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY year ORDER BY n DESC, word) AS nth FROM c QUALIFY nth <= 3",
    "word_years": f"WITH {_GRAPH} SELECT word, min(year(published)) AS year FROM con JOIN docs USING (doc_id) GROUP BY word",
    "length_frame": f"WITH {DOCS}, q AS (SELECT quantile_cont(word_count, 0.25) AS q1, quantile_cont(word_count, 0.75) AS q3 FROM docs) SELECT min(word_count) AS low, max(word_count) AS high, count(*) AS n FROM docs, q WHERE word_count BETWEEN q1 - 3 * (q3 - q1) AND q3 + 3 * (q3 - q1)",
    "formatted_sizes": """WITH n AS (SELECT doc_id, n_chars, n_chars * n_chars AS n FROM documents)
SELECT doc_id, CASE WHEN n >= 1024 ** 3 THEN printf('%.1f GB', floor(n / 1024 ** 3 * 10 + 0.5) / 10) WHEN n >= 1024 ** 2 THEN printf('%.1f MB', floor(n / 1024 ** 2 * 10 + 0.5) / 10) WHEN n >= 1024 THEN printf('%.1f KB', floor(n / 1024 * 10 + 0.5) / 10) ELSE n || ' B' END AS size,
  ((doc_id % 9 + 0.5) * 1048576)::BIGINT AS bytes, round(14 + 46 * sqrt(n_chars / 40000), 6) AS node FROM n""",
    "error_classes": f"""WITH {DOCS}, e AS (SELECT doc_id, doc_id % 7 AS s, doc_id % 3 = 0 AS k, coalesce(error, 'Sign in to confirm: 未能提取到正文') AS e FROM docs),
n AS (SELECT *, CASE WHEN s = 0 AND regexp_matches(e, 'HTTP 40[13]') THEN 'HTTP 403 —— ' || CASE WHEN k THEN '登录态多半已过期，需要重新登录' ELSE '未登录的访问一律 403，登录后才有正文' END WHEN s = 1 AND regexp_matches(e, 'HTTP 40[13]') THEN CASE WHEN k THEN '登录态多半已过期，需要重新登录' ELSE '未登录的访问会转到登录页' END
  WHEN s = 2 AND regexp_matches(e, 'HTTP 40[13]') THEN '未登录读不到正文' WHEN s = 4 AND contains(e, '未能提取到正文') THEN '文章页会要求验证，抓不到正文多半是平台拦截' WHEN s = 5 AND contains(e, 'Sign in') THEN '出口地址被判为机器人（' || e || '）' END AS note FROM e)
SELECT doc_id, false AS retry, '已知限制（不是故障）：' || note AS limitation, note IS NOT NULL AS known, '失败:' || e AS status FROM n""",
    "refreshed_documents": f"WITH {RESULTS}, r AS (SELECT page_id, CASE WHEN norm_url IN (SELECT norm_url FROM results WHERE page_id % 3 = 0) THEN 'fresh' WHEN norm_url IN (SELECT norm_url FROM results WHERE page_id % 2 = 0) THEN 'old' END AS document FROM results) SELECT * FROM r WHERE document IS NOT NULL",
}

ORACLES["filled_years"] = f"""WITH {_GRAPH}, y AS (SELECT word, min(year(published)) AS year FROM con JOIN docs USING (doc_id) GROUP BY word),
n AS (SELECT word, year, cluster FROM kw LEFT JOIN y USING (word) JOIN cl USING (word)), c AS (SELECT cluster, floor(quantile_cont(year, 0.5) + 0.5)::INT AS cy FROM n WHERE year IS NOT NULL GROUP BY cluster)
SELECT word, coalesce(year, cy, (SELECT floor(quantile_cont(year, 0.5) + 0.5)::INT FROM n), 2026) AS year, year IS NULL AS inferred FROM n LEFT JOIN c USING (cluster)"""

# 64-bit FNV-1a over the characters of each word, then a vote of each bit; copies by comparing all pairs.
SIMHASH = f"""{DOCS}, {TOKENS}, able AS (
  SELECT doc_id FROM docs JOIN toks USING (doc_id) WHERE error IS NULL AND word_count >= 80 GROUP BY doc_id HAVING count(*) >= 80
), wn AS (SELECT doc_id, word, count(*) AS n FROM toks SEMI JOIN able USING (doc_id) GROUP BY ALL), wh AS (
  SELECT word, list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(range(1, length(word) + 1), lambda i: unicode(word[i])::HUGEINT)),
                           lambda h, c: (xor(h::UBIGINT, c::UBIGINT)::HUGEINT * 1099511628211) % 18446744073709551616)::UBIGINT AS h FROM (SELECT DISTINCT word FROM wn)
), votes AS (
  SELECT doc_id, b, sum(CASE WHEN (h >> b) & 1 = 1 THEN n ELSE -n END) AS v FROM wn JOIN wh USING (word), (SELECT unnest(range(64))::UBIGINT AS b) GROUP BY ALL
), prints AS (SELECT doc_id, sum(CASE WHEN v > 0 THEN (1::UBIGINT << b)::HUGEINT ELSE 0 END)::HUGEINT AS u FROM votes GROUP BY doc_id), hashes AS (
  SELECT doc_id, u, (CASE WHEN u >= 9223372036854775808 THEN u - 18446744073709551616 ELSE u END)::BIGINT AS hash FROM prints
), copies AS (
  SELECT x.doc_id, min(y.doc_id) AS duplicate_of FROM hashes x JOIN hashes y ON y.doc_id < x.doc_id AND bit_count(xor(x.hash, y.hash)) <= 8 GROUP BY x.doc_id
)"""

_EDGES = """hits AS (SELECT doc_id, pos, word FROM toks SEMI JOIN kw USING (word)), p AS (
  SELECT least(a.word, b.word) AS word_a, greatest(a.word, b.word) AS word_b, b.pos - a.pos AS d, count(*) AS n
  FROM hits a JOIN hits b ON a.doc_id = b.doc_id AND b.pos BETWEEN a.pos + 1 AND a.pos + 15 AND a.word <> b.word GROUP BY ALL
), co AS (SELECT word_a, word_b, round(sum((3 * n / (3 + d))::DECIMAL(38, 12)), 3)::DOUBLE AS weight FROM p GROUP BY ALL), place AS (
  SELECT word, row_number() OVER (ORDER BY word) AS i FROM kw
), e AS (
  SELECT row_number() OVER (ORDER BY weight DESC, word_a, word_b) AS k, word_a, word_b, weight, x.i AS ia, y.i AS ib FROM co JOIN place x ON x.word = word_a JOIN place y ON y.word = word_b WHERE weight >= 0.6
), walk AS (
  SELECT 0::BIGINT AS k, list_transform(range(60), lambda z: 0) AS deg, false AS ok
  UNION ALL
  SELECT e.k, list_transform(deg, lambda g, i: g + (CASE WHEN deg[ia] < 8 AND deg[ib] < 8 AND i IN (ia, ib) THEN 1 ELSE 0 END)), deg[ia] < 8 AND deg[ib] < 8 FROM walk JOIN e ON e.k = walk.k + 1
), kept AS (SELECT word_a, word_b, weight FROM e JOIN walk USING (k) WHERE ok), ends AS (
  SELECT word, count(*) AS degree FROM (SELECT word_a AS word FROM kept UNION ALL SELECT word_b FROM kept) GROUP BY word
)"""


def _answers(items: str) -> str:
    """Pages in tens, as the made-up answers hold them, with the url missing from every seventh."""
    return f"""{RESULTS}, a AS (SELECT *, page_id // 10 AS query, CASE WHEN page_id % 7 > 0 THEN url END AS kept FROM results), r AS ({items})"""


ORACLES |= {
    "simhash_fingerprints": f"WITH {SIMHASH} SELECT doc_id, hash, lpad(lower(to_hex(u::UBIGINT)), 16, '0') AS hex FROM hashes",
    "simhash_duplicates": f"WITH {SIMHASH} SELECT * FROM copies",
    "independent_sources": f"WITH {SIMHASH} SELECT count(DISTINCT coalesce(duplicate_of, doc_id)) AS independent, count(duplicate_of) AS copies FROM hashes LEFT JOIN copies USING (doc_id)",
    "duplicate_groups": f"WITH {SIMHASH} SELECT duplicate_of AS doc_id, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS copies, count(*) AS n FROM copies GROUP BY duplicate_of",
    "source_list": f"""WITH {SIMHASH}, {_GRADE}, {RESULTS}
SELECT page_id AS doc_id, results.title, rank, duplicate_of, CASE WHEN grade IS NULL THEN '未抓取' ELSE (CASE grade WHEN 'full' THEN '正文完整' WHEN 'thin' THEN '正文很短' ELSE '仅摘要' END) || ' ' || w.word_count || ' 字' || coalesce(' · 与《' || f.title || '》同源', '') END AS body
FROM results LEFT JOIN worth w ON w.doc_id = page_id LEFT JOIN copies c ON c.doc_id = page_id LEFT JOIN docs f ON f.doc_id = duplicate_of""",
    "keyword_graph": f"WITH RECURSIVE {TFIDF}, {_EDGES} SELECT * FROM kept",
    "keyword_nodes": f"""WITH RECURSIVE {TFIDF}, {_EDGES} SELECT 'k:' || word AS id, word, CASE WHEN regexp_matches(word, '{C.TYPE_PRODUCT}') OR regexp_matches(word, '{C.TYPE_ENG_PRODUCT}') THEN '产品' WHEN regexp_matches(word, '{C.TYPE_ENG_TECHNOLOGY}') THEN '技术' ELSE '产品' END AS type,
  floor(weight * 1000 + 0.5) / 1000 AS weight, coalesce(degree, 0) AS degree, df AS n_docs FROM kw LEFT JOIN ends USING (word)""",
    "isolated_nodes": f"WITH RECURSIVE {TFIDF}, {_EDGES}, s AS (SELECT avg((coalesce(degree, 0) <= 1)::INT) AS isolated FROM kw LEFT JOIN ends USING (word)) SELECT isolated, isolated > 0.5 AS warn FROM s",
    "picked_targets": rf"""WITH {RESULTS}, c AS (SELECT page_id, rank, norm_url, trim(title) AS t, trim(snippet) AS s, CASE quality WHEN 1 THEN 'likely' WHEN 0 THEN 'unlikely' END AS verdict, CASE toxic WHEN 1 THEN 'low' WHEN 0 THEN 'high' END AS value FROM results LEFT JOIN labels ON doc_id = page_id), r AS (
  SELECT *, CASE WHEN regexp_matches(s, '(?i)not found') THEN 'reject' WHEN (length(t) < 4 AND length(s) < 30) OR length(s) < 60 THEN 'low' WHEN length(t) >= 8 AND length(s) >= 80 THEN 'high' ELSE 'usable' END AS tier FROM c WHERE verdict IS DISTINCT FROM 'unlikely'
), a AS (SELECT *, row_number() OVER (PARTITION BY value IS NOT DISTINCT FROM 'low' ORDER BY rank, norm_url) AS nth FROM r), b AS (
  SELECT * FROM a WHERE value IS DISTINCT FROM 'low' OR nth <= 3 - (SELECT count(*) FROM r WHERE value IS DISTINCT FROM 'low')
), e AS (SELECT *, row_number() OVER (PARTITION BY tier = 'low' ORDER BY rank, norm_url) AS mth FROM b)
SELECT page_id, tier, verdict, value FROM e WHERE tier IN ('high', 'usable') OR tier = 'low' AND mth <= 8 - (SELECT count(*) FROM b WHERE tier IN ('high', 'usable'))""",
    "cleaned_text": r"""WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '[ \t\x{00A0}]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS t FROM documents),
l AS (SELECT doc_id, list_filter(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x NOT IN ('分享', '收藏', '点赞', '评论', '关注', '举报', '展开', '收起', '阅读全文')) AS l FROM a)
SELECT doc_id, md5(regexp_replace(array_to_string(l, chr(10)), '^\s+|\s+$', '', 'g')) AS clean_md5 FROM l""",
    "available_artefacts": "SELECT count(*) FILTER (doc_id % 10 <> 9 AND text <> '') AS article, count(*) FILTER (doc_id % 5 = 0 AND text <> '') AS transcript, count(*) FILTER (doc_id % 4 = 0) AS image, count(*) FILTER (doc_id % 5 = 0) AS media FROM documents",
    "job_kinds": """WITH k AS (SELECT doc_id, unnest([CASE WHEN doc_id % 10 <> 9 AND text <> '' THEN 'article' END, CASE WHEN doc_id % 5 = 0 AND text <> '' THEN 'transcript' END, CASE WHEN doc_id % 4 = 0 THEN 'image' END, CASE WHEN doc_id % 5 = 0 THEN 'media' END]) AS kind FROM documents)
SELECT doc_id % 50 AS job_id, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM k WHERE kind IS NOT NULL GROUP BY 1""",
    "existing_artefacts": """WITH k AS (SELECT doc_id, unnest([CASE WHEN doc_id % 10 <> 9 AND text <> '' THEN 'article' END, CASE WHEN doc_id % 5 = 0 AND text <> '' THEN 'transcript' END, CASE WHEN doc_id % 4 = 0 THEN 'image' END, CASE WHEN doc_id % 5 = 0 THEN 'media' END]) AS kind FROM documents)
SELECT doc_id, kind, (kind = 'article' AND doc_id % 3 > 0) OR (kind = 'image' AND doc_id % 3 = 1) AS exists FROM k WHERE kind IS NOT NULL""",
    "image_outcomes": """WITH g AS (SELECT l_orderkey AS task_id, count(*) FILTER (l_quantity > 25) AS fetched, count(*) AS asked FROM lineitem WHERE l_linenumber <= 4 GROUP BY 1)
SELECT *, CASE WHEN fetched > 0 THEN 'done' ELSE 'failed' END AS status, CASE WHEN fetched > 0 AND fetched < asked THEN fetched || ' of ' || asked || ' images' END AS note FROM g""",
    "report_overview": f"""WITH {SIMHASH}, n AS (SELECT 'documents' AS name, count(*) AS n FROM docs UNION ALL SELECT 'sites', count(DISTINCT site) FROM docs UNION ALL SELECT 'graphed', count(*) FROM docs WHERE word_count >= 30
  UNION ALL SELECT 'concepts', least(60, (SELECT count(*) FROM (SELECT word FROM toks GROUP BY word HAVING count(DISTINCT doc_id) >= 2))) UNION ALL SELECT 'copies', count(*) FROM copies) SELECT * FROM n WHERE name <> 'copies' OR n > 0""",
    "unused_documents": f"WITH {DOCS} SELECT doc_id, CASE WHEN method = 'raw' THEN '正文没抓到，只有搜索摘要' ELSE '正文过短（' || word_count || ' 字）' END AS reason FROM docs WHERE method = 'raw' OR word_count < 30",
    "unused_methods": f"WITH {DOCS} SELECT method, count(*) AS n FROM docs WHERE method = 'raw' OR word_count < 30 GROUP BY 1",
    "data_as_of": "SELECT floor(epoch(max(ts)))::BIGINT AS as_of FROM events",
    "published_span": f"WITH {DOCS} SELECT count(published) AS dated, count(*) - count(published) AS undated, strftime(min(published), '%Y-%m') || CASE WHEN strftime(min(published), '%Y-%m') = strftime(max(published), '%Y-%m') THEN '' ELSE ' ~ ' || strftime(max(published), '%Y-%m') END AS span FROM docs",
    "shown_results": f"WITH {DOCS} SELECT doc_id FROM docs WHERE verdict IS DISTINCT FROM 'unlikely' AND value IS DISTINCT FROM 'low' AND doc_id % 3 <> 1",
    "video_documents": "SELECT doc_id FROM documents WHERE doc_id % 5 = 0",
    "unmatched_industries": "SELECT count(*) FILTER (NOT contains(lower(text), 'the') AND NOT contains(lower(text), 'eaux')) AS unmatched FROM documents",
    "refining_documents": f"WITH {DOCS} SELECT doc_id, word_count FROM docs ORDER BY CASE verdict WHEN 'likely' THEN 0.9 WHEN 'unlikely' THEN 0.05 ELSE 0 END DESC, word_count DESC, doc_id LIMIT 20",
    "chain_steps": f"WITH {RESULTS}, n AS (SELECT provider, count(*) % 9 AS found FROM results GROUP BY 1), b AS (SELECT provider, coalesce(sum(found) OVER (ORDER BY provider ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM n) SELECT * FROM b WHERE before < 12",
    "selected_documents": "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)",
    "merged_terms": """WITH w AS (SELECT item_id, string_split(lower(text), ' ') AS w FROM benchmark), l AS (SELECT item_id, list_concat(w[1:6], CASE WHEN item_id % 5 > 0 THEN list_reverse(w)[1:4] ELSE [] END) AS l FROM w)
SELECT item_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|') AS terms FROM l""",
    "year_chart": f"WITH {DOCS} SELECT year(published) AS year, count(*) FILTER (method = 'readability') AS readability, count(*) FILTER (method = 'raw') AS raw FROM docs WHERE published IS NOT NULL GROUP BY 1",
    "healthy_checks": "SELECT coalesce(bool_and(quality = 1) FILTER (toxic = 1), true) AS healthy, count(*) FILTER (quality <> 1) AS failed FROM labels",
    "searx_results": f"""WITH {_answers(f"SELECT query, row_number() OVER (PARTITION BY query ORDER BY page_id) AS rank, substr(sha1(norm_url), 1, 16) AS result_id, CASE WHEN page_id % 4 = 0 OR trim(title) = '' THEN url ELSE trim(title) END AS title, url, trim(left(snippet, 80)) AS snippet, {_HOST} AS domain, 'web' AS site, strftime(published, '%Y-%m-%d') AS raw_date FROM a WHERE kept IS NOT NULL AND ({_HOST} = 'example.net' OR ends_with({_HOST}, '.example.net'))")}
SELECT * REPLACE (rank::INT AS rank) FROM r WHERE rank <= 3""",
    "serper_results": f"""WITH {_answers("SELECT query, page_id, row_number() OVER (PARTITION BY query ORDER BY page_id) AS nth, url, trim(title) AS title FROM a WHERE kept IS NOT NULL")} SELECT query, (CASE WHEN page_id % 3 = 0 THEN page_id + 100 ELSE nth END)::INT AS rank, url, coalesce(nullif(title, ''), url) AS title, 'serper' AS provider FROM r""",
    "story_results": f"""WITH {_answers("SELECT query, page_id, row_number() OVER (PARTITION BY query ORDER BY page_id)::INT AS rank, coalesce(kept, 'https://news.ycombinator.com/item?id=' || page_id) AS url FROM a WHERE page_id % 6 > 0 AND title <> ''")}, v AS (SELECT *, list_transform([2 * page_id, page_id], lambda c: CASE WHEN c < 1000 THEN c::VARCHAR WHEN c < 10000 THEN regexp_replace(printf('%.1f', floor(c / 1000 * 10 + 0.5) / 10), '\\.0$', '') || 'k' ELSE regexp_replace(printf('%.1f', floor(c / 10000 * 10 + 0.5) / 10), '\\.0$', '') || '万' END) AS f FROM r)
SELECT query, rank, url, '赞 ' || f[1] || CASE WHEN page_id % 2 = 0 THEN ' · 评论 ' || f[2] ELSE '' END AS signals FROM v""",
    "video_results": f"""WITH {_answers("SELECT query, row_number() OVER (PARTITION BY query ORDER BY page_id)::INT AS rank, 'https://www.youtube.com/watch?v=' || page_id AS url, CASE WHEN page_id % 3 = 0 THEN 'u' ELSE provider END AS author, CASE WHEN page_id % 2 = 0 THEN 'b' ELSE 'https://i.ytimg.com/vi/' || page_id || '/mqdefault.jpg' END AS thumbnail, floor(page_id * 1.5)::INT AS duration FROM a WHERE page_id % 5 > 0")} SELECT * FROM r WHERE rank <= 6""",
    "bilibili_results": f"""WITH {_answers("SELECT query, row_number() OVER (PARTITION BY query ORDER BY page_id)::INT AS rank, CASE WHEN kept IS NULL THEN 'https://www.bilibili.com/video/BV' || page_id ELSE regexp_replace(replace(kept, 'https://', 'http://'), '^http://', 'https://') END AS url, trim(replace(regexp_replace(title, '\\s+', ' ', 'g'), '&amp;', '&')) || ' & more' AS title, ((page_id % 60) * 60 + 5)::INT AS duration, 'https://i.hdslb.com/x.jpg' AS thumbnail FROM a")} SELECT * FROM r WHERE rank <= 8""",
    "repository_results": f"""WITH {_answers("SELECT query, row_number() OVER (PARTITION BY query ORDER BY page_id)::INT AS rank, trim(title) AS title, trim(left(snippet, 20) || CASE WHEN page_id % 2 = 0 THEN ' · C' ELSE '' END) AS snippet, 'github' AS site FROM a WHERE kept IS NOT NULL")} SELECT * FROM r""",
}

_PLAIN_TEXT = f"plain AS (SELECT page_id, {_PLAIN} AS plain FROM pages)"
_MODEL_GRAPH = f"""WITH {DOCS}, d AS (
  SELECT doc_id, doc_id // 20 AS topic, doc_id % 20 AS k, row_number() OVER (PARTITION BY doc_id // 20 ORDER BY doc_id) - 1 AS i, word_count FROM docs
), shown AS (SELECT topic, doc_id, k AS nth FROM d WHERE k < 15),
ent AS (SELECT topic, 'e' || (doc_id % 7) AS name, arg_min('t' || (doc_id % 3), i) AS type, min(i) AS first, array_to_string(list_sort(list(DISTINCT 'a' || (doc_id % 5))), ',') AS aliases FROM d GROUP BY 1, 2),
ment AS (
  SELECT topic, name, s.doc_id, min(met) AS met FROM (
    SELECT topic, 'e' || (doc_id % 7) AS name, 2 * i AS met, k AS nth FROM d UNION ALL SELECT topic, 'e' || (doc_id % 7), 2 * i + 1, k * 3 % 20 FROM d
  ) JOIN shown s USING (topic, nth) GROUP BY ALL
), mine AS (SELECT topic, 'e' || (doc_id % 5) AS name, min(i) AS c FROM d WHERE i < 12 GROUP BY ALL),
dcl AS (SELECT topic, s.doc_id, min(i) AS c FROM (SELECT topic, i, k * 7 % 20 AS nth FROM d WHERE i < 12) JOIN shown s USING (topic, nth) GROUP BY ALL),
vote AS (SELECT topic, name, arg_min(c, met - 1000 * n) AS v FROM (SELECT topic, name, c, count(*) AS n, min(met) AS met FROM ment JOIN dcl USING (topic, doc_id) GROUP BY ALL) GROUP BY ALL),
ends AS (SELECT topic, least(12, count(*)) AS n FROM d GROUP BY topic),
edges AS (
  SELECT topic, 'k:e' || (doc_id % 7) AS src, 'k:e' || (doc_id * 3 % 8) AS dst, 'relation' AS kind, CASE WHEN k % 3 > 0 THEN 'is' END AS label, least(1, k / 10) AS weight, CASE WHEN k < 15 THEN doc_id::VARCHAR ELSE '' END AS evidence
  FROM d WHERE doc_id % 7 <> doc_id * 3 % 8 AND (topic, 'e' || (doc_id * 3 % 8)) IN (SELECT (topic, name) FROM ent)
  UNION ALL SELECT topic, 'd:' || doc_id, 'k:' || name, 'contains', NULL, 1.0, doc_id::VARCHAR FROM ment
), deg AS (SELECT topic, id, count(*) AS degree FROM (SELECT topic, src AS id FROM edges UNION ALL SELECT topic, dst FROM edges) GROUP BY ALL),
nodes AS (
  SELECT topic, 'k:' || name AS id, 'entity' AS kind, type, aliases, greatest(1, (SELECT count(*) FROM ment m WHERE m.topic = ent.topic AND m.name = ent.name))::DOUBLE AS weight, coalesce(degree, 0) AS degree, coalesce(c, v, n) AS cl, first, name
  FROM ent LEFT JOIN mine USING (topic, name) LEFT JOIN vote USING (topic, name) JOIN ends USING (topic) LEFT JOIN deg ON deg.topic = ent.topic AND deg.id = 'k:' || ent.name
  UNION ALL SELECT topic, 'd:' || doc_id, 'document', NULL, '', floor(round(ln(1 + word_count), 9) * 1000 + 0.5) / 1000, 0, CASE WHEN k < 15 THEN coalesce(c, n) ELSE 0 END, NULL, NULL FROM d LEFT JOIN dcl USING (topic, doc_id) JOIN ends USING (topic)
)"""
_BATCHED = """WITH b AS (SELECT page_id, page_id // 50 AS query, row_number() OVER (PARTITION BY page_id // 50 ORDER BY page_id) - 1 AS i FROM pages),
r AS (SELECT *, i // 20 AS batch, i % 20 AS nth FROM b WHERE i < 45),
a AS (SELECT query, batch, nth * 3 % 25 AS nth, page_id AS said, nth AS n FROM r WHERE (query + batch) % 4 <> 3),
v AS (SELECT r.page_id, r.query, r.batch, arg_max(said, said) AS said, arg_max(n, said) AS n FROM r JOIN a USING (query, batch, nth) GROUP BY ALL)"""
_NOTICES = ("已跳过 %d 条疑似与主题不相关的结果（它们仍在列表里；想抓的话在结果里勾选这几条，再点一次抓取）", "已跳过 %d 条预判低价值的结果（仅凭标题与摘要；在结果里勾选可以单独补抓）", "本次会话已有 %d 篇靠无头浏览器渲染拿到正文", "质量过滤层已跳过 %d 条明显无用/低质候选（候选不足时会自动补回低质链接）")
_NOTICE = ", ".join(f"CASE WHEN doc_id % {m} > 0 THEN replace('{t}', '%d', (doc_id % {m})::VARCHAR) END" for t, m in zip(_NOTICES, (2, 3, 7, 5), strict=True))
_TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def _labelled(table: str, key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.LABELS[table].items()) + f" ELSE {key} END"


ORACLES |= {
    "topic_graph_nodes": f"""SELECT k.id, 'keyword' AS kind, type, weight, degree, n_docs::BIGINT AS n_docs, 'c' || (ascii(word) % 4) AS cluster FROM ({ORACLES['keyword_nodes']}) k
UNION ALL SELECT 'd:' || doc_id, 'document', NULL, weight, degree, 1, cluster FROM ({ORACLES['document_nodes']}) JOIN ({ORACLES['document_clusters']}) USING (doc_id)""",
    "topic_graph_edges": f"""SELECT 'k:' || word_a AS src, 'k:' || word_b AS dst, 'cooccur' AS kind, weight, NULL AS evidence FROM ({ORACLES['keyword_graph']})
UNION ALL SELECT 'd:' || doc_id, 'k:' || word, 'contains', weight, doc_id::VARCHAR FROM ({ORACLES['contains_edges']})""",
    "model_graph_nodes": f"{_MODEL_GRAPH} SELECT topic, id, kind, type, aliases, weight, degree, 'c' || cl AS cluster FROM nodes",
    "model_graph_edges": f"{_MODEL_GRAPH} SELECT * FROM edges",
    "model_graph_clusters": f"""{_MODEL_GRAPH}, t AS (SELECT topic, cl, count(*) AS size, coalesce(array_to_string((list(name ORDER BY weight DESC, first) FILTER (kind = 'entity'))[1:5], ','), '') AS top_terms FROM nodes GROUP BY ALL)
SELECT topic, 'c' || cl AS cluster, CASE WHEN cl >= n THEN '其他' WHEN k % 4 = 0 THEN '主题 ' || (cl + 1) ELSE 'L' || k END AS label, size, top_terms FROM t JOIN ends USING (topic) LEFT JOIN (SELECT topic, i AS cl, k FROM d) USING (topic, cl)""",
    "model_verdicts": f"{_BATCHED} SELECT page_id, CASE WHEN said % 2 = 0 THEN 'likely' ELSE 'unlikely' END AS verdict, least(1, n / 10) AS score, CASE WHEN said % 3 = 0 THEN '模型未给出依据' ELSE 'r' END AS reason FROM v",
    "model_values": f"""{_BATCHED}, bad AS (SELECT query, min(batch) AS stop FROM r WHERE (query + batch) % 4 = 3 GROUP BY query)
SELECT page_id, CASE WHEN said % 2 = 0 THEN 'high' ELSE 'low' END AS verdict, ['未分类', 'x', '未分类', 'y'][1 + said % 4] AS category, 'r' AS reason FROM v LEFT JOIN bad USING (query) WHERE stop IS NULL OR batch < stop""",
    "model_failures": "SELECT doc_id, ['LLM 调用被取消', 'LLM 限流或过载，已降级：HTTP 429', 'LLM 限流或过载，已降级：Overloaded now', 'LLM_API_KEY 无效，已降级：invalid x api key', 'LLM 调用网络失败，已降级：ETIMEDOUT', 'LLM 构图失败，已降级：other 4290'][1 + doc_id % 6] AS reason FROM documents",
    "documents_of_pages": f"""WITH {RESULTS}, {_PLAIN_TEXT}, f AS (
  SELECT page_id, title AS own, CASE WHEN page_id % 2 = 0 THEN title ELSE 'found' END AS title, CASE WHEN page_id % 11 = 0 AND trim(title) <> '' THEN trim(title) WHEN page_id % 5 > 0 AND trim(plain) <> '' THEN trim(plain) ELSE trim(snippet) END AS body,
         CASE WHEN page_id % 11 = 0 AND trim(title) <> '' THEN 'subtitle' WHEN page_id % 5 > 0 AND trim(plain) <> '' THEN 'readability' ELSE 'raw' END AS method
  FROM results JOIN plain USING (page_id)
), w AS (SELECT *, title || '。' || body AS text FROM f), c AS (SELECT *, {WORD_COUNT} AS word_count FROM w)
SELECT page_id, title, kind, method, CASE WHEN method = 'raw' THEN 'HTTP 403' END AS error, md5(body) AS markdown_md5, left(body, 200) AS excerpt,
       CASE WHEN trim(left(body, 1000)) = '' THEN 'unknown' WHEN len(regexp_extract_all(left(body, 1000), '[一-鿿]')) / length(left(body, 1000)) > 0.15 THEN 'zh' ELSE 'en' END AS lang, word_count
FROM c JOIN ({ORACLES['url_facts']}) USING (page_id)""",
    "browser_choices": f"SELECT page_id, coalesce(shell OR page_id % 6 = 0, false) AS wanted, page_id % 3 = 0 AS retried, false AS never FROM ({ORACLES['html_facts']})",
    "site_logins": "SELECT source || '-' || (doc_id % 97) AS site, bool_or(doc_id % 40 = 0 OR coalesce(n_chars > 3000, true)) AS logged_in FROM documents GROUP BY 1",
    "video_grades": f"""WITH {DOCS}, p AS (SELECT doc_id, array_to_string(list_filter([title, CASE WHEN doc_id % 4 = 0 THEN title || chr(10) || 'c' ELSE '' END, CASE WHEN doc_id % 3 = 0 THEN text ELSE '' END], lambda x: x <> ''), chr(10)) AS body FROM docs),
n AS (SELECT doc_id, length({_TRIM.format('body')}) AS n FROM p)
SELECT doc_id, n >= 30 AS substantive, CASE WHEN n < 30 THEN '该视频没有可用的字幕与简介，仅有标题与标签' WHEN n < 300 THEN '该视频没有可用字幕，正文仅有简介与标签（' || n || ' 字）' END AS error FROM n""",
    "timely_results": """WITH a AS (SELECT event_id, user_id AS query, event_id % 5 = 0 AS own, event_id * 37 % 20000 AS ms FROM events),
c AS (SELECT query, greatest(coalesce(max(ms) FILTER (own), 0), least(coalesce(max(ms) FILTER (NOT own), 0), 8000)) AS closed FROM a GROUP BY query)
SELECT event_id, query FROM a JOIN c USING (query) WHERE ms <= closed""",
    "source_targets": """WITH p AS (SELECT n_name AS provider, ['de', 'en', 'xx', NULL][1 + n_nationkey % 4] AS own, CASE WHEN n_nationkey % 3 = 0 THEN 'topic' ELSE 'site' END AS scope, n_nationkey::BIGINT AS place FROM nation WHERE n_nationkey % 5 > 0)
SELECT lang AS site, provider, scope, CASE WHEN own IS NULL THEN 1 ELSE 0 END AS step, place FROM (VALUES ('de'), ('en'), ('fr')) s(lang) JOIN p ON own = lang OR (own IS NULL AND scope = 'site')""",
    "fetch_notices": f"SELECT doc_id, nullif(concat_ws('；', {_NOTICE}), '') AS notice FROM documents",
    "refined_intents": "SELECT item_id, array_to_string(list_filter([CASE WHEN item_id % 2 = 0 THEN 'goal' END] || string_split(text, ' ') || CASE WHEN item_id % 3 = 0 THEN ['q'] ELSE [] END, lambda x: x <> ''), '；') AS intent FROM benchmark",
    "view_states": """SELECT doc_id, CASE WHEN doc_id % 10 < 9 THEN array_to_string(list_filter([CASE WHEN doc_id <= 1000000 THEN 'a' END, CASE WHEN doc_id * 9000 <= 1000000 THEN 'b' END], lambda x: x IS NOT NULL), ',') END AS placed,
  CASE WHEN doc_id % 10 < 9 THEN 1 + (doc_id < 200)::BIGINT END AS n_pinned, CASE WHEN doc_id % 10 < 9 THEN doc_id % 2 = 0 END AS shown, CASE WHEN doc_id % 10 < 9 AND doc_id % 3 = 0 THEN 'free' END AS layout, CASE WHEN doc_id % 10 < 9 THEN 'cooccur' END AS hidden FROM documents""",
    "type_buttons": """WITH t AS (SELECT ['概念', 'z', '组织', 'a', NULL, '产品'][1 + n_nationkey % 6] AS type, min(n_nationkey) AS first FROM nation GROUP BY 1)
SELECT type, row_number() OVER (ORDER BY coalesce(list_position(['组织', '技术', '产品', '概念', '人物', '地点'], type), 7), first) AS place FROM t WHERE type IS NOT NULL""",
    "node_emphasis": """WITH e AS (SELECT l_suppkey AS a, l_suppkey * l_linenumber % 7 AS b FROM lineitem), n AS (SELECT b AS id FROM e WHERE a = 3 UNION SELECT a FROM e WHERE b = 3 UNION SELECT 3)
SELECT s_suppkey::BIGINT AS id, CASE WHEN (SELECT bool_or(s_suppkey = 3) FROM supplier) THEN s_suppkey IN (SELECT id FROM n) END AS near FROM supplier""",
    "node_places": """WITH n AS (SELECT doc_id, doc_id % 5 AS c, CASE WHEN doc_id % 2 = 0 THEN 320 ELSE 200 END AS far FROM documents),
a AS (SELECT *, CASE WHEN c < 4 THEN c / 4 * 2 * pi() ELSE (doc_id * 0.7::DOUBLE) % (2 * pi()) END AS t, CASE WHEN c < 4 THEN (c % 3 - 1) * 0.45 ELSE 0 END AS p FROM n)
SELECT doc_id, round(cos(t) * cos(p) * far + sin(doc_id * 12.9898::DOUBLE) * 45, 6) AS x, round(sin(p) * far + cos(doc_id * 78.233::DOUBLE) * 45, 6) AS y, round(sin(t) * cos(p) * far + sin(doc_id * 43.123::DOUBLE) * 45, 6) AS z FROM a""",
    "rewritten_queries": "SELECT doc_id AS site, CASE WHEN doc_id % 3 > 0 THEN lang END AS query FROM documents WHERE doc_id % 3 = 0 OR lang <> 'en'",
    "escaped_titles": rf"""WITH l AS (SELECT doc_id, text, {_TRIM.format(r"regexp_replace(text, '\s*\r?\n\s*', ' ', 'g')")} AS line, {_TRIM.format("regexp_replace(split_part(text, chr(10), 1), '[\\\\/:*?\"<>|\x00-\x1f]', '', 'g')")} AS head FROM documents)
SELECT doc_id, md5(regexp_replace(replace(text, '|', '\|'), '\r?\n', ' ', 'g')) AS cell, md5(regexp_replace(replace(replace(replace(text, '\', '\\'), '[', '\['), ']', '\]'), '\r?\n', ' ', 'g')) AS link,
  md5(CASE WHEN length(line) > 300 THEN left(line, 300) || '…' ELSE line END) AS quote, md5(regexp_replace(replace(replace(replace(replace(text, '"', ''), '`', ''), '[', '('), ']', ')'), '\r?\n', ' ', 'g')) AS diagram, md5(coalesce(nullif(head, ''), 'report') || '-20260102-0304.md') AS file FROM l""",
    "labelled_documents": f"SELECT doc_id, {_labelled('grade', 'grade')} AS grade_label, {_labelled('value', 'value')} AS value_label, {_labelled('provider', 'site')} AS site_label FROM (SELECT doc_id, grade FROM ({ORACLES['graded_documents']})) JOIN (WITH {DOCS} SELECT doc_id, value, site FROM docs) USING (doc_id)",
}
ORACLES["refined_results"] = f"""WITH {RESULTS}, n AS (SELECT page_id, norm_url, lower(concat_ws(' ', title, snippet)) AS t, CASE WHEN page_id % 4 = 0 THEN 'high' END AS value FROM results WHERE norm_url NOT IN (SELECT norm_url FROM results WHERE page_id % 2 = 0)),
a AS (SELECT page_id, value, CASE WHEN value IS NULL THEN CASE WHEN contains(t, 'the') THEN 'the' WHEN contains(t, 'eaux') THEN 'eaux' END END AS avoid FROM n) SELECT page_id, avoid, CASE WHEN avoid IS NULL THEN value ELSE 'low' END AS value FROM a"""
_SHORT = "CASE WHEN w < 1000 THEN w::VARCHAR WHEN w < 10000 THEN regexp_replace(printf('%.1f', floor(w / 1000 * 10 + 0.5) / 10), '\\.0$', '') || 'k' WHEN w < 100000000 THEN regexp_replace(printf('%.1f', floor(w / 10000 * 10 + 0.5) / 10), '\\.0$', '') || '万' ELSE regexp_replace(printf('%.1f', floor(w / 100000000 * 10 + 0.5) / 10), '\\.0$', '') || '亿' END"
ORACLES |= {
    "video_texts": f"""WITH {DOCS}, n AS (SELECT *, word_count * 100 AS w, CASE WHEN doc_id % 2 = 0 THEN site || '、' || method ELSE '' END AS tags, replace(title, ' ', chr(10)) AS chapters FROM docs),
s AS (SELECT *, concat_ws(' · ', CASE WHEN w > 0 THEN '播放 ' || {_SHORT.replace(chr(92) * 2, chr(92))} END, CASE WHEN doc_id % 2 > 0 THEN '点赞 1' END) AS numbers FROM n)
SELECT doc_id, md5(trim(array_to_string(list_filter([CASE WHEN doc_id % 3 > 0 THEN trim(site) END, tags, CASE WHEN doc_id % 5 > 0 THEN title END, chapters, text], lambda p: p <> ''), chr(10)))) AS text_md5,
  md5(trim(array_to_string(list_filter([CASE WHEN trim(title) <> '' THEN '标题：' || trim(title) END, CASE WHEN doc_id % 3 > 0 THEN 'UP主：' || trim(site) END, CASE WHEN numbers <> '' THEN '数据：' || numbers END, CASE WHEN tags <> '' THEN '标签：' || tags END,
    CASE WHEN chapters <> '' THEN chr(10) || '章节：' || chr(10) || chapters END, CASE WHEN doc_id % 4 > 0 AND text <> '' THEN chr(10) || '字幕：' || chr(10) || text END], lambda p: p IS NOT NULL), chr(10)))) AS markdown_md5, numbers FROM s""",
    "feed_probes": f"WITH {DOCS} SELECT site AS feed, count(*) AS n, (list(published ORDER BY doc_id))[1] AS latest, array_to_string(list(title ORDER BY doc_id)[1:3], '|') AS sample FROM docs GROUP BY site",
    "fetch_tally": f"WITH {DOCS} SELECT method, count(*) AS n, count(error) AS failed, sum(word_count)::BIGINT AS words FROM docs GROUP BY method",
}
