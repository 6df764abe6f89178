"""SQL that gives the same rows as the registered queries, from the same tables, in another engine."""

from __future__ import annotations

from .functions.text import BLANK, STOPWORDS
from .queries import BATCH, FIRST, LAST, PHRASES, SOURCE

_W = BLANK


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _tok(c: str, stop=STOPWORDS) -> str:
    return f"list_filter(string_split(regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9]+', ' ', 'g'), ' '), lambda t: t <> '' AND t NOT IN ({', '.join(map(_q, sorted(stop)))}))"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^{_W}+|{_W}+$', '', 'g')"


def _source(c: str) -> str:
    return f"nullif(regexp_replace(lower({_strip(c)}), '\\.+$', ''), '')"


def _host(c: str) -> str:
    authority = f"regexp_replace(regexp_extract({c}, '^[\\s\\x00-\\x20]*[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1), '^.*@', '')"
    plain = f"CASE WHEN starts_with({authority}, '[') THEN regexp_extract({authority}, '^\\[([^\\]]*)\\]', 1) ELSE regexp_extract({authority}, '^([^:\\[\\]]*)', 1) END"
    return f"nullif(regexp_replace(lower({plain}), '\\.+$', ''), '')"


DOCS = f"""docs AS (SELECT DISTINCT id, coalesce(title, '') AS title, coalesce(content, '') AS content, url,
  coalesce({_source("source_host")}, {_host("url")}) AS source_host, created_at FROM indexed_documents WHERE id IS NOT NULL)"""
TERMS = f"""parts AS (SELECT id, {_tok("title")} AS t, {_tok("content")} AS c FROM docs),
terms AS (SELECT 'all' AS scope, id, list_concat(list_concat(t, t), c) AS terms FROM parts UNION ALL SELECT 'title', id, t FROM parts UNION ALL SELECT 'content', id, c FROM parts)"""
INDEX = f"""{DOCS}, {TERMS},
lengths AS (SELECT scope, id, len(terms) AS dl FROM terms),
stats AS (SELECT scope, count(*) AS n_docs, coalesce(avg(dl), 0.0) AS avg_dl FROM lengths GROUP BY scope),
postings AS (SELECT p.scope, p.term, p.id, p.tf, l.dl FROM (SELECT scope, id, term, count(*) AS tf FROM (SELECT scope, id, unnest(terms) AS term FROM terms) GROUP BY ALL) p JOIN lengths l USING (scope, id)),
dfs AS (SELECT scope, term, count(*) AS df FROM postings GROUP BY ALL)"""


def _values(rows, names: str) -> str:
    return f"(VALUES {', '.join('(' + ', '.join(_q(v) if isinstance(v, str) else str(v) for v in r) + ')' for r in rows)}) AS v({names})"


def _matches(rows, k1: float = 1.5, b: float = 0.75, where: str = "TRUE", phrase: bool = False) -> str:
    """CTEs up to found(qid, id, score, matched_terms)."""
    q = _values(rows, "qid, query, ranking, scope")
    weight = f"""CASE WHEN q.ranking = 'bm25' THEN ln(1 + (s.n_docs - d.df + 0.5) / (d.df + 0.5)) * p.tf * ({k1} + 1) / (p.tf + {k1} * (1 - {b} + {b} * p.dl / s.avg_dl))
      ELSE p.tf / p.dl * (ln((1 + s.n_docs) / (1 + d.df)) + 1) END"""
    extra = ""
    if phrase:
        extra = f""" AND EXISTS (SELECT 1 FROM terms t JOIN q2 ON q2.qid = q.qid WHERE t.id = p.id AND t.scope IN ('title', 'content') AND (q2.scope = 'all' OR q2.scope = t.scope)
          AND contains(' ' || array_to_string(t.terms, ' ') || ' ', ' ' || array_to_string({_tok("q2.query")}, ' ') || ' '))"""
    return f"""WITH {INDEX}, q2 AS (SELECT * FROM {q}),
qt AS (SELECT qid, ranking, scope, term, count(*) AS times FROM (SELECT qid, ranking, scope, unnest({_tok("query")}) AS term FROM q2) GROUP BY ALL),
found AS (SELECT q.qid, p.id, sum(q.times * ({weight})) AS score, list_sort(list(DISTINCT p.term)) AS matched_terms
  FROM qt q JOIN postings p ON p.scope = q.scope AND p.term = q.term JOIN dfs d ON d.scope = q.scope AND d.term = q.term JOIN stats s ON s.scope = q.scope JOIN docs x ON x.id = p.id
  WHERE {where}{extra} GROUP BY q.qid, p.id)"""


def _page(matches: str, limit: int | None = 10, offset: int = 0) -> str:
    top = "TRUE" if limit is None else f"rank <= {offset + limit}"
    return f"""{matches}, ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM found)
SELECT qid, rank, id, round(score, 6) AS score, array_to_string(matched_terms, ' ') AS matched_terms FROM ranked WHERE {top} AND rank > {offset}"""


def _batch(ranking: str | None = None, scope: str | None = None) -> list:
    return [r for r in BATCH if (ranking is None or r[2] == ranking) and (scope is None or r[3] == scope)]


_OWN = f"(x.source_host = '{SOURCE}' OR x.source_host LIKE '%.{SOURCE}')"
_DAYS = f"CAST(x.created_at AT TIME ZONE 'UTC' AS DATE) BETWEEN DATE '{FIRST}' AND DATE '{LAST}'"

_JUDGED = f"""WITH d AS (SELECT doc_id AS id, nullif(lower({_strip("source")}), '') AS name, text FROM documents),
terms AS (SELECT doc_id AS id, {_tok("text")} AS terms FROM documents), lengths AS (SELECT id, len(terms) AS dl FROM terms), stats AS (SELECT count(*) AS n, avg(dl) AS avg_dl FROM lengths),
postings AS (SELECT p.*, l.dl FROM (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(terms) AS term FROM terms) GROUP BY ALL) p JOIN lengths l USING (id)),
dfs AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
queries AS (SELECT DISTINCT name, r.ranking FROM d, (VALUES ('bm25'), ('tfidf')) AS r(ranking) WHERE name IS NOT NULL),
qt AS (SELECT name, ranking, term, count(*) AS times FROM (SELECT name, ranking, unnest({_tok("replace(name, '_', ' ')")}) AS term FROM queries) GROUP BY ALL),
found AS (SELECT q.name, q.ranking, p.id, sum(q.times * CASE WHEN q.ranking = 'bm25' THEN ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg_dl)) ELSE tf / dl * (ln((1 + n) / (1 + df)) + 1) END) AS score
  FROM qt q JOIN postings p USING (term) JOIN dfs USING (term), stats GROUP BY ALL),
hits AS (SELECT name, ranking, id, row_number() OVER (PARTITION BY name, ranking ORDER BY round(score, 9) DESC, id) AS rank FROM found),
metrics AS (SELECT q.name, q.ranking, coalesce(g.hit, 0) / 10 AS precision, coalesce(g.hit, 0) / r.relevant AS recall, coalesce(1.0 / g.first, 0.0) AS reciprocal_rank
  FROM queries q JOIN (SELECT name, count(*) AS relevant FROM d WHERE name IS NOT NULL GROUP BY name) r USING (name)
  LEFT JOIN (SELECT h.name, h.ranking, count(*) AS hit, CAST(min(rank) AS DOUBLE) AS first FROM hits h JOIN d ON d.id = h.id AND d.name = h.name WHERE rank <= 10 GROUP BY ALL) g ON g.name = q.name AND g.ranking = q.ranking)"""

_ITEMS = "items AS (SELECT DISTINCT id, job_id, position, title, canonical_url, error, embedded_content FROM crawl_items)"
_VALID = f"""{_ITEMS}, checked AS (SELECT job_id, position, id, {_strip("title")} AS t, {_strip("coalesce(embedded_content, title)")} AS c, nullif({_strip("canonical_url")}, '') AS u,
  title, coalesce(embedded_content, title) AS content, error AS extra FROM items),
valid AS (SELECT job_id, position, id, CASE WHEN title IS NULL THEN 'title: Field required' WHEN t = '' THEN 'title: must be a non-empty string' WHEN contains(t, chr(0)) THEN 'title: must not contain null characters'
    WHEN content IS NULL THEN 'content: Field required' WHEN c = '' THEN 'content: must be a non-empty string' WHEN contains(c, chr(0)) THEN 'content: must not contain null characters'
    WHEN u IS NOT NULL AND contains(u, chr(0)) THEN 'url: must not contain null characters' WHEN extra IS NOT NULL THEN 'error: Extra inputs are not permitted' END AS error, t, c, u FROM checked)"""
_CLASSIFIED = f"""{_VALID}, done AS (SELECT job_id, position, id, CASE WHEN error IS NULL THEN u END AS url, error,
   error IS NULL AND u IS NOT NULL AND (EXISTS (SELECT 1 FROM document_responses d WHERE d.url = u) OR row_number() OVER (PARTITION BY u, error IS NULL ORDER BY job_id, position, id) > 1) AS again FROM valid),
classified AS (SELECT job_id, position, id, url, CASE WHEN again THEN 'duplicate_url' ELSE error END AS error, CASE WHEN error IS NOT NULL THEN 'failed' WHEN again THEN 'skipped' ELSE 'imported' END AS status FROM done)"""
_RESPONSES = "responses AS (SELECT DISTINCT * FROM document_responses)"
_OUTCOMES = """x AS (SELECT DISTINCT * FROM crawl_items), outcomes AS (SELECT DISTINCT ingestion_item_id, CASE WHEN document_id IS NOT NULL THEN 'imported' WHEN title IS NULL THEN 'failed' ELSE 'skipped' END AS status,
  CASE WHEN document_id IS NOT NULL THEN NULL WHEN title IS NULL THEN 'title: Field required' ELSE 'duplicate_url' END AS error FROM x WHERE ingestion_item_id IS NOT NULL)"""
_FRONTIER = "f AS (SELECT DISTINCT id, job_id, fetch_attempts AS depth, CASE WHEN fetch_status = 'fetched' THEN 'completed' ELSE fetch_status END AS status, source_item_id AS continuation FROM (SELECT DISTINCT * FROM crawl_items))"
_SNIP = "list_filter(list_transform(list_concat(string_split(title, '.'), string_split(content, '.')), lambda p: " + _strip("p") + "), lambda p: p <> '')"


def _snippet(hit: str) -> str:
    return f"substring(coalesce(list_filter({_SNIP}, lambda p: {hit})[1], content), 1, 180)"


#: Names of parameters that are dropped, and schemes, by kind of source.
_KINDS = {"medium": ("utm_.*|source|ref|sk|from", "'http', 'https'"), "rss": ("utm_.*|source|ref|from|feed", "'https'")}


def _canonical(c: str, kind: str) -> str:
    tracking, schemes = _KINDS[kind]
    u = _strip(c)
    scheme, authority = f"lower(regexp_extract({u}, '^([A-Za-z][A-Za-z0-9+.\\-]*)://', 1))", f"lower(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1))"
    path, query = f"regexp_extract({u}, '^[^:]*://[^/?#]*([^?#]*)', 1)", f"regexp_extract({u}, '^[^?#]*\\?([^#]*)', 1)"
    pairs = f"list_transform(list_filter(string_split({query}, '&'), lambda p: p <> ''), lambda p: [url_decode(replace(split_part(p, '=', 1), '+', ' ')), url_decode(replace(substr(p, length(split_part(p, '=', 1)) + 2), '+', ' '))])"
    kept = f"list_filter({pairs}, lambda p: NOT regexp_full_match(lower(p[1]), '{tracking}'))"
    joined = f"array_to_string(list_transform({kept}, lambda p: replace(url_encode(p[1]), '%20', '+') || '=' || replace(url_encode(p[2]), '%20', '+')), '&')"
    return f"CASE WHEN {scheme} IN ({schemes}) AND {authority} <> '' THEN {scheme} || '://' || {authority} || coalesce(nullif({path}, ''), '/') || coalesce('?' || nullif({joined}, ''), '') END"


_PUBLICATION = "regexp_extract(seed_url, '^https://[^/]+(/[^/]*)', 1)"
_SHARED = "regexp_replace(lower(regexp_extract({}, '^(?i:(https://[^/?#]*))', 1)), ':443$', '')"
_LINKS = """links AS (SELECT 'root' AS parent, 'category' AS kind, r_regionkey AS position, CAST(NULL AS BIGINT) AS page_id, r_name AS title FROM region
UNION ALL SELECT r_name, 'category', n_nationkey, NULL, n_name FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT n_name, 'page', s_suppkey, s_suppkey, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT DISTINCT n_name, 'category', length(c_mktsegment), NULL, n_name || '/' || c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
_IMPORTED = f"""WITH {_CLASSIFIED} SELECT (SELECT max(id) FROM document_responses) + row_number() OVER (ORDER BY job_id, position, v.id) AS id, v.t AS title, {{content}}c.url, 'active' AS status
FROM classified c JOIN valid v USING (job_id, position, id) WHERE status = 'imported'"""
_CATEGORY = f"CASE WHEN starts_with(lower({_strip('title')}), 'category:') THEN {_strip('substr(' + _strip('title') + ', 10)')} ELSE {_strip('title')} END"


def oracle_sql() -> dict[str, str]:
    base = f"WITH {INDEX} "
    bm25 = _batch("bm25")
    return {
        "analyze_tokens": f"WITH {DOCS} SELECT id, array_to_string({_tok('content')}, ' ') AS tokens FROM docs",
        "analyze_custom_stopwords": f"WITH {DOCS} SELECT id, array_to_string({_tok('title', ('archive', 'notes', 'the'))}, ' ') AS tokens FROM docs",
        "doc_lengths": base + "SELECT scope, id, dl FROM lengths",
        "scope_stats": base + "SELECT scope, n_docs, round(avg_dl, 6) AS avg_dl FROM stats",
        "vocabulary_size": base + "SELECT scope, count(*) AS n_terms FROM dfs GROUP BY scope",
        "term_frequencies": base + "SELECT scope, term, id, tf, dl FROM postings",
        "document_frequencies": base + "SELECT scope, term, df FROM dfs",
        "idf_table": base + "SELECT scope, term, df, round(ln(1 + (n_docs - df + 0.5) / (df + 0.5)), 6) AS bm25_idf, round(ln((1 + n_docs) / (1 + df)) + 1, 6) AS tfidf_idf FROM dfs JOIN stats USING (scope)",
        "postings_for_term": base + "SELECT id, tf, dl FROM postings WHERE scope = 'all' AND term = 'archive'",
        "postings_candidates": base + f"SELECT p.id, tf, dl FROM postings p JOIN docs x USING (id) WHERE scope = 'content' AND term = 'archive' AND {_OWN} AND {_DAYS}",
        "bm25_top10": _page(_matches(_batch("bm25", "all"))),
        "bm25_title": _page(_matches(_batch("bm25", "title"))),
        "bm25_content": _page(_matches(_batch("bm25", "content"))),
        "bm25_custom_k1_b": _page(_matches(bm25, 1.2, 0.3)),
        "bm25_paged": _page(_matches(bm25), 7, 5),
        "bm25_total": _matches(BATCH) + " SELECT qid, count(*) AS total_results FROM found GROUP BY qid",
        "bm25_full_scores": _page(_matches(bm25), None),
        "tfidf_top10": _page(_matches(_batch("tfidf"))),
        "explain_bm25": f"""WITH {INDEX}, q2 AS (SELECT * FROM {_values(bm25, "qid, query, ranking, scope")}), qt AS (SELECT qid, scope, unnest(terms) AS term, generate_subscripts(terms, 1) - 1 AS pos FROM (SELECT qid, scope, {_tok("query")} AS terms FROM q2))
SELECT qid, p.id, pos, p.term, tf, df, round(ln(1 + (n_docs - df + 0.5) / (df + 0.5)), 6) AS idf, round(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg_dl)), 6) AS contribution
FROM qt JOIN postings p ON p.scope = qt.scope AND p.term = qt.term JOIN dfs d ON d.scope = qt.scope AND d.term = qt.term JOIN stats s ON s.scope = qt.scope""",
        "match_any": _matches(BATCH) + " SELECT qid, id FROM found",
        "phrase_match": f"""WITH {DOCS}, {TERMS}, q2 AS (SELECT * FROM {_values(PHRASES, "qid, query, scope")}) SELECT DISTINCT qid, t.id FROM terms t JOIN q2 ON q2.scope = 'all' OR q2.scope = t.scope
WHERE t.scope IN ('title', 'content') AND len({_tok("query")}) > 0 AND contains(' ' || array_to_string(t.terms, ' ') || ' ', ' ' || array_to_string({_tok("query")}, ' ') || ' ')""",
        "phrase_bm25": _page(_matches([(a, b, "bm25", c) for a, b, c in PHRASES], phrase=True)),
        "filter_source": f"WITH {DOCS} SELECT id, source_host FROM docs x WHERE {_OWN}",
        "filter_dates": f"WITH {DOCS} SELECT id, CAST(CAST(created_at AT TIME ZONE 'UTC' AS DATE) AS VARCHAR) AS day FROM docs x WHERE {_DAYS}",
        "filter_combined": f"WITH {DOCS} SELECT id FROM docs x WHERE {_OWN} AND {_DAYS}",
        "filtered_search": _page(_matches(BATCH, where=f"{_OWN} AND {_DAYS}")),
        "source_hosts": f"SELECT DISTINCT id, {_host('url')} AS url_host, {_source('source_host')} AS given, coalesce({_source('source_host')}, {_host('url')}) AS host FROM indexed_documents",
        "utc_dates": "SELECT CAST(CAST(created_at AT TIME ZONE 'UTC' AS DATE) AS VARCHAR) AS day, count(DISTINCT id) AS n FROM indexed_documents GROUP BY 1",
        "snippets": f"WITH {DOCS} SELECT id, {_snippet('''contains(lower(p), 'archive') OR contains(lower(p), 'slow')''')} AS snippet FROM docs",
        "search_page_enriched": f"""{_matches(BATCH)}, ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM found)
SELECT qid, rank, r.id AS document_id, title, url, round(score, 6) AS score, {_snippet("len(list_filter(r.matched_terms, lambda t: contains(lower(p), t))) > 0")} AS snippet, array_to_string(matched_terms, ' ') AS matched_terms FROM ranked r JOIN docs USING (id) WHERE rank <= 10""",
        "eval_queries": _JUDGED + " SELECT name, ranking, round(precision, 6) AS precision, round(recall, 6) AS recall, round(reciprocal_rank, 6) AS reciprocal_rank FROM metrics",
        "eval_summary": _JUDGED + " SELECT ranking, count(*) AS queries, round(avg(precision), 6) AS mean_precision, round(avg(recall), 6) AS mean_recall, round(avg(reciprocal_rank), 6) AS mrr FROM metrics GROUP BY ranking",
        "latency_percentiles": "SELECT event_type, round(median(value), 6) AS median, round(quantile_disc(value, 0.95), 6) AS p95, round(max(value), 6) AS max FROM events GROUP BY event_type",
        "ingest_validated": f"WITH {_VALID} SELECT job_id, position, id, CASE WHEN error IS NULL THEN t END AS title, CASE WHEN error IS NULL THEN c END AS content, CASE WHEN error IS NULL THEN u END AS url, error FROM valid",
        "ingest_classified": f"WITH {_CLASSIFIED} SELECT * FROM classified",
        "ingest_counts": f"WITH {_CLASSIFIED} SELECT job_id, count(*) AS received, count(*) FILTER (status = 'imported') AS imported, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'failed') AS failed FROM classified GROUP BY job_id",
        "ingest_first_wins": "SELECT job_id, canonical_url, position, id FROM (SELECT DISTINCT job_id, canonical_url, position, id FROM crawl_items WHERE canonical_url IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY canonical_url ORDER BY job_id, position, id) = 1",
        "active_page": f"WITH {_RESPONSES} SELECT id, title, url FROM responses WHERE status = 'active' ORDER BY id LIMIT 50 OFFSET 100",
        "soft_delete_view": f"WITH {_RESPONSES}, gone AS (SELECT DISTINCT document_id AS id FROM crawl_items WHERE (fetch_status = 'failed' OR title IS NULL) AND document_id IS NOT NULL) SELECT CASE WHEN status = 'active' AND id IN (SELECT id FROM gone) THEN 'deleted' ELSE status END AS status, count(*) AS n FROM responses GROUP BY 1",
        "patched_view": f"""WITH {_RESPONSES}, c AS (SELECT document_id AS id, max(title) AS title, max(discovered_url) AS url FROM crawl_items WHERE document_id IS NOT NULL GROUP BY 1)
SELECT r.id, CASE WHEN r.status = 'active' AND c.title IS NOT NULL THEN c.title ELSE r.title END AS title, CASE WHEN r.status = 'active' AND c.id IS NOT NULL THEN c.url ELSE r.url END AS url, r.status FROM responses r LEFT JOIN c USING (id)""",
        "upsert_view": f"""WITH {DOCS}, n AS (SELECT DISTINCT id, coalesce(title, '') AS title, coalesce(content, '') AS content FROM document_responses)
SELECT id, title, length(content) AS chars FROM n UNION ALL SELECT id, title, length(content) FROM docs WHERE id NOT IN (SELECT id FROM n)""",
        "remove_doc_stats": f"""WITH {DOCS}, {TERMS} SELECT scope, count(*) AS n_docs, round(avg(len(terms)), 6) AS avg_dl FROM terms WHERE id NOT IN (SELECT id FROM indexed_documents WHERE created_at IS NULL) GROUP BY scope""",
        "visible_counts": f"""WITH {DOCS} SELECT id, length(regexp_replace(content, '{_W}', '', 'g')) AS visible, {_strip("content")} <> '' AND NOT regexp_matches(content, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]') AS clean,
substring(trim(regexp_replace(content, '{_W}+', ' ', 'g'), ' '), 1, 80) AS message FROM docs""",
        "crawl_bfs": "SELECT 'root' AS title, CAST(0 AS BIGINT) AS depth UNION ALL SELECT r_name, 1 FROM region UNION ALL SELECT n_name, 2 FROM nation JOIN region ON n_regionkey = r_regionkey",
        "crawl_bfs_pages": """SELECT row_number() OVER (ORDER BY r_regionkey, n_nationkey, s_suppkey) - 1 AS position, s_suppkey AS page_id, s_name AS title FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
        "crawl_capped": """WITH once AS (SELECT job_id, canonical_url, position, id FROM (SELECT DISTINCT job_id, canonical_url, position, id FROM crawl_items WHERE canonical_url IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY job_id, canonical_url ORDER BY position, id) = 1)
SELECT job_id, position, id, canonical_url, row_number() OVER (PARTITION BY job_id ORDER BY position, id) AS n FROM once JOIN crawl_runs USING (job_id) QUALIFY n <= max_articles""",
        "crawl_counts": f"""WITH {_OUTCOMES}, c AS (SELECT job_id, count(id) AS discovered, count(*) FILTER (fetch_status = 'fetched') AS fetched, count(*) FILTER (o.status = 'imported') AS imported, count(*) FILTER (o.status = 'skipped') AS skipped,
  count(*) FILTER (fetch_status = 'failed') AS fetch_failed, count(*) FILTER (o.status = 'failed') AS ingestion_failed FROM x LEFT JOIN outcomes o USING (ingestion_item_id) GROUP BY job_id)
SELECT *, fetch_failed + ingestion_failed AS failed, fetch_failed + ingestion_failed + imported + skipped AS terminal FROM c""",
        "crawl_item_report": f"WITH {_OUTCOMES} SELECT job_id, position, id, canonical_url, fetch_status, o.status AS ingestion_status, document_id, coalesce(x.error, o.error) AS error FROM x LEFT JOIN outcomes o USING (ingestion_item_id)",
        "next_positions": "SELECT job_id, coalesce(max(position) + 1, 0) AS next_position FROM crawl_items GROUP BY job_id",
        "pending_frontier": f"WITH {_FRONTIER} SELECT job_id, depth, id FROM f WHERE status = 'pending' QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY depth, id) = 1",
        "has_pending": f"WITH {_FRONTIER} SELECT job_id, bool_or(status = 'pending') AS has_pending FROM f GROUP BY job_id",
        "categories_visited": f"WITH {_FRONTIER} SELECT job_id, count(*) FILTER (status IN ('completed', 'failed') OR continuation IS NOT NULL) AS categories_visited FROM f GROUP BY job_id",
        "crawl_checkpoint": """WITH have AS (SELECT DISTINCT url, id FROM document_responses WHERE url IS NOT NULL), once AS (SELECT canonical_url, job_id, position AS place, id FROM (SELECT DISTINCT canonical_url, job_id, position, id FROM crawl_items WHERE canonical_url IS NOT NULL)
  QUALIFY row_number() OVER (PARTITION BY canonical_url ORDER BY job_id, position, id) = 1)
SELECT canonical_url, id, (SELECT max(id) + 1 FROM have) + row_number() OVER (ORDER BY job_id, place, id, canonical_url) - 1 AS position FROM once WHERE canonical_url NOT IN (SELECT url FROM have)""",
        "job_progress": "SELECT job_id, count(*) FILTER (fetch_status <> 'pending') AS current, count(*) AS total, round(count(*) FILTER (fetch_status <> 'pending') / count(*) * 100, 2) AS percentage FROM (SELECT DISTINCT * FROM crawl_items) GROUP BY job_id",
        "embedded_pages": """SELECT DISTINCT id, CASE WHEN embedded_content IS NOT NULL AND embedded_content <> '' THEN '<html><head><link rel="canonical" href="' || e(canonical_url) || '"><meta property="og:title" content="' || e(coalesce(nullif(title, ''), 'Article')) || '"></head><body><article>' || embedded_content || '</article></body></html>' END AS html FROM crawl_items""".replace(
            "e(canonical_url)", _escaped("canonical_url")).replace("e(coalesce(nullif(title, ''), 'Article'))", _escaped("coalesce(nullif(title, ''), 'Article')")),
        "canonical_urls": f"SELECT DISTINCT id, {_canonical('discovered_url', 'medium')} AS medium, {_canonical('discovered_url', 'rss')} AS rss FROM crawl_items",
        "wikipedia_urls": f"""WITH x AS (SELECT DISTINCT page_id, title, {_CATEGORY} AS c FROM fetched_wikipedia_articles)
SELECT DISTINCT page_id, 'https://en.wikipedia.org/wiki/' || replace(replace(url_encode(replace(title, ' ', '_')), '%28', '('), '%29', ')') AS url,
CASE WHEN c <> '' AND NOT regexp_matches({_strip('title')}, '[\\x00-\\x1f\\x7f]') AND NOT (regexp_matches(c, '^[A-Za-z][A-Za-z0-9+.\\-]*:\\S*$') AND NOT regexp_matches(c, '^[A-Za-z][A-Za-z0-9+.\\-]*::')) AND NOT starts_with(c, '//') AND length(c) <= 246 THEN 'Category:' || c END AS category FROM x""",
        "publication_scope": f"""WITH x AS (SELECT DISTINCT i.id, discovered_url AS u, seed_url, regexp_extract(seed_url, '^(https://[^/]+)', 1) AS origin, {_PUBLICATION} AS path FROM crawl_items i JOIN crawl_runs USING (job_id)),
y AS (SELECT *, coalesce(regexp_extract(u, '^https://[^/?#]*([^?#]*)', 1), '') AS p, coalesce({_SHARED.format('u')}, '') AS a, {_SHARED.format('seed_url')} AS b FROM x)
SELECT DISTINCT id, a = b AND a <> '' AS same_origin, coalesce('https://' || lower(regexp_extract(u, '^https://([^/:?#]*)', 1)) = origin AND p NOT IN ('/feed', '/sitemap.xml', '/robots.txt'), FALSE) AS own,
coalesce(starts_with(u, 'https://') AND starts_with(p, path || '/'), FALSE) AS section FROM y""",
        "parse_feed": f"""WITH items AS (SELECT DISTINCT * FROM crawl_items), x AS (SELECT batch_no AS feed_id, position, nullif(array_to_string(list_filter(string_split(regexp_replace(coalesce(source_item_id, ''), '\\s+', ' ', 'g'), ' '), lambda t: t <> ''), ' '), '') AS guid,
  array_to_string(list_filter(string_split(regexp_replace(coalesce(title, ''), '\\s+', ' ', 'g'), ' '), lambda t: t <> ''), ' ') AS title, regexp_replace(regexp_replace({_strip('discovered_url')}, '\\?(#|$)', '\\1'), '#$', '') AS discovered_url, {_canonical('discovered_url', 'rss')} AS canonical_url FROM items JOIN crawl_runs USING (job_id))
SELECT feed_id, row_number() OVER (PARTITION BY feed_id ORDER BY position) - 1 AS position, coalesce(guid, canonical_url) AS source_item_id, title, discovered_url, canonical_url, CAST(NULL AS VARCHAR) AS embedded_content, CAST(NULL AS VARCHAR) AS error
FROM x WHERE title <> '' AND canonical_url IS NOT NULL""",
        "parse_sitemap": """WITH x AS (SELECT DISTINCT batch_no, batch_no * 1000 + position // 100 AS feed_id, position, trim(discovered_url) AS url FROM crawl_items JOIN crawl_runs USING (job_id))
SELECT feed_id, CASE WHEN batch_no % 2 = 1 THEN 'sitemap' ELSE 'page' END AS kind, url, CAST(NULL AS VARCHAR) AS error FROM x WHERE feed_id <> 2000 UNION ALL SELECT DISTINCT feed_id, NULL, NULL, 'medium_invalid_sitemap' FROM x WHERE feed_id = 2000""",
        "category_members": f"WITH {_LINKS} SELECT parent, kind, title, row_number() OVER (PARTITION BY parent ORDER BY kind, position, title) - 1 AS at FROM links",
        "point_lookup": f"WITH {_RESPONSES} SELECT id, title, content, url, status FROM responses WHERE id = 7 AND status = 'active'",
        "imported_documents": _IMPORTED.replace("{content}", "v.c AS content, "),
        "stream_ingest": _IMPORTED.replace("{content}", ""),
        "staged_items": f"""WITH {_VALID} SELECT job_id || '/' || (position // 100) AS job_id, row_number() OVER (PARTITION BY job_id, position // 100 ORDER BY position, id) - 1 AS position,
CASE WHEN error IS NULL THEN t END AS title, CASE WHEN error IS NULL THEN u END AS url, error FROM valid""",
        "pending_items": "SELECT DISTINCT job_id, position, id, ingestion_item_id FROM crawl_items WHERE fetch_status = 'fetched' AND ingestion_item_id IN (SELECT ingestion_item_id FROM crawl_items WHERE ingestion_item_id IS NOT NULL AND document_id IS NULL)",
        "frontier_lookup": "SELECT DISTINCT id, job_id, canonical_url AS locator FROM crawl_items x WHERE EXISTS (SELECT 1 FROM crawl_items y WHERE y.job_id = x.job_id AND y.canonical_url = x.canonical_url AND y.position = 0)",
        "json_corpus": f"WITH {DOCS} SELECT id, title, content, url FROM docs",
        "index_status": f"WITH {DOCS} SELECT count(*) AS documents FROM docs",
        "index_upsert": f"""WITH {INDEX.replace('docs AS (', 'old AS (', 1).replace('parts AS (', "fresh AS (SELECT DISTINCT id, coalesce(title, '') AS title, coalesce(content, '') AS content FROM document_responses), docs AS (SELECT id, title, content FROM fresh UNION ALL SELECT id, title, content FROM old WHERE id NOT IN (SELECT id FROM fresh)), parts AS (", 1)}
SELECT scope, term, df FROM dfs""",
        "index_removed_top10": _page(_matches(BATCH)).replace("WHERE id IS NOT NULL)", "WHERE id IS NOT NULL AND created_at IS NOT NULL)", 1),
        "synthetic_corpus": f"""WITH docs AS (SELECT id, 'Distributed systems guide ' || id AS title, 'distributed systems search indexing caching document number ' || id || ' with BM25 ranking and retrieval' AS content FROM (SELECT unnest(range((SELECT count(DISTINCT id) FROM indexed_documents))) AS id)),
{TERMS} SELECT scope, count(*) AS n_docs, round(avg(len(terms)), 6) AS avg_dl FROM terms GROUP BY scope""",
    }


def _escaped(c: str) -> str:
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        c = f"replace({c}, '{mark}', '{name}')" if mark != "''" else f"replace({c}, '''', '{name}')"
    return c
