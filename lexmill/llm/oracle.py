"""SQL that gives the same rows as those of this subpackage's queries that SQL can express on whole tables."""

from __future__ import annotations

_BLANK = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _clean(c: str) -> str:
    return f"nullif(regexp_replace(lower(regexp_replace({c}, '^{_BLANK}+|{_BLANK}+$', '', 'g')), '\\.+$', ''), '')"


_HOST = f"""coalesce({_clean("source_host")}, {_clean("regexp_extract(url, '^\\s*[A-Za-z][A-Za-z0-9+.\\-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)")})"""
_LINES = f"""docs AS (SELECT DISTINCT id, {_HOST} AS src, content FROM indexed_documents WHERE id IS NOT NULL AND {_HOST} IS NOT NULL),
lines AS (SELECT id, src, unnest(x) AS line, generate_subscripts(x, 1) - 1 AS line_no FROM (SELECT id, src, string_split(content, chr(10)) AS x FROM docs)),
keyed AS (SELECT id, src, line_no, regexp_replace(lower(upper(line)), '[^\\p{{L}}]+', '', 'g') AS k FROM lines),
excessive AS (SELECT src, k FROM (SELECT src, k, count(DISTINCT id) AS n FROM keyed WHERE k <> '' GROUP BY ALL) JOIN (SELECT src, count(DISTINCT id) AS total FROM docs GROUP BY src) USING (src) WHERE n >= 5 AND n >= 0.1 * total)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": f"WITH {_LINES} SELECT DISTINCT id, line_no FROM keyed JOIN excessive USING (src, k)",
        "p2_clean": f"""WITH {_LINES}, bad AS (SELECT DISTINCT id, line_no FROM keyed JOIN excessive USING (src, k)), hit AS (SELECT DISTINCT id FROM bad),
every AS (SELECT DISTINCT id, content FROM indexed_documents)
SELECT id, content FROM every WHERE id NOT IN (SELECT id FROM hit)
UNION ALL SELECT h.id, coalesce(string_agg(l.line, chr(10) ORDER BY l.line_no) FILTER (b.id IS NULL), '') FROM hit h JOIN lines l ON l.id = h.id LEFT JOIN bad b ON b.id = l.id AND b.line_no = l.line_no GROUP BY h.id""",
        "p3_statistics": """WITH t AS (SELECT DISTINCT id, coalesce(content, '') AS text FROM document_responses),
u AS (SELECT id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '[\\s\\x{a0}\\x0b]', '', 'g') <> '') AS lines,
 length(regexp_replace(text, '[\\s\\x{a0}\\x0b]', '', 'g')) AS solid, length(regexp_replace(text, '[\\s\\x{a0}\\x0b\\p{L}\\p{N}]', '', 'g')) AS symbols FROM t), c AS (SELECT list(DISTINCT lower(word)) AS common FROM common_words WHERE word IS NOT NULL)
SELECT id, len(ws) AS words, round(list_sum(list_transform(ws, lambda x: length(x))) / nullif(len(ws), 0), 6) AS mean_word_length, round(symbols / nullif(solid, 0), 6) AS symbol_share,
 round(len(list_filter(lines, lambda x: regexp_matches(x, '[.!?…][\\s\\x{a0}\\x0b]*$'))) / nullif(len(lines), 0), 6) AS punctuated_lines, round(len(list_filter(ws, lambda x: list_contains(common, x))) / nullif(len(ws), 0), 6) AS common_share FROM u, c""",
        "p6_texts": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    }
