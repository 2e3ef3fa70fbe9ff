"""DuckDB SQL of what SQL can express of the training-data operators: parts of their results, registered as queries of their own.

The operators as a whole cannot be expressed: they learn models, or use hashes and tokenizers that SQL does not have.
"""

from __future__ import annotations

_AFTER = "CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = "list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
_LINES = "list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]'))"


def _fits(host: str, path: str) -> str:
    return f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}'))"


ORACLES: dict[str, str] = {
    "url_rules": f"""
WITH a AS (SELECT page_id, {_AFTER} AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
r AS (SELECT *, CASE WHEN {_fits('example.net', '/en/')} THEN 'example.net/en/' WHEN {_fits('example.com', '/de/')} THEN 'example.com/de/'
  WHEN {_fits('org', '/fr/')} THEN 'org/fr/' WHEN {_fits('net', '/')} THEN 'net/' END AS rule FROM p)
SELECT page_id, host, path, coalesce(rule, '') AS rule, CASE rule WHEN 'example.net/en/' THEN 'allow' WHEN 'org/fr/' THEN 'allow' WHEN 'example.com/de/' THEN 'block' WHEN 'net/' THEN 'block' ELSE '' END AS verdict FROM r""",
    "edited_texts": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id), first_value(coalesce(text, '')) OVER (ORDER BY doc_id)) AS u FROM documents)
SELECT doc_id, length(t)::BIGINT AS n_chars, sha256(substr(t, 1, length(t) - length(t) // 2) || substr(u, 1, length(t) // 2)) AS edited_sha256 FROM d""",
    "secret_counts": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, len(list_filter(regexp_extract_all(t, '(?i)(password|passwd|secret|token|api_?key)["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda v: length(v) >= 12)) AS n_assign,
  len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda v: length(v) >= 18)) AS n_access, len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda v: length(v) >= 16)) AS n_hex FROM d""",
    "rule_counts": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, {_WORDS} AS ws, {_LINES} AS ls FROM d),
g AS (SELECT doc_id, i, array_to_string(ws[i + 1:i + 8], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(0, len(ws) - 7)) AS i FROM w)),
s AS (SELECT DISTINCT doc_id, i + unnest(range(0, 8)) AS place FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(*) AS n_repeat_words FROM s GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
  len(ws) < 20 OR 100 * coalesce(n_repeat_words, 0) > 30 * len(ws) AS base_failed FROM w LEFT JOIN c USING (doc_id)""",
    "license_words": f"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS ws FROM documents),
p AS (SELECT r, ws, unnest(range(0, len(ws))) AS i FROM w),
f AS (SELECT r, i, CASE WHEN ws[i + 1:i + 4] = ['gnu', 'general', 'public', 'license'] THEN 'gpl' WHEN ws[i + 1:i + 2] = ['apache', 'license'] THEN 'apache' WHEN ws[i + 1:i + 2] = ['cc', 'by'] THEN 'cc-by'
  WHEN ws[i + 1:i + 2] = ['mit', 'license'] THEN 'mit' END AS label FROM p),
g AS (SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM f WHERE label IS NOT NULL GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, coalesce(first_word, -1)::BIGINT AS first_word, coalesce(last_word, -1)::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels FROM w LEFT JOIN g USING (r)""",
}
