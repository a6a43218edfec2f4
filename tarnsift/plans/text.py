"""Tokens, keyword scores, containment, sentences, citations, clips and HTML fields."""

from tarnsift.plans.sql import pairs

#: Words that keyword search leaves out.
STOP_WORDS = (
    "the", "and", "for", "with", "how", "does", "can", "that", "this", "from", "are", "was", "were", "has", "have", "not", "but", "you",
    "your", "when", "what", "who", "why", "his", "her", "its", "they", "them", "their", "any", "all", "did", "yes", "get", "one",
)
_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_SCORE = """
    SELECT doc_id, score FROM (SELECT doc_id, CAST({total} AS BIGINT) AS score FROM ({rows}) w) s WHERE score > 0
    ORDER BY score DESC, doc_id LIMIT 50"""

QUERIES, ORACLE_SQL = pairs({
    "R14_tokens": (
        rf"SELECT doc_id, size(filter(regexp_extract_all(lower(text), '[a-z0-9\']+', 0), x -> length(x) >= 3 AND NOT array_contains(array({_STOP}), x))) AS n FROM documents",
        rf"SELECT doc_id, len(list_filter(regexp_extract_all(lower(text), '[a-z0-9'']+'), lambda x: length(x) >= 3 AND NOT list_contains([{_STOP}], x))) AS n FROM documents"),
    "R12_keyword_score": (
        _SCORE.format(total="aggregate(array('heat', 'ouan', 'heat'), 0, (s, q) -> s + CASE WHEN exists(title, t -> startswith(t, q)) THEN 3 ELSE 0 END + CASE WHEN exists(body, t -> startswith(t, q)) THEN 1 ELSE 0 END)",
                      rows=r"SELECT doc_id, regexp_extract_all(lower(split(text, '\n')[0]), '[a-z0-9\']+', 0) AS title, regexp_extract_all(lower(text), '[a-z0-9\']+', 0) AS body FROM documents"),
        _SCORE.format(total="list_sum(list_transform(['heat', 'ouan', 'heat'], lambda q: CASE WHEN len(list_filter(title, lambda t: starts_with(t, q))) > 0 THEN 3 ELSE 0 END + CASE WHEN len(list_filter(body, lambda t: starts_with(t, q))) > 0 THEN 1 ELSE 0 END))",
                      rows="SELECT doc_id, regexp_extract_all(lower(string_split(text, chr(10))[1]), '[a-z0-9'']+') AS title, regexp_extract_all(lower(text), '[a-z0-9'']+') AS body FROM documents")),
    "R15_word_start_search": (
        r"SELECT conv_id, turn FROM conversations WHERE lower(text) RLIKE '(?U)(?<!\\w)heat'",
        r"SELECT conv_id, turn FROM conversations WHERE regexp_matches(lower(text), '(^|[^\p{L}\p{N}_])heat')"),
    "F16_grep": (
        r"SELECT doc_id, pos + 1 AS line_no, substr(line, 1, 200) AS line FROM documents LATERAL VIEW posexplode(split(text, '\n')) p AS pos, line WHERE line RLIKE 'License'",
        "SELECT doc_id, pos AS line_no, substr(line, 1, 200) AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents) x WHERE contains(line, 'License')"),
    "F6_cell_contains": "SELECT page_id, url FROM pages WHERE contains(lower(url), '/en/') AND contains(lower(html), '<table')",
    "G27_token_estimate": (
        r"SELECT doc_id, CAST(bround(length(regexp_replace(text, '[^A-Za-z]', '')) / 4.0D + length(regexp_replace(text, '[A-Za-z\\s]', '')) / 2.0D) AS BIGINT) AS tokens FROM documents",
        r"SELECT doc_id, CAST(round_even(length(regexp_replace(text, '[^A-Za-z]', '', 'g')) / 4.0 + length(regexp_replace(text, '[A-Za-z\s]', '', 'g')) / 2.0, 0) AS BIGINT) AS tokens FROM documents"),
    "T25_words": (
        r"SELECT doc_id, size(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+|#', 0)) AS n FROM documents",
        r"SELECT doc_id, len(regexp_extract_all(lower(text), '[\p{L}\p{N}]+|#')) AS n FROM documents"),
    "T11_sentences": (
        r"SELECT doc_id, size(regexp_extract_all(text, '[.!?…]+[\\x22)]*\\s', 0)) AS ends FROM documents",
        r"SELECT doc_id, len(regexp_extract_all(text, '[.!?…]+[\x22)]*\s')) AS ends FROM documents"),
    "T28_refs": (
        r"SELECT conv_id, turn, size(regexp_extract_all(text, '\\[\\d+(, *\\d+)*\\]', 0)) AS refs FROM conversations",
        r"SELECT conv_id, turn, len(regexp_extract_all(text, '\[\d+(, *\d+)*\]')) AS refs FROM conversations"),
    "T33_cited_numbers": (
        r"""SELECT id, array_sort(array_distinct(flatten(transform(regexp_extract_all(t, '\\d+(?:–\\d+)?', 0),
            x -> sequence(CAST(split(x, '–')[0] AS INT), CAST(element_at(split(x, '–'), -1) AS INT)))))) AS cited
            FROM VALUES (1, '[1, 3] and [2–4]'), (2, '[7]'), (3, 'none') AS v(id, t)""",
        r"""SELECT id, list_sort(list_distinct(flatten(list_transform(regexp_extract_all(t, '\d+(?:–\d+)?'),
            lambda x: generate_series(CAST(string_split(x, '–')[1] AS INT), CAST(string_split(x, '–')[-1] AS INT)))))) AS cited
            FROM (VALUES (1, '[1, 3] and [2–4]'), (2, '[7]'), (3, 'none')) AS v(id, t)"""),
    "T39_slug": (
        r"SELECT p_partkey, substr(trim(BOTH '-' FROM regexp_replace(lower(p_name), '[^a-z0-9]+', '-')), 1, 40) AS slug FROM part",
        r"SELECT p_partkey, substr(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-'), 1, 40) AS slug FROM part"),
    "T17_links": (
        r"SELECT page_id, size(regexp_extract_all(html, '<a href=\"([^\"]+)\"', 1)) AS links, regexp_extract(url, '/([0-9]+)', 1) AS link_id FROM pages",
        r"""SELECT page_id, len(regexp_extract_all(html, '<a href="([^"]+)"', 1)) AS links, regexp_extract(url, '/([0-9]+)', 1) AS link_id FROM pages"""),
    "S9_page_scan": (
        r"SELECT page_id, parse_url(url, 'HOST') AS host, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages",
        r"SELECT page_id, regexp_extract(url, '://([^/]+)', 1) AS host, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages"),
    "T34_kv_lines": (
        r"SELECT id, trim(split(line, ':', 2)[0]) AS k, trim(split(line, ':', 2)[1]) AS v FROM (SELECT id, explode(split(t, ';')) AS line FROM VALUES (1, 'goal: ship; owner: me'), (2, 'a:b:c') AS x(id, t)) y WHERE contains(line, ':')",
        "SELECT id, trim(substr(line, 1, strpos(line, ':') - 1)) AS k, trim(substr(line, strpos(line, ':') + 1)) AS v FROM (SELECT id, unnest(string_split(t, ';')) AS line FROM (VALUES (1, 'goal: ship; owner: me'), (2, 'a:b:c')) AS x(id, t)) y WHERE contains(line, ':')"),
    "F4_drop_rules": (
        r"SELECT rule, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS chars FROM (SELECT line, CASE WHEN line RLIKE '^[0-9]+$' THEN 'digits' WHEN line RLIKE '^[-•*]$' THEN 'bullet' WHEN line RLIKE '[\\x00-\\x08]' THEN 'control' ELSE 'kept' END AS rule FROM documents LATERAL VIEW explode(split(text, '\n')) p AS line WHERE line <> '') x GROUP BY rule",
        r"SELECT rule, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS chars FROM (SELECT line, CASE WHEN regexp_matches(line, '^[0-9]+$') THEN 'digits' WHEN regexp_matches(line, '^[-•*]$') THEN 'bullet' WHEN regexp_matches(line, '[\x00-\x08]') THEN 'control' ELSE 'kept' END AS rule FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) d WHERE line <> '') x GROUP BY rule"),
    "V7_markup_detector": (
        "SELECT page_id, html RLIKE '<script' AS has_script FROM pages",
        "SELECT page_id, regexp_matches(html, '<script') AS has_script FROM pages"),
})
