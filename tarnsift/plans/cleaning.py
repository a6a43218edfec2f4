"""Lines into text: reading order, headings, paragraphs, hyphens; recovered records, saved names, guarded scans.

Lineitem stands for placed lines (order the page, supplier the column, part the block), documents for extracted text.
"""

from tarnsift.plans.sql import pairs


def _both(text: str, **parts: tuple[str, str]) -> tuple[str, str]:
    return tuple(text.format(**{k: v[side] for k, v in parts.items()}) for side in (0, 1))


_NL = (r"'\n'", "chr(10)")
_LINES = ("SELECT doc_id, pos + 1 AS line_no, line FROM documents LATERAL VIEW posexplode(split(text, '\\n')) p AS pos, line",
          "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents")
_LOWER = (r"line RLIKE '^\\p{Ll}'", r"regexp_matches(line, '^\p{Ll}')")
_LETTER = (r"line RLIKE '^[\\p{L}•*-]'", r"regexp_matches(line, '^[\p{L}•*-]')")
_ENDED = (r"was RLIKE '[.!?…:;,][\\x22»”)]*$'", r"regexp_matches(was, '[.!?…:;,][\x22»”)]*$')")

QUERIES, ORACLE_SQL = pairs({
    "T2_reading_order": """
        WITH blocks AS (SELECT l_orderkey AS page, l_partkey AS block, min(l_suppkey) AS x, min(l_extendedprice) AS y, count(*) AS lines FROM lineitem GROUP BY l_orderkey, l_partkey)
        SELECT page, block, lines, row_number() OVER (PARTITION BY page ORDER BY CASE WHEN page % 2 = 0 AND x >= 5 THEN 1 ELSE 0 END, CASE WHEN page % 2 = 0 THEN y END, CASE WHEN page % 2 = 0 THEN x END, block) AS place FROM blocks""",
    "T3_image_headings": _both(
        """WITH lines AS ({lines}), anchors AS (SELECT doc_id, min(line_no) AS at_line FROM lines WHERE contains(line, 'License') GROUP BY doc_id)
        SELECT doc_id, line_no * 2 AS place, line FROM lines WHERE doc_id IN (SELECT doc_id FROM anchors)
        UNION ALL SELECT doc_id, at_line * 2 - 1, 'Licence' FROM anchors""", lines=_LINES),
    "T4_renamed_headings": """
        SELECT p_partkey, coalesce(r.new_name, p_name) AS name, r.new_name IS NOT NULL AS renamed FROM part
        LEFT JOIN (VALUES ('small ring', 11, 'Ring, small'), ('red widget', 11, 'Widget')) r(old_name, page, new_name) ON r.old_name = p_name AND r.page = p_size""",
    "T5_paragraphs": _both(
        """SELECT doc_id, paragraph, min(line_no) AS first_line, count(*) AS lines, CAST(sum(length(line)) AS BIGINT) AS chars FROM (
            SELECT doc_id, line_no, line, sum(CASE WHEN was IS NULL OR NOT ({lower} OR (NOT {letter} AND NOT {ended})) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS paragraph FROM (
                SELECT doc_id, line_no, line, lag(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS was FROM ({lines}) l WHERE trim(line) <> '') y) x GROUP BY doc_id, paragraph""",
        lines=_LINES, lower=_LOWER, letter=_LETTER, ended=_ENDED),
    "T6_joined_hyphens": _both(
        """SELECT doc_id, CAST((length(broken) - length(joined)) / 2 AS BIGINT) AS hyphens, length(joined) AS chars, joined = text AS as_before FROM (
            SELECT doc_id, text, broken, {joined} AS joined FROM (SELECT doc_id, text, replace(text, 'tion ', concat('ti-', {nl}, 'on ')) AS broken FROM documents) y) x""",
        nl=_NL, joined=(r"regexp_replace(broken, '(\\p{L})-\\n(?=\\p{Ll})', '$1')", r"regexp_replace(broken, '(\p{L})-\n(\p{Ll})', '\1\2', 'g')")),
    "T20_clip": _both(
        """SELECT doc_id, CASE WHEN length(text) <= 300 THEN text ELSE {stripped} END AS clipped FROM (
            SELECT doc_id, text, substr(text, 1, CASE WHEN line_end >= 150 THEN line_end WHEN blank > 0 THEN blank ELSE 300 END) AS head FROM (
                SELECT doc_id, text, CASE WHEN {line_end} > 0 THEN 300 - {line_end} ELSE -1 END AS line_end, CASE WHEN {blank} > 0 THEN 300 - {blank} ELSE -1 END AS blank FROM documents) y) x""",
        stripped=(r"regexp_replace(head, '\\s+\\z', '')", r"regexp_replace(head, '\s+\z', '')"),
        line_end=(r"instr(reverse(substr(text, 1, 300)), '\n')", "strpos(reverse(substr(text, 1, 300)), chr(10))"), blank=("instr(reverse(substr(text, 1, 300)), ' ')", "strpos(reverse(substr(text, 1, 300)), ' ')")),
    "T35_recovered_json": _both(
        """SELECT event_id, {k} AS k, {k} IS NULL OR {k} > 90 AS rejected FROM (SELECT event_id, concat('Sure, here it is: ', CASE WHEN event_id % 9 = 0 THEN 'nothing' ELSE props END, ' Anything else?') AS said FROM events) x""",
        k=(r"CAST(get_json_object(regexp_extract(said, '(\\{[^}]*\\})', 1), '$.k') AS INT)", r"CAST(json_extract_string(nullif(regexp_extract(said, '(\{[^}]*\})', 1), ''), '$.k') AS INT)")),
    "S6_vector_checks": _both(
        """SELECT label, count(*) AS vectors, count(DISTINCT {size}) AS lengths, count_if({bad} > 0) AS not_finite, count_if(abs({norm} - 1) > 0.001) AS not_unit FROM embeddings GROUP BY label""",
        size=("size(embedding)", "len(embedding)"), bad=("size(filter(embedding, x -> isnan(x) OR x IS NULL))", "len(list_filter(embedding, lambda x: isnan(x) OR x IS NULL))"),
        norm=("aggregate(embedding, CAST(0 AS DOUBLE), (s, x) -> s + CAST(x AS DOUBLE) * x)", "list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])")),
    "S4_index_scan": "SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS ordinal FROM embeddings",
    "S5_changed_since": """
        SELECT o_custkey, count(*) AS files, count_if(o_orderdate > last) AS changed, count_if(o_orderdate > last) > 0 AS reload FROM orders, (SELECT max(o_orderdate) - INTERVAL 90 DAY AS last FROM orders) m GROUP BY o_custkey""",
    "S17_listing": _both(
        """SELECT path FROM (SELECT DISTINCT {path} AS path FROM pages) x WHERE {wanted} ORDER BY path LIMIT 300""",
        path=(r"regexp_extract(url, '://([^?#]*)', 1)", r"regexp_extract(url, '://([^?#]*)', 1)"), wanted=("path LIKE '%/en/%'", "path LIKE '%/en/%'")),
    "S21_cursor_paging": """
        SELECT server, CAST(floor((n - 1) / 5) AS INT) + 1 AS page, count(*) AS tools, min(cursor_id) AS first_tool FROM (
            SELECT p_brand AS server, p_partkey AS cursor_id, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part) t GROUP BY 1, 2""",
    "K6_search_log": """
        SELECT conv_id AS search_id, position, turn AS article_id FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS position FROM conversations WHERE role = 'assistant') x WHERE position <= 10""",
    "K9_saved_names": _both(
        """SELECT p_partkey, concat('2024-01-01-', slug, CASE WHEN n > 1 THEN concat('-', n) ELSE '' END, '.md') AS name FROM (
            SELECT p_partkey, slug, row_number() OVER (PARTITION BY slug ORDER BY p_partkey) AS n FROM (SELECT p_partkey, {slug} AS slug FROM part) y) x""",
        slug=("substr(trim(BOTH '-' FROM regexp_replace(lower(p_name), '[^a-z0-9]+', '-')), 1, 40)", "substr(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-'), 1, 40)")),
    "J16_best_of_queries": """
        SELECT l_partkey AS chunk, l_suppkey AS question, max(l_discount) AS best, count(DISTINCT l_returnflag) AS queries FROM lineitem GROUP BY l_partkey, l_suppkey""",
    "F5_heading_lines": _both(
        """SELECT doc_id, count_if({short}) AS headings, count(*) AS lines FROM ({lines}) l WHERE trim(line) <> '' GROUP BY doc_id""",
        lines=_LINES, short=(r"length(line) <= 60 AND NOT line RLIKE '[.,;:!?]'", r"length(line) <= 60 AND NOT regexp_matches(line, '[.,;:!?]')")),
    "F3_score_threshold": "SELECT l_orderkey, l_linenumber, l_discount AS score FROM lineitem WHERE l_discount >= 0.05",
    "P1_candidate_table": """
        SELECT l_orderkey, l_linenumber, place, second, CASE WHEN score < 0.02 THEN 'below threshold' WHEN second > 5 THEN 'beyond top' ELSE 'kept' END AS fate FROM (
            SELECT l_orderkey, l_linenumber, l_discount AS score, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey) AS place,
                   row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC, l_extendedprice DESC, l_linenumber, l_partkey) AS second FROM lineitem) x""",
})
