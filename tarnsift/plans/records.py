"""Scans with their guards, request and record validation, ordering and limits, evaluation roll-ups, report frames.

Conversations stand for sessions and answers, events for turns (event_type the mode, the day the repeat, value the
elapsed seconds, under 5 a failed turn), orders and lineitem for change sets, documents for files and articles.
"""

from tarnsift.plans.sql import pairs

#: Statuses of a tool call, severities in their order, categories of findings.
SEVERITIES = ("high", "medium", "low")
CATEGORIES = ("bug", "risk", "style", "recommendation")

_LINES = ("SELECT doc_id, pos + 1 AS line_no, line FROM documents LATERAL VIEW posexplode(split(text, '\\n')) p AS pos, line",
          "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents")


def _both(text: str, **parts: tuple[str, str]) -> tuple[str, str]:
    """Spark and DuckDB text of one query, with the parts that differ."""
    return tuple(text.format(**{k: v[side] for k, v in parts.items()}) for side in (0, 1))


def _over_lines(text: str, **parts: tuple[str, str]) -> tuple[str, str]:
    return _both(text, lines=_LINES, **parts)


_JSON = ("CAST(get_json_object(props, '$.k') AS INT)", "CAST(json_extract_string(props, '$.k') AS INT)")
_MATCH = lambda column, pattern: (f"{column} RLIKE '{pattern}'", f"regexp_matches({column}, '{pattern}')")

QUERIES, ORACLE_SQL = pairs({
    # scans
    "S3_corpus_globs": _both(
        """SELECT DISTINCT path FROM (SELECT {path} AS path FROM pages) x
        WHERE {wanted} AND NOT {excluded} AND NOT contains(path, '..') AND NOT path LIKE '%/AGENTS.md' ORDER BY path""",
        path=(r"regexp_extract(url, '://[^/]+(/[^?#]*)', 1)", r"regexp_extract(url, '://[^/]+(/[^?#]*)', 1)"),
        wanted=_MATCH("path", "^/(en|de|fr)/[0-9]+$"), excluded=_MATCH("path", "/[0-9]*7$")),
    "S7_snapshot_as_of": """
        WITH log AS (SELECT o_custkey, o_orderkey, o_orderstatus, year(o_orderdate) AS run_id, row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY o_orderkey) AS row_no FROM orders)
        SELECT run_id, row_no, o_orderkey, o_orderstatus FROM log WHERE run_id = (SELECT max(run_id) FROM log WHERE run_id <= 1996) ORDER BY row_no""",
    "S8_run_log": """
        SELECT event_id, ts AS started_at, value >= 5 AS ok, CASE WHEN value < 5 THEN event_type END AS error, round(value, 2) AS elapsed_s FROM events""",
    "S12_document_checks": _both(
        """SELECT event_id, CASE WHEN {k} IS NULL THEN 'k missing' WHEN {k} NOT BETWEEN 0 AND 94 THEN 'k out of range'
               WHEN event_type NOT IN ('view', 'click', 'purchase', 'signup') THEN 'unknown type' WHEN value < 0 THEN 'negative value' ELSE 'ok' END AS verdict FROM events""", k=_JSON),
    "S13_session_catalogue": """
        SELECT concat('s', conv_id) AS session_id, count(*) AS messages, count_if(role = 'user') AS asked, max(turn) AS last_turn FROM conversations
        GROUP BY conv_id HAVING count_if(role NOT IN ('system', 'user', 'assistant')) = 0""",
    "S14_session_history": """
        SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS seq, role, text FROM conversations
        WHERE role IN ('user', 'assistant') AND text IS NOT NULL AND trim(text) <> ''""",
    "S15_reference_checks": """
        SELECT 'label without document' AS problem, count(*) AS n FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id)
        UNION ALL SELECT 'document without label', count(*) FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
        UNION ALL SELECT 'quality out of range', count(*) FROM labels WHERE quality NOT IN (0, 1)
        UNION ALL SELECT 'key repeated', count(*) FROM (SELECT doc_id FROM labels GROUP BY doc_id HAVING count(*) > 1) r""",
    "S16_change_scan": """
        WITH status AS (SELECT l_orderkey, l_linenumber, CASE l_linestatus WHEN 'O' THEN 'modified' ELSE 'renamed' END AS change FROM lineitem WHERE l_returnflag <> 'R'),
             stats AS (SELECT l_orderkey, l_linenumber, l_quantity AS added, l_suppkey AS removed FROM lineitem WHERE l_quantity > 5)
        SELECT s.l_orderkey, s.l_linenumber, s.change, t.added, t.removed, t.added IS NULL AS is_binary
        FROM status s LEFT JOIN stats t ON t.l_orderkey = s.l_orderkey AND t.l_linenumber = s.l_linenumber""",
    "S18_line_range": _over_lines(
        """SELECT doc_id, line_no, line FROM (
            SELECT doc_id, line_no, line, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used
            FROM ({lines}) l WHERE line_no BETWEEN 2 AND 40) x WHERE used <= 2000"""),
    # predicates and validators
    "F2_kind_and_exclusions": "SELECT doc_id, source FROM documents WHERE lang IN ('en', 'de') AND source NOT IN ('src0', 'src3')",
    "F7_section_filter": "SELECT DISTINCT source AS section FROM documents WHERE contains(lower(source), 'src1')",
    "F8_slug_or_label": "SELECT n_nationkey, n_name FROM nation WHERE contains(lower(n_name), '1') OR contains(replace(lower(n_name), ' ', '-'), 'n-2')",
    "F11_day_period": _both(
        """WITH dated AS (SELECT event_id, CASE WHEN value < 3 THEN 'yesterday' ELSE {day} END AS said FROM events),
               parsed AS (SELECT event_id, {parse} AS day FROM dated)
        SELECT count_if(day IS NULL) AS unparsed, count_if(day >= last - INTERVAL 3 DAY) AS recent, count_if(day < last - INTERVAL 3 DAY) AS older
        FROM parsed, (SELECT max(day) AS last FROM parsed) m""",
        day=("date_format(ts, 'yyyy-MM-dd')", "strftime(ts, '%Y-%m-%d')"), parse=("try_to_date(said)", "TRY_CAST(said AS DATE)")),
    "F14_ceiling_hit": """
        SELECT user_id, date_trunc('day', ts) AS turn, max(CASE WHEN value > 40 THEN 1 ELSE 0 END) = 1 AS hit_ceiling FROM events GROUP BY user_id, date_trunc('day', ts)""",
    "F17_safe_paths": _both(
        """SELECT page_id, path, NOT {absolute} AND NOT {upward} AND {plain} AS is_safe
        FROM (SELECT page_id, concat(CASE WHEN page_id % 5 = 0 THEN '/' WHEN page_id % 5 = 1 THEN 'a/../' ELSE '' END, 'docs/', page_id, CASE WHEN page_id % 3 = 0 THEN '.md' ELSE '.exe' END) AS path FROM pages) x""",
        absolute=_MATCH("path", "^[/~]"), upward=_MATCH("path", "(^|/)[.][.](/|$)"), plain=_MATCH("path", "[.](md|txt|py)$")),
    "F21_request_validation": """
        SELECT conv_id, CASE WHEN count(*) = 0 THEN 'messages is empty' WHEN count_if(role IS NULL OR role NOT IN ('system', 'user', 'assistant')) > 0 THEN 'unknown role'
               WHEN count_if(text IS NULL OR trim(text) = '') > 0 THEN 'empty content' WHEN max_by(role, turn) <> 'user' THEN 'last message is not the user''s' ELSE 'ok' END AS verdict
        FROM conversations GROUP BY conv_id""",
    "F22_tool_call_status": _both(
        """SELECT event_id, CASE WHEN event_type = 'signup' THEN 'unknown tool' WHEN {k} IS NULL OR {k} > 90 THEN 'bad arguments' WHEN event_type = 'error' THEN 'tool error'
               WHEN value > 60 THEN 'unavailable' ELSE 'ok' END AS status FROM events""", k=_JSON),
    "F23_transfer_check": _both(
        """SELECT f.conv_id, f.turn, CASE WHEN {a} = {b} THEN 'equal' WHEN contains({b}, {a}) OR contains({a}, {b}) THEN 'contained' ELSE 'different' END AS transfer
        FROM conversations f JOIN conversations g ON g.conv_id = f.conv_id AND g.turn = f.turn + 1""",
        a=(r"trim(regexp_replace(f.text, '[ ]*\\n[ ]*', '\n'))", r"trim(regexp_replace(f.text, '[ ]*\n[ ]*', chr(10), 'g'))"),
        b=(r"trim(regexp_replace(g.text, '[ ]*\\n[ ]*', '\n'))", r"trim(regexp_replace(g.text, '[ ]*\n[ ]*', chr(10), 'g'))")),
    "V1_profile_parse": """
        SELECT p_partkey, CASE WHEN trim(p_name) = '' THEN 'no name' WHEN length(p_name) > 60 THEN 'name too long' WHEN p_size NOT BETWEEN 1 AND 50 THEN 'size out of range'
               WHEN count(*) OVER (PARTITION BY lower(p_name), p_brand) > 1 THEN 'repeated' END AS note FROM part""",
    "V2_rule_checks": """
        SELECT user_id, event_type, rules, CASE WHEN event_type NOT IN ('click', 'view', 'purchase') THEN 'unknown event' WHEN rules > 12 THEN 'too many' WHEN longest > 9 THEN 'too long' ELSE 'ok' END AS verdict
        FROM (SELECT user_id, event_type, count(*) AS rules, max(length(props)) AS longest FROM events GROUP BY user_id, event_type) x""",
    "V4_client_keys": """
        SELECT c_custkey, CASE WHEN length(c_name) < 8 THEN 'key too short' WHEN count(*) OVER (PARTITION BY c_name) > 1 THEN 'name repeated'
               WHEN floor(c_acctbal / 1000) < 1 THEN 'rate under 1' ELSE 'ok' END AS verdict FROM customer""",
    "V5_chat_body": """
        SELECT conv_id, turn, text IS NOT NULL AND length(text) BETWEEN 1 AND 4000 AND role = 'user' AS is_body FROM conversations""",
    "V6_finding_warnings": """
        WITH findings AS (SELECT l_orderkey AS file, l_linenumber AS line, l_quantity AS source_no, CASE WHEN l_tax > 0.07 THEN 'taste' ELSE 'bug' END AS category FROM lineitem WHERE l_discount > 0.08),
             ranges AS (SELECT l_orderkey AS file, min(l_linenumber) AS low, max(l_linenumber) - 1 AS high FROM lineitem WHERE l_returnflag <> 'R' GROUP BY l_orderkey)
        SELECT f.file, f.line, f.category NOT IN ('bug', 'risk', 'style', 'recommendation') AS unknown_category, r.file IS NULL AS unknown_file,
               r.file IS NOT NULL AND f.line NOT BETWEEN r.low AND r.high AS outside, f.source_no > 40 AS bad_source
        FROM findings f LEFT JOIN ranges r ON r.file = f.file""",
    "V3_layers": """
        SELECT event_type AS layer, count(*) AS entries, count(DISTINCT props) AS keys, count_if(props IS NULL OR trim(props) = '') AS blank FROM events GROUP BY event_type""",
    # ordering and limits
    "L3_newest_with_rest": """
        SELECT user_id, event_id, CAST(greatest(total - 20, 0) AS BIGINT) AS more FROM (
            SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n, count(*) OVER (PARTITION BY user_id) AS total FROM events) x WHERE n <= 20""",
    "L4_budget_with_degrade": """
        SELECT conv_id, turn, CASE WHEN whole <= 2000 THEN text ELSE concat(substr(text, 1, 80), '…') END AS shown FROM (
            SELECT conv_id, turn, text, sum(length(text)) OVER w AS whole, sum(least(length(text), 81)) OVER w AS small FROM conversations
            WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) x WHERE whole <= 2000 OR small <= 2000""",
    "L5_line_truncation": _both(
        """SELECT doc_id, CASE WHEN length(text) <= 500 THEN text ELSE concat({cut}, {nl}, '[truncated]') END AS shown FROM documents""",
        cut=(r"CASE WHEN contains(substr(text, 1, 500), '\n') THEN regexp_replace(substr(text, 1, 500), '\\n[^\\n]*\\z', '') ELSE substr(text, 1, 500) END",
             r"CASE WHEN contains(substr(text, 1, 500), chr(10)) THEN regexp_replace(substr(text, 1, 500), '\n[^\n]*\z', '') ELSE substr(text, 1, 500) END"),
        nl=(r"'\n'", "chr(10)")),
    "L6_severity_order": """
        SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 0 WHEN '2' THEN 1 WHEN '3' THEN 2 ELSE 3 END, o_orderkey) AS place FROM orders""",
    "W3_fold_trigger": """
        SELECT conv_id, turn, CAST(CASE WHEN seen <= 6 THEN 0 ELSE floor((seen - 6) / 6) * 6 END AS BIGINT) AS covered FROM (
            SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS seen FROM conversations) x""",
    "W6_last_known_changes": _both(
        """SELECT event_id, user_id, goal FROM (SELECT event_id, user_id, goal, {known} OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was
        FROM (SELECT *, CASE WHEN value >= 20 THEN event_type END AS goal FROM events) y) x WHERE goal IS NOT NULL AND was IS DISTINCT FROM goal""",
        known=("last_value(goal, true)", "last_value(goal IGNORE NULLS)")),
    "W7_failed_after_success": """
        WITH good AS (SELECT user_id, max(event_id) AS last_ok FROM events WHERE value >= 5 GROUP BY user_id)
        SELECT g.user_id, g.last_ok, min(e.event_id) AS failed_after FROM good g LEFT JOIN events e ON e.user_id = g.user_id AND e.event_id > g.last_ok AND e.value < 5 GROUP BY g.user_id, g.last_ok""",
    "W9_first_and_last_repeat": """
        SELECT user_id, event_type, min_by(props, event_id) AS first_text, max_by(props, event_id) AS last_text, min_by(props, event_id) = max_by(props, event_id) AS same FROM events GROUP BY user_id, event_type""",
    # set operations and maintenance
    "U2_merge_runs": """
        WITH a AS (SELECT r_regionkey AS col, r_name AS name FROM region), b AS (SELECT n_nationkey AS col, n_name AS name FROM nation)
        SELECT col, name FROM a UNION ALL SELECT b.col + m.shift, b.name FROM b, (SELECT max(col) + 1 AS shift FROM a) m""",
    "U5_rebuild_reason": """
        SELECT doc_id, CASE WHEN lang = 'fr' THEN 'model' WHEN n_chars > 5000 THEN 'size' WHEN source = 'src2' THEN 'overlap' END AS reason FROM documents""",
    "U7_merge_changes": """
        SELECT user_id, k, event_id, CASE WHEN v IS NULL AND was IS NOT NULL THEN 'deleted' WHEN was IS NULL AND v IS NOT NULL THEN 'added' WHEN was <> v THEN 'replaced' END AS change FROM (
            SELECT user_id, event_type AS k, event_id, v, lag(v) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS was
            FROM (SELECT *, CASE WHEN value >= 5 THEN props END AS v FROM events) y) x WHERE v IS DISTINCT FROM was""",
    "Z2_complete_ingestion": """
        SELECT source, declared, done, CASE WHEN done < declared THEN 'failed attempt' ELSE 'snapshot' END AS outcome FROM (
            SELECT source, count(*) AS declared, count(l.doc_id) AS done FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY source) x""",
    "Z7_once_per_position": """
        SELECT user_id, position, min(event_id) AS event_id, count(*) - 1 AS ignored FROM (
            SELECT user_id, event_id, count_if(event_type = 'click') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS position FROM events) x
        GROUP BY user_id, position""",
    "Z9_coverage_counters": """
        SELECT conv_id, messages, CAST(covered AS BIGINT) AS covered, CAST(messages - covered AS BIGINT) AS tail FROM (
            SELECT conv_id, count(*) AS messages, CASE WHEN count(*) <= 6 THEN 0 ELSE floor((count(*) - 6) / 6) * 6 END AS covered FROM conversations GROUP BY conv_id) x""",
    # roll-ups
    "G3_dropped_by_rule": _over_lines(
        """SELECT d.doc_id, r.rule, CAST(coalesce(sum(x.chars), 0) AS BIGINT) AS chars FROM documents d CROSS JOIN (VALUES ('digits'), ('marker'), ('control')) r(rule)
        LEFT JOIN (SELECT doc_id, length(line) AS chars, CASE WHEN {digits} THEN 'digits' WHEN {marker} THEN 'marker' WHEN {control} THEN 'control' END AS rule FROM ({lines}) l) x
        ON x.doc_id = d.doc_id AND x.rule = r.rule GROUP BY d.doc_id, r.rule""",
        digits=_MATCH("line", "^[ ]*[0-9]+[ ]*$"), marker=_MATCH("line", "^[ ]*[-•*][ ]*$"), control=(r"line RLIKE '[\\x00-\\x08]'", r"regexp_matches(line, '[\x00-\x08]')")),
    "G4_count_by_strategy": "SELECT lang AS strategy, count(*) AS chunks FROM documents GROUP BY lang",
    "G5_build_statistics": """
        SELECT lang, count(DISTINCT source) AS files, count(*) AS chunks, round(avg(n_chars), 4) AS mean_chars, max(n_chars) AS longest, count_if(n_chars > 2048) AS over_limit FROM documents GROUP BY lang""",
    "G10_overlapping_sets": """
        SELECT s.name, count(*) AS answers, count_if(length(text) < 200) AS short, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations
        JOIN (VALUES ('all'), ('controls')) s(name) ON s.name = 'all' OR conv_id % 3 = 0 WHERE role = 'assistant' GROUP BY s.name""",
    "G13_dialog_statistics": """
        SELECT conv_id % 2 AS scenario, role AS mode, count(*) AS turns, count(DISTINCT conv_id) AS dialogs, count_if(length(text) = 0) AS empty, count_if(contains(text, '?')) AS asking,
               count_if(length(text) >= 1000) AS long, count_if(length(text) < 1000 AND length(text) >= 200) AS usual, count_if(length(text) < 200) AS brief,
               max(turn) AS last_turn, round(avg(length(text)), 4) AS mean_chars, max(length(text)) AS longest, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY 1, 2""",
    "G14_expected_keys": _both(
        """SELECT conv_id, turn, CAST({n} AS BIGINT) AS found, 3 AS expected FROM conversations""",
        n=("size(filter(array('la', 'the', 'en'), k -> contains(concat(' ', lower(text), ' '), concat(' ', k, ' '))))",
           "len(list_filter(['la', 'the', 'en'], lambda k: contains(concat(' ', lower(text), ' '), concat(' ', k, ' '))))")),
    "G17_tokens_per_second": "SELECT event_id, CASE WHEN value > 0 THEN round(length(props) / value, 6) END AS per_second FROM events",
    "G18_stability_measures": """
        SELECT user_id, event_type, count(*) AS repeats, count(DISTINCT v) AS texts, count(DISTINCT v) = 1 AS all_same, count_if(n > 1 AND v <> first_v) = count(*) - 1 AS first_differs,
               count(DISTINCT CASE WHEN n > 1 THEN v END) <= 1 AS rest_same, round(max(value) - min(value), 4) AS spread FROM (
            SELECT user_id, event_type, value, lower(trim(props)) AS v, row_number() OVER w AS n, first_value(lower(trim(props))) OVER w AS first_v FROM events WHERE value >= 5
            WINDOW w AS (PARTITION BY user_id, event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) x
        GROUP BY user_id, event_type HAVING count(*) >= 2""",
    "G21_resource_peaks": """
        SELECT user_id, min_by(value, event_id) AS idle, max(value) AS peak, count(*) AS samples, round(max(value) - min_by(value, event_id), 4) AS grown FROM events GROUP BY user_id""",
    "G22_models_in_order": _both(
        "SELECT user_id, {names} AS models FROM (SELECT user_id, event_type, min(event_id) AS first_seen FROM events GROUP BY user_id, event_type) x GROUP BY user_id",
        names=("array_join(transform(array_sort(collect_list(struct(first_seen, event_type))), x -> x.event_type), ', ')", "string_agg(event_type, ', ' ORDER BY first_seen)")),
    "G23_load_by_scenario": """
        SELECT user_id % 4 AS scenario, count(*) AS requests, count_if(value < 5) AS unexpected, max(CASE WHEN value > 30 THEN value - 30 END) AS longest_wait,
               min(CASE WHEN value >= 5 THEN value END) AS fastest, max(CASE WHEN value >= 5 THEN value END) AS slowest FROM events GROUP BY user_id % 4""",
    "G30_findings_by_category": """
        SELECT category, o_orderkey, place, CAST(total - 15 AS BIGINT) AS beyond FROM (
            SELECT category, o_orderkey, row_number() OVER (PARTITION BY category ORDER BY severity, o_orderkey) AS place, count(*) OVER (PARTITION BY category) AS total FROM (
                SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'bug' WHEN 'F' THEN 'risk' ELSE 'recommendation' END AS category, substr(o_orderpriority, 1, 1) AS severity FROM orders) y) x WHERE place <= 15""",
    "G34_context_saving": """
        SELECT conv_id, CAST(sum(length(text)) AS BIGINT) AS full_chars, CAST(sum(CASE WHEN n <= 6 THEN length(text) ELSE 0 END) AS BIGINT) AS sent_chars,
               CAST(sum(CASE WHEN n > 6 THEN length(text) ELSE 0 END) AS BIGINT) AS saved FROM (
            SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) x GROUP BY conv_id""",
    "G11_mode_costs": """
        SELECT event_type, count(*) AS turns, count_if(value < 5) AS failed, count(CASE WHEN value >= 5 THEN 1 END) AS counted, CAST(sum(CASE WHEN value >= 5 THEN length(props) END) AS BIGINT) AS tokens,
               round(sum(CASE WHEN value >= 5 THEN value END), 4) AS seconds, round(sum(value) * 0.001, 6) AS cost, count_if(value >= 5 AND length(props) < 8) AS empties FROM events GROUP BY event_type""",
    # report frames
    "P2_question_mode_grid": """
        SELECT user_id, max(CASE WHEN event_type = 'click' THEN value END) AS click_best, max(CASE WHEN event_type = 'view' THEN value END) AS view_best, max(CASE WHEN event_type = 'purchase' THEN value END) AS purchase_best,
               count(DISTINCT event_type) AS modes FROM events GROUP BY user_id""",
    "P4_dialog_steps": """
        SELECT conv_id, turn, max(CASE WHEN role = 'user' THEN length(text) END) AS asked, max(CASE WHEN role = 'assistant' THEN length(text) END) AS answered FROM conversations GROUP BY conv_id, turn""",
    "P5_per_question_grid": _both(
        """SELECT user_id, event_type, count(*) AS answers, count(DISTINCT props) AS kinds, {mid} AS median_value, CASE WHEN count(*) < 2 THEN 'one' WHEN count(DISTINCT props) = 1 THEN 'same' ELSE 'different' END AS stability
        FROM events GROUP BY user_id, event_type""", mid=("round(median(value), 6)", "round(median(value), 6)")),
    "P6_local_run": "SELECT event_type, event_id, round(value, 1) AS seconds, value >= 5 AS ok FROM events",
    "P7_strategies_as_columns": """
        SELECT source, count_if(lang = 'en') AS en, count_if(lang = 'de') AS de, count_if(lang = 'fr') AS fr, count_if(lang = 'es') AS es, max(CASE WHEN lang = 'en' THEN n_chars END) AS en_longest FROM documents GROUP BY source""",
})
