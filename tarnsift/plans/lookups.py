"""Lookups by stored lists, merges of results, query building, small text rules, patches and diffs."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnsift.plans.sql import pairs
from tarnsift.session import table

#: Lines of a diff that are shown, and characters of each.
MOST_LINES, MOST_CHARS = 12, 200


def text_diff(old: str, new: str) -> list[str]:
    """Lines removed and added, without context or blank lines; the first MOST_LINES, the rest as a count."""
    a, b = old.splitlines(), new.splitlines()
    found = []
    for tag, i, j, k, m in difflib.SequenceMatcher(None, a, b).get_opcodes():
        if tag != "equal":
            found += [f"- {x.strip()}" for x in a[i:j] if x.strip()] + [f"+ {x.strip()}" for x in b[k:m] if x.strip()]
    shown = [x if len(x) <= MOST_CHARS else x[:MOST_CHARS].rstrip() + " …" for x in found[:MOST_LINES]]
    return shown + [f"… and {len(found) - MOST_LINES} more"] * (len(found) > MOST_LINES)


def unified(old: str, new: str, name: str) -> tuple[str, int, int]:
    """A patch with file headers, and its numbers of added and removed lines."""
    lines = []
    for line in difflib.unified_diff(old.splitlines(True), new.splitlines(True), f"a/{name}", f"b/{name}"):
        lines += [line] if line.endswith("\n") else [line + "\n", "\\ No newline at end of file\n"]
    return "".join(lines), sum(x[0] == "+" for x in lines[2:]), sum(x[0] == "-" for x in lines[2:])


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in two versions: the later one has another second line, and a line more at the end."""
    lines = F.split("text", "\n")
    later = F.concat_ws("\n", F.get(lines, 0), F.concat(F.lit("edited "), F.coalesce(F.get(lines, 1), F.lit(""))), F.array_join(F.slice(lines, 3, 1 << 30), "\n"), F.lit("last line"))
    return table(spark, sf_dir, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(later).alias("later"))


def t21_text_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "lines": [text_diff(a or "", b or "") for a, b in zip(batch["text"], batch["later"])]})

    return _versions(spark, sf_dir).mapInPandas(run, "doc_id long, lines array<string>")


def t22_unified_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [unified(a or "", b or "", f"{d}.txt") for d, a, b in zip(batch["doc_id"], batch["text"], batch["later"])]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "patch": [x[0] for x in out], "added": [x[1] for x in out], "removed": [x[2] for x in out]})

    return _versions(spark, sf_dir).mapInPandas(run, "doc_id long, patch string, added long, removed long")


QUERIES = {"T21_text_diff": t21_text_diff, "T22_unified_diff": t22_unified_diff}
ORACLE_SQL: dict[str, str] = {}

_FIRST_LINE = ("split(text, '\\n')[0]", "string_split(text, chr(10))[1]")


def _both(text: str, **parts: tuple[str, str]) -> tuple[str, str]:
    return tuple(text.format(**{k: v[side] for k, v in parts.items()}) for side in (0, 1))


_more, _more_sql = pairs({
    "J2_text_by_id": ("SELECT doc_id, substr(sha2(text, 256), 1, 16) AS hash, n_chars FROM documents WHERE doc_id IN (3, 50, 77)",
                      "SELECT doc_id, substr(sha256(text), 1, 16) AS hash, n_chars FROM documents WHERE doc_id IN (3, 50, 77)"),
    "J3_stored_order": _both(
        """WITH stored AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS position FROM orders),
             listed AS (SELECT o_custkey, {ids} AS ids FROM stored GROUP BY o_custkey), again AS (SELECT l_orderkey AS o_orderkey, count(*) AS lines FROM lineitem GROUP BY l_orderkey)
        SELECT s.o_custkey, count(*) AS stored, count(a.lines) AS found, count(*) = count(a.lines) AS same_sequence, max(l.ids) AS ids FROM stored s
        LEFT JOIN again a ON a.o_orderkey = s.o_orderkey JOIN listed l ON l.o_custkey = s.o_custkey GROUP BY s.o_custkey""",
        ids=("array_join(transform(array_sort(collect_list(struct(position, o_orderkey))), x -> CAST(x.o_orderkey AS STRING)), ',')", "string_agg(o_orderkey::VARCHAR, ',' ORDER BY position)")),
    "J4_id_array": _both(
        """SELECT c_custkey, position, w.n_nationkey, n_name, n_name IS NULL AS missing FROM ({unnested}) w LEFT JOIN nation ON nation.n_nationkey = w.n_nationkey""",
        unnested=("SELECT c_custkey, pos AS position, id AS n_nationkey FROM customer LATERAL VIEW posexplode(array(c_nationkey, c_nationkey + 7, 3)) p AS pos, id",
                  "SELECT c_custkey, unnest([0, 1, 2]) AS position, unnest([c_nationkey, c_nationkey + 7, 3]) AS n_nationkey FROM customer")),
    "J13_number_to_excerpt": """
        WITH excerpts AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE role = 'assistant'),
             cited AS (SELECT DISTINCT conv_id, conv_id % 4 + 1 AS n FROM conversations)
        SELECT c.conv_id, c.n, e.text IS NULL AS unknown, length(e.text) AS chars FROM cited c LEFT JOIN excerpts e ON e.conv_id = c.conv_id AND e.n = c.n""",
    "J15_foreign_references": """
        SELECT user_id, event_id FROM events a WHERE value > 90 AND NOT EXISTS (SELECT 1 FROM events s WHERE s.user_id = a.user_id AND s.event_type = 'view' AND s.event_id % 10 = a.event_id % 10)""",
    "J17_merged_results": """
        SELECT doc, section, score, similarity FROM (
            SELECT *, row_number() OVER (PARTITION BY doc, section ORDER BY CASE WHEN score IS NULL THEN 1 ELSE 0 END, coalesce(score, similarity) DESC, similarity DESC, line) AS n FROM (
                SELECT l_suppkey AS doc, l_returnflag AS section, l_linenumber AS line, CASE WHEN l_quantity > 25 THEN l_discount END AS score, l_extendedprice AS similarity FROM lineitem) y) x WHERE n = 1""",
    "J27_one_mode": """
        SELECT c_custkey, CASE WHEN count(m.mode) = 1 THEN max(m.mode) END AS mode FROM customer
        LEFT JOIN (VALUES ('automobile'), ('building'), ('build'), ('machinery')) m(mode) ON contains(lower(trim(c_mktsegment)), m.mode) GROUP BY c_custkey""",
    "R8_alternatives": _both(
        """SELECT conv_id, turn, {kept} AS queries FROM (SELECT conv_id, turn, {asked} AS asked FROM conversations WHERE role = 'user') x""",
        asked=(r"transform(array(text, split(text, '\\.')[0], split(text, '\\.')[1], ' '), q -> trim(regexp_replace(coalesce(q, ''), '[ \\n\\t]+', ' ')))",
               r"list_transform([text, string_split(text, '.')[1], string_split(text, '.')[2], ' '], lambda q: trim(regexp_replace(coalesce(q, ''), '[ \n\t]+', ' ', 'g')))"),
        kept=("array_join(array_distinct(filter(asked, q -> q <> '')), '|')",
              "array_to_string(list_filter(asked, lambda q, i: q <> '' AND list_position(asked, q) = i), '|')")),
    "R13_title_search": _both(
        """SELECT doc_id, score FROM (SELECT doc_id, CAST({score} AS BIGINT) AS score FROM (SELECT doc_id, {words} AS title FROM documents) t) x WHERE score > 0""",
        words=(f"regexp_extract_all(lower({_FIRST_LINE[0]}), '[a-z0-9\\']+', 0)", f"regexp_extract_all(lower({_FIRST_LINE[1]}), '[a-z0-9'']+')"),
        score=("3 * (CASE WHEN exists(title, t -> startswith(t, 'heat')) THEN 1 ELSE 0 END + CASE WHEN exists(title, t -> startswith(t, 'an')) THEN 1 ELSE 0 END)",
               "3 * (CASE WHEN len(list_filter(title, lambda t: starts_with(t, 'heat'))) > 0 THEN 1 ELSE 0 END + CASE WHEN len(list_filter(title, lambda t: starts_with(t, 'an'))) > 0 THEN 1 ELSE 0 END)")),
    "R16_freshness_route": """
        WITH copies AS (SELECT user_id, max(CASE WHEN value >= 5 THEN ts END) AS copied, max_by(value, event_id) >= 2 AS is_up FROM events GROUP BY user_id)
        SELECT user_id, CASE WHEN copied >= last - INTERVAL 12 HOUR THEN 'copy' WHEN is_up THEN 'live, refresh asked' WHEN copied IS NOT NULL THEN 'stale copy' ELSE 'error' END AS route
        FROM copies, (SELECT max(ts) AS last FROM events) m""",
    "R19_built_query": """
        SELECT f.conv_id, f.turn, substr(concat(f.text, ' · ', coalesce(p.text, ''), ' · ', f.role), 1, 300) AS query FROM conversations f
        LEFT JOIN conversations p ON p.conv_id = f.conv_id AND p.turn = f.turn - 2 WHERE f.role = 'user'""",
    "R20_rewrite_lines": _both(
        """SELECT conv_id, turn, {first_two} AS queries FROM (SELECT conv_id, turn, {peeled} AS lines FROM conversations) x""",
        peeled=(r"filter(transform(split(text, '\n'), x -> trim(regexp_replace(trim(x), '^(?:[-*•]|[0-9]+[.)])[ ]+|^[\\x22«]|[\\x22»]$', ''))), x -> x <> '')",
                r"list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(trim(x), '^(?:[-*•]|[0-9]+[.)])[ ]+|^[\x22«]|[\x22»]$', '', 'g'))), lambda x: x <> '')"),
        first_two=("array_join(slice(array_distinct(lines), 1, 2), '|')", "array_to_string((list_filter(lines, lambda q, i: list_position(lines, q) = i))[1:2], '|')")),
    "T23_added_ranges": """
        SELECT l_orderkey AS file, min(l_linenumber) AS first_line, max(l_linenumber) AS last_line, count(*) AS lines FROM (
            SELECT l_orderkey, l_linenumber, l_linenumber - row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS island
            FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag <> 'R') d) x GROUP BY l_orderkey, island""",
    "T24_replace_once": _both(
        """SELECT doc_id, hits, CASE WHEN hits = 1 THEN replace(text, 'The ', 'A ') END AS edited FROM (SELECT doc_id, text, CAST({hits} AS BIGINT) AS hits FROM documents) x""",
        hits=("(length(text) - length(replace(text, 'The ', ''))) / 4", "(length(text) - length(replace(text, 'The ', ''))) / 4")),
    "T26_in_order": _both(
        """SELECT doc_id, strpos_a > 0 AND strpos_b > 0 AS in_order FROM (
            SELECT doc_id, {a} AS strpos_a, CASE WHEN {a} > 0 THEN {b} ELSE 0 END AS strpos_b FROM (SELECT doc_id, concat(' ', {words}, ' ') AS t FROM documents) y) x""",
        a=("instr(t, ' of the ')", "strpos(t, ' of the ')"), b=("instr(substr(t, instr(t, ' of the ') + 7), ' in ')", "strpos(substr(t, strpos(t, ' of the ') + 7), ' in ')"),
        words=(r"array_join(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+|#', 0), ' ')".replace("{", "{{").replace("}", "}}").replace("{{", "{").replace("}}", "}"),
               r"array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}]+|#'), ' ')")),
    "T33_numbers_of_turns": _both(
        """SELECT conv_id, turn, {numbers} AS cited FROM (SELECT conv_id, turn, concat('[', turn, ', ', turn + 2, '] and [', turn + 1, '–', turn + CASE WHEN conv_id % 2 = 0 THEN 3 ELSE 25 END, '] ', text) AS t FROM conversations) x""",
        numbers=(r"""array_sort(array_distinct(flatten(transform(regexp_extract_all(array_join(regexp_extract_all(t, '\\[([0-9]+(?:[–-][0-9]+)?(?:, *[0-9]+(?:[–-][0-9]+)?)*)\\]', 1), ','), '[0-9]+(?:[–-][0-9]+)?', 0),
                    x -> CASE WHEN NOT x RLIKE '[–-]' THEN array(CAST(x AS INT)) WHEN CAST(split(x, '[–-]')[1] AS INT) BETWEEN CAST(split(x, '[–-]')[0] AS INT) AND CAST(split(x, '[–-]')[0] AS INT) + 19
                         THEN sequence(CAST(split(x, '[–-]')[0] AS INT), CAST(split(x, '[–-]')[1] AS INT)) ELSE CAST(array() AS array<int>) END))))""",
                 r"""list_sort(list_distinct(flatten(list_transform(regexp_extract_all(array_to_string(regexp_extract_all(t, '\[([0-9]+(?:[–-][0-9]+)?(?:, *[0-9]+(?:[–-][0-9]+)?)*)\]', 1), ','), '[0-9]+(?:[–-][0-9]+)?'),
                    lambda x: CASE WHEN NOT regexp_matches(x, '[–-]') THEN [CAST(x AS INT)] WHEN CAST(string_split_regex(x, '[–-]')[2] AS INT) BETWEEN CAST(string_split_regex(x, '[–-]')[1] AS INT) AND CAST(string_split_regex(x, '[–-]')[1] AS INT) + 19
                         THEN generate_series(CAST(string_split_regex(x, '[–-]')[1] AS INT), CAST(string_split_regex(x, '[–-]')[2] AS INT))::INT[] ELSE []::INT[] END))))""")),
    "T34_changes_of_turns": _both(
        """SELECT conv_id, turn, k, CASE WHEN v IN ('-', '—', 'delete') THEN NULL ELSE v END AS v FROM (
            SELECT conv_id, turn, lower({key}) AS k, {value} AS v FROM ({lines}) l WHERE contains(line, ':')) x WHERE k <> '' AND v <> '' AND k <> 'no changes'""",
        lines=(r"SELECT conv_id, turn, line FROM (SELECT conv_id, turn, concat('- **Goal**: ', role, '\n2) note: delete\nNo changes\n: nothing\n', text) AS t FROM conversations) y LATERAL VIEW explode(split(t, '\n')) p AS line",
               "SELECT conv_id, turn, unnest(string_split(concat('- **Goal**: ', role, chr(10), '2) note: delete', chr(10), 'No changes', chr(10), ': nothing', chr(10), text), chr(10))) AS line FROM conversations"),
        key=(r"trim(regexp_replace(regexp_replace(split(line, ':', 2)[0], '^[ ]*(?:[-*•]|[0-9]+[.)])[ ]+', ''), '[*_`\\x22«»]', ''))",
             r"trim(regexp_replace(regexp_replace(substr(line, 1, strpos(line, ':') - 1), '^[ ]*(?:[-*•]|[0-9]+[.)])[ ]+', ''), '[*_`\x22«»]', '', 'g'))"),
        value=(r"trim(regexp_replace(split(line, ':', 2)[1], '[*_`\\x22«»]', ''))", r"trim(regexp_replace(substr(line, strpos(line, ':') + 1), '[*_`\x22«»]', '', 'g'))")),
    "T36_summary_items": _both(
        "SELECT conv_id, turn, {items} AS items, {none} AS no_answer FROM conversations",
        items=(r"size(filter(split(concat('- first\n', text), '\n'), x -> startswith(x, '- ')))", r"len(list_filter(string_split(concat('- first', chr(10), text), chr(10)), lambda x: starts_with(x, '- ')))"),
        none=("startswith(lower(trim(text)), 'no answer')", "starts_with(lower(trim(text)), 'no answer')")),
    "T38_page_labels": _both(
        """SELECT l_suppkey, {label} AS label FROM (
            SELECT l_suppkey, min(p) AS a, CASE WHEN min(p) = max(p) THEN CAST(min(p) AS {string}) ELSE concat(min(p), '–', max(p)) END AS part FROM (
                SELECT l_suppkey, p, p - row_number() OVER (PARTITION BY l_suppkey ORDER BY p) AS island FROM (SELECT DISTINCT l_suppkey, l_partkey % 40 AS p FROM lineitem) d) x GROUP BY l_suppkey, island) y GROUP BY l_suppkey""",
        label=("array_join(transform(array_sort(collect_list(struct(a, part))), x -> x.part), ', ')", "string_agg(part, ', ' ORDER BY a)"), string=("STRING", "VARCHAR")),
    "T40_budget_text": """
        SELECT conv_id, count(*) AS messages, count_if(later + length(text) <= 3000) AS kept, CAST(sum(CASE WHEN later + length(text) <= 3000 THEN length(text) ELSE 0 END) AS BIGINT) AS chars FROM (
            SELECT conv_id, text, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS later FROM conversations) x GROUP BY conv_id""",
    "T41_filler": _both(
        """SELECT p_partkey, p_size * 4 AS target, {filler} AS text FROM part""",
        filler=("substr(repeat(concat(p_name, ' '), 30), 1, p_size * 4)", "substr(repeat(concat(p_name, ' '), 30), 1, p_size * 4)")),
    "K4_failed_attempts": """
        SELECT event_id AS id, ts AS started_at, ts + INTERVAL 5 SECOND AS finished_at, false AS ok, event_type AS error FROM events WHERE value < 1""",
    "K5_settings_upsert": """
        WITH stored AS (SELECT event_type AS k, 'old' AS v, -1 AS seq FROM events GROUP BY event_type), changes AS (SELECT event_type AS k, props AS v, event_id AS seq FROM events WHERE value > 95)
        SELECT k, max_by(v, seq) AS v FROM (SELECT * FROM stored UNION ALL SELECT * FROM changes) x GROUP BY k""",
    "K7_summary_references": """
        SELECT a.user_id, count(*) AS refs, count(s.event_id) AS known, count(*) - count(s.event_id) AS foreign_refs FROM events a
        LEFT JOIN (SELECT event_id FROM events WHERE event_type = 'view') s ON s.event_id = a.event_id - 1 WHERE a.event_type = 'click' GROUP BY a.user_id""",
    "K14_migration": "SELECT event_id, ts, event_type, value, 'copy' AS source, 3 AS version FROM events",
})
QUERIES |= _more
ORACLE_SQL |= _more_sql
