"""Request weights by part, running folds, recovered JSON, sentences, all counters of dialogs and checked answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnsift.operators import accounts
from tarnsift.session import table


def g27_request_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as requests: the first message stands for the system prompt, the last for the question, the others are history; other parts by the
    number of the conversation."""
    said = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.coalesce(x["text"], F.lit(""))).alias("m"))
    first = F.element_at("m", 1)
    some = lambda n: F.when(F.col("conv_id") % n == 0, F.substring(first, 1, 40 * n)).otherwise("")
    requests = said.select(
        "conv_id", first.alias("system"), F.slice("m", F.lit(2), F.greatest(F.size("m") - 2, F.lit(0))).alias("history"), F.when(F.size("m") > 1, F.element_at("m", -1)).otherwise("").alias("question"),
        some(2).alias("memory"), some(3).alias("long_term"), some(5).alias("working"), some(7).alias("profile"), some(11).alias("task"), F.lit(None).cast("string").alias("invariants"), F.lit('{"tools": []}').alias("tools"), some(4).alias("rag"))
    return accounts.request_tokens(requests, "conv_id").drop("per_message")


def w3_running_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events as histories: a fold is due at six messages before the last six; where the event is an error, it fails and is tried again."""
    turns = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_type") != "error").alias("answered"))
    return accounts.folds(turns, "user_id", ["event_id"], 6, 6)


def t35_recovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects that stand in free texts: whole, with text behind, nested, torn; a number given as digits counts as one."""
    n = F.col("event_id")
    text = (
        F.when(n % 7 == 0, F.concat(F.lit("Here: "), "props", F.lit(" done {")))
        .when(n % 7 == 1, F.concat(F.lit('{"k": "'), n.cast("string"), F.lit('", "in": {"a": "}"}} and {"k": 1}')))
        .when(n % 7 == 2, F.lit("none {at all")).when(n % 7 == 3, F.concat(F.lit('} {"k": [1, {}]} '), "event_type")).when(n % 7 == 4, F.lit("no braces")).otherwise(F.col("props"))
    )
    rows = table(spark, sf_dir, "events").select("event_id", accounts.recovered_json(text).alias("json"))
    return rows.select("event_id", "json", accounts.as_integer(F.get_json_object("json", "$.k")).alias("k"))


def t11_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of the lines of documents, with their places."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "said"))
    # outer: else the optimizer puts a filter below that works out the sentences a second time
    return lines.select("doc_id", "line", F.inline_outer(accounts.sentences(F.col("said")))).filter("text IS NOT NULL")


def g13_dialog_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as turns of dialogs, with what a check would say of each by its number."""
    n, value = F.col("event_id"), F.col("value")
    turns = table(spark, sf_dir, "events").select(
        (F.col("user_id") % 4).alias("scenario"), "event_type", n.alias("turn_id"), (n % 11 != 0).alias("ok"), (n % 13 != 0).alias("search_ok"), (n % 17 != 0).alias("checked"), (n % 6 == 0).alias("empty"),
        F.when(n % 5 < 2, "answer").when(n % 5 == 2, "memory").when(n % 5 == 3, "unknown").otherwise("none").alias("kind"), (n % 4).alias("refs"), (n % 3).alias("memory_refs"), (n % 2).alias("missing"),
        (n % 3).alias("sources_found"), F.lit(3).alias("sources_asked"), (n % 5).alias("keys_found"), F.when(n % 7 > 0, 5).alias("keys_asked"), (n % 19 == 0).alias("repaired"), (n % 97 == 0).alias("violated"),
        F.floor(value).cast("long").alias("prompt"), F.when(n % 2 == 0, 7).alias("completion"),
        *[(F.floor(value * 100) * k / 1024).alias(f"{what}_{call}") for k, (what, call) in enumerate(((w, c) for w in ("cost", "seconds") for c in ("main", "rewrite", "memory", "search")), 1)])
    return accounts.dialog_statistics(turns, ["scenario", "event_type"])


QUERIES = {"G27_request_parts": g27_request_parts, "W3_running_folds": w3_running_folds, "T35_recovered_objects": t35_recovered, "T11_sentence_spans": t11_sentence_spans, "G13_dialog_counters": g13_dialog_counters}


def _tokens(text: str) -> str:
    bare = rf"regexp_replace(coalesce({text}, ''), '\s+', '', 'g')"
    letters = rf"length(regexp_replace({bare}, '[^\x{{0400}}-\x{{052F}}]+', '', 'g'))", f"length(regexp_replace({bare}, '[^A-Za-z]+', '', 'g'))"
    return f"round_even({letters[0]} / 2.5::DOUBLE + {letters[1]} / 4.0::DOUBLE + (length({bare}) - {letters[0]} - {letters[1]}) / 2.0::DOUBLE, 0)::BIGINT"


_SOME = {"memory": 2, "long_term": 3, "working": 5, "profile": 7, "task": 11, "rag": 4}
_SUMMED = lambda c, when: f"coalesce(sum(coalesce({c}, 0)) FILTER ({when}), 0)"
_CALLS = [(k, w, c) for k, (w, c) in enumerate(((w, c) for w in ("cost", "seconds") for c in ("main", "rewrite", "memory", "search")), 1)]
_JUDGED = "ok AND search_ok AND checked"
ORACLE_SQL = {
    "G27_request_parts": f"""
    WITH said AS (SELECT conv_id, list(coalesce(text, '') ORDER BY turn, role, text) AS m FROM conversations GROUP BY conv_id),
    parts AS (
        SELECT conv_id, m[1] AS system, m[2 : len(m) - 1] AS h, CASE WHEN len(m) > 1 THEN m[len(m)] ELSE '' END AS question,
               {", ".join(f"CASE WHEN conv_id % {n} = 0 THEN substr(m[1], 1, {40 * n}) ELSE '' END AS {p}" for p, n in _SOME.items())} FROM said),
    told AS (
        SELECT conv_id, {_tokens("system")} AS system, coalesce(list_sum([{_tokens("x")} for x in h]), 0)::BIGINT AS history, {", ".join(f"{_tokens(p)} AS {p}" for p in ("question", *_SOME))}, 0::BIGINT AS invariants, {_tokens("'{" + chr(34) + "tools" + chr(34) + ": []}'")} AS tools,
               ((1 + len(h) + {" + ".join(f"({p} <> '')::INT" for p in ("question", "memory", "long_term", "working", "profile", "task"))}) * 4 + 3)::BIGINT AS overhead FROM parts)
    SELECT *, system + history + question + memory + long_term + working + profile + task + invariants + tools + rag + overhead AS total FROM told""",
    "W3_running_folds": """
    WITH RECURSIVE turns AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, event_type <> 'error' AS answered FROM events),
    walk AS (
        SELECT DISTINCT user_id, 0::BIGINT AS n, 0::BIGINT AS covered, 0 AS tried, 0 AS done FROM events
        UNION ALL
        SELECT w.user_id, t.n, CASE WHEN due AND answered THEN t.n - 6 ELSE covered END, tried + due::INT, done + (due AND answered)::INT
        FROM (SELECT *, n + 1 - 6 - covered >= 6 AS due FROM walk) AS w JOIN turns AS t ON t.user_id = w.user_id AND t.n = w.n + 1)
    SELECT user_id, n::INTEGER AS n, covered::INTEGER AS covered, tried, done FROM walk WHERE n > 0""",
    "T35_recovered_objects": """
    WITH said AS (
        SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'Here: ' || props || ' done {' WHEN 1 THEN '{"k": "' || event_id || '", "in": {"a": "}"}} and {"k": 1}' WHEN 2 THEN 'none {at all' WHEN 3 THEN '} {"k": [1, {}]} ' || event_type
                                        WHEN 4 THEN 'no braces' ELSE props END AS text FROM events),
    tails AS (SELECT event_id, CASE WHEN contains(text, '{') THEN substr(text, strpos(text, '{')) END AS tail FROM said),
    found AS (SELECT event_id, [substr(tail, 1, i) for i in range(1, length(tail) + 1) if tail[i] = '}' AND json_valid(substr(tail, 1, i))][1] AS json FROM tails)
    SELECT event_id, json, CASE WHEN regexp_matches(json_extract_string(json, '$.k'), '^[0-9]+$') THEN json_extract_string(json, '$.k')::BIGINT END AS k FROM found""",
    "T11_sentence_spans": r"""
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS said, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents),
    marked AS (SELECT doc_id, line, string_split(regexp_replace(said, '([.!?…]+["''»”’)\]]*)(\s)', '\1' || chr(1) || '\2', 'g'), chr(1)) AS cut FROM l),
    placed AS (SELECT doc_id, line, unnest(cut) AS t, unnest([coalesce(list_sum([length(x) for x in cut[1 : i - 1]]), 0) for i in range(1, len(cut) + 1)]) AS place FROM marked)
    SELECT doc_id, line::INTEGER AS line, (place + length(regexp_extract(t, '^\s*')))::INTEGER AS "start", (place + length(regexp_replace(t, '\s+$', '')))::INTEGER AS "end", regexp_replace(t, '^\s+|\s+$', '', 'g') AS text
    FROM placed WHERE regexp_matches(t, '\S')""",
    "G13_dialog_counters": f"""
    WITH turns AS (
        SELECT user_id % 4 AS scenario, event_type, event_id AS n, event_id % 11 <> 0 AS ok, event_id % 13 <> 0 AS search_ok, event_id % 17 <> 0 AS checked, event_id % 6 = 0 AS empty,
               CASE WHEN event_id % 5 < 2 THEN 'answer' WHEN event_id % 5 = 2 THEN 'memory' WHEN event_id % 5 = 3 THEN 'unknown' ELSE 'none' END AS kind,
               floor(value)::BIGINT AS prompt, CASE WHEN event_id % 2 = 0 THEN 7 END AS completion, {", ".join(f"floor(value * 100) * {k} / 1024 AS {w}_{c}" for k, w, c in _CALLS)} FROM events)
    SELECT scenario, event_type, count(*) AS turns, count(*) FILTER (ok) AS ok, count(*) FILTER (ok AND NOT search_ok) AS search_failed, count(*) FILTER (ok AND search_ok AND NOT checked) AS unchecked,
           count(*) FILTER ({_JUDGED} AND kind = 'answer') AS by_excerpts, count(*) FILTER ({_JUDGED} AND kind = 'memory') AS by_memory, count(*) FILTER ({_JUDGED} AND kind = 'unknown' AND empty) AS unknown_nothing_found,
           count(*) FILTER ({_JUDGED} AND kind = 'unknown' AND NOT empty) AS unknown_by_content, count(*) FILTER ({_JUDGED} AND kind = 'none') AS no_references,
           count(*) FILTER ({_JUDGED} AND kind = 'unknown' AND (n % 4 > 0 OR n % 3 > 0)) AS unknown_with_references, count(*) FILTER ({_JUDGED} AND n % 4 > 0) AS with_source, count(*) FILTER (ok AND search_ok AND empty) AS empty,
           {_SUMMED("n % 3", _JUDGED)}::BIGINT AS memory_ok, {_SUMMED("n % 2", _JUDGED)}::BIGINT AS memory_missing, {_SUMMED("n % 3", "ok")}::BIGINT AS sources_found, {_SUMMED("3", "ok")}::BIGINT AS sources_asked,
           sum(n % 5)::BIGINT AS keys_found, sum(CASE WHEN n % 7 > 0 THEN 5 ELSE 0 END)::BIGINT AS keys_asked, count(*) FILTER ({_JUDGED} AND n % 19 = 0) AS repaired,
           coalesce(list(n ORDER BY n) FILTER ({_JUDGED} AND n % 97 = 0), []) AS violated, {_SUMMED("prompt", "ok")}::BIGINT AS prompt, {_SUMMED("completion", "ok")}::BIGINT AS completion,
           {", ".join(f"round({_SUMMED(f'{w}_{c}', 'ok AND search_ok' if c == 'search' else 'ok')}, 6) AS {w}_{c}" for _, w, c in _CALLS if (w, c) != ("cost", "search"))}
    FROM turns GROUP BY scenario, event_type""",
}
