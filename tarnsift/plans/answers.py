"""Answers made from conversations, checked against their excerpts; counters over the checks.

Assistant turns stand for excerpts: an answer to a conversation gets its first three as excerpts and says one sentence
of its own, refers to some of them, and quotes from the first, by a fixed pattern of the conversation's number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnsift.operators import answers
from tarnsift.session import table

_ANSWERS = """
    WITH given AS (
        SELECT conv_id, slice(transform(array_sort(collect_list(struct(turn, text))), x -> x.text), 1, 3) AS excerpts
        FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
    quoted AS (SELECT conv_id, excerpts, array_join(slice(split(excerpts[0], '[ \\n]+'), 1, CASE WHEN conv_id % 5 = 1 THEN 2 ELSE 8 END), ' ') AS fragment FROM given)
    SELECT conv_id AS answer_id, excerpts, array('goal') AS memory, array('goal', 'party') AS memory_keys,
           CASE conv_id % 7
               WHEN 0 THEN concat('It is so [1]. And so [2, 3].\\n\\nQuotes:\\n[1] «', fragment, '»')
               WHEN 1 THEN concat('All of it holds. [1] Nothing else does.\\n\\n**Quotes:**\\n- [1]: "', fragment, '".')
               WHEN 2 THEN concat('It is in [4].\\n\\nQuotes:\\n[2] «', fragment, '»')
               WHEN 3 THEN 'I don’t know. What do you mean?'
               WHEN 4 THEN 'As you said [goal], and [party].'
               WHEN 5 THEN 'No reference at all, [see above] and [a](link).'
               ELSE concat('Yes [1].\\n\\nQuotes:\\n[1] «', fragment, ' … made up words here»\\n\\nSources:\\n[1] book') END AS raw
    FROM quoted"""


def made_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "conversations").createOrReplaceTempView("conversations")
    return spark.sql(_ANSWERS)


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.checked(made_answers(spark, sf_dir))


def t31_answer_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked(spark, sf_dir)


def t27_answer_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked(spark, sf_dir).select("answer_id", "body", "own_sources", F.transform("quotes", lambda q: q["quote"]).alias("quotes"))


def t28_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked(spark, sf_dir).select("answer_id", "refs", "memory_refs")


def _each(rows: DataFrame, field: str, *others: str) -> DataFrame:
    """A row, one, for each element of field. Outer: else the optimizer puts a filter on its size below, where the whole check
    is worked out again, each column inlined wherever another one names it."""
    return rows.select("answer_id", *others, F.explode_outer(field).alias("one")).filter("one IS NOT NULL")


def t29_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(_checked(spark, sf_dir), "claims").select("answer_id", "one.*")


def t30_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(_checked(spark, sf_dir), "quotes").select("answer_id", "one.*")


def t32_rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = made_answers(spark, sf_dir)
    return answers.rendered(answers.checked(made).join(made.select("answer_id", "excerpts"), "answer_id"))


def p3_claim_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claim, the excerpt it refers to, and how the quotation of that excerpt fared (J13: number to excerpt by place)."""
    made = made_answers(spark, sf_dir).select("answer_id", "excerpts")
    claims = _each(_checked(spark, sf_dir), "claims", "quotes").select("answer_id", "quotes", "one.*").withColumn("number", F.col("ref").try_cast("long"))
    rows = claims.withColumn("q", F.explode_outer(F.filter("quotes", lambda q: q["number"] == F.col("number")))).join(made, "answer_id")
    return rows.select("answer_id", "ref", "sentence", F.get("excerpts", (F.col("number") - 1).cast("int")).alias("excerpt"), "q.quote", "q.status")


def j14_memory_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memory keys that answers name, and whether the turn's memory has them."""
    made = made_answers(spark, sf_dir)
    named = made.select("answer_id", "memory", F.explode(F.regexp_extract_all("raw", F.lit(r"\[([a-z]+)\]"), F.lit(1))).alias("key"))
    known = spark.createDataFrame([("goal", "to finish"), ("place", "north")], "key string, entry string")
    return named.join(F.broadcast(known), "key", "left").select("answer_id", "key", "entry", F.array_contains("memory", F.col("key")).alias("in_memory"))


def g9_answer_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters over checked answers, in all and by parity of the conversation."""
    rows = _checked(spark, sf_dir).withColumn("half", F.col("answer_id") % 2)
    kind = lambda k: F.count_if(F.col("kind") == k)
    quotes = lambda s: F.sum(F.size(F.filter("quotes", lambda q: q["status"] == s)))
    return rows.groupingSets([[], ["half"]], "half").agg(
        F.count("*").alias("answers"), kind("answer").alias("answered"), kind("unknown").alias("unknown"), kind("memory").alias("by_memory"), kind("none").alias("unreferenced"),
        F.count_if(F.size("violations") == 0).alias("clean"), F.count_if("asks").alias("asking"), F.count_if("own_sources").alias("with_sources"), F.sum(F.size("quotes")).alias("quotes"),
        quotes("ok").alias("verbatim"), quotes("short").alias("short"), quotes("other").alias("elsewhere"), quotes("loose").alias("loose"), quotes("none").alias("unknown_excerpt"),
        F.sum(F.size("refs")).alias("refs"), F.sum(F.size("memory_refs")).alias("memory_refs"), F.sum(F.size("sources")).alias("sources"), F.sum(F.size("violations")).alias("violations"),
        F.array_sort(F.collect_list(F.when(F.size("violations") > 0, F.col("answer_id")))).alias("failed"),
    )


QUERIES = {"T27_answer_parts": t27_answer_parts, "T28_references": t28_references, "T29_claims": t29_claims, "T30_quotes": t30_quotes, "T31_answer_check": t31_answer_check,
           "T32_rendered": t32_rendered, "P3_claim_table": p3_claim_table, "J14_memory_lookup": j14_memory_lookup, "G9_answer_counters": g9_answer_counters}

#: The answers made and checked in SQL. Their bodies say what they refer to by how they are made; quotations are looked up in the excerpts.
_CHECKED = r"""
    WITH given AS (SELECT conv_id, list(text ORDER BY turn, text)[1:3] AS excerpts FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
    quoted AS (SELECT *, array_to_string(string_split_regex(excerpts[1], '[ \n]+')[1 : CASE WHEN conv_id % 5 = 1 THEN 2 ELSE 8 END], ' ') AS fragment FROM given),
    made AS (
        SELECT conv_id AS answer_id, excerpts, conv_id % 7 AS way, CASE WHEN conv_id % 7 IN (0, 1, 6) THEN 1 WHEN conv_id % 7 = 2 THEN 2 END AS number,
               CASE conv_id % 7 WHEN 0 THEN 'It is so [1]. And so [2, 3].' WHEN 1 THEN 'All of it holds. [1] Nothing else does.' WHEN 2 THEN 'It is in [4].' WHEN 3 THEN 'I don’t know. What do you mean?'
                                WHEN 4 THEN 'As you said [goal], and [party].' WHEN 5 THEN 'No reference at all, [see above] and [a](link).' ELSE 'Yes [1].' END AS body,
               [[1, 2, 3], [1], [4], [], [], [], [1]][conv_id % 7 + 1]::BIGINT[] AS refs,
               CASE WHEN conv_id % 7 IN (0, 1, 2) THEN trim(fragment) WHEN conv_id % 7 = 6 THEN fragment || ' … made up words here' END AS quote FROM quoted),
    worded AS (
        SELECT *, [' ' || array_to_string(regexp_extract_all(replace(lower(e), 'ё', 'е'), '[\p{L}\p{N}]+|#'), ' ') || ' ' for e in excerpts] AS texts,
               [' ' || p || ' ' for p in [array_to_string(regexp_extract_all(replace(lower(x), 'ё', 'е'), '[\p{L}\p{N}]+|#'), ' ') for x in string_split(quote, '…')] if p <> ''] AS parts FROM made),
    looked AS (
        SELECT *, number <= len(texts) AS there, [w for w in string_split(trim(array_to_string(parts, '')), ' ') if w <> ''] AS flat,
               [k for k in range(1, len(texts) + 1) if coalesce(contains(texts[k], parts[1]), TRUE) AND (len(parts) < 2 OR contains(substr(texts[k], strpos(texts[k], parts[1]) + length(parts[1]) - 1), parts[2]))] AS holding FROM worded),
    told AS (
        SELECT *, CASE WHEN number IS NULL THEN NULL WHEN NOT there THEN 'none' WHEN list_contains(holding, number) THEN CASE WHEN len(flat) >= 4 THEN 'ok' ELSE 'short' END WHEN len(holding) > 0 THEN 'other' ELSE 'loose' END AS status FROM looked),
    checked AS (
        SELECT *, CASE WHEN there AND list_contains(holding, number) THEN number WHEN there THEN holding[1] END::BIGINT AS found_in,
               CASE WHEN status = 'loose' THEN len([w for w in flat if contains(texts[number], ' ' || w || ' ')])::DOUBLE / len(flat) END AS coverage,
               ['answer', 'answer', 'answer', 'unknown', 'memory', 'none', 'answer'][way + 1] AS kind, CASE WHEN way = 4 THEN ['goal'] ELSE [] END::VARCHAR[] AS memory_refs,
               list_concat(CASE WHEN way = 5 THEN ['no reference'] ELSE [] END, ['no excerpt ' || n for n in refs if n > len(texts)], CASE WHEN number IS NOT NULL THEN ['no quotation of ' || n for n in refs if n <= len(texts) AND n <> number] ELSE [] END,
                           CASE WHEN status <> 'ok' THEN ['quotation ' || number || ' ' || status] ELSE [] END, CASE WHEN way = 4 THEN ['no memory party'] ELSE [] END)::VARCHAR[] AS violations,
               list_sort(list_distinct([n for n in list_concat(refs, CASE WHEN number IS NULL THEN [] ELSE [number::BIGINT] END) if n <= len(texts)])) AS sources FROM told)"""
_CLAIMS = """
    SELECT answer_id, unnest([['1', '2', '3'], ['1'], ['4'], [], ['goal', 'party'], [], ['1']][way + 1]) AS ref,
           unnest([['It is so [1].', 'And so [2, 3].', 'And so [2, 3].'], ['All of it holds.'], ['It is in [4].'], [], ['As you said [goal], and [party].', 'As you said [goal], and [party].'], [], ['Yes [1].']][way + 1]) AS sentence, excerpts FROM checked"""
ORACLE_SQL: dict[str, str] = {
    "T27_answer_parts": f"{_CHECKED} SELECT answer_id, body, way = 6 AS own_sources, CASE WHEN quote IS NULL THEN [] ELSE [quote] END AS quotes FROM checked",
    "T28_references": f"{_CHECKED} SELECT answer_id, refs, memory_refs FROM checked",
    "T29_claims": f"{_CHECKED} SELECT answer_id, ref, sentence FROM ({_CLAIMS})",
    "T30_quotes": f"{_CHECKED} SELECT answer_id, number::BIGINT AS number, quote, status, found_in, coverage FROM checked WHERE number IS NOT NULL",
    "T32_rendered": f"""{_CHECKED}
    SELECT answer_id, concat_ws(chr(10) || chr(10), body, CASE WHEN status = 'ok' THEN '[' || number || '] «' || quote || '»' END,
               CASE WHEN len(sources) > 0 THEN array_to_string(['[' || n || '] ' || substr(excerpts[n], 1, 60) for n in sources], chr(10)) END,
               CASE WHEN len(violations) > 0 THEN 'unchecked: ' || array_to_string(violations, '; ') END) AS shown FROM checked""",
    "P3_claim_table": f"""{_CHECKED}
    SELECT c.answer_id, ref, sentence, c.excerpts[try_cast(ref AS BIGINT)] AS excerpt, quote, status FROM ({_CLAIMS}) AS c
    LEFT JOIN checked AS q ON q.answer_id = c.answer_id AND q.number = try_cast(ref AS BIGINT)""",
    "J14_memory_lookup": """
    SELECT conv_id AS answer_id, key, CASE key WHEN 'goal' THEN 'to finish' END AS entry, key = 'goal' AS in_memory FROM (
        SELECT conv_id, unnest(CASE conv_id % 7 WHEN 4 THEN ['goal', 'party'] WHEN 5 THEN ['a'] ELSE [] END) AS key FROM conversations WHERE role = 'assistant' GROUP BY conv_id)""",
    "G9_answer_counters": f"""{_CHECKED}
    SELECT half, count(*) AS answers, count(*) FILTER (kind = 'answer') AS answered, count(*) FILTER (kind = 'unknown') AS unknown, count(*) FILTER (kind = 'memory') AS by_memory, count(*) FILTER (kind = 'none') AS unreferenced,
           count(*) FILTER (len(violations) = 0) AS clean, count(*) FILTER (way = 3) AS asking, count(*) FILTER (way = 6) AS with_sources, count(quote) AS quotes, count(*) FILTER (status = 'ok') AS verbatim,
           count(*) FILTER (status = 'short') AS short, count(*) FILTER (status = 'other') AS elsewhere, count(*) FILTER (status = 'loose') AS loose, count(*) FILTER (status = 'none') AS unknown_excerpt,
           sum(len(refs))::BIGINT AS refs, sum(len(memory_refs))::BIGINT AS memory_refs, sum(len(sources))::BIGINT AS sources, sum(len(violations))::BIGINT AS violations,
           coalesce(list(answer_id ORDER BY answer_id) FILTER (len(violations) > 0), []) AS failed
    FROM (SELECT *, answer_id % 2 AS half FROM checked) GROUP BY GROUPING SETS ((), (half))""",
}
