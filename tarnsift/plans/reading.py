"""Documents cleaned end to end, glossary units, texts under budgets, parts in order, profiles compared field by field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnsift.operators import budgets, cleaned, line_chunks, ordered_parts, profiles, ranks
from tarnsift.session import scratch_dir, table

#: Lines of a page; letter sizes stand in for those of a printed page.
PAGE, DROPPED_PAGE, LEAST_SIZE = 30, 2, 8.0


def printed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as they would come from print: words cut by hyphens at the end of some lines, numbers and bullets alone on
    lines, soft hyphens within words' ends."""
    lower = lambda x: F.concat(F.lower(F.substring(x, 1, 1)), F.substring(x, F.lit(2), F.length(x)))

    def line(x: Column, i: Column) -> Column:
        x = F.when(i % 5 == 3, F.concat(x, F.lit("-"))).when(i % 5 == 4, lower(x)).otherwise(x)
        x = F.when(i % 13 == 5, F.concat(F.substring_index(x, " ", 1), F.lit("­"), F.substring(x, F.length(F.substring_index(x, " ", 1)) + 1, F.length(x)))).otherwise(x)
        return F.when(i % 7 == 2, F.concat(x, F.lit("\n12"))).when(i % 11 == 4, F.concat(x, F.lit("\n•"))).otherwise(x)

    docs = table(spark, sf_dir, "documents").filter("text <> ''")
    return docs.select("doc_id", F.array_join(F.transform(F.split("text", "\n"), line), "\n").alias("text"))


def _told(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cleaned.raw_lines(printed(spark, sf_dir))
    page, size = (F.floor((F.col("n") - 1) / PAGE) + 1).cast("int"), F.when((F.col("doc_id") + F.col("n")) % 19 == 0, 6.0).otherwise(10.0)
    return cleaned.dropped(rows.select("*", page.alias("page"), size.alias("size")), (DROPPED_PAGE,), LEAST_SIZE)


def t1_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's clean text by its digest, its paragraphs, joined words, and the characters that each rule took."""
    told = _told(spark, sf_dir)
    gone = told.groupBy("doc_id").agg(*[F.coalesce(F.sum(F.when(F.coalesce("rule", F.lit("control")) == r, F.col("gone"))), F.lit(0)).alias(r) for r in cleaned.RULES])
    texts = cleaned.clean_texts(cleaned.pieces(told))
    return gone.join(texts, "doc_id", "left").select("doc_id", F.length("text").alias("chars"), F.sha2("text", 256).alias("sha256"), "paragraphs", "hyphens", *cleaned.RULES)


def f4_dropped_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and characters by the rule that took them, all five in their order of priority."""
    told = _told(spark, sf_dir).withColumn("rule", F.coalesce("rule", F.when(F.col("gone") > 0, "control"), F.lit("kept")))
    return told.groupBy("rule").agg(F.count("*").alias("lines"), F.sum("gone").alias("chars"))


def t1_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 400th place of the clean texts, led back to the raw text, and what stands at both."""
    return cleaned.places_every(cleaned.pieces(_told(spark, sf_dir)), 400)


def t8_glossary_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as paragraphs: headings by their form; every third line is an entry, named by its first two words."""
    rows = cleaned.raw_lines(table(spark, sf_dir, "documents").filter("text <> ''")).filter(F.col("line").rlike(r"\S"))
    said = F.regexp_replace("line", r"^\s+|\s+$", "")
    kind = F.when(said.rlike(line_chunks.HEADING), "heading").when(F.col("n") % 3 == 0, "entry").otherwise("text")
    told = rows.select("doc_id", "n", kind.alias("kind"), said.alias("text"), F.substring_index(said, " ", 2).alias("name"), F.col("raw_start").alias("start"), (F.col("raw_start") + F.length("line")).alias("end"))
    return cleaned.glossary_units(told)


def l4_degraded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of each conversation under 1,500 characters; a turn that is too long shows its first 80, then the list stops."""
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    full, short = F.concat("role", F.lit(": "), "text"), F.concat("role", F.lit(": "), F.substring("text", 1, 80), F.lit("…"))
    return budgets.degraded_lists(said, "conv_id", ["turn", "role", "text"], full, short, 1500)


def t40_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("ticket"), F.col("turn").alias("n"), F.col("role").alias("sender"), "text")
    return budgets.tickets(said, 1200, 400)


def t26_benchmark_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold all sentences of a benchmark item, in order."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split("text", "[.]")).alias("part", "text")).withColumn("part", F.col("part") + 1)
    return ordered_parts.found_in_order(table(spark, sf_dir, "documents").select("doc_id", "text"), items)


def j24_profile_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands stand for modes: what smaller parts say of them against what every fourth part says, with the names spelled anew."""
    part = table(spark, sf_dir, "part")
    fields = {"type": F.min("p_type"), "size": F.max("p_size").cast("string"), "name": F.min("p_name"), "price": F.when(F.max("p_size") > 40, F.floor(F.max("p_retailprice")).cast("string"))}
    told = lambda rows, mode: rows.groupBy(mode.alias("mode")).agg(F.map_filter(F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), v)]), lambda _, v: v.isNotNull()).alias("fields"))
    old = told(part.filter("p_size < 25 AND p_partkey % 3 > 0 AND p_brand <> 'Brand#9'"), F.col("p_brand"))
    return profiles.compared(old, told(part.filter("p_partkey % 4 = 0 AND p_brand <> 'Brand#7'"), F.concat(F.lit(" "), F.upper("p_brand"))))


def l7_numeric_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of a letter and a number, placed by the number."""
    number = F.regexp_extract("id", "([0-9]+)", 1).cast("int")
    ids = table(spark, sf_dir, "documents").select(F.col("source").alias("id")).distinct().withColumn("n", number)
    return ranks.numbered(ids, ["n", "id"], "place", f"{scratch_dir(spark)}/ids").select("id", F.col("place").cast("int").alias("place"))


def s7_events_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of a snapshot in the order in which they came, numbered over the whole of it."""
    late = table(spark, sf_dir, "orders").filter("year(o_orderdate) <= 1996").select("o_orderdate", "o_orderkey", "o_orderstatus")
    return ranks.numbered(late, ["o_orderdate", "o_orderkey"], "row_no", f"{scratch_dir(spark)}/rows").select("row_no", "o_orderkey", "o_orderstatus")


def t24_replaced_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edit that replaces a text which must stand in the document exactly once; places that overlap count each."""
    needle = "anan"
    hits = F.regexp_count("text", F.lit(f"(?={needle})"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", hits.alias("hits"))
    fate = F.when(F.col("hits") == 0, "not found").when(F.col("hits") > 1, "not once").otherwise("applied")
    at = F.instr("text", needle)
    edited = F.when(F.col("hits") == 1, F.concat(F.substring("text", F.lit(1), at - 1), F.lit("_"), F.substring("text", at + len(needle), F.length("text")))).otherwise(F.col("text"))
    return docs.select("doc_id", F.col("hits").cast("long").alias("hits"), fate.alias("fate"), F.md5(edited).alias("md5"))


def t25_folded_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal words of documents whose letters ê are written ё first: lower case, ё as е, letters and digits only."""
    words = ordered_parts.words(F.translate("text", "êÊ", "ёЁ"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(words).alias("n"), F.md5(F.array_join(words, " ")).alias("md5"))


QUERIES = {"L7_numeric_ids": l7_numeric_ids, "S7_events_in_order": s7_events_in_order, "T24_replaced_once": t24_replaced_once, "T25_folded_words": t25_folded_words, "T1_cleaned": t1_cleaned, "T1_places": t1_places, "F4_dropped_by_rule": f4_dropped_by_rule, "T8_glossary_units": t8_glossary_units, "L4_degraded_lists": l4_degraded, "T40_tickets": t40_tickets,
           "T26_benchmark_parts": t26_benchmark_parts, "J24_profile_fields": j24_profile_fields}

_TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_REMOVED = "translate(line, concat(chr(7), chr(8), chr(173), chr(8203), chr(65279)), '')"
_TOLD = rf"""
    WITH printed AS (
        SELECT doc_id, array_to_string(list_transform(list_transform(list_transform(string_split(text, chr(10)),
                   lambda x, i: CASE WHEN i % 5 = 4 THEN x || '-' WHEN i % 5 = 0 THEN lower(substr(x, 1, 1)) || substr(x, 2) ELSE x END),
                   lambda x, i: CASE WHEN i % 13 = 6 THEN string_split(x, ' ')[1] || chr(173) || substr(x, length(string_split(x, ' ')[1]) + 1) ELSE x END),
                   lambda x, i: CASE WHEN i % 7 = 3 THEN x || chr(10) || '12' WHEN i % 11 = 5 THEN x || chr(10) || '•' ELSE x END), chr(10)) AS text FROM documents WHERE text <> ''),
    l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM printed),
    r AS (
        SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS raw_start,
               {_TRIM.format("line")} AS bare, trim(regexp_replace({_REMOVED}, '\s+', ' ', 'g'), ' ') AS said, length(line) - length({_REMOVED}) AS removed FROM l),
    told AS (
        SELECT *, CASE WHEN rule IN ('page', 'small', 'digits', 'bullet') THEN length(bare) ELSE removed END AS gone FROM (
            SELECT *, CASE WHEN (n - 1) // {PAGE} + 1 = {DROPPED_PAGE} THEN 'page' WHEN (doc_id + n) % 19 = 0 THEN 'small' WHEN regexp_matches(bare, '^[0-9]+$') THEN 'digits'
                                WHEN bare = '•' THEN 'bullet' WHEN said = '' THEN 'control' END AS rule FROM r WHERE regexp_matches(line, '\S'))),
    j AS (
        SELECT *, CASE WHEN was IS NULL THEN 'paragraph' WHEN regexp_matches(was, '\p{{L}}-$') AND regexp_matches(said, '^\p{{Ll}}') THEN 'hyphen'
                       WHEN regexp_matches(said, '^\p{{Ll}}') OR (regexp_matches(said, '^[^\p{{L}}•—–-]') AND NOT regexp_matches(was, '[.!?…:]["''»”’)\]\s]*$')) THEN 'blank' ELSE 'paragraph' END AS joined
        FROM (SELECT *, lag(said) OVER (PARTITION BY doc_id ORDER BY n) AS was FROM told WHERE rule IS NULL)),
    p AS (
        SELECT *, CASE WHEN joined = 'hyphen' OR was IS NULL THEN '' WHEN joined = 'paragraph' THEN chr(10) ELSE ' ' END AS gap,
               CASE WHEN coalesce(lead(joined) OVER (PARTITION BY doc_id ORDER BY n) = 'hyphen', FALSE) THEN substr(said, 1, length(said) - 1) ELSE said END AS piece FROM j),
    clean AS (SELECT doc_id, string_agg(gap || piece, '' ORDER BY n) AS text, count(*) FILTER (joined = 'paragraph') AS paragraphs, count(*) FILTER (joined = 'hyphen') AS hyphens FROM p GROUP BY doc_id)"""
ORACLE_SQL = {
    "L7_numeric_ids": "SELECT id, dense_rank() OVER (ORDER BY regexp_extract(id, '([0-9]+)', 1)::INT)::INTEGER AS place FROM (SELECT DISTINCT source AS id FROM documents)",
    "S7_events_in_order": "SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS row_no, o_orderkey, o_orderstatus FROM orders WHERE year(o_orderdate) <= 1996",
    "T24_replaced_once": """
    SELECT doc_id, hits, CASE WHEN hits = 0 THEN 'not found' WHEN hits > 1 THEN 'not once' ELSE 'applied' END AS fate, md5(CASE WHEN hits = 1 THEN replace(text, 'anan', '_') ELSE text END) AS md5 FROM (
        SELECT doc_id, text, list_sum([len([i for i in range(1, length(l)) if l[i : i + 3] = 'anan']) for l in string_split(text, ' ')])::BIGINT AS hits FROM documents)""",
    "T25_folded_words": r"""
    SELECT doc_id, len(w)::INTEGER AS n, md5(array_to_string(w, ' ')) AS md5 FROM (
        SELECT doc_id, regexp_extract_all(translate(lower(translate(text, 'êÊ', 'ёЁ')), 'ё', 'е'), '[\p{L}\p{N}]+|#') AS w FROM documents)""",
    "T40_tickets": """
    WITH m AS (SELECT conv_id AS ticket, turn AS n, role AS sender, coalesce(text, '') AS text, role || ': ' || coalesce(text, '') AS line FROM conversations),
    t AS (
        SELECT ticket, count(*) AS every, string_split(arg_min(text, n), chr(10))[1] AS subject, coalesce(arg_max(text, n) FILTER (sender = 'user'), '') AS question,
               arg_max(sender, n) AS sender, arg_max(text, n) AS text, list(line ORDER BY n) AS lines FROM m GROUP BY ticket),
    ways AS (
        SELECT *, unnest(range(every)) AS way, every - 1 - unnest(range(every)) AS kept, NULL::INTEGER AS field_limit FROM t
        UNION ALL SELECT t.*, every + k, 0, (400 >> k)::INTEGER FROM t, (SELECT unnest(range(9)) AS k)),
    clipped AS (
        SELECT *, CASE WHEN field_limit < length(subject) THEN substr(subject, 1, field_limit) || '… [cut]' ELSE subject END AS s,
               CASE WHEN field_limit < length(question) THEN substr(question, 1, field_limit) || '… [cut]' ELSE question END AS q,
               CASE WHEN field_limit < length(text) THEN substr(text, 1, field_limit) || '… [cut]' ELSE text END AS l FROM ways),
    shown AS (
        SELECT *, concat_ws(chr(10), 'Ticket ' || ticket, 'Subject: ' || s, 'Question: ' || q, 'Messages:', CASE WHEN every - 1 > kept THEN '… ' || (every - 1 - kept) || ' earlier not shown' END,
               CASE WHEN kept > 0 THEN array_to_string(lines[every - kept : every - 1], chr(10)) END, sender || ': ' || l) AS shown FROM clipped)
    SELECT ticket, shown, kept::INTEGER AS kept, field_limit, length(shown) <= 1200 AS fits FROM shown
    QUALIFY row_number() OVER (PARTITION BY ticket ORDER BY length(shown) > 1200, CASE WHEN length(shown) > 1200 THEN -way ELSE way END) = 1""",
    "T1_cleaned": f"""{_TOLD}
    SELECT doc_id, any_value(length(text)) AS chars, any_value(sha256(text)) AS sha256, any_value(paragraphs) AS paragraphs, any_value(hyphens) AS hyphens,
           {", ".join(f"coalesce(sum(gone) FILTER (coalesce(rule, 'control') = '{r}'), 0)::BIGINT AS {r}" for r in cleaned.RULES)}
    FROM told LEFT JOIN clean USING (doc_id) GROUP BY doc_id""",
    "F4_dropped_by_rule": f"""{_TOLD}
    SELECT coalesce(rule, CASE WHEN gone > 0 THEN 'control' ELSE 'kept' END) AS rule, count(*) AS lines, sum(gone)::BIGINT AS chars FROM told GROUP BY 1""",
    "T1_places": rf"""{_TOLD},
    spots AS (SELECT doc_id, n, line, raw_start, piece, sum(length(piece) + length(gap)) OVER (PARTITION BY doc_id ORDER BY n) - length(piece) AS clean_start FROM p),
    asked AS (SELECT doc_id, text, unnest(range(0, length(text), 400)) AS place FROM clean WHERE length(text) > 0),
    of AS (SELECT a.*, line, raw_start, substr(piece, 1, least(place - clean_start, length(piece))::BIGINT) AS head, regexp_extract_all(line, '\s*\S+') AS t FROM asked a ASOF JOIN spots ON a.doc_id = spots.doc_id AND a.place >= spots.clean_start),
    led AS (
        SELECT doc_id, text, place, (raw_start + coalesce(list_sum([length(x) for x in t[1 : length(regexp_replace(head, '[^ ]', '', 'g'))]]), 0)
               + length(regexp_extract(coalesce(t[length(regexp_replace(head, '[^ ]', '', 'g')) + 1], ''), '^\s*')) + length(string_split(head, ' ')[-1]))::BIGINT AS raw_place FROM of)
    SELECT doc_id, place, raw_place, substr(led.text, place + 1, 1) AS clean_char, substr(printed.text, raw_place + 1, 1) AS raw_char FROM led JOIN printed USING (doc_id)""",
    "T8_glossary_units": rf"""
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents WHERE text <> ''),
    r AS (
        SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s, {_TRIM.format("line")} AS said FROM l),
    k AS (SELECT *, s + length(line) AS e, CASE WHEN regexp_matches(said, '{line_chunks.HEADING}') THEN 'heading' WHEN n % 3 = 0 THEN 'entry' ELSE 'text' END AS kind FROM r WHERE regexp_matches(line, '\S')),
    w AS (SELECT *, coalesce(lag(kind) OVER (PARTITION BY doc_id ORDER BY n), '') AS was FROM k),
    u AS (
        SELECT *, sum((kind = 'heading' AND was <> 'heading')::INT) OVER o AS island, sum((kind = 'entry' OR (kind = 'text' AND was <> 'text'))::INT) OVER o AS unit FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY n)),
    g AS (SELECT doc_id, island, string_agg(said, ' · ' ORDER BY n) AS name, min(s) AS s, max(e) AS e FROM u WHERE kind = 'heading' GROUP BY doc_id, island),
    b AS (
        SELECT doc_id, unit, any_value(island) AS island, arg_min(kind, n) AS kind, arg_min(was, n) AS was, arg_min(array_to_string(string_split(said, ' ')[1:2], ' '), n) AS entry, min(s) AS s, max(e) AS e
        FROM u WHERE kind <> 'heading' GROUP BY doc_id, unit),
    f AS (
        SELECT doc_id, unit, CASE WHEN kind = 'entry' THEN 'entry' ELSE 'group' END AS kind, coalesce(g.name, '') || CASE WHEN kind = 'entry' THEN ' › ' || entry ELSE '' END AS name,
               CASE WHEN was = 'heading' THEN g.s ELSE b.s END AS s, b.e AS e, island FROM b LEFT JOIN g USING (doc_id, island)),
    x AS (SELECT doc_id, max(island) AS island, max(unit) AS unit FROM f GROUP BY doc_id),
    tail AS (SELECT g.doc_id, g.name, g.s, g.e, x.unit FROM g LEFT JOIN x USING (doc_id) WHERE g.island > coalesce(x.island, 0))
    SELECT doc_id, unit::INTEGER AS ordinal, kind, name, f.s AS "start", coalesce(tail.e, f.e) AS "end" FROM f LEFT JOIN (SELECT doc_id, unit, e FROM tail) AS tail USING (doc_id, unit)
    UNION ALL SELECT doc_id, 1, 'group', name, s, e FROM tail WHERE unit IS NULL""",
    "L4_degraded_lists": """
    WITH RECURSIVE items AS (
        SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n, coalesce(role, '') || ': ' || coalesce(text, '') AS whole,
               coalesce(role, '') || ': ' || substr(coalesce(text, ''), 1, 80) || '…' AS short, count(*) OVER (PARTITION BY conv_id) AS every FROM conversations),
    walk AS (
        SELECT conv_id, 0 AS n, 1440 AS room, '' AS shown, 0 AS whole, 0 AS cut FROM items GROUP BY conv_id
        UNION ALL
        SELECT w.conv_id, i.n, w.room - length(t) - 1, w.shown || CASE WHEN w.n > 0 THEN chr(10) ELSE '' END || t, w.whole + (t = i.whole)::INT, w.cut + (t <> i.whole)::INT FROM (
            SELECT w.*, CASE WHEN length(i.whole) + 1 <= w.room THEN i.whole WHEN length(i.short) + 1 <= w.room THEN i.short END AS t FROM walk w JOIN items i ON i.conv_id = w.conv_id AND i.n = w.n + 1) AS w
        JOIN items i ON i.conv_id = w.conv_id AND i.n = w.n + 1 WHERE t IS NOT NULL AND i.n <= 40)
    SELECT conv_id, shown, whole, cut AS shortened, (every - n)::BIGINT AS left_out, 1440 - room AS used FROM walk JOIN (SELECT conv_id, any_value(every) AS every FROM items GROUP BY conv_id) USING (conv_id)
    QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC) = 1""",
    "T26_benchmark_parts": r"""
    WITH RECURSIVE spaced AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(replace(lower(text), 'ё', 'е'), '[\p{L}\p{N}]+|#'), ' ') || ' ' AS t FROM documents),
    parts AS (
        SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY part) AS k, count(*) OVER (PARTITION BY item_id) AS every, ' ' || w || ' ' AS w FROM (
            SELECT item_id, generate_subscripts(string_split(text, '.'), 1) AS part, array_to_string(regexp_extract_all(replace(lower(unnest(string_split(text, '.'))), 'ё', 'е'), '[\p{L}\p{N}]+|#'), ' ') AS w FROM benchmark)
        WHERE w <> ''),
    walk AS (
        SELECT doc_id, item_id, k, every, strpos(t, w) AS first, strpos(t, w) + length(w) - 1 AS behind FROM spaced, parts WHERE k = 1 AND contains(t, w)
        UNION ALL
        SELECT doc_id, a.item_id, b.k, a.every, first, behind - 1 + strpos(substr(t, behind), w) + length(w) - 1 FROM walk AS a JOIN parts AS b ON b.item_id = a.item_id AND b.k = a.k + 1 JOIN spaced USING (doc_id)
        WHERE contains(substr(t, behind), w))
    SELECT doc_id, item_id, (length(regexp_replace(substr(t, 1, first), '[^ ]', '', 'g')) - 1)::INTEGER AS first, (length(regexp_replace(substr(t, 1, behind), '[^ ]', '', 'g')) - 1)::INTEGER AS last
    FROM walk JOIN spaced USING (doc_id) WHERE k = every""",
    "J24_profile_fields": """
    WITH told AS (
        SELECT p_brand AS mode, 1 AS side, min(p_type) AS type, max(p_size)::VARCHAR AS size, min(p_name) AS name, CASE WHEN max(p_size) > 40 THEN floor(max(p_retailprice))::BIGINT::VARCHAR END AS price
        FROM part WHERE p_size < 25 AND p_partkey % 3 > 0 AND p_brand <> 'Brand#9' GROUP BY p_brand
        UNION ALL SELECT ' ' || upper(p_brand), 2, min(p_type), max(p_size)::VARCHAR, min(p_name), CASE WHEN max(p_size) > 40 THEN floor(max(p_retailprice))::BIGINT::VARCHAR END FROM part WHERE p_partkey % 4 = 0 AND p_brand <> 'Brand#7' GROUP BY p_brand),
    fields AS (
        SELECT lower(trim(mode)) AS key, side, mode, unnest(['name', 'price', 'size', 'type']) AS field, unnest([name, price, size, type]) AS value FROM told),
    zipped AS (
        SELECT key, field, max(value) FILTER (side = 1) AS a, max(value) FILTER (side = 2) AS b FROM fields GROUP BY key, field),
    modes AS (SELECT key, max(mode) FILTER (side = 1) AS old, max(mode) FILTER (side = 2) AS new FROM fields GROUP BY key)
    SELECT coalesce(new, old) AS mode, CASE WHEN old IS NULL THEN 'added' WHEN new IS NULL THEN 'removed' WHEN count(*) FILTER (a IS DISTINCT FROM b) > 0 THEN 'changed' ELSE 'same' END AS status,
           coalesce(list(CASE WHEN a IS NULL THEN field || ' added' WHEN b IS NULL THEN field || ' removed' ELSE field || ' changed' END ORDER BY field) FILTER (a IS DISTINCT FROM b AND old IS NOT NULL AND new IS NOT NULL), []) AS fields
    FROM zipped JOIN modes USING (key) GROUP BY key, old, new""",
}
