"""Chunking, its comparison, and as-of and range joins between chunks, sections and lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnsift.operators import chunking, line_chunks
from tarnsift.plans.sql import pairs
from tarnsift.session import table


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def t7_section_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_chunks.section_units(_documents(spark, sf_dir))


def t9_fixed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.fixed_chunks(_documents(spark, sf_dir))


def t10_structural_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.structural_chunks(_documents(spark, sf_dir))


def t12_markdown_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_chunks.markdown_chunks(_documents(spark, sf_dir))


def t13_code_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page sources stand for code, one tag a line."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.replace("html", F.lit("><"), F.lit(">\n\n<")).alias("html"))
    return line_chunks.code_chunks(pages, "html", "page_id")


def g1_chunk_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both chunkings, over all documents and by language: sizes, limits, cut ends and starts, sections met."""
    docs = _documents(spark, sf_dir).select("doc_id", "lang", F.col("text").alias("whole"))
    fixed = t9_fixed_chunks(spark, sf_dir).select("doc_id", "char_start", "char_end", "chars", "text", F.lit("fixed").alias("strategy"))
    both = fixed.unionByName(t10_structural_chunks(spark, sf_dir).select("doc_id", "char_start", "char_end", "chars", "text", F.lit("structural").alias("strategy")))
    rows = both.join(docs.select("doc_id", "lang"), "doc_id")
    ends = ~F.trim("text").rlike(r"[.!?…][\"'»”’)\]]*$")
    return rows.groupingSets([["strategy"], ["strategy", "lang"]], "strategy", "lang").agg(
        F.count("*").alias("n"), F.min("chars").alias("least"), F.median("chars").alias("mid"), F.max("chars").alias("most"), F.count_if(F.col("chars") > 1600).alias("over_limit"),
        F.count_if(ends).alias("cut_ends"), F.count_if(F.col("text").rlike(r"^\p{Ll}")).alias("cut_starts"), F.sum("chars").alias("volume"),
    )


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, start, size): places of lines by a running sum."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).select("doc_id", "line_no", F.length("line").alias("size"))
    before = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("start", F.coalesce(F.sum(F.col("size") + 1).over(before), F.lit(0)))


def j8_overlapping_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that each fixed chunk overlaps. Both sides are dealt to cells of a document's characters, so a long
    document's chunks meet the lines near them only; a pair counts in the first cell that both stand in."""
    cell = 1000
    cut = t9_fixed_chunks(spark, sf_dir).select("doc_id", "ordinal", "char_start", "char_end")
    lines = _lines(_documents(spark, sf_dir)).filter("size > 0")
    in_cells = lambda a, b: F.explode(F.sequence(F.floor(a / cell), F.floor(b / cell)))
    cut = cut.withColumn("cell", in_cells(F.col("char_start"), F.col("char_end") - 1))
    lines = lines.withColumn("cell", in_cells(F.col("start"), F.col("start") + F.col("size") - 1))
    met = cut.join(lines, ["doc_id", "cell"]).filter((F.col("start") < F.col("char_end")) & (F.col("start") + F.col("size") > F.col("char_start")))
    met = met.filter(F.col("cell") == F.floor(F.greatest("char_start", "start") / cell))
    return met.groupBy("doc_id", "ordinal").agg(F.count("*").alias("lines"), F.min("line_no").alias("first_line"))


def _as_of(left: DataFrame, right: DataFrame, key: str, at: str, start: str, value: str) -> DataFrame:
    """left with value of the last row of right whose start is at or before at, within key: one sort by place of both."""
    a = left.withColumn("_at", F.col(at)).withColumn("_value", F.lit(None).cast("string")).withColumn("_side", F.lit(1))
    b = right.select(key, F.col(start).alias("_at"), F.col(value).cast("string").alias("_value"), F.lit(0).alias("_side"))
    order = Window.partitionBy(key).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    rows = a.unionByName(b, allowMissingColumns=True)
    return rows.withColumn("_value", F.last("_value", ignorenulls=True).over(order)).filter("_side = 1").withColumnRenamed("_value", value).drop("_at", "_side")


def j10_section_at_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = t9_fixed_chunks(spark, sf_dir).select("doc_id", "ordinal", "char_start")
    return _as_of(cut, t7_section_units(spark, sf_dir), "doc_id", "char_start", "char_start", "name")


_MARKS = """
    WITH marks AS (SELECT l_orderkey AS doc, l_linenumber AS page, sum(CAST(floor(l_quantity) AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS place FROM lineitem),
         asked AS (SELECT o_orderkey AS doc, CAST(o_custkey % 120 AS BIGINT) AS place FROM orders)"""


def j11_page_at_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page whose mark is the last at or before an offset; lineitem's running quantity stands for the marks."""
    items = table(spark, sf_dir, "lineitem")
    running = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").rowsBetween(Window.unboundedPreceding, 0)
    marks = items.select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("page"), F.sum(F.floor("l_quantity")).over(running).alias("place"))
    asked = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"), (F.col("o_custkey") % 120).cast("long").alias("offset"))
    return _as_of(asked, marks, "doc", "offset", "place", "page").select("doc", "offset", F.col("page").cast("long").alias("page"))


QUERIES = {"T7_section_units": t7_section_units, "T9_fixed_chunks": t9_fixed_chunks, "T10_structural_chunks": t10_structural_chunks, "T12_markdown_chunks": t12_markdown_chunks,
           "T13_code_chunks": t13_code_chunks, "G1_chunk_comparison": g1_chunk_comparison, "J8_overlapping_lines": j8_overlapping_lines, "J10_section_at_start": j10_section_at_start,
           "J11_page_at_offset": j11_page_at_offset}
ORACLE_SQL: dict[str, str] = {
    "T7_section_units": rf"""
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents WHERE text <> ''),
    p AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM l),
    t AS (
        SELECT doc_id, n, place + length(regexp_extract(line, '^\s*')) AS b, place + length(regexp_replace(line, '\s+$', '')) AS e, regexp_replace(line, '^\s+|\s+$', '', 'g') AS said
        FROM p WHERE regexp_matches(line, '\S')),
    h AS (SELECT *, regexp_matches(said, '{line_chunks.HEADING}') AS head FROM t),
    u AS (
        SELECT *, sum((was IS NULL OR (head AND NOT was))::INT) OVER (PARTITION BY doc_id ORDER BY n) AS unit
        FROM (SELECT *, lag(head) OVER (PARTITION BY doc_id ORDER BY n) AS was FROM h)),
    g AS (
        SELECT doc_id, unit, min(b) AS s, max(e) AS e, bool_or(NOT head) AS body, coalesce(string_agg(regexp_replace(said, '^[# ]+', ''), ' · ' ORDER BY n) FILTER (head), '') AS name
        FROM u GROUP BY doc_id, unit)
    SELECT doc_id, unit::BIGINT AS ordinal, s::BIGINT AS char_start, until::BIGINT AS char_end, name FROM (
        SELECT *, CASE WHEN NOT lead(body) OVER w THEN lead(e) OVER w ELSE e END AS until FROM g WINDOW w AS (PARTITION BY doc_id ORDER BY unit)) WHERE body OR unit = 1""",
    "J11_page_at_offset": f"""{_MARKS}
    SELECT a.doc, a.place AS "offset", max_by(m.page, m.place)::BIGINT AS page FROM asked a LEFT JOIN marks m ON m.doc = a.doc AND m.place <= a.place GROUP BY a.doc, a.place""",
}

_more, _more_sql = pairs({
    "J5_heading_band": """
        SELECT p_partkey, p_size, max(CASE WHEN r.name IS NOT NULL THEN 1 ELSE 0 END) = 1 AS is_heading FROM part
        LEFT JOIN (VALUES ('ECONOMY', 11.0), ('PROMO', 24.0), ('STANDARD', 40.0)) r(name, size) ON r.name = p_type AND abs(p_size - r.size) <= 0.5 GROUP BY p_partkey, p_size""",
    "J9_span_containment": """
        SELECT o.o_orderkey, count(*) AS parts, count_if(within) AS inside FROM (
            SELECT o_orderkey, l_linenumber, l_shipdate >= o_orderdate AND l_shipdate + INTERVAL 5 DAY <= o_orderdate + INTERVAL 60 DAY AS within FROM orders JOIN lineitem ON l_orderkey = o_orderkey) o GROUP BY o.o_orderkey""",
    "J12_expected_source": """
        WITH hits AS (SELECT l_orderkey, l_suppkey AS section, l_linenumber AS page_from, l_linenumber + 1 AS page_to, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS place FROM lineitem),
             expected AS (SELECT l_orderkey, max(l_suppkey) AS section, 2 AS page FROM lineitem GROUP BY l_orderkey)
        SELECT e.l_orderkey, e.section, min(h.place) AS place FROM expected e
        LEFT JOIN hits h ON h.l_orderkey = e.l_orderkey AND h.section = e.section AND e.page BETWEEN h.page_from AND h.page_to GROUP BY e.l_orderkey, e.section""",
})
QUERIES |= _more
ORACLE_SQL |= _more_sql
