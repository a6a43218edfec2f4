"""Pages read as trees, text, tables and fields; paging through folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnsift.operators.html import REFERENCES, pages_read
from tarnsift.plans.sql import pairs
from tarnsift.session import table


def _read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages_read(table(spark, sf_dir, "pages"))


def t14_page_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir).select("page_id", "title", "nodes", "problem")


def t15_body_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir).select("page_id", "body")


def t16_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir).select("page_id", F.posexplode("links").alias("n", "link")).select("page_id", "n", "link.*")


def _relaid(spark: SparkSession, sf_dir: str, outer: str, item: str) -> DataFrame:
    """The pages with their lists of links laid out anew: they have neither tables nor lists of terms."""
    html = F.regexp_replace(F.regexp_replace("html", "<(/?)ul>", f"<$1{outer}>"), r'<li><a href="([^"]*)">([^<]*)</a></li>', item)
    return pages_read(table(spark, sf_dir, "pages").select("page_id", html.alias("html")))


def t18_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _relaid(spark, sf_dir, "table", "<tr class=x><th>$1<td><b>$2</b><td></tr>")
    return rows.select("page_id", F.posexplode("cells").alias("row", "cells"))


def t19_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _relaid(spark, sf_dir, "dl", "<dt>$1</dt><dd>$2<dd>again").select("page_id", F.posexplode("fields").alias("n", "f")).select("page_id", "n", "f.*")


def f6_cells_containing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table rows in which any cell holds a piece of text, whatever its case."""
    return t18_tables(spark, sf_dir).filter(F.exists("cells", lambda c: F.contains(F.lower(c), F.lit("an"))))


def s11_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of a listing by host and language, the count that the site declares (its navigation) and what was read."""
    rows = _read(spark, sf_dir).join(table(spark, sf_dir, "pages").select("page_id", "url"), "page_id")
    section = F.regexp_extract("url", r"://[^/]+/([a-z]+)/", 1)
    declared = F.size(F.filter("links", lambda x: x["href"].startswith("/")))
    return rows.groupBy(section.alias("section")).agg(F.count("*").alias("pages"), F.sum(declared).alias("declared"), F.sum(F.size("links")).alias("read"), F.count_if(F.col("problem").isNotNull()).alias("missing"))


QUERIES = {"T14_page_tree": t14_page_tree, "T15_body_text": t15_body_text, "T16_selected": t16_selected, "T18_tables": t18_tables, "T19_fields": t19_fields, "S11_categories": s11_categories,
           "F6_cells_containing": f6_cells_containing}
_DECODED = "{}"
for _name, _sign in sorted(REFERENCES.items(), key=lambda x: x[0] == "amp"):  # & comes last
    _DECODED = f"replace({_DECODED}, '&{_name};', {'chr(39)' if _name == 'apos' else repr(_sign)})"
_BARE = r"regexp_replace(regexp_replace(html, '<!--(?s:.*?)-->', '', 'g'), '(?is)(<(?:script|style)[^>]*>).*?(</(?:script|style)>)', '\1\2', 'g')"
_BODY = rf"regexp_replace(regexp_extract({_BARE}, '(?is)<body[^>]*>(.*?)(?:</body>|$)', 1), '\s+', ' ', 'g')"
_LINES = rf"""regexp_replace(regexp_replace(regexp_replace(regexp_replace({_BODY}, '<li[^>]*>', chr(10) || '- ', 'g'), '<img[^>]*>', '[image]', 'g'),
              '</?(?:p|div|section|article|header|footer|nav|ul|ol|table|tr|h[1-6]|blockquote|pre|dl|dt|dd|br|hr|li)(?:\s[^>]*)?/?>', chr(10), 'g'), '</?[A-Za-z!][^>]*>', '', 'g')"""
_LINKS = """SELECT page_id, unnest(found) AS a, generate_subscripts(found, 1) - 1 AS n FROM (SELECT page_id, regexp_extract_all(html, '<li><a href="[^"]*">[^<]*</a></li>') AS found FROM pages)"""
_HREF, _LABEL = _DECODED.format("""regexp_extract(a, 'href="([^"]*)"', 1)"""), _DECODED.format("regexp_extract(a, '>([^<]*)</a>', 1)")
_CELLS = f"SELECT page_id, n::INTEGER AS row, [CASE WHEN x = '' THEN '—' ELSE x END for x in [trim({_HREF}), trim({_LABEL}), '']] AS cells FROM ({_LINKS})"
ORACLE_SQL = {
    "T14_page_tree": rf"""
    SELECT page_id, trim({_DECODED.format("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1)")}) AS title, len(regexp_extract_all({_BARE}, '<[A-Za-z]'))::BIGINT AS nodes, NULL AS problem FROM pages""",
    "T15_body_text": rf"""
    SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace({_DECODED.format(_LINES)}, ' +', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10)) AS body FROM pages""",
    "T16_selected": r"""
    SELECT page_id, n - 1 AS n, regexp_extract(a, '<a href="([^"]+)"', 1) AS href, regexp_extract(a, '>([^<]*)</a>', 1) AS label FROM (
        SELECT page_id, unnest(found) AS a, generate_subscripts(found, 1) AS n FROM (SELECT page_id, regexp_extract_all(html, '<a href="[^"]+">[^<]*</a>') AS found FROM pages))""",
    "T18_tables": _CELLS,
    "F6_cells_containing": f"SELECT * FROM ({_CELLS}) WHERE len([c for c in cells if contains(lower(c), 'an')]) > 0",
    "T19_fields": f"""
    SELECT page_id, (2 * n + k)::INTEGER AS n, trim({_HREF}) AS name, CASE WHEN k = 0 THEN trim({_LABEL}) ELSE 'again' END AS value FROM ({_LINKS}), (VALUES (0), (1)) AS v(k)""",
    "S11_categories": r"""
    SELECT section, count(*) AS pages, sum(len([a for a in found if starts_with(a, '<a href="/')]))::BIGINT AS declared, sum(len(found))::BIGINT AS read, 0::BIGINT AS missing FROM (
        SELECT regexp_extract(url, '://[^/]+/([a-z]+)/', 1) AS section, regexp_extract_all(html, '<a href="[^"]+">[^<]*</a>') AS found FROM pages) GROUP BY section""",
}
_more, _more_sql = pairs({
    "S10_paging": """
        WITH RECURSIVE links AS (SELECT page_id, CASE WHEN page_id % 25 = 24 OR page_id = (SELECT max(page_id) FROM pages) THEN page_id - page_id % 25 ELSE page_id + 1 END AS next FROM pages),
        walk(folder, page_id, n) AS (
            SELECT page_id, page_id, 1 FROM links WHERE page_id % 25 = 0
            UNION ALL SELECT w.folder, l.next, w.n + 1 FROM walk w JOIN links l ON l.page_id = w.page_id WHERE w.n < 20 AND l.next <> w.folder)
        SELECT folder, page_id, n FROM walk""",
})
QUERIES |= _more
ORACLE_SQL |= _more_sql
