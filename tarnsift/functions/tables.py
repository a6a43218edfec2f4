"""Table functions with parameters, to be called from SQL over views of files and tickets.

They are SQL functions, so that their bodies are planned with the query that calls them: parameters fold into filters, a
limit becomes a top-n, and columns that the caller leaves out are never read. json_fields is a Python table function, as its columns
depend on its argument.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import StringType, StructType

#: Most hits and letters of a line that a search in files shows; most lines and letters of a range.
HITS, CLIP, LINES, CHARS = 100, 200, 400, 8000

_GREP = """
    CREATE OR REPLACE TEMPORARY FUNCTION grep(pattern STRING, fixed BOOLEAN DEFAULT false, glob STRING DEFAULT '*', most INT DEFAULT {hits})
    RETURNS TABLE(path STRING, line_no INT, line STRING)
    RETURN SELECT path, line_no, substr(line, 1, {clip}) FROM (
        SELECT path, at + 1 AS line_no, line, row_number() OVER (ORDER BY path, at) AS n
        FROM {files} LATERAL VIEW posexplode(split(text, '\\n')) p AS at, line
        WHERE path RLIKE concat('^', replace(replace(replace(grep.glob, '.', '\\\\.'), '*', '.*'), '?', '.'), '$')
          AND CASE WHEN grep.fixed THEN contains(line, grep.pattern) ELSE line RLIKE grep.pattern END)
    WHERE n <= grep.most"""

_RANGE = """
    CREATE OR REPLACE TEMPORARY FUNCTION show_range(file STRING, first INT DEFAULT 1, last INT DEFAULT 2147483647, most_chars INT DEFAULT {chars})
    RETURNS TABLE(line_no INT, line STRING)
    RETURN SELECT line_no, line FROM (
        SELECT line_no, line, sum(length(line) + 1) OVER (ORDER BY line_no) AS used, row_number() OVER (ORDER BY line_no) AS n FROM (
            SELECT at + 1 AS line_no, line FROM {files} LATERAL VIEW posexplode(split(text, '\\n')) p AS at, line
            WHERE path = show_range.file AND at + 1 BETWEEN show_range.first AND show_range.last))
    WHERE used <= show_range.most_chars AND n <= {lines}"""

_FIND = """
    CREATE OR REPLACE TEMPORARY FUNCTION find_tickets(query STRING DEFAULT '', user BIGINT DEFAULT NULL, wanted STRING DEFAULT NULL, most INT DEFAULT 5)
    RETURNS TABLE(ticket BIGINT, user_id BIGINT, status STRING, score INT)
    RETURN SELECT ticket, user_id, status, score FROM (
        SELECT ticket, user_id, status, score, row_number() OVER (ORDER BY score DESC, created DESC, ticket DESC) AS n FROM (
            SELECT *, size(filter(asked, q -> exists(said, w -> startswith(w, q)))) AS score FROM (
                SELECT *, regexp_extract_all(lower(text), '[\\\\p{{L}}\\\\p{{N}}_]+', 0) AS said,
                       array_distinct(filter(regexp_extract_all(lower(find_tickets.query), '[\\\\p{{L}}\\\\p{{N}}_]+', 0), q -> length(q) >= 3)) AS asked FROM {tickets}
                WHERE (find_tickets.user IS NULL OR user_id = find_tickets.user) AND (find_tickets.wanted IS NULL OR status = find_tickets.wanted)))
        WHERE score > 0 OR size(asked) = 0)
    WHERE n <= find_tickets.most"""


@udtf
class JsonFields:
    """json_fields(text, 'a,b'): one row with a column for each name; a value that is no text as JSON; null where there is none."""

    @staticmethod
    def analyze(text: AnalyzeArgument, names: AnalyzeArgument) -> AnalyzeResult:
        if not names.isConstantExpression or not names.value:
            raise ValueError("json_fields takes the names of its columns as a constant, comma-separated")
        schema = StructType()
        for name in names.value.split(","):
            schema = schema.add(name.strip(), StringType())
        return AnalyzeResult(schema)

    def eval(self, text: str | None, names: str):
        try:
            found = json.loads(text or "{}")
        except ValueError:
            found = {}
        found = found if isinstance(found, dict) else {}
        values = [found.get(n.strip()) for n in names.split(",")]
        yield tuple(v if v is None or isinstance(v, str) else json.dumps(v) for v in values)


def register(spark: SparkSession, files: str = "files", tickets: str = "tickets") -> None:
    """Make grep and show_range over a view files (path, text), find_tickets over a view tickets (ticket, user_id, status, created, text), and
    json_fields callable. The views must be there."""
    names = {"files": files, "tickets": tickets, "hits": HITS, "clip": CLIP, "lines": LINES, "chars": CHARS}
    for function in (_GREP, _RANGE, _FIND):
        spark.sql(function.format(**names))
    register_python(spark)


def register_python(spark: SparkSession) -> None:
    spark.udtf.register("json_fields", JsonFields)
