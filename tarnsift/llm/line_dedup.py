"""Line dedup by a fixed-depth tree of line templates.

Words with a digit become <*> at once. A line goes down the tree by its number of words, then by its DEPTH leading
words; every level has a wildcard child, and a path takes at most one of them. A line goes to the first of its
paths (no wildcard, then the last, middle, first leading word wild) that at least MIN_LINES lines share. In that node
its remaining words form up to SEGMENTS segments of equal length (single words in lines of up to DEPTH + SEGMENTS
words). A segment that under MIN_LINES lines of the node have in this place is a variable field and becomes <*>.
What remains is the line's template. It stands for the line if at least MIN_KEPT of its words are fixed; lines under
GENERAL_WORDS words have only the template of their digits.

Templates met in enough documents are recurring: two for lines of LONG_WORDS words or LONG_CHARS characters, three for
lines of MIN_WORDS words or MIN_CHARS characters, SHORT_DOCS for shorter ones. They stay in the document with the least
doc_id and are dropped from every other one.

All counts are aggregations combined before rows move; lines are read from text once, and the last pass only picks
lines by their places.

Defined cases: null text stays null, empty text stays empty; lines of variable fields only or of white space are never
dropped; rows with equal doc_id and text are one document, so each keeps what the other keeps; a null doc_id comes
before all others; an empty table gives an empty result; very long texts are taken line by line. Other columns pass
through, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, SPACE_RE, materialize, releasing, row_key, small_side

DEPTH, SEGMENTS, MIN_LINES, GENERAL_WORDS, MIN_KEPT = 3, 8, 3, 8, 0.75
LONG_WORDS, LONG_CHARS, MIN_WORDS, MIN_CHARS, SHORT_DOCS = 50, 300, 4, 24, 6
FIELD = r"[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*"


def _masked(line: Column) -> Column:
    """The line without outer white space, its words with a digit as <*>."""
    inner = F.btrim(line, F.lit(SPACE))
    return F.when(inner.rlike("[0-9]"), F.regexp_replace(inner, FIELD, "<*>")).otherwise(inner)


def _lines(docs: DataFrame) -> DataFrame:
    """One row per line that takes part: document key, place, digit template, words, documents needed, tree paths
    and hashed segments."""
    rows = docs.select(*row_key(docs["doc_id"], docs["text"]), F.posexplode(F.split(docs["text"], "\n")).alias("place", "line"))
    rows = rows.select("_id", "_sum", "place", _masked(F.col("line")).alias("t")).filter(F.replace("t", F.lit("<*>"), F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.select("_id", "_sum", "place", "t", F.split("t", SPACE_RE).alias("w"), F.length("t").alias("chars")).withColumn("n", F.size("w"))
    long, usual = (F.col("n") >= LONG_WORDS) | (F.col("chars") >= LONG_CHARS), (F.col("n") >= MIN_WORDS) | (F.col("chars") >= MIN_CHARS)
    head = [F.get("w", k) for k in range(DEPTH)]
    paths = [F.xxhash64("n", *[F.lit(None).cast("string") if k == wild else h for k, h in enumerate(head)], F.lit(wild)) for wild in (-1, *reversed(range(DEPTH)))]
    step = F.ceil((F.col("n") - DEPTH) / SEGMENTS).cast("int")
    segments = F.transform(F.sequence(F.lit(0), F.floor((F.col("n") - DEPTH - 1) / step).cast("int")), lambda k: F.xxhash64(F.slice("w", DEPTH + 1 + k * step, step)))
    general = F.col("n") >= GENERAL_WORDS
    return rows.select(
        "_id", "_sum", "place", F.xxhash64("t").alias("leaf"), "n", F.when(long, 2).when(usual, 3).otherwise(SHORT_DOCS).alias("need"),
        F.when(general, F.array(*paths)).alias("paths"), F.when(general, segments).alias("segments"),
    )


def _recurring(lines: DataFrame, key: str, name: str) -> DataFrame:
    """(key, first): templates met in enough documents, and the first document of each. Lines are counted first, so
    only templates of enough lines in more than one document have their documents told apart."""
    doc = F.struct("_id", "_sum")
    met = lines.groupBy(key).agg(F.count("*").alias("lines"), F.min("need").alias("need"), F.min(doc).alias("first"), F.max(doc).alias("last"))
    met = materialize(met.filter((F.col("lines") >= F.col("need")) & (F.col("first") < F.col("last"))).select(key, "need", "first"), f"{name}-met")
    two = met.filter("need = 2").select(key, "first")
    more = lines.select(key, "_id", "_sum").join(small_side(met.filter("need > 2")), key)
    more = more.groupBy(key, "need", "first").agg(F.count_distinct("_id", "_sum").alias("docs")).filter(F.col("docs") >= F.col("need"))
    return materialize(two.union(more.select(key, "first")), name)


def _gone(lines: DataFrame, recurring: DataFrame, key: str) -> DataFrame:
    """(_id, _sum, place) of the lines to drop."""
    return lines.join(small_side(recurring), key).filter(F.struct("_id", "_sum") != F.col("first")).select("_id", "_sum", "place")


def _generalised(lines: DataFrame) -> DataFrame:
    """(_id, _sum, place, need, template) of lines whose template has variable fields in the tree."""
    able = lines.filter(F.col("paths").isNotNull())
    shared = able.select(F.explode("paths").alias("path")).groupBy("path").agg(F.count("*").alias("k")).filter(F.col("k") >= MIN_LINES)
    shared = small_side(materialize(shared.select("path"), "line-paths"))
    for k in range(DEPTH + 1):
        able = able.withColumn("path", F.get("paths", k)).join(shared.select("path", F.lit(True).alias(f"in{k}")), "path", "left").drop("path")
    node = reduce(lambda rest, k: F.when(F.col(f"in{k}"), F.get("paths", k)).otherwise(rest), reversed(range(DEPTH + 1)), F.lit(None).cast("long"))
    wild = F.when(F.col("in0"), 0).otherwise(1)
    routed = able.select("_id", "_sum", "place", "n", "need", node.alias("node"), wild.alias("wild"), "segments").filter(F.col("node").isNotNull())
    routed = materialize(routed, "line-nodes")
    cells = routed.select("_id", "_sum", "place", "n", "need", "node", "wild", F.posexplode("segments").alias("at", "segment"))
    fixed = cells.groupBy("node", "at", "segment").agg(F.count("*").alias("k")).filter(F.col("k") >= MIN_LINES).select("node", "at", "segment")
    fixed = small_side(materialize(fixed, "line-fixed"))
    kept = cells.join(fixed, ["node", "at", "segment"]).groupBy("_id", "_sum", "place", "n", "need", "node", "wild").agg(F.sort_array(F.collect_list(F.struct("at", "segment"))).alias("kept"))
    step = F.ceil((F.col("n") - DEPTH) / SEGMENTS)
    size = F.aggregate("kept", F.lit(0).cast("long"), lambda a, x: a + F.least(step, F.col("n") - DEPTH - x["at"] * step))
    kept = kept.filter(size + DEPTH - F.col("wild") >= MIN_KEPT * F.col("n"))
    return kept.select("_id", "_sum", "place", "need", F.xxhash64("node", "kept").alias("template"))


def _dropped(docs: DataFrame) -> DataFrame:
    """(_id, _sum, places): the places of the lines to drop from each document; bounded by its lines."""
    with releasing(docs.sparkSession):
        lines = materialize(_lines(docs), "lines")
        alike = materialize(_generalised(lines), "line-templates")
        gone = _gone(lines, _recurring(lines, "leaf", "line-leaves"), "leaf")
        gone = gone.union(_gone(alike, _recurring(alike, "template", "line-recurring"), "template"))
        return materialize(gone.groupBy("_id", "_sum").agg(F.collect_set("place").alias("places")), "lines-gone", keep=True)


def dedup_lines(docs: DataFrame, counts: bool = False) -> DataFrame:
    """All rows and columns of docs, text without its recurring lines. With counts, only doc_id, text, n_lines and
    n_dropped."""
    id_, sum_ = row_key(docs["doc_id"], docs["text"])
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")  # one column, so no name can clash
    gone = _dropped(docs)
    rows = docs.select(id_, sum_, row).join(gone.hint("merge"), ["_id", "_sum"], "left")  # one way at every size
    text, places = F.col("row.text"), F.col("places")
    rows = rows.withColumn("lines", F.when(text.isNotNull() & (places.isNotNull() | F.lit(counts)), F.split(text, "\n")))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), places)
    out = F.when(places.isNull(), text).otherwise(F.array_join(F.transform(left, lambda k: F.get("lines", k)), "\n"))
    if counts:
        n, k = F.when(text.isNull(), 0).otherwise(F.size("lines")), F.when(places.isNull(), 0).otherwise(F.size(places))
        return rows.select(F.col("row.doc_id").alias("doc_id"), out.alias("text"), n.cast("long").alias("n_lines"), k.cast("long").alias("n_dropped"))
    return rows.select(*[out.alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])
