"""Snapshots of a site taken in as runs: all of a run or nothing, failed attempts recorded, none taken in twice.

A crawl leaves a listing, a table with one row for each article that a section lists, and announces it with a small file.
The stream of announcements is taken in batch by batch. A run's new texts, its articles and its changes since the last good run
are written to folders of its number, texts straight from the rows of the listing that hold them first; the version of that number, written last, makes them visible and is the
ledger: a batch that is replayed finds its announcement there and adds nothing, and what a run left behind that was
killed is overwritten by the next one, which has the same number.

Defined cases: a section that declares another number of articles than were read makes the attempt a failed one, with
the reason; so does a listing that cannot be read. An article listed twice counts where it comes first. A
section without articles has one row without article_id. Null text is an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnsift.sources import versions

LISTING = "section string, declared long, place long, article_id long, question string, text string"
ANNOUNCED = "source string, path string"
#: Sections that a reason names at most.
MOST_NAMED = 20
#: Rows that a mark of rows holds, a bit each; marks of 4 kB that are broadcast once counted.
BLOCK_ROWS, BROADCAST_MARKS = 32_768, 4_096
_AT = ("_metadata.file_path AS file", "_metadata.row_index AS row")
_RUN = "run long, source string, ok boolean, reason string, articles long, twice long"


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """run, source, ok, reason, articles, twice of every attempt."""
    known = versions.numbers(spark, folder)
    if not known:
        return spark.createDataFrame([], _RUN)
    return spark.read.schema(_RUN).json(f"{folder}/{versions.FOLDER}")


def _of_good_runs(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    if not versions.exists(spark, f"{folder}/{name}"):
        return spark.createDataFrame([], f"{schema}, run long")
    rows = spark.read.schema(f"{schema}, run long").parquet(f"{folder}/{name}")
    return rows.join(F.broadcast(runs(spark, folder).filter("ok").select("run")), "run", "left_semi")  # one row a run


def articles(spark: SparkSession, folder: str) -> DataFrame:
    return _of_good_runs(spark, folder, "articles", "article_id long, section string, question string, text_hash string, chars long")


def texts(spark: SparkSession, folder: str) -> DataFrame:
    return _of_good_runs(spark, folder, "texts", "text_hash string, text string")


def changes(spark: SparkSession, folder: str) -> DataFrame:
    return _of_good_runs(spark, folder, "changes", "article_id long, kind string")


def incomplete(listing: DataFrame) -> DataFrame:
    """section, declared, read of the sections of which not as much was read as they declare."""
    by = listing.groupBy("section").agg(F.max("declared").alias("declared"), F.count("article_id").alias("read"))
    return by.filter(~F.col("declared").eqNullSafe(F.col("read")))


def compared(before: DataFrame, after: DataFrame) -> DataFrame:
    """article_id, kind: new, deleted, changed (text or question) or moved (section)."""
    a, b = before.alias("a"), after.alias("b")
    same = lambda c: F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    kind: Column = (
        F.when(F.col("a.article_id").isNull(), "new").when(F.col("b.article_id").isNull(), "deleted")
        .when(~(same("text_hash") & same("question")), "changed").when(~same("section"), "moved")
    )
    both = a.join(b, F.col("a.article_id") == F.col("b.article_id"), "full_outer")
    return both.select(F.coalesce("a.article_id", "b.article_id").alias("article_id"), kind.alias("kind")).filter("kind IS NOT NULL")


def _marked(chosen: DataFrame) -> DataFrame:
    """file, block, rows: rows (file, row) of files as a bit each, in blocks of BLOCK_ROWS rows."""
    block, bit = F.floor(F.col("row") / BLOCK_ROWS), F.col("row") % BLOCK_ROWS
    return chosen.groupBy("file", block.alias("block")).agg(F.bitmap_construct_agg(bit).alias("rows"))


def _rows_at(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """The rows (with file, row) that are marked. Marks take a bit a row, so the rows need not move for them."""
    few = marks.limit(BROADCAST_MARKS + 1).count() <= BROADCAST_MARKS
    found = rows.withColumn("block", F.floor(F.col("row") / BLOCK_ROWS)).join(F.broadcast(marks) if few else marks, ["file", "block"])
    bit = F.col("row") % BLOCK_ROWS
    byte = F.conv(F.hex(F.substring("rows", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return found.filter(F.getbit(byte, (bit % 8).cast("int")) == 1)


def take_in(spark: SparkSession, folder: str, source: str, path: str) -> int | None:
    """Take in the listing at path as a run; its number, or None if source has been taken in before."""
    number, _ = versions.current(spark, folder)
    known = runs(spark, folder)
    if known.filter(F.col("source") == source).limit(1).count():
        return None
    row = {"run": number + 1, "source": source, "ok": False, "reason": None, "articles": 0, "twice": 0}
    try:
        listing = spark.read.schema(LISTING).parquet(path)
        lacking = incomplete(listing).orderBy("section").limit(MOST_NAMED).collect()
    except AnalysisException as error:
        return versions.commit(spark, folder, number, row | {"reason": f"listing not read: {error.getCondition()}"})
    if lacking:
        named = "; ".join(f"section {r['section']}: {r['declared']} declared, {r['read']} read" for r in lacking)
        return versions.commit(spark, folder, number, row | {"reason": named})
    heads = f"{folder}/heads/run={number + 1}"
    put = lambda rows, name: rows.write.mode("overwrite").parquet(f"{folder}/{name}/run={number + 1}")
    text = F.coalesce("text", F.lit(""))
    listed = listing.filter("article_id IS NOT NULL").select(
        "article_id", "place", "section", "question", F.sha2(text, 256).alias("text_hash"), F.length(text).cast("long").alias("chars"), *map(F.expr, _AT))
    put(listed, "heads")  # no text: what is sorted and shuffled below is narrow
    listed = spark.read.schema(listed.schema).parquet(heads)
    first = listed.groupBy("article_id").agg(F.min_by(F.struct("section", "question", "text_hash", "chars"), F.struct("place", "section")).alias("r"))
    put(first.select("article_id", "r.section", "r.question", "r.text_hash", "r.chars"), "articles")
    now = spark.read.parquet(f"{folder}/articles/run={number + 1}")
    fresh = listed.join(now.select("text_hash").distinct(), "text_hash", "left_semi").join(texts(spark, folder).select("text_hash"), "text_hash", "left_anti")
    chosen = fresh.groupBy("text_hash").agg(F.min(F.struct("file", "row")).alias("at")).select("at.file", "at.row")
    put(_marked(chosen), "marks")
    marks = spark.read.schema("file string, block long, rows binary").parquet(f"{folder}/marks/run={number + 1}")
    chosen_rows = _rows_at(listing.select(text.alias("text"), *map(F.expr, _AT)), marks)
    put(chosen_rows.select(F.sha2("text", 256).alias("text_hash"), "text"), "texts")
    last = known.filter("ok").agg(F.max("run").alias("run")).first()["run"]
    before = articles(spark, folder).filter(F.col("run") == last) if last is not None else now.limit(0)
    put(compared(before.select(now.columns), now) if last is not None else spark.createDataFrame([], "article_id long, kind string"), "changes")
    n, twice = now.count(), listed.count() - now.count()
    for name in ("heads", "marks"):
        versions.remove(spark, f"{folder}/{name}/run={number + 1}")
    return versions.commit(spark, folder, number, row | {"ok": True, "articles": n, "twice": twice})


def taking_in(folder: str) -> Callable[[DataFrame, int], None]:
    """What foreachBatch calls: the announcements of a batch, in order of their names."""

    def batch(announced: DataFrame, _: int) -> None:
        for r in announced.orderBy("source").collect():  # small files, as many as the trigger allows
            take_in(announced.sparkSession, folder, r["source"], r["path"])

    return batch


def announce(spark: SparkSession, folder: str, source: str, path: str) -> None:
    spark.createDataFrame([(source, path)], ANNOUNCED).coalesce(1).write.mode("append").json(folder)


def ingest(spark: SparkSession, announced: str, folder: str, files_at_once: int = 1):
    """Start the stream that takes in what is announced, as far as there is something; returns the query."""
    stream = spark.readStream.schema(ANNOUNCED).option("maxFilesPerTrigger", files_at_once).json(announced)
    return stream.writeStream.foreachBatch(taking_in(folder)).option("checkpointLocation", f"{folder}/_checkpoint").trigger(availableNow=True).start()

