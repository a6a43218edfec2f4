"""What the training-data operators share: table reading, written intermediate tables, words."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = " \t\n\x0b\x0c\r"
SPACE_RE = r"[\x20\x09-\x0D]+"
#: Used only where the session has no spark.checkpoint.dir, as in tests.
DEFAULT_SCRATCH = "file:///tmp/checkpoints/tarnsift"
#: Rows up to which a side of a join is broadcast, after it has been counted; beyond it the join shuffles.
BROADCAST_ROWS = 400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster for intermediate tables. Only a local session may do without."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return path or DEFAULT_SCRATCH


_SCOPES: list[list[str]] = []


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


@contextmanager
def releasing(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables written inside are deleted at the end, but for those written to be kept, which belong to
    the scope around. What leaves the scope must not read the others."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            files, at = _file_system(spark, path)
            files.delete(at, True)


def materialize(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write a table into the shared folder and read it back: it cuts lineage and outlives executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    files, at = _file_system(spark, path)
    files.deleteOnExit(at)
    if len(_SCOPES) > keep:
        _SCOPES[-1 - keep].append(path)
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a written table if it has been counted to be small; else leave the join to shuffle."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def sampled(docs: DataFrame, rows: int) -> DataFrame:
    """About rows rows of docs, chosen by the hash of doc_id before anything moves; all rows of a smaller table.
    Rows of one doc_id come together, so what needs a bound sets a limit on top."""
    share = min(1.0, rows / max(1, docs.count()))
    return docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate value once per row and give it to body by name."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words of a text, split at ASCII white space; null or blank: empty array."""
    trimmed = F.btrim(text, F.lit(SPACE))
    return F.when(text.isNull() | (trimmed == ""), F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RE))


def row_key(*columns: Column) -> list[Column]:
    """Two columns _id, _sum that tell rows apart, nulls included; equal rows share them."""
    first = F.coalesce(columns[0].cast("long"), F.lit(-(2**63)))
    # hashes pass over nulls, so each column comes with a mark of whether it is one
    return [first.alias("_id"), F.xxhash64(*[x for c in columns for x in (c.isNull(), c)]).alias("_sum")]
