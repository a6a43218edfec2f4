"""Tables on shared storage: published whole or not at all, appended to by content, merged by key, guarded by hash."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tarnsift.sources import versions

#: Buckets of a table that rows are merged into by key.
BUCKETS = 32


def publish(df: DataFrame, path: str, version: int = 1) -> None:
    """Write a table under a fresh name in the folder path, then let the folder's next version name it. Readers see the
    old table or the new one at any time; a failed write leaves the old one as it was. The table before the last stays
    for those who still read it, older ones are deleted."""
    spark = df.sparkSession
    number, before = versions.current(spark, path)
    name = f"data-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{name}")
    versions.commit(spark, path, number, {"data": name, "before": before.get("data"), "version": version})
    if before.get("before"):
        versions.remove(spark, f"{path}/{before['before']}")


def published(spark: SparkSession, path: str, schema: str, version: int = 1) -> DataFrame:
    """The table at path, if it has the version and the columns asked for."""
    number, now = versions.current(spark, path)
    if not number:
        raise ValueError(f"{path} holds no table")
    table = spark.read.parquet(f"{path}/{now['data']}")
    wanted = spark.createDataFrame([], schema).schema
    missing = [f.name for f in wanted if f.name not in table.columns or table.schema[f.name].dataType != f.dataType]
    if missing:
        raise ValueError(f"{path} lacks {missing}")
    if now["version"] != version:
        raise ValueError(f"{path} has version {now['version']}, not {version}")
    return table.select(wanted.names)


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def merge(rows: DataFrame, folder: str, key: str, gone: DataFrame | None = None, buckets: int = BUCKETS) -> list[int]:
    """rows replace all rows of the same key in the table at folder, and the keys of gone go. Only buckets that have
    such a key are written anew, beside the old ones; the next version of the folder names them. Returns those buckets.
    Rows with no key are left out. A folder keeps the number of buckets that it began with."""
    spark = rows.sparkSession
    number, before = versions.current(spark, folder)
    buckets = before.get("buckets", buckets)
    rows = rows.filter(F.col(key).isNotNull())
    keys = rows.select(key) if gone is None else rows.select(key).union(gone.select(key))
    touched = sorted(r["b"] for r in keys.select(_bucket(key, buckets).alias("b")).distinct().collect())  # no more than there are buckets
    held = {int(b): name for b, name in before.get("held", {}).items()}
    name = f"part-{uuid.uuid4().hex}"
    old = [f"{folder}/{held[b]}/bucket={b}" for b in touched if b in held]
    out = rows
    if old:
        out = spark.read.schema(rows.schema).parquet(*old).join(keys.distinct(), key, "left_anti").select(rows.columns).union(rows)
    out.withColumn("bucket", _bucket(key, buckets)).repartition("bucket").write.partitionBy("bucket").parquet(f"{folder}/{name}")
    for b in touched:
        held.pop(b, None)
        if versions.exists(spark, f"{folder}/{name}/bucket={b}"):
            held[b] = name
    schema = rows.schema.json()
    versions.commit(spark, folder, number, {"held": held, "buckets": buckets, "schema": schema})
    return touched


def merged(spark: SparkSession, folder: str) -> DataFrame:
    """The table that merge() keeps at folder."""
    number, now = versions.current(spark, folder)
    if not number:
        raise ValueError(f"{folder} holds no table")
    schema = StructType.fromJson(json.loads(now["schema"]))
    paths = [f"{folder}/{name}/bucket={b}" for b, name in now["held"].items()]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def save_sessions(messages: DataFrame, folder: str, emptied: DataFrame | None = None) -> None:
    """messages (conv_id, turn, role, text): the sessions named replace those of the same number, those of emptied are
    deleted, others stay."""
    merge(messages, folder, "conv_id", emptied)


def guarded(edits: DataFrame, current: DataFrame) -> DataFrame:
    """edits (doc_id, sha, text) beside current (doc_id, text): applied only where the file is still what it was."""
    now = current.select("doc_id", F.sha2("text", 256).alias("now"), F.col("text").alias("was"))
    rows = now.join(edits, "doc_id", "left")
    fits = F.col("sha") == F.col("now")
    return rows.select("doc_id", F.when(fits, F.col("text")).otherwise(F.col("was")).alias("text"), F.when(F.col("sha").isNull(), "unchanged").when(fits, "applied").otherwise("refused").alias("fate"))


def migrate(spark: SparkSession, path: str, to: int, steps: dict[int, Callable[[DataFrame], DataFrame]]) -> int:
    """Bring the table published at path up to version to, by the step of each version on the way; it is published anew once, and readers
    see the old table until then. Returns the version that it had."""
    number, now = versions.current(spark, path)
    if not number:
        raise ValueError(f"{path} holds no table")
    table, had = spark.read.parquet(f"{path}/{now['data']}"), now["version"]
    if had > to:
        raise ValueError(f"{path} has version {had}, above {to}")
    for version in range(had, to):
        table = steps[version](table)
    if had < to:
        publish(table, path, to)
    return had


def slug(name: str | Column, longest: int = 40) -> Column:
    """A safe name: small letters, digits and single dashes; note if nothing is left."""
    bare = F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-")
    return F.coalesce(F.nullif(F.btrim(F.substring(F.btrim(bare, F.lit("-")), 1, longest), F.lit("-")), F.lit("")), F.lit("note"))


def save_notes(notes: DataFrame, folder: str) -> DataFrame:
    """notes (note_id, day, title, text) saved under names that are not taken: day-title.md, then -2, -3 and so on, in the order of note_id; none is
    ever overwritten. Returns note_id, name, saved: whether what is read back is, by its digest, what was to be saved."""
    spark = notes.sparkSession
    base = F.concat_ws("-", F.col("day").cast("string"), slug("title"))
    rows = notes.select("note_id", base.alias("base"), F.coalesce("text", F.lit("")).alias("text"))
    number, _ = versions.current(spark, folder)
    taken = merged(spark, folder).groupBy("base").agg(F.max("n").alias("before")) if number else spark.createDataFrame([], "base string, before int")
    nth = F.row_number().over(Window.partitionBy("base").orderBy("note_id"))
    named = rows.withColumn("nth", nth).join(taken, "base", "left").withColumn("n", F.col("nth") + F.coalesce("before", F.lit(0)))
    name = F.concat("base", F.when(F.col("n") > 1, F.concat(F.lit("-"), "n")).otherwise(""), F.lit(".md"))
    fresh = named.select(name.alias("name"), "base", "n", "text", "note_id", F.sha2("text", 256).alias("sha256"))
    held = f"{folder}/_fresh-{uuid.uuid4().hex}"
    fresh.write.parquet(held)
    fresh = spark.read.schema(fresh.schema).parquet(held)
    merge(fresh.select("name", "base", "n", "text"), folder, "name")
    back = merged(spark, folder).select("name", F.sha2("text", 256).alias("now"))
    return fresh.join(back, "name", "left").select("note_id", "name", F.coalesce(F.col("now") == F.col("sha256"), F.lit(False)).alias("saved"))


def stacked(table: DataFrame, by: str, id_: str, vector: str, most: int = 1024) -> DataFrame:
    """Vectors of a table stacked into blocks of about most rows of one group: by, block, ids, size (of a vector), values (all in a row, in the order of ids)."""
    blocks = F.pmod(F.xxhash64(id_), F.lit(max(1, -(-table.count() // most))))
    rows = table.filter(F.col(vector).isNotNull()).select(by, blocks.alias("block"), F.col(id_).alias("id"), F.col(vector).alias("v"), F.size(vector).alias("size"))
    packed = rows.groupBy(by, "block", "size").agg(F.array_sort(F.collect_list(F.struct("id", "v"))).alias("rows"))
    return packed.select(by, "block", F.transform("rows", lambda r: r["id"]).alias("ids"), "size", F.flatten(F.transform("rows", lambda r: r["v"])).alias("values"))
