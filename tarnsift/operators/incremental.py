"""Derived tables that are rebuilt for changed documents only.

A folder holds segments of rows, a manifest (a row for each document: stamp, hash, segment) and a list of rows that no
longer count (document, segment). A rebuild looks at the stamps first: only documents whose stamp is not the manifest's are
hashed, and only those whose hash differs are computed, into a new segment; all other rows stay where they
are, unread. The next version of the folder names segments, manifest and list together, so that readers see the build before or
after. A build with other parameters than the last one computes everything, and says which parameter it was.

Defined cases: rows without doc_id are left out; of several rows of one doc_id the one with the least hash counts; null
text is hashed as empty and computed like any other; a document that computes to no rows has a manifest row all the same.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnsift.sources import versions

#: Rows up to which the list of what no longer counts, or the changed documents, are broadcast once counted; segments
#: beyond which a rebuild writes one new segment of all rows.
BROADCAST_ROWS, MOST_SEGMENTS = 200_000, 16
MANIFEST = "doc_id long, stamp string, sha256 string, segment string"


def full_reason(state: dict, params: dict[str, str], full: bool = False) -> str | None:
    """Why all has to be computed: asked for, nothing there, or the first parameter that differs."""
    if full or not state:
        return "asked for" if full else "no build yet"
    return next((f"other {k}" for k, v in params.items() if state["params"].get(k) != v), None)


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    _, state = versions.current(spark, folder)
    return spark.read.schema(MANIFEST).parquet(f"{folder}/{state['manifest']}") if state else spark.createDataFrame([], MANIFEST)


def rows(spark: SparkSession, folder: str) -> DataFrame:
    """The derived rows that count, with doc_id."""
    _, state = versions.current(spark, folder)
    if not state:
        raise ValueError(f"{folder} holds no build")
    every = spark.read.parquet(*[f"{folder}/{s}" for s in state["segments"]])
    if state["dead"]:
        every = every.join(_small(spark.read.schema("doc_id long, _segment string").parquet(f"{folder}/{state['dead']}")), ["doc_id", "_segment"], "left_anti")
    return every.drop("_segment")


def rebuild(docs: DataFrame, folder: str, params: dict[str, str], compute: Callable[[DataFrame], DataFrame], stamp: Column | None = None, full: bool = False) -> dict:
    """Bring the build at folder up to docs (doc_id, text). compute: from (doc_id, text) to rows with doc_id. stamp: what
    changes whenever a text may have (size and time of a file); without it every text is hashed.

    Returns reason (of a full build), kept, recomputed, deleted and hashed documents, and the version."""
    spark = docs.sparkSession
    number, state = versions.current(spark, folder)
    reason = full_reason(state, params, full)
    old = manifest(spark, folder)
    known = old if reason is None else old.limit(0)
    tag = uuid.uuid4().hex
    place = lambda name: f"{folder}/{name}-{tag}"
    source = docs.filter("doc_id IS NOT NULL").select("doc_id", "text", (F.lit(None) if stamp is None else stamp).cast("string").alias("stamp"))
    source.select("doc_id", "stamp").distinct().write.parquet(place("stamps"))
    stamps = spark.read.parquet(place("stamps"))
    unsure = stamps.join(known.select("doc_id", "stamp"), ["doc_id", "stamp"], "left_anti")  # a null stamp is never known
    looked = source.join(_small(unsure), ["doc_id"], "left_semi").withColumn("sha256", F.sha2(F.coalesce("text", F.lit("")), 256))
    looked.groupBy("doc_id").agg(F.min(F.struct("sha256", "stamp")).alias("r")).select("doc_id", "r.*").write.parquet(place("hashes"))
    hashes = spark.read.parquet(place("hashes"))
    changed = hashes.join(known.select("doc_id", "sha256"), ["doc_id", "sha256"], "left_anti")
    segment = f"rows-{tag}"
    given = looked.join(_small(changed.select("doc_id", "sha256")), ["doc_id", "sha256"], "left_semi").dropDuplicates(["doc_id"])
    compute(given.select("doc_id", "text")).withColumn("_segment", F.lit(segment)).write.parquet(f"{folder}/{segment}")
    # kept: by stamp alone, or hashed and found equal (which takes the new stamp along)
    by_stamp = known.join(stamps, ["doc_id"], "left_semi").join(hashes.select("doc_id"), ["doc_id"], "left_anti")
    by_hash = hashes.join(known.select("doc_id", "sha256", "segment"), ["doc_id", "sha256"])
    fresh = changed.withColumn("segment", F.lit(segment))
    columns = ["doc_id", "stamp", "sha256", "segment"]
    by_stamp.select(columns).union(by_hash.select(columns)).union(fresh.select(columns)).write.parquet(place("manifest"))
    now = spark.read.schema(MANIFEST).parquet(place("manifest"))
    dead, segments = None, [segment]
    if reason is None:
        gone = old.select("doc_id", F.col("segment").alias("_segment")).join(now.select("doc_id", F.col("segment").alias("_segment")), ["doc_id", "_segment"], "left_anti")
        before = [spark.read.schema("doc_id long, _segment string").parquet(f"{folder}/{state['dead']}")] if state["dead"] else []
        (gone.union(before[0].select("doc_id", "_segment")) if before else gone).write.parquet(place("dead"))
        dead, segments = f"dead-{tag}", [*state["segments"], segment]
    count = lambda df: df.count()
    report = {
        "reason": reason, "kept": count(now.filter(F.col("segment") != segment)), "recomputed": count(changed), "hashed": count(hashes),
        "deleted": count(old.join(now, "doc_id", "left_anti")),
    }
    versions.commit(spark, folder, number, {"params": params, "segments": segments, "manifest": f"manifest-{tag}", "dead": dead, "report": report})
    versions.remove(spark, place("stamps"))
    versions.remove(spark, place("hashes"))
    if len(segments) > MOST_SEGMENTS:
        compact(spark, folder)
    return report | {"version": number + 1}


def compact(spark: SparkSession, folder: str) -> None:
    """Write the rows that count as one segment, and forget the list of the others."""
    number, state = versions.current(spark, folder)
    tag = uuid.uuid4().hex
    rows(spark, folder).withColumn("_segment", F.lit(f"rows-{tag}")).write.parquet(f"{folder}/rows-{tag}")
    manifest(spark, folder).withColumn("segment", F.lit(f"rows-{tag}")).write.parquet(f"{folder}/manifest-{tag}")
    versions.commit(spark, folder, number, state | {"segments": [f"rows-{tag}"], "manifest": f"manifest-{tag}", "dead": None})
