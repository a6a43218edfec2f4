"""Mixing sources to target weights, by weighted sampling without replacement (Efraimidis and Spirakis).

A document's size is its number of words. Sources get shares of a budget by weight; none gets more than MOST times its
size, and what a source cannot take is shared again by weight among the others until none is above. A document's key
is an exponential variate, from a hash of its id and text, over its quality weight: in the order of keys, documents of
twice the weight come first twice as likely. Within a source, sizes are summed in that order. A source is taken whole
as often as its target allows (complete epochs), and the rest of the target is filled by the documents
that come first by key; the one at the edge gives its first words only, so that each source's words are its target
rounded down.

Sums run over two digits of the key, so that no source is sorted in one task: keys are dealt into BUCKETS ranges, each
(source, range) is sorted by itself, and the sums of the ranges before it are added. Sources are ranked by ranges
as well, and shared again by sums over one row a source; only those sums reach the driver.

Defined cases: null or blank text has size 0 and nothing is taken of it; null source is the last one; a source without words has
target 0; equal rows are documents of their own with equal keys; null ids take part by their text. An empty table gives
an empty result. Other columns are ignored. Nothing depends on the order or the partitions of the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, releasing, small_side

#: Weights of the sources in code-point order, repeating; budget as a share of all words; most epochs of a source.
WEIGHTS, BUDGET, MOST = (5, 2, 1), 1.5, 2
BUCKETS = 1024
WORD = r"[^\x20\x09-\x0D]+"
SIGNS = r"[#*$%&|<>]"
LEAST_QUALITY = 0.1


def quality(text: Column) -> Column:
    """Weight from 0.1 to 1: few signs, few repeated lines."""
    lines = F.split(text, "\n")
    clean = 1.0 - F.least(F.lit(1.0), 10.0 * F.regexp_count(text, F.lit(SIGNS)) / F.greatest(F.lit(1), F.length(text)))
    return F.greatest(F.lit(LEAST_QUALITY), clean * (F.size(F.array_distinct(lines)) / F.size(lines)))


def keyed(docs: DataFrame, weight: Column | None = None) -> DataFrame:
    """doc_id, _s (source, null last), size, key, bucket of each document. weight: positive; by default quality()."""
    text = F.coalesce("text", F.lit(""))
    weight = quality(text) if weight is None else weight
    digits = F.conv(F.substring(F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text)), 1, 13), 16, 10).cast("long")
    uniform = (2 * digits + 1) / F.lit(float(1 << 53))
    rows = docs.select(
        "doc_id", F.coalesce(F.concat(F.lit("+"), "source"), F.lit("-")).alias("_s"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), (-F.log(uniform) / weight).alias("key"),
    )
    # k / (k + 1) spreads exponential keys of all weights over the ranges: none gets over six times its share
    return rows.withColumn("bucket", F.floor(F.col("key") / (F.col("key") + 1.0) * BUCKETS).cast("int"))


def _ranked(sources: DataFrame) -> DataFrame:
    """sources (_s, source_size) with their number in code-point order, from 0: ranges are numbered one by one, after
    the rows of the ranges before them."""
    spark = sources.sparkSession
    dealt = materialize(sources.repartitionByRange("_s").withColumn("part", F.spark_partition_id()), "mix-sources")
    before, starts = 0, []
    for part, n in sorted((r["part"], r["n"]) for r in dealt.groupBy("part").agg(F.count("*").alias("n")).collect()):  # one row a range
        starts.append((part, before))
        before += n
    offsets = spark.createDataFrame(starts, "part int, before long")
    within = F.row_number().over(Window.partitionBy("part").orderBy("_s")) - 1
    return dealt.withColumn("within", within).join(F.broadcast(offsets), "part").select("_s", "source_size", (F.col("before") + F.col("within")).alias("rank"))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, most: int = MOST) -> DataFrame:
    """sources (_s, source_size) with target: the least of most times its size and rate times its weight, where rate is
    what the budget leaves to the sources under their bound, by weight."""
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    known = materialize(_ranked(sources).select("_s", "source_size", weight.alias("weight")), "mix-ranked", keep=True)
    bound, rate = most * F.col("source_size"), 0.0
    while True:  # each round bounds further sources, until none is above; a round is one sum
        above = bound < rate * F.col("weight")
        row = known.agg(F.sum("source_size").alias("all"), F.sum(F.when(above, bound)).alias("bound"), F.sum(F.when(~above, F.col("weight"))).alias("open")).first()
        fresh = (budget * (row["all"] or 0) - (row["bound"] or 0)) / row["open"] if row["open"] else rate
        if fresh <= rate:
            return known.select("_s", "source_size", F.least(bound.cast("double"), F.lit(rate) * F.col("weight")).alias("target"))
        rate = fresh


def mix(docs: DataFrame, weight: Column | None = None, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, most: int = MOST) -> DataFrame:
    """doc_id, size, source_size, target, taken of each document."""
    with releasing(docs.sparkSession):
        rows = materialize(keyed(docs, weight), "mix-keys", keep=True)
        ranges = materialize(rows.groupBy("_s", "bucket").agg(F.sum("size").alias("words")), "mix-ranges", keep=True)
        known = materialize(targets(ranges.groupBy("_s").agg(F.sum("words").alias("source_size")), weights, budget, most), "mix-targets", keep=True)
    earlier = F.coalesce(F.sum("words").over(Window.partitionBy("_s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = ranges.select("_s", "bucket", earlier.alias("start"))  # at most BUCKETS rows a source
    here = Window.partitionBy("_s", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = rows.withColumn("before", F.sum("size").over(here) - F.col("size")).join(starts, ["_s", "bucket"]).join(small_side(known), "_s")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.floor(F.col("target")) - epochs * F.col("source_size") - F.col("start") - F.col("before")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return summed.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))
