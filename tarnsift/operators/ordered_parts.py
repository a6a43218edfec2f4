"""Which texts hold all parts of a needle in order: many needles against many texts, joined on the hashes of first words.

A part is anchored at its first ANCHOR words (fewer, if it has fewer). Texts are read once: each place's windows of the anchor lengths
that needles have are hashed and joined with the anchors; hits are verified word by word. Then a fold over the places of each
(text, needle) takes every part at its first place behind the one before.

Defined cases: a part without words stands anywhere; a needle without parts, or with blank ones only, is in no text; null texts hold nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of an anchor; rows of parts that are broadcast once counted.
ANCHOR, BROADCAST_ROWS = 4, 200_000
WORD = r"[\p{L}\p{N}]+|#"


def words(text: Column) -> Column:
    """Lower-case words, ё as е."""
    return F.regexp_extract_all(F.translate(F.lower(F.coalesce(text, F.lit(""))), "ё", "е"), F.lit(WORD), F.lit(0))


def found_in_order(texts: DataFrame, parts: DataFrame) -> DataFrame:
    """texts (doc_id, text), parts (item_id, part from 1, text): doc_id, item_id, first and last place (words from 0, last exclusive) of the
    earliest way in which the text holds all parts of the item in order."""
    told = parts.select("item_id", "part", words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    told = told.select("item_id", "part", "w", F.size("w").alias("size"), F.least(F.lit(ANCHOR), F.size("w")).alias("reach"))
    counts = told.groupBy("item_id").agg(F.count("*").alias("parts"))
    reaches = sorted(r["reach"] for r in told.select("reach").distinct().collect())  # one to ANCHOR
    anchors = told.withColumn("hash", F.xxhash64(F.col("reach").cast("int"), F.array_join(F.slice("w", F.lit(1), F.col("reach")), " "))).join(counts, "item_id")
    if anchors.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        anchors = F.broadcast(anchors)
    base = texts.select("doc_id", words(F.col("text")).alias("tw"))

    def windows(n: int) -> Column:
        """Place and hash of each n words in a row."""
        at = lambda i: F.struct(i.alias("at"), F.xxhash64(F.lit(n), F.concat_ws(" ", *[F.get("tw", i + k) for k in range(n)])).alias("hash"))
        return F.transform(F.slice("tw", F.lit(1), F.greatest(F.size("tw") - (n - 1), F.lit(0))), lambda _, i: at(i))

    places = F.concat(F.array().cast("array<struct<at:int,hash:bigint>>"), *map(windows, reaches))
    # outer: else the optimizer puts a filter below that works out all windows a second time
    hits = base.select("doc_id", F.explode_outer(places).alias("p")).filter("p IS NOT NULL").select("doc_id", "p.at", "p.hash").join(anchors, "hash").select("doc_id", "item_id", "part", "at", "size", "parts", "w")
    if hits.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        hits = F.broadcast(hits)
    same = F.slice("b.tw", F.col("h.at") + 1, F.col("h.size")) == F.col("h.w")
    sure = base.alias("b").join(hits.alias("h"), (F.col("b.doc_id") == F.col("h.doc_id")) & same).select("b.doc_id", "item_id", "part", "at", "size", "parts")
    by = sure.groupBy("doc_id", "item_id").agg(F.first("parts").alias("parts"), F.count_distinct("part").alias("met"), F.array_sort(F.collect_set(F.struct("part", "at", "size"))).alias("hits")).filter("met = parts")
    start = F.struct(F.lit(None).cast("int").alias("first"), F.lit(0).alias("behind"), F.lit(0).alias("part"), F.lit(0).alias("done"))

    def step(s: Column, x: Column) -> Column:
        # hits come by part, then place: the first one behind what is taken decides its part
        return F.when((x["part"] > s["part"]) & (x["at"] >= s["behind"]), F.struct(F.coalesce(s["first"], x["at"]).alias("first"), (x["at"] + x["size"]).alias("behind"), x["part"].alias("part"), (s["done"] + 1).alias("done"))).otherwise(s)

    chain = by.select("doc_id", "item_id", "parts", F.aggregate("hits", start, step).alias("s"))
    return chain.filter(F.col("s.done") == F.col("parts")).select("doc_id", "item_id", F.col("s.first").alias("first"), F.col("s.behind").alias("last"))
