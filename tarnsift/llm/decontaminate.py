"""Benchmark decontamination by spaced seeds.

Texts become arrays of word hashes. Fixed masks pick some of the words of every window and ignore the
others, so a window still matches where an ignored word was replaced. An item's masks follow from its length, so
that every way of replacing words that leaves MIN_SHARE of the item in place leaves a seed. Hashes of the picked words join test
items and documents; each hit names a diagonal (place in the document less place in the item), and on the
hit diagonals the whole item is laid over the document. A neighbourhood is all diagonals that lie less than two
item lengths apart; in it each word of the item and each word of the document counts once, and an item's
match is that of its best neighbourhood.

Defined cases: null texts are empty and match nothing; items of one word and two words only match whole; case and trailing punctuation of words are ignored; a document row repeated is reported for each row, an
item repeated once; of neighbourhoods that match alike it does not matter which counts; an empty benchmark or an empty
table of documents gives no overlaps; of a very long text, only the stretches under its hits move on;
columns besides doc_id and text (item_id and text) are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialize, releasing, row_key, small_side, words

#: 1: the word counts, 0: it may differ. All start and end with 1. Without a seed of the first three, no four
#: words in a row hold three equal ones, so 2 * (n // 4) + min(2, n % 4) of n words are equal at most: under MIN_SHARE
#: but for 5, 6 and 10 words, where the next three make up for it (any three equal words of five). The rest
#: are of items of up to three words.
MASKS = ("111", "1101", "1011", "11001", "10101", "10011", "101", "11", "1")
#: A document holds an item if so large a share of the item's words, or so many of them, stand in place.
MIN_SHARE, MIN_MATCHED = 0.6, 30


def _hashes(text: Column) -> Column:
    return F.transform(words(F.lower(text)), lambda w: F.xxhash64(F.rtrim(w, F.lit(".,;:!?"))))


def masks_of(n_item: int) -> tuple[int, ...]:
    """Numbers of the masks that an item of so many words is searched by."""
    if n_item < 4:
        return {0: (), 1: (8,), 2: (7,), 3: (6, 7)}[n_item]
    return tuple(range(6 if n_item in (5, 6, 10) else 3))


def _seeds(tokens: Column, mask: str, number: int) -> Column:
    picked = [k for k, bit in enumerate(mask) if bit == "1"]
    seeds = F.transform(
        F.sequence(F.lit(0), F.size(tokens) - len(mask)),
        lambda i: F.xxhash64(F.lit(number), *[F.get(tokens, i + k) for k in picked]),
    )
    return F.when(F.size(tokens) >= len(mask), seeds).otherwise(F.array().cast("array<bigint>"))


def _seed_rows(rows: DataFrame, numbers: list[int], *keep: str) -> DataFrame:
    """One row (keep.., place, number, seed) per window and mask of column tokens."""
    parts = rows.select(*keep, let(F.col("tokens"), lambda t: F.struct(*[_seeds(t, MASKS[k], k).alias(f"s{k}") for k in numbers])).alias("s"))
    parts = parts.select(*keep, *[F.col(f"s.s{k}").alias(f"s{k}") for k in numbers])
    sizes = [F.size(f"s{k}").alias(f"n{k}") for k in numbers]
    flat = parts.select(*keep, *sizes, F.concat(*[f"s{k}" for k in numbers]).alias("all"))
    flat = flat.select(*keep, *[f"n{k}" for k in numbers], F.posexplode("all").alias("at", "seed"))
    place, number, before = F.col("at"), F.lit(numbers[0]), F.lit(0)
    for last, k in zip(numbers, numbers[1:]):
        before = before + F.col(f"n{last}")
        place = F.when(F.col("at") >= before, F.col("at") - before).otherwise(place)
        number = F.when(F.col("at") >= before, F.lit(k)).otherwise(number)
    return flat.select(*keep, place.alias("place"), number.alias("number"), "seed")


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows (_id, _sum, doc_id, item_id, n_matched, n_item): documents that hold a benchmark item."""
    items = materialize(
        benchmark.select("item_id", _hashes(F.col("text")).alias("tokens")).filter(F.size("tokens") > 0)
        .withColumns({"item": F.xxhash64("item_id", "tokens"), "n_item": F.size("tokens")}).distinct(), "items")
    # documents are searched by the masks that some item needs: short lengths add theirs, all others share three
    short = {r["n_item"] for r in items.filter(F.col("n_item") <= 10).select("n_item").distinct().collect()}
    lengths = sorted(short | {11})
    numbers = sorted({k for n in lengths for k in masks_of(n)})
    own = reduce(lambda a, b: a | b, [F.col("number").isin(*masks_of(n)) & ((F.col("n_item") > 10) if n == 11 else (F.col("n_item") == n)) for n in lengths])
    of_items = _seed_rows(items, numbers, "item", "n_item").filter(own)
    seeds = materialize(of_items.select("item", "n_item", F.col("place").alias("item_place"), "seed").distinct(), "seeds")
    keyed = docs.select(*row_key(docs["doc_id"], docs["text"]), "doc_id", "text")
    rows = _seed_rows(keyed.select("_id", "_sum", _hashes(F.col("text")).alias("tokens")), numbers, "_id", "_sum")
    hits = rows.join(small_side(seeds), "seed").select("_id", "_sum", "item", "n_item", (F.col("place") - F.col("item_place")).alias("shift"))
    # the hits of one document are bounded by its length for each item
    by_doc = materialize(hits.groupBy("_id", "_sum").agg(F.collect_set(F.struct("item", "n_item", "shift")).alias("hits")), "hits")
    found = keyed.join(small_side(by_doc), ["_id", "_sum"]).select("_id", "_sum", "doc_id", _hashes(F.col("text")).alias("d"), "hits")
    # only the words under the item move on; in place of the item's words before the document there are none
    under = F.transform("hits", lambda h: F.struct(h["item"].alias("item"), h["shift"].alias("shift"), F.slice("d", F.greatest(h["shift"] + 1, F.lit(1)), h["n_item"]).alias("d")))
    found = found.select("_id", "_sum", "doc_id", F.explode(under).alias("hit")).select("_id", "_sum", "doc_id", "hit.*")
    laid = found.join(small_side(items), "item")
    skip = F.greatest(-F.col("shift"), F.lit(0))
    both = F.arrays_zip(F.slice("tokens", skip + 1, F.size("tokens")).alias("t"), F.slice("d", F.lit(1), F.size("tokens")).alias("d"))
    at = F.filter(F.transform(both, lambda x, i: F.when(x["t"] == x["d"], skip + i)), lambda i: i.isNotNull())
    laid = laid.select("_id", "_sum", "doc_id", "item_id", "item", "n_item", "shift", F.explode(at).alias("at"))
    cell = F.floor(F.col("shift") / F.col("n_item"))
    laid = laid.withColumn("cell", F.explode(F.array(cell - 1, cell)))
    # at most n_item places of the item and three times as many of the document in a neighbourhood
    of_item, of_doc = F.size(F.collect_set("at")), F.size(F.collect_set(F.col("at") + F.col("shift")))
    near = laid.groupBy("_id", "_sum", "doc_id", "item_id", "item", "n_item", "cell").agg(F.least(of_item, of_doc).alias("n"))
    total = near.groupBy("_id", "_sum", "doc_id", "item_id", "item", "n_item").agg(F.max("n").cast("long").alias("n_matched"))
    return total.filter((F.col("n_matched") >= MIN_SHARE * F.col("n_item")) | (F.col("n_matched") >= MIN_MATCHED)).drop("item")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Pairs of a document and a benchmark item that it holds, with the number of words in place."""
    return overlaps(docs, benchmark).select("doc_id", "item_id", "n_matched", F.col("n_item").cast("long").alias("n_item"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns untouched, that hold no benchmark item."""
    with releasing(docs.sparkSession):
        gone = materialize(overlaps(docs, benchmark).select("_id", "_sum").distinct(), "contaminated", keep=True)
    gone = small_side(gone)
    id_, sum_ = row_key(docs["doc_id"], docs["text"])
    return docs.join(gone, (id_ == gone["_id"]) & (sum_ == gone["_sum"]), "left_anti")
