"""How filters share the work of removing documents: every order of them, and their Shapley values.

One pass over the texts gives each document the set of filters that it fails, as bits; copies are found by the hash of
the text. Counts of these sets by part are all that the audit needs. For a part, the number of documents that a
set of filters removes is a multilinear polynomial R in one variable a filter: the coefficient of a product over a set T
is (-1)^(|T|+1) times the documents that fail at least T. At a corner (variables 0 or 1) R says what that set of filters
removes, hence what survives after each step of an order. The Shapley value of a filter is the integral over t
of its partial derivative on the diagonal, where a product over T contributes the coefficient over |T|; it is kept as
an exact fraction, and 120 times it is the filter's removals summed over all orders.

Defined cases: null text is an empty one, null lang the part with an empty name; no words: under 200 words, and not
short of distinct ones. Equal rows count as often as they stand there; a document is a copy if a smaller doc_id has its text,
so rows that share an id are no copies of one another, and a row without id is neither copy nor original. A document
with several labels is good or toxic if one of them says so. No documents: no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations
from math import factorial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, releasing, words

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITAL_PERCENT, SIGNS = 200, 50, 3, r"[#$%&*|]"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part, hash of the text, and the bits of the filters A to D that a document fails."""
    text = F.coalesce("text", F.lit(""))
    base = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"), words(text).alias("w"))
    fails = (
        F.size("w") < MIN_WORDS,
        100 * F.size(F.array_distinct("w")) < MIN_DISTINCT_PERCENT * F.size("w"),
        100 * F.regexp_count("text", F.lit("[A-Z]")) > MAX_CAPITAL_PERCENT * F.length("text"),
        F.col("text").rlike(SIGNS),
    )
    mask = sum(F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails))
    return base.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("hash"), mask.cast("int").alias("mask"))


def set_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents by the whole set of filters that they fail. A group of copies is met
    by its hash only in sums and minima; rows are joined on hash and id together, which no group of copies makes hot."""
    with releasing(docs.sparkSession):
        rows = materialize(failures(docs), "audit-rows")
        first = rows.groupBy("hash").agg(F.min("doc_id").alias("doc_id")).filter(F.col("doc_id").isNotNull()).withColumn("first", F.lit(True))
        marks = labels.filter((F.col("quality") == 1) | (F.col("toxic") == 1)).groupBy("doc_id").agg(
            F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("good"), F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("toxic"))
        copy = F.when(F.col("doc_id").isNotNull() & F.col("first").isNull(), 1 << FILTERS.index("E")).otherwise(0)
        marked = rows.join(first, ["hash", "doc_id"], "left").withColumn("mask", F.col("mask") + copy).join(marks, "doc_id", "left")
        counts = marked.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"))
        return materialize(counts, "audit-counts", keep=True)


class Removal:
    """The polynomial of what sets of filters remove, from {set of failed filters: documents}."""

    def __init__(self, counts: dict[int, int], filters: int) -> None:
        self.n = filters
        at_least = {t: sum(c for m, c in counts.items() if m & t == t) for t in range(1, 1 << filters)}
        self.coefficients = {t: (-1) ** (t.bit_count() + 1) * c for t, c in at_least.items() if c}

    def corner(self, filters: int) -> int:
        """Its value where the variables of filters are 1 and the others 0: documents that these filters remove."""
        return sum(c for t, c in self.coefficients.items() if t & filters == t)

    def derivative(self, i: int) -> dict[int, int]:
        """By the variable of filter i: again coefficients of products."""
        return {t ^ (1 << i): c for t, c in self.coefficients.items() if t >> i & 1}

    def shapley(self, i: int) -> Fraction:
        """The derivative integrated along the diagonal from 0 to 1."""
        return sum((Fraction(c, t.bit_count() + 1) for t, c in self.derivative(i).items()), Fraction(0))


def audit_of(counts: dict[int, tuple[int, int, int]], filters: str = FILTERS) -> Iterator[tuple]:
    """(order, step, *COUNTS) for all orders of a part's filters; counts: {set: (documents, good, toxic)}."""
    every, orders = (1 << len(filters)) - 1, factorial(len(filters))
    removal, good, toxic = (Removal({m: c[k] for m, c in counts.items()}, len(filters)) for k in range(3))
    total = sum(c[0] for c in counts.values())
    shares = [int(orders * removal.shapley(i)) for i in range(len(filters))]
    alone = [removal.corner(every) - removal.corner(every ^ (1 << i)) for i in range(len(filters))]
    for order in permutations(range(len(filters))):
        done = 0
        for step, i in enumerate(order, 1):
            then = done | 1 << i
            removed = removal.corner(then) - removal.corner(done)
            yield ("".join(filters[k] for k in order), step, total - removal.corner(then), removed, removal.corner(1 << i) - removed, alone[i],
                   good.corner(then) - good.corner(done), toxic.corner(then) - toxic.corner(done), shares[i])
            done = then


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step and COUNTS, for each part, each of the 120 orders and each of its five steps."""
    sets = set_counts(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("sets"))  # at most 32 a part

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in parts:
            for part, found in zip(frame["part"], frame["sets"]):
                rows = audit_of({s["mask"]: (s["n"], s["good"], s["toxic"]) for s in found})
                yield pd.DataFrame([(part, *r) for r in rows], columns=["part", "filter_order", "step", *COUNTS])

    return sets.mapInPandas(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))
