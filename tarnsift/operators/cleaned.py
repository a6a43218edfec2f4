"""Documents cleaned line by line, with places that lead back: drop rules, paragraphs, hyphens, glossary units.

Lines come as rows with their page, letter size and place in the raw text. The first rule that a line meets drops it. What is
kept is told by windows over the kept lines of a document: whether it goes on the paragraph before, whether it joins a
word that a hyphen cut, and where it begins in the clean text (a running sum of what stands before it). A piece knows
both its places, so a place in the clean text is led back by the last piece that begins at or before it.

Defined cases: blank lines are neither kept nor dropped; a line that is nothing but removed signs is dropped for them; the
blank between two pieces belongs to the first of them; within a word that signs were removed from, places are exact up to
the first of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Signs that are removed, bullets, what ends a clause and may stand behind it.
REMOVED = "\x07\x08­​﻿"
BULLETS = ("•",)
CLAUSE_END = r"""[.!?…:]["'»”’)\]\s]*$"""
STARTS_LOWER, NO_START, CUT_WORD = r"^\p{Ll}", r"^[^\p{L}•—–-]", r"\p{L}-$"
RULES = ("page", "small", "digits", "bullet", "control")


def raw_lines(docs: DataFrame) -> DataFrame:
    """doc_id, n (from 1), line, raw_start (from 0) of every line."""
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    before = Window.partitionBy("doc_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("raw_start", F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)).cast("long")).withColumn("n", F.col("n") + 1)


def dropped(lines: DataFrame, drop_pages: tuple[int, ...] = (), least_size: float = 0.0) -> DataFrame:
    """lines (doc_id, n, page, size, line, raw_start) with said (cleaned text), rule (of a dropped line; null if kept), gone (characters
    that a rule takes, control signs of kept lines too). Blank lines are left out."""
    bare = F.regexp_replace("line", r"^\s+|\s+$", "")
    said = F.btrim(F.regexp_replace(F.translate("line", REMOVED, ""), r"\s+", " "))
    removed = F.length("line") - F.length(F.translate("line", REMOVED, ""))
    rule = (
        F.when(F.col("page").isin(*drop_pages) if drop_pages else F.lit(False), "page").when(F.col("size") < least_size, "small")
        .when(bare.rlike("^[0-9]+$"), "digits").when(bare.isin(*BULLETS), "bullet").when(said == "", "control")
    )
    rows = lines.filter(F.col("line").rlike(r"\S")).withColumn("rule", rule)
    gone = F.when(F.col("rule").isin("page", "small", "digits", "bullet"), F.length(bare)).otherwise(removed)
    return rows.select("*", said.alias("said"), gone.cast("long").alias("gone"))


def pieces(told: DataFrame) -> DataFrame:
    """Kept lines of dropped(): doc_id, n, line, raw_start, joined (paragraph, hyphen or blank: how it follows the one before), piece
    (its text in the clean text), clean_start, paragraph (from 1)."""
    order = Window.partitionBy("doc_id").orderBy("n")
    rows = told.filter("rule IS NULL").withColumn("was", F.lag("said").over(order))
    hyphen = F.col("was").rlike(CUT_WORD) & F.col("said").rlike(STARTS_LOWER)
    goes_on = F.col("said").rlike(STARTS_LOWER) | (F.col("said").rlike(NO_START) & ~F.col("was").rlike(CLAUSE_END))
    rows = rows.withColumn("joined", F.when(F.col("was").isNull(), "paragraph").when(hyphen, "hyphen").when(goes_on, "blank").otherwise("paragraph"))
    cut = F.lead("joined").over(order) == "hyphen"
    rows = rows.withColumn("piece", F.when(cut, F.expr("substr(said, 1, length(said) - 1)")).otherwise(F.col("said")))
    gap = F.when((F.col("joined") == "hyphen") | F.col("was").isNull(), 0).otherwise(1)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("gap", gap).withColumn("clean_start", (F.sum(F.length("piece") + F.col("gap")).over(upto) - F.length("piece")).cast("long"))
    paragraph = F.sum((F.col("joined") == "paragraph").cast("int")).over(upto)
    return rows.select("doc_id", "n", "line", "raw_start", "joined", "piece", "gap", "clean_start", paragraph.alias("paragraph"))


def clean_texts(kept: DataFrame) -> DataFrame:
    """doc_id, text, paragraphs, hyphens of the pieces of each document."""
    lead = F.when(F.col("gap") == 0, "").when(F.col("joined") == "paragraph", "\n").otherwise(" ")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("n", F.concat(lead, "piece").alias("t")))), lambda x: x["t"])
    return kept.groupBy("doc_id").agg(F.array_join(parts, "").alias("text"), F.max("paragraph").alias("paragraphs"), F.count_if(F.col("joined") == "hyphen").alias("hyphens"))


def raw_places(kept: DataFrame, places: DataFrame) -> DataFrame:
    """places (doc_id, place in the clean text) with raw_place: one sort of pieces and places together, then the word of the
    piece that the place stands in is found in the raw line by its number."""
    marks = kept.select("doc_id", F.col("clean_start").alias("at"), F.struct("line", "raw_start", "piece", "clean_start").alias("of"), F.lit(0).alias("side"))
    asked = places.select("doc_id", F.col("place").alias("at"), F.lit(None).cast(marks.schema["of"].dataType).alias("of"), F.lit(1).alias("side"))
    order = Window.partitionBy("doc_id").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = marks.union(asked).withColumn("of", F.last("of", ignorenulls=True).over(order)).filter("side = 1")
    return _led_back(rows).select("doc_id", F.col("at").alias("place"), "raw_place")


def _led_back(rows: DataFrame) -> DataFrame:
    """rows (at, of: line, raw_start, piece, clean_start of the piece that at stands in) with raw_place."""
    others = [c for c in rows.columns if c not in ("inside", "head")]
    inside: Column = F.least(F.col("at") - F.col("of.clean_start"), F.length("of.piece")).cast("int")
    rows = rows.withColumn("inside", inside).withColumn("head", F.expr("substr(of.piece, 1, inside)"))
    words = F.length(F.regexp_replace("head", "[^ ]", ""))
    in_word = F.length(F.substring_index("head", " ", -1))
    tokens = F.regexp_extract_all("of.line", F.lit(r"\s*\S+"), F.lit(0))
    rows = rows.select(*others, words.alias("k"), in_word.alias("in_word"), tokens.alias("tokens"))
    before = F.aggregate(F.slice("tokens", F.lit(1), F.col("k")), F.lit(0), lambda s, t: s + F.length(t))
    blanks = F.length(F.regexp_extract(F.coalesce(F.get("tokens", F.col("k")), F.lit("")), r"^\s*", 0))
    return rows.select(*others, (F.col("of.raw_start") + before + blanks + F.col("in_word")).cast("long").alias("raw_place"))


def places_every(kept: DataFrame, step: int) -> DataFrame:
    """Every step-th place of the clean texts: doc_id, place, raw_place, clean_char, raw_char. A piece reaches to where the next one
    begins, so each gives its own places and the signs at them; neither texts nor places are put together or joined.
    Behind the end of a piece or line that another one follows stands what joins the two."""
    order = Window.partitionBy("doc_id").orderBy("n")
    end = F.col("clean_start") + F.length("piece")
    rows = kept.withColumn("next_gap", F.lead("gap", 1, 0).over(order)).withColumn("next_joined", F.lead("joined").over(order))
    first, last = F.ceil(F.col("clean_start") / step) * step, (end + F.col("next_gap") - 1).cast("long")
    held = rows.filter(first <= last).select("doc_id", "next_joined", F.struct("line", "raw_start", "piece", "clean_start").alias("of"), F.explode(F.sequence(first, last, F.lit(step).cast("long"))).alias("at"))
    rows = _led_back(held)
    sign = lambda text, at: F.substring(text, at.cast("int") + 1, F.lit(1))
    inside, in_line = F.col("at") - F.col("of.clean_start"), F.col("raw_place") - F.col("of.raw_start")
    between = F.when(F.col("next_joined") == "paragraph", "\n").otherwise(" ")
    clean = F.when(inside < F.length("of.piece"), sign(F.col("of.piece"), inside)).otherwise(between)
    raw = F.when(in_line < F.length("of.line"), sign(F.col("of.line"), in_line)).otherwise("\n")
    return rows.select("doc_id", F.col("at").alias("place"), "raw_place", clean.alias("clean_char"), raw.alias("raw_char"))


def glossary_units(paragraphs: DataFrame) -> DataFrame:
    """paragraphs (doc_id, n, kind: heading, entry or text, text, name of an entry, start, end) as units: doc_id, ordinal, kind (entry or group),
    name, start, end. Headings in a row name a group, an entry is named group › entry, texts in a row without an entry are one unit of the group's
    name. Headings belong to the unit behind them; at the end of a document, to the last."""
    order = Window.partitionBy("doc_id").orderBy("n")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    was = F.lag("kind", 1, "").over(order)
    heads = F.col("kind") == "heading"
    rows = paragraphs.withColumn("was", was).withColumn("island", F.sum((heads & (F.col("was") != "heading")).cast("int")).over(upto))
    rows = rows.withColumn("unit", F.sum(((F.col("kind") == "entry") | ((F.col("kind") == "text") & (F.col("was") != "text"))).cast("int")).over(upto))
    groups = rows.filter(heads).groupBy("doc_id", "island").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), " · ").alias("group"), F.min("start").alias("head_start"), F.max("end").alias("head_end"),
        F.max("n").alias("last_head"))
    body = rows.filter(~heads).groupBy("doc_id", "unit").agg(
        F.min_by(F.struct("kind", "name", "island", "was"), "n").alias("first"), F.min("n").alias("n"), F.min("start").alias("start"), F.max("end").alias("end"))
    units = body.withColumn("island", F.col("first.island")).join(groups, ["doc_id", "island"], "left")
    group = F.coalesce("group", F.lit(""))
    told = units.select(
        "doc_id", "n", "island", F.when(F.col("first.kind") == "entry", "entry").otherwise("group").alias("kind"), F.when(F.col("first.kind") == "entry", F.concat(group, F.lit(" › "), "first.name")).otherwise(group).alias("name"),
        F.when(F.col("first.was") == "heading", F.col("head_start")).otherwise(F.col("start")).alias("start"), "end")
    last = told.groupBy("doc_id").agg(F.max("island").alias("used"), F.max("n").alias("last_n"))
    tails = groups.join(last, "doc_id", "left").filter(F.col("used").isNull() | (F.col("island") > F.col("used")))
    ends = tails.filter("used IS NOT NULL").select("doc_id", F.col("last_n").alias("n"), "head_end")
    alone = tails.filter("used IS NULL").select("doc_id", F.col("last_head").alias("n"), F.lit("group").alias("kind"), F.col("group").alias("name"), F.col("head_start").alias("start"), F.col("head_end").alias("end"))
    every = told.join(ends, ["doc_id", "n"], "left").select("doc_id", "n", "kind", "name", "start", F.coalesce("head_end", "end").alias("end")).union(alone)
    return every.select("doc_id", F.row_number().over(order).alias("ordinal"), "kind", "name", "start", "end")
