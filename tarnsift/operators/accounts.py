"""What requests weigh and what histories have folded: token estimates by part, running folds, statistics of dialogs.

An estimate is a formula over the letters of a text. A request's parts are columns; the history is an array whose messages are
bounded by the context that they were cut to. The fold of a history goes on over its turns: one that fails leaves
what is covered as it was, so that the next turn tries again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters a token for Cyrillic, Latin and other signs; tokens of a message and of a request beside their texts.
CYRILLIC, LATIN, OTHER = 2.5, 4.0, 2.0
PER_MESSAGE, PER_REQUEST = 4, 3
#: Parts of a request that are messages of their own when they are not empty, and those that belong to another message or to none.
MESSAGES = ("question", "memory", "long_term", "working", "profile", "task", "invariants")
BESIDE = ("tools", "rag")


def estimated_tokens(text: Column) -> Column:
    """Estimated tokens of a text, rounded half to even; null: 0."""
    said = F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", "")
    count = lambda letters: F.length(F.regexp_replace(said, rf"[^{letters}]+", ""))
    cyrillic, latin = count(r"\x{0400}-\x{052F}"), count("A-Za-z")
    return F.bround(cyrillic / CYRILLIC + latin / LATIN + (F.length(said) - cyrillic - latin) / OTHER).cast("long")


def request_tokens(requests: DataFrame, key: str) -> DataFrame:
    """requests (key, system, history array of texts, MESSAGES, BESIDE) by part: tokens of each, per_message, overhead, total. A column that
    is not there is an empty part. An empty part is no message; tools are none, and what was retrieved is part of the question's."""
    part = lambda name: F.col(name) if name in requests.columns else F.lit(None).cast("string")
    per_message = F.transform(F.coalesce("history", F.array().cast("array<string>")), estimated_tokens)
    told = requests.select(key, estimated_tokens(part("system")).alias("system"), per_message.alias("per_message"), *[estimated_tokens(part(p)).alias(p) for p in (*MESSAGES, *BESIDE)],
                           sum((F.coalesce(part(p) != "", F.lit(False))).cast("int") for p in MESSAGES).alias("_more"))
    history = F.aggregate("per_message", F.lit(0).cast("long"), lambda s, x: s + x)
    told = told.withColumn("history", history).withColumn("overhead", ((1 + F.size("per_message") + F.col("_more")) * PER_MESSAGE + PER_REQUEST).cast("long"))
    total = sum((F.col(c) for c in ("history", *MESSAGES, *BESIDE, "overhead")), F.col("system"))
    return told.select(key, "system", "history", *MESSAGES, *BESIDE, "overhead", total.alias("total"), "per_message")


def folds(turns: DataFrame, key: str, order: list[str], fold_every: int, keep_last: int) -> DataFrame:
    """turns (key, order, answered: whether a fold that is due at this turn succeeds): key, n (turn from 1), covered after it, tried, done (folds so far). A fold
    is due when fold_every messages before the last keep_last are not covered. Rows stream in order of key and turn, so only the counters of one
    history are held; null answered is a failure."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, n, covered, tried, done = None, 0, 0, 0, 0
        for batch in batches:
            out = []
            for of, answered in zip(batch[key], batch["answered"]):
                if of != now:
                    now, n, covered, tried, done = of, 0, 0, 0, 0
                n += 1
                if n - keep_last - covered >= fold_every:
                    tried += 1
                    if answered is not None and answered:
                        covered, done = n - keep_last, done + 1
                out.append((of, n, covered, tried, done))
            yield pd.DataFrame(out, columns=[key, "n", "covered", "tried", "done"])

    ordered = turns.filter(F.col(key).isNotNull()).repartition(key).sortWithinPartitions(key, *order)
    return ordered.select(key, "answered").mapInPandas(run, f"{key} {dict(turns.dtypes)[key]}, n int, covered int, tried int, done int")


def recovered_json(text: Column) -> Column:
    """The first JSON object in a free text, whatever stands before and after it; null if none is whole. It ends at the first closing
    brace up to which it reads as JSON."""
    start = F.instr(text, "{")
    tail = F.substring(text, start, F.length(text))
    ends = F.transform(F.slice(F.split(tail, "[}]"), F.lit(1), F.size(F.split(tail, "[}]")) - 1), lambda p: F.length(p) + 1)
    upto = F.transform(ends, lambda _, i: F.aggregate(F.slice(ends, F.lit(1), i + 1), F.lit(0), lambda s, x: s + x))
    whole = F.filter(F.transform(upto, lambda n: F.substring(tail, F.lit(1), n)), lambda t: F.try_parse_json(t).isNotNull())
    return F.when(start > 0, F.get(whole, F.lit(0)))


def as_integer(value: Column) -> Column:
    """A number, or digits given as a string; null for anything else."""
    return F.when(F.btrim(value).rlike("^[0-9]+$"), F.btrim(value).cast("long"))


#: Pieces whose lengths are added up as one on the way to a place.
PIECES = 64


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value; what a lambda names is worked out anew for each element, so value is given as a variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def sentences(text: Column) -> Column:
    """(start, end, text) of the sentences of a text: ends at signs and closing marks before white space, trimmed."""
    total = lambda sizes: F.aggregate(sizes, F.lit(0), lambda s, x: s + x)
    told = lambda t, at: F.struct(
        (at + F.length(F.regexp_extract(t, r"^\s*", 0))).alias("start"), (at + F.length(F.regexp_replace(t, r"\s+$", ""))).alias("end"), F.regexp_replace(t, r"^\s+|\s+$", "").alias("text"))

    def placed(cut: Column, sizes: Column, heads: Column) -> Column:
        block = lambda i: F.floor(i / PIECES).cast("int")
        at = lambda i: F.get(heads, block(i)) + total(F.slice(sizes, block(i) * PIECES + 1, i % PIECES))
        return F.transform(cut, lambda t, i: told(t, at(i)))

    def of(cut: Column, sizes: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / PIECES).cast("int")), lambda b: total(F.slice(sizes, b * PIECES + 1, F.lit(PIECES))))
        heads = _once(blocks, lambda bs: F.transform(bs, lambda _, i: total(F.slice(bs, F.lit(1), i))))
        return _once(heads, lambda h: placed(cut, sizes, h))

    pieces = F.split(text, r"(?<=[.!?…][\"'»”’)\]]{0,5})(?=\s)")
    spans = F.when(text.isNotNull(), _once(pieces, lambda cut: _once(F.transform(cut, F.length), lambda sizes: of(cut, sizes))))
    return F.filter(spans, lambda p: p["text"] != "")


#: Kinds of a turn of a dialog, in order: the first that holds is the turn's.
KINDS = ("search failed", "unchecked", "by excerpts", "by memory", "unknown, nothing found", "unknown by content", "no references")


def dialog_statistics(turns: DataFrame, by: list[str]) -> DataFrame:
    """Counters of dialogs over turns (ok, search_ok, checked, kind of the answer, empty, refs, memory_refs, missing, sources_found, sources_asked, keys_found, keys_asked,
    repaired, violated, turn_id, prompt, completion, cost and seconds of the main call, of the rewrite and of the memory call, seconds of the search). Tokens, costs and seconds count over turns that went well; keys over
    all; what was checked over turns whose search went well."""
    ok = F.col("ok")
    kind = (
        F.when(~ok, None).when(~F.col("search_ok"), KINDS[0]).when(~F.col("checked"), KINDS[1]).when(F.col("kind") == "answer", KINDS[2]).when(F.col("kind") == "memory", KINDS[3])
        .when((F.col("kind") == "unknown") & F.col("empty"), KINDS[4]).when(F.col("kind") == "unknown", KINDS[5]).otherwise(KINDS[6])
    )
    rows = turns.withColumn("_kind", kind).withColumn("_judged", ok & F.col("search_ok") & F.col("checked"))
    summed = lambda c, when, to="long": F.coalesce(F.sum(F.when(when, F.coalesce(F.col(c), F.lit(0)))), F.lit(0)).cast(to)
    judged = F.col("_judged")
    return rows.groupBy(*by).agg(
        F.count("*").alias("turns"), F.count_if(ok).alias("ok"), *[F.count_if(F.col("_kind") == k).alias(k.replace(",", "").replace(" ", "_")) for k in KINDS],
        F.count_if(judged & (F.col("kind") == "unknown") & ((F.col("refs") > 0) | (F.col("memory_refs") > 0))).alias("unknown_with_references"), F.count_if(judged & (F.col("refs") > 0)).alias("with_source"),
        F.count_if(ok & F.col("search_ok") & F.col("empty")).alias("empty"), summed("memory_refs", judged).alias("memory_ok"), summed("missing", judged).alias("memory_missing"),
        summed("sources_found", ok).alias("sources_found"), summed("sources_asked", ok).alias("sources_asked"), summed("keys_found", F.lit(True)).alias("keys_found"), summed("keys_asked", F.lit(True)).alias("keys_asked"),
        F.count_if(judged & F.col("repaired")).alias("repaired"), F.array_sort(F.collect_list(F.when(judged & F.col("violated"), F.col("turn_id")))).alias("violated"),
        summed("prompt", ok).alias("prompt"), summed("completion", ok).alias("completion"),
        *[F.round(summed(f"{what}_{call}", ok, "double"), 6).alias(f"{what}_{call}") for what in ("cost", "seconds") for call in ("main", "rewrite", "memory")],
        F.round(summed("seconds_search", ok & F.col("search_ok"), "double"), 6).alias("seconds_search"),
    )
