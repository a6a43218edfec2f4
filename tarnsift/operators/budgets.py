"""Texts under a budget of characters: rows that are shortened before the list stops, tickets that lose their oldest messages first.

The greedy rules are folds over arrays whose length is bounded before they are gathered: a list by its most items, a ticket by
the messages that can fit its budget at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def degraded_lists(rows: DataFrame, key: str, order: list[str], full: Column, short: Column, budget: int, most: int = 40, reserve: int = 60) -> DataFrame:
    """Per key: shown (the blocks, in order), whole, shortened, left_out, used. A block that does not fit what is left of
    budget - reserve is put in short; one that does not fit even so ends the list. Items beyond most never come in."""
    window = Window.partitionBy(key).orderBy(*order)
    ranked = rows.select(key, F.row_number().over(window).alias("_n"), F.count("*").over(Window.partitionBy(key)).alias("_all"), full.alias("full"), short.alias("short")).filter(F.col("_n") <= most)
    lists = ranked.groupBy(key).agg(F.first("_all").alias("all"), F.array_sort(F.collect_list(F.struct("_n", "full", "short"))).alias("items"))
    size = lambda t: F.length(t) + 1
    start = F.struct(F.lit(budget - reserve).alias("left"), F.lit(False).alias("over"), F.array().cast("array<struct<text:string,short:boolean>>").alias("shown"))

    def step(state: Column, x: Column) -> Column:
        put = lambda text, short: F.struct((state["left"] - size(text)).alias("left"), F.lit(False).alias("over"), F.concat(state["shown"], F.array(F.struct(text.alias("text"), F.lit(short).alias("short")))).alias("shown"))
        stop = F.struct(state["left"].alias("left"), F.lit(True).alias("over"), state["shown"].alias("shown"))
        return F.when(state["over"], state).when(size(x["full"]) <= state["left"], put(x["full"], False)).when(size(x["short"]) <= state["left"], put(x["short"], True)).otherwise(stop)

    done = lists.select(key, "all", F.aggregate("items", start, step).alias("s"))
    cut = F.size(F.filter("s.shown", lambda x: x["short"]))
    return done.select(
        key, F.array_join(F.transform("s.shown", lambda x: x["text"]), "\n").alias("shown"), (F.size("s.shown") - cut).alias("whole"), cut.alias("shortened"), (F.col("all") - F.size("s.shown")).cast("long").alias("left_out"),
        (F.lit(budget - reserve) - F.col("s.left")).alias("used"))


def tickets(messages: DataFrame, budget: int, first_limit: int) -> DataFrame:
    """messages (ticket, n, sender, text) of each ticket as text: ticket, shown, kept (earlier messages), field_limit (null: whole), fits.

    Earlier messages go from the oldest on until the text fits; then the subject, the question and the last message are clipped to
    first_limit, half of it, and so on, until it fits."""
    newest, oldest = Window.partitionBy("ticket").orderBy(F.col("n").desc()), Window.partitionBy("ticket")
    line = F.concat(F.col("sender"), F.lit(": "), F.coalesce("text", F.lit("")))
    rows = messages.select("ticket", "n", "sender", F.coalesce("text", F.lit("")).alias("text"), line.alias("line"))
    rows = rows.select("*", F.sum(F.length("line") + 1).over(newest.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("_size"), F.row_number().over(newest).alias("_back"))
    heads = rows.groupBy("ticket").agg(
        F.count("*").alias("n"), F.min_by(F.substring_index("text", "\n", 1), "n").alias("subject"), F.coalesce(F.max_by(F.when(F.col("sender") == "user", F.col("text")), F.when(F.col("sender") == "user", F.col("n"))), F.lit("")).alias("question"),
        F.max_by(F.struct("sender", "text"), "n").alias("last"),
        F.array_sort(F.collect_list(F.when((F.col("_back") > 1) & (F.col("_size") <= budget), F.struct(F.col("n").alias("n"), F.col("line").alias("line"))))).alias("earlier"))
    clip = lambda text, limit: F.when(limit.isNull() | (F.length(text) <= limit), text).otherwise(F.concat(F.substring(text, F.lit(1), limit), F.lit("… [cut]")))

    def text(kept: Column, limit: Column) -> Column:
        skipped = F.col("n") - 1 - kept
        lines = F.concat(
            F.array(F.concat(F.lit("Ticket "), F.col("ticket")), F.concat(F.lit("Subject: "), clip(F.col("subject"), limit)), F.concat(F.lit("Question: "), clip(F.col("question"), limit)), F.lit("Messages:")),
            F.when(skipped > 0, F.array(F.concat(F.lit("… "), skipped, F.lit(" earlier not shown")))).otherwise(F.array().cast("array<string>")),
            F.transform(F.slice("earlier", F.size("earlier") - kept + 1, kept), lambda m: m["line"]),
            F.array(F.concat(F.col("last.sender"), F.lit(": "), clip(F.col("last.text"), limit))))
        return F.array_join(lines, "\n")

    limits = []
    while first_limit > 0:
        limits.append(first_limit)
        first_limit //= 2
    none = F.lit(None).cast("int")
    ways = F.concat(
        F.transform(F.sequence(F.size("earlier"), F.lit(0)), lambda k: F.struct(k.alias("kept"), none.alias("limit"))),
        F.array(*[F.struct(F.lit(0).alias("kept"), F.lit(x).cast("int").alias("limit")) for x in limits]),
    )
    found = heads.withColumn("ways", ways).withColumn("way", F.get(F.filter("ways", lambda w: F.length(text(w["kept"], w["limit"])) <= budget), F.lit(0)))
    chosen = found.withColumn("fits", F.col("way").isNotNull()).withColumn("way", F.coalesce("way", F.element_at("ways", -1)))
    return chosen.select("ticket", text(F.col("way.kept"), F.col("way.limit")).alias("shown"), F.col("way.kept").alias("kept"), F.col("way.limit").alias("field_limit"), "fits")
