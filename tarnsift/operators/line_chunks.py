"""Sections and chunks told from lines: windows over the lines of a document, then one fold of what belongs together.

Lines are rows. What a line is (heading, blank, fence, at the margin) is an expression of the line; what it belongs to
(section, paragraph, block) is a running count of the lines that begin one; the path of headings over a line is the last heading of
each level that no higher one has followed. Whether a line stands inside a fence takes a fold, over the fence lines of
a document only; its result joins the lines by place. Paragraphs of a section are packed by a fold over that section's
paragraphs. All of it is expressions and windows by document; the largest thing held together is one document's lines.

Defined cases: null and empty texts give no chunks; lines end at line feeds; blank is white space of ASCII.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A line that is a heading of plain text: a markdown heading, or a short line without any mark of a sentence.
HEADING = r"^(?:#{1,6}\s+\S.*|[^\s.,;:!?][^.,;:!?]{0,58}[^\s.,;:!?])$"
#: A heading of markdown (level, title), a line that opens or closes a fence (signs, rest).
MARKDOWN_HEADING = r"^ {0,3}(#{1,6})[ \t]+(.+?)(?:[ \t]+#+)?[ \t\r]*$"
FENCE = r"^ {0,3}(`{3,}|~{3,})(.*)$"
#: What a nested definition begins with; what a remark begins with; letters of a block's name.
DEFINITION = r"^\s+(?:async\s+def|def|class|fun|func|struct|enum|interface|object)\s"
REMARK = r"^(?:@|#|//|/\*|\*)"
NAME = 120


def lines(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n (from 1), line of every line."""
    return docs.filter(F.col(text) != "").select(key, F.posexplode(F.split(text, "\n")).alias("n", "line")).withColumn("n", F.col("n") + 1)


def _running(key: str) -> Window:
    return Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _blank(line: Column) -> Column:
    return ~line.rlike(r"\S")


def section_units(docs: DataFrame, default: str = "") -> DataFrame:
    """doc_id, ordinal, char_start, char_end, name of the sections of a text of one paragraph a line. Headings in a row make
    one name, joined by a middle dot; those at the very end belong to the section before; text before any has the default name."""
    rows = lines(docs)
    place = F.coalesce(F.sum(F.length("line") + 1).over(Window.partitionBy("doc_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    told = rows.withColumn("at", place).filter(~_blank(F.col("line"))).select(
        "doc_id", "n", (F.col("at") + F.length(F.regexp_extract("line", r"^\s*", 0))).alias("begin"), (F.col("at") + F.length(F.regexp_replace("line", r"\s+$", ""))).alias("end"),
        F.regexp_replace("line", r"^\s+|\s+$", "").alias("said"),
    ).withColumn("head", F.col("said").rlike(HEADING))
    before = F.lag("head").over(Window.partitionBy("doc_id").orderBy("n"))
    told = told.withColumn("unit", F.sum(F.when(before.isNull() | (F.col("head") & ~before), 1).otherwise(0)).over(_running("doc_id")))
    names = F.transform(F.array_sort(F.collect_list(F.when(F.col("head"), F.struct("n", "said")))), lambda x: F.regexp_replace(x["said"], "^[# ]+", ""))
    units = told.groupBy("doc_id", "unit").agg(F.min("begin").alias("char_start"), F.max("end").alias("char_end"), F.bool_or(~F.col("head")).alias("body"), F.array_join(names, " · ").alias("name"))
    after = Window.partitionBy("doc_id").orderBy("unit")
    last_end = F.when(~F.lead("body").over(after), F.lead("char_end").over(after)).otherwise(F.col("char_end"))  # only the last has headings alone
    units = units.withColumn("char_end", last_end).filter(F.col("body") | (F.col("unit") == 1))
    return units.select("doc_id", F.col("unit").cast("long").alias("ordinal"), F.col("char_start").cast("long").alias("char_start"), F.col("char_end").cast("long").alias("char_end"), F.when(F.col("name") == "", default).otherwise(F.col("name")).alias("name"))


def fence_turns(text: Column) -> Column:
    """(n, inside after it) of the lines of a text that open or close a fence. A fence ends with the same sign, at least as
    often, and nothing behind; until then nothing else opens one."""
    found = F.filter(F.transform(F.split(text, "\n"), lambda x, i: F.struct((i + 1).alias("n"), F.regexp_extract(x, FENCE, 1).alias("mark"), F.regexp_extract(x, FENCE, 2).alias("rest"))), lambda x: x["mark"] != "")
    start = F.struct(F.lit("").alias("open"), F.array().cast("array<struct<n:int,inside:boolean>>").alias("turns"))

    def step(state: Column, x: Column) -> Column:
        opens = (state["open"] == "") & ~((F.substring(x["mark"], 1, 1) == "`") & F.contains(x["rest"], F.lit("`")))
        closes = (state["open"] != "") & F.startswith(x["mark"], state["open"]) & _blank(x["rest"])
        turn = lambda inside: F.concat(state["turns"], F.array(F.struct(x["n"].alias("n"), F.lit(inside).alias("inside"))))
        return F.when(opens, F.struct(x["mark"].alias("open"), turn(True).alias("turns"))).when(closes, F.struct(F.lit("").alias("open"), turn(False).alias("turns"))).otherwise(state)

    return F.aggregate(found, start, step, lambda s: s["turns"])


def packed(atoms: Column, most: int, gap: Column | None = None) -> Column:
    """Atoms (n, last, text) in a row, packed greedily up to most characters: (n, last, text) of each piece. Between two stand
    as many line feeds as their lines are apart, two at most if gap is two."""
    limit = F.lit(1 << 30) if gap is None else gap

    def add(done: Column, x: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        between = F.repeat(F.lit("\n"), F.greatest(F.lit(1), F.least(limit, x["n"] - last["last"])).cast("int"))
        fits = (F.size(done) > 0) & (F.length(last["text"]) + F.length(between) + F.length(x["text"]) <= most)
        joined = F.struct(last["n"].alias("n"), x["last"].alias("last"), F.concat(last["text"], between, x["text"]).alias("text"))
        return F.when(fits, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(atoms, F.array().cast("array<struct<n:int,last:int,text:string>>"), add)


def _pieces(rows: DataFrame, key: str, most: int, cut: Column, gap: Column | None, strip: bool) -> DataFrame:
    """Rows (key, section, title, run, n, line) packed by section: key, section, title, part, parts, line, body. A run is one atom if it is
    not longer than most; else each of its lines is, cut into the matches of a pattern where a line is too long."""
    bare = lambda t: F.regexp_replace(t, r"\s+$", "") if strip else t
    of_run = rows.groupBy(key, "section", "run").agg(F.first("title").alias("title"), F.array_sort(F.collect_list(F.struct("n", "line"))).alias("found"))
    text = bare(F.array_join(F.transform("found", lambda x: x["line"]), "\n"))
    ends = lambda x: F.struct(x["n"].alias("n"), x["n"].alias("last"), x["line"].alias("text"))
    single = F.flatten(F.transform("found", lambda x: F.transform(F.when(F.length(x["line"]) <= most, F.array(x["line"])).otherwise(F.regexp_extract_all(x["line"], cut, F.lit(1))), lambda t: ends(x.withField("line", t)))))
    one = F.array(F.struct(F.element_at("found", 1)["n"].alias("n"), F.element_at("found", -1)["n"].alias("last"), F.col("whole").alias("text")))
    atoms = of_run.withColumn("whole", text).withColumn("atoms", F.when(F.length("whole") <= most, one).otherwise(F.filter(single, lambda a: ~_blank(a["text"]) | (a["text"] == ""))))
    of_section = atoms.groupBy(key, "section").agg(F.first("title").alias("title"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("run", "atoms"))), lambda r: r["atoms"])).alias("atoms"))
    done = of_section.withColumn("pieces", F.filter(packed(F.col("atoms"), most, gap), lambda p: ~_blank(p["text"])))
    return done.select(key, "section", "title", F.size("pieces").cast("long").alias("parts"), F.posexplode("pieces").alias("part", "p")).select(
        key, "section", "title", (F.col("part") + 1).cast("long").alias("part"), "parts", F.col("p.n").cast("long").alias("line"), bare(F.col("p.text")).alias("body"))


def _numbered(pieces: DataFrame, key: str) -> DataFrame:
    ordinal = F.row_number().over(Window.partitionBy(key).orderBy("section", "part")).cast("long")
    return pieces.select(key, ordinal.alias("ordinal"), F.col("title").alias("section"), "part", "parts", "line", "body")


def markdown_chunks(docs: DataFrame, text: str = "text", key: str = "doc_id", most: int = 1200) -> DataFrame:
    """key, ordinal, section, part, parts, line, body: paths of headings as sections, paragraphs packed within them; nothing
    inside a fence is a heading, and a fenced block is one paragraph."""
    turns = docs.filter(F.col(text).rlike("`{3}|~{3}")).select(key, F.explode(fence_turns(F.col(text))).alias("t")).select(key, F.col("t.n").alias("n"), F.col("t.inside").alias("turn"))
    rows = lines(docs, text, key).withColumn("turn", F.lit(None).cast("boolean"))
    rows = rows.unionByName(turns.withColumn("line", F.lit(None).cast("string"))).groupBy(key, "n").agg(F.max("line").alias("line"), F.max("turn").alias("turn"))
    upto, before = _running(key), Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("was", F.coalesce(F.last("turn", ignorenulls=True).over(before), F.lit(False))).withColumn("inside", F.coalesce("turn", "was"))
    fenced = F.col("was") | F.col("inside")
    rows = rows.withColumn("level", F.when(~fenced, F.nullif(F.length(F.regexp_extract("line", MARKDOWN_HEADING, 1)), F.lit(0))))
    at = [F.last(F.when(F.col("level") == k, F.struct(F.col("n").alias("n"), F.trim(F.regexp_extract("line", MARKDOWN_HEADING, 2)).alias("t"))), ignorenulls=True).over(upto).alias(f"h{k}") for k in range(1, 7)]
    flag = (F.col("level").isNotNull()).cast("int")
    rows = rows.select("*", *at, F.sum(flag).over(upto).alias("section"))
    known = lambda k: F.col(f"h{k}").isNotNull() & (F.lit(True) if k == 1 else F.col(f"h{k}.n") > F.greatest(F.lit(0), F.lit(0), *[F.coalesce(F.col(f"h{j}.n"), F.lit(0)) for j in range(1, k)]))
    title = F.array_join(F.array_compact(F.array(*[F.when(known(k), F.col(f"h{k}.t")) for k in range(1, 7)])), " › ")
    starts = F.lag(_blank(F.col("line")) & ~fenced, 1, True).over(Window.partitionBy(key).orderBy("n")) | (~F.col("was") & F.col("inside")) | F.lag(F.col("was") & ~F.col("inside"), 1, False).over(Window.partitionBy(key).orderBy("n"))
    rows = rows.withColumn("title", title).withColumn("starts", starts).withColumn("run", F.sum(F.col("starts").cast("int") + flag).over(upto))
    body = rows.filter(F.col("level").isNull() & (fenced | ~_blank(F.col("line"))))
    cut = F.lit(rf" *(\S.{{0,{most - 1}}}(?= |$)|\S.{{0,{most - 1}}})")
    return _numbered(_pieces(body, key, most, cut, F.lit(2), True), key)


def code_chunks(docs: DataFrame, text: str = "text", key: str = "doc_id", most: int = 1200) -> DataFrame:
    """key, ordinal, section, part, parts, line, body: a block begins with a line at the margin after a blank one and is named
    after its first line that is no remark; a piece that begins with a nested definition names it as well."""
    order = Window.partitionBy(key).orderBy("n")
    rows = lines(docs, text, key).withColumn("blank", _blank(F.col("line")))
    begins = F.lag("blank", 1, True).over(order) & ((F.col("n") == 1) | F.col("line").rlike(r"^[^\s)\]}]"))
    rows = rows.withColumn("section", F.sum(begins.cast("int")).over(_running(key))).withColumn("run", F.sum(F.lag("blank", 1, True).over(order).cast("int")).over(_running(key)))
    said = F.substring(F.trim("line"), 1, NAME)
    block = Window.partitionBy(key, "section").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    names = F.coalesce(F.first(F.when(~F.col("blank") & ~F.ltrim("line").rlike(REMARK), said), ignorenulls=True).over(block), F.first(F.when(~F.col("blank"), said), ignorenulls=True).over(block), F.lit(""))
    rows = rows.withColumn("title", names).filter(~F.col("blank"))
    done = _numbered(_pieces(rows, key, most, F.lit(rf"(.{{1,{most}}})"), None, False), key)
    head = F.substring_index("body", "\n", 1)
    return done.withColumn("section", F.when(head.rlike(DEFINITION), F.concat("section", F.lit(" › "), F.substring(F.trim(head), 1, NAME))).otherwise(F.col("section")))
