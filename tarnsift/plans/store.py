"""What is written and read back: published tables, snapshots as runs, incremental builds, merged settings and sessions, guarded edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnsift.operators import incremental
from tarnsift.session import scratch_dir, table
from tarnsift.sources import store
from tarnsift.streaming import snapshots


#: Sections of a listing whose sizes are broadcast once counted.
BROADCAST_SECTIONS = 10_000


def k1_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index published twice; what is read is the second, whole."""
    path = f"{scratch_dir(spark)}/index"
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    store.publish(docs.filter("doc_id % 2 = 0"), path)
    store.publish(docs, path)
    return store.published(spark, path, "doc_id long, lang string, n_chars long")


def _listing(docs: DataFrame, text: Column, section: Column | None = None, beyond: Column | None = None) -> DataFrame:
    """documents as the listing of a crawl; beyond: what a section declares beyond what was read."""
    section, declared = F.col("source") if section is None else section, F.lit(0) if beyond is None else beyond
    rows = docs.select(section.alias("section"), F.col("doc_id").alias("place"), F.col("doc_id").alias("article_id"), F.substring_index("text", "\n", 1).alias("question"), text.alias("text"))
    sizes = rows.groupBy("section").agg((F.count("*") + F.max(declared)).alias("declared"))
    if sizes.limit(BROADCAST_SECTIONS + 1).count() <= BROADCAST_SECTIONS:
        sizes = F.broadcast(sizes)  # else texts would be shuffled by section
    return rows.join(sizes, "section").select([c.split()[0] for c in snapshots.LISTING.split(", ")])


def k3_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over documents, the second with every third text changed; articles joined with their texts."""
    folder = scratch_dir(spark)
    docs = table(spark, sf_dir, "documents")
    changed = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    for k, text in enumerate((F.col("text"), changed)):
        _listing(docs, text).write.parquet(f"{folder}/listing{k}")
        snapshots.take_in(spark, folder, str(k), f"{folder}/listing{k}")
    # lengths of the stored texts, so that the texts themselves stay where they are
    lengths = snapshots.texts(spark, folder).select("text_hash", F.length("text").alias("length"))
    joined = snapshots.articles(spark, folder).join(lengths, "text_hash")
    return joined.groupBy(F.col("run").alias("run_id")).agg(F.count("*").alias("articles"), F.count_distinct("text_hash").alias("texts"), F.sum("length").alias("chars"))


def z2_ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four crawls announced one after another and taken in by a stream, which then starts again on the same announcements: the
    second lists one section short and fails, the third has changed, moved and new articles, the fourth lacks some."""
    folder = scratch_dir(spark)
    docs, n = table(spark, sf_dir, "documents").filter("source IS NOT NULL AND doc_id IS NOT NULL"), F.col("doc_id")
    text = F.when(n % 5 == 0, F.concat("text", F.lit(" again"))).otherwise(F.col("text"))
    section = F.when(n % 7 == 0, F.lit("moved")).otherwise(F.col("source"))
    short = F.when(F.col("section") == "src0", 2).otherwise(0)
    crawls = (
        _listing(docs.filter(n % 11 != 0), F.col("text")), _listing(docs, text, beyond=short),
        _listing(docs, text, section), _listing(docs.filter(n % 13 != 0), text, section),
    )
    for k, crawl in enumerate(crawls):
        crawl.write.parquet(f"{folder}/crawl{k}")
        snapshots.announce(spark, f"{folder}/announced", f"crawl{k}", f"{folder}/crawl{k}")
        snapshots.ingest(spark, f"{folder}/announced", f"{folder}/site").awaitTermination()
    snapshots.ingest(spark, f"{folder}/announced", f"{folder}/site").awaitTermination()
    kinds = snapshots.changes(spark, f"{folder}/site").groupBy("run").pivot("kind", ["new", "changed", "moved", "deleted"]).count()
    texts = snapshots.texts(spark, f"{folder}/site").groupBy("run").agg(F.count("*").alias("new_texts"))
    every = snapshots.runs(spark, f"{folder}/site").join(kinds, "run", "left").join(texts, "run", "left")
    return every.select("run", "source", "ok", "reason", "articles", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("new", "changed", "moved", "deleted", "new_texts")])


def u4_incremental_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of documents, built once and brought up to what has changed since: every tenth text, some documents
    gone, some new. Each paragraph says which build computed it; paragraphs of other documents are those of the first."""
    folder = scratch_dir(spark)
    docs, n = table(spark, sf_dir, "documents").filter("doc_id IS NOT NULL"), F.col("doc_id")
    later = docs.filter(n % 7 != 3).select("doc_id", F.when(n % 10 == 0, F.concat("text", F.lit("\nmore"))).otherwise(F.col("text")).alias("text"))

    def paragraphs(build: int):
        def compute(given: DataFrame) -> DataFrame:
            lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.btrim(x) != "")
            return given.select("doc_id", F.posexplode(lines).alias("part", "text")).withColumn("build", F.lit(build))

        return compute

    for build, given in ((1, docs.filter(n % 9 != 4)), (2, later)):
        incremental.rebuild(given, f"{folder}/paragraphs", {"cut": "lines"}, paragraphs(build), stamp=F.xxhash64("text"))
    by = incremental.rows(spark, f"{folder}/paragraphs").groupBy("doc_id").agg(F.max("build").alias("build"), F.min("build").alias("first_build"), F.count("*").alias("parts"), F.sum(F.length("text")).alias("chars"))
    return by


def k5_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last value that events give each setting, merged in two steps; the first step's other settings stay."""
    folder = scratch_dir(spark)
    events = table(spark, sf_dir, "events").select(F.concat_ws(":", "user_id", "event_type").alias("key"), "event_id", "value")
    half = F.col("event_id") % 3 == 0
    for part in (events.filter(half), events.filter(~half & (F.col("value") > 50))):
        store.merge(part.groupBy("key").agg(F.max_by("value", "event_id").alias("value")), folder, "key")
    return store.merged(spark, folder)


def k11_guarded_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    stale = F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit(" "))).otherwise(F.col("text"))
    edits = docs.filter("doc_id % 2 = 0").select("doc_id", F.sha2(stale, 256).alias("sha"), F.concat("text", F.lit("!")).alias("text"))
    return store.guarded(edits, docs).select("doc_id", "fate", F.length("text").alias("chars"))


def k10_dropped_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by the rule that drops them, with their places: one row per document and rule, bounded by the document."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    rule = F.when(F.col("line").rlike("^[ ]*[0-9]+[ ]*$"), "digits").when(F.length(F.trim("line")) <= 3, "short").when(F.col("line").rlike("[#*$%&|<>]{3}"), "signs").otherwise("kept")
    rows = lines.withColumn("rule", rule).groupBy("doc_id", "rule").agg(F.count("*").alias("lines"), F.array_sort(F.collect_list("at")).alias("places"))
    return rows.select("doc_id", "rule", "lines", F.array_join("places", ",").alias("places"))


def k8_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions saved, then the even ones saved again with their first three messages."""
    folder = scratch_dir(spark)
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    store.save_sessions(said, folder)
    store.save_sessions(said.filter("conv_id % 2 = 0 AND turn < 3"), folder)
    return store.merged(spark, folder).groupBy("conv_id").agg(F.count("*").alias("messages"), F.sum(F.length("text")).alias("chars"))


def k10_dropped_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by the rule that drops them, with their places: one row per document and rule, bounded by the document."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    rule = F.when(F.col("line").rlike("^[ ]*[0-9]+[ ]*$"), "digits").when(F.length(F.trim("line")) <= 3, "short").when(F.col("line").rlike("[#*$%&|<>]{3}"), "signs").otherwise("kept")
    rows = lines.withColumn("rule", rule).groupBy("doc_id", "rule").agg(F.count("*").alias("lines"), F.array_sort(F.collect_list("at")).alias("places"))
    return rows.select("doc_id", "rule", "lines", F.array_join("places", ",").alias("places"))


QUERIES = {"K1_published": k1_published, "K3_snapshots": k3_snapshots, "K8_sessions": k8_sessions, "K10_dropped_dump": k10_dropped_dump, "K11_guarded_edits": k11_guarded_edits,
           "K5_settings_merged": k5_settings, "Z2_ingested_runs": z2_ingested, "U4_incremental_rebuild": u4_incremental_rebuild}
ORACLE_SQL = {
    "K1_published": "SELECT doc_id, lang, n_chars FROM documents",
    "K3_snapshots": """
    SELECT run_id, count(*) AS articles, count(DISTINCT text) AS texts, sum(length(text))::BIGINT AS chars FROM (
        SELECT 1 AS run_id, text FROM documents UNION ALL SELECT 2, CASE WHEN doc_id % 3 = 0 THEN text || '!' ELSE text END FROM documents) GROUP BY run_id""",
    "K8_sessions": "SELECT conv_id, count(*) AS messages, sum(length(text))::BIGINT AS chars FROM conversations WHERE conv_id % 2 = 1 OR turn < 3 GROUP BY conv_id",
    "K10_dropped_dump": """
    SELECT doc_id, rule, count(*) AS lines, string_agg(at - 1, ',' ORDER BY at) AS places FROM (
        SELECT doc_id, at, CASE WHEN regexp_matches(line, '^[ ]*[0-9]+[ ]*$') THEN 'digits' WHEN length(trim(line)) <= 3 THEN 'short' WHEN regexp_matches(line, '[#*$%&|<>]{3}') THEN 'signs' ELSE 'kept' END AS rule FROM (
            SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS "at" FROM documents)) GROUP BY doc_id, rule""".replace("at - 1", '"at" - 1').replace("ORDER BY at)", 'ORDER BY "at")').replace("doc_id, at, CASE", 'doc_id, "at", CASE'),
    "K5_settings_merged": """
    SELECT key, coalesce(arg_max(value, event_id) FILTER (event_id % 3 <> 0 AND value > 50), arg_max(value, event_id) FILTER (event_id % 3 = 0)) AS value FROM (
        SELECT concat_ws(':', user_id, event_type) AS key, event_id, value FROM events WHERE event_id % 3 = 0 OR value > 50) GROUP BY key""",
    "Z2_ingested_runs": """
    WITH d AS (SELECT *, doc_id % 5 = 0 AS c, doc_id % 7 = 0 AS m, doc_id % 11 = 0 AS late, doc_id % 13 = 0 AS gone, text || ' again' AS t2 FROM documents WHERE source IS NOT NULL AND doc_id IS NOT NULL),
    later AS (SELECT DISTINCT CASE WHEN c THEN t2 ELSE text END AS t FROM d)
    SELECT 1::BIGINT AS run, 'crawl0' AS source, TRUE AS ok, NULL AS reason, (SELECT count(*) FROM d WHERE NOT late) AS articles, 0::BIGINT AS new, 0::BIGINT AS changed, 0::BIGINT AS moved, 0::BIGINT AS deleted,
           (SELECT count(DISTINCT text) FROM d WHERE NOT late) AS new_texts
    UNION ALL SELECT 2, 'crawl1', FALSE, 'section src0: ' || (count(*) + 2) || ' declared, ' || count(*) || ' read', 0, 0, 0, 0, 0, 0 FROM d WHERE source = 'src0'
    UNION ALL SELECT 3, 'crawl2', TRUE, NULL, count(*), count(*) FILTER (late), count(*) FILTER (c AND NOT late), count(*) FILTER (m AND NOT c AND NOT late), 0,
           (SELECT count(*) FROM later WHERE t NOT IN (SELECT text FROM d WHERE NOT late)) FROM d
    UNION ALL SELECT 4, 'crawl3', TRUE, NULL, count(*) FILTER (NOT gone), 0, 0, 0, count(*) FILTER (gone), 0 FROM d""",
    "U4_incremental_rebuild": """
    SELECT doc_id, build::INTEGER AS build, build::INTEGER AS first_build, count(*) AS parts, sum(length(line))::BIGINT AS chars FROM (
        SELECT doc_id, CASE WHEN doc_id % 10 = 0 OR doc_id % 9 = 4 THEN 2 ELSE 1 END AS build, unnest(string_split(CASE WHEN doc_id % 10 = 0 THEN text || chr(10) || 'more' ELSE text END, chr(10))) AS line
        FROM documents WHERE doc_id % 7 <> 3) WHERE trim(line, ' ') <> '' GROUP BY doc_id, build""",
    "K11_guarded_edits": "SELECT doc_id, CASE WHEN doc_id % 2 = 1 THEN 'unchanged' WHEN doc_id % 4 = 0 THEN 'refused' ELSE 'applied' END AS fate, length(CASE WHEN doc_id % 4 = 2 THEN text || '!' ELSE text END) AS chars FROM documents",
}
