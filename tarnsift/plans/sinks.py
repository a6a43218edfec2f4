"""Notes, search logs and exports written and read back, migrations, guarded index scans; rules over changes, requests and rewrites."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnsift.operators import inverted, ranks
from tarnsift.session import scratch_dir, table
from tarnsift.sources import store


def k9_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as notes, saved in two goes: later ones take the next free names."""
    folder = f"{scratch_dir(spark)}/notes"
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("note_id"), F.lit("2024-01-01").alias("day"), F.col("p_name").alias("title"), F.concat_ws(" ", "p_name", "p_type", "p_partkey").alias("text"))
    first = store.save_notes(part.filter("note_id % 2 = 0"), folder)
    return first.unionByName(store.save_notes(part.filter("note_id % 2 = 1"), folder))


def k6_search_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches kept with the articles that they found, in order; the log is read back."""
    folder = scratch_dir(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", F.substring_index("text", "\n", 1).alias("title"), "text")
    index = inverted.build(docs, f"{folder}/index", {"title": 3, "text": 1})
    turns = table(spark, sf_dir, "conversations").filter("role = 'user' AND conv_id % 20 = 0").select(F.concat_ws("/", "conv_id", "turn").alias("query_id"), "text")
    found = inverted.search(index, turns, 10).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "doc_id"))), lambda x: x["doc_id"]).alias("articles"))
    log = turns.join(found, "query_id", "left").select(F.col("query_id").alias("search_id"), F.col("text").alias("query"), F.coalesce("articles", F.array().cast("array<bigint>")).alias("articles"))
    store.merge(log, f"{folder}/searches", "search_id")
    return store.merged(spark, f"{folder}/searches").select("search_id", F.length("query").alias("letters"), F.array_join(F.transform("articles", lambda a: a.cast("string")), ",").alias("articles"))


def k13_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs as JSON, a line each, read back by their schema."""
    path = f"{scratch_dir(spark)}/runs"
    runs = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("calls"), F.round(F.sum("value"), 4).alias("cost"), F.array_sort(F.collect_set("event_type")).alias("kinds"), F.max_by("props", "event_id").alias("last"))
    runs.write.json(path)
    return spark.read.schema(runs.schema).json(path)


def k14_migrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of version 1, brought to version 3: version 2 has a column more, version 3 says where rows come from."""
    path = f"{scratch_dir(spark)}/log"
    store.publish(table(spark, sf_dir, "events").select("event_id", "event_type"), path, 1)
    store.migrate(spark, path, 3, {1: lambda t: t.withColumn("letters", F.length("event_type")), 2: lambda t: t.withColumn("source", F.lit("copy"))})
    return store.published(spark, path, "event_id long, event_type string, letters int, source string", 3)


def s4_stacked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index published, read by its version and columns, numbered by label and id, its vectors stacked; each block's ids and the sum of its components."""
    folder = scratch_dir(spark)
    store.publish(table(spark, sf_dir, "embeddings"), f"{folder}/index", 7)
    index = store.published(spark, f"{folder}/index", "vec_id long, embedding array<float>, label int", 7)
    numbered = ranks.numbered(index, ["label", "vec_id"], "ordinal", f"{folder}/numbered")
    blocks = store.stacked(numbered, "label", "ordinal", "embedding")
    total = F.aggregate("values", F.lit(0.0), lambda s, x: s + x.cast("double"))
    rows = blocks.select("label", F.explode("ids").alias("ordinal"), F.size("ids").alias("n"), "size", (F.size("values") == F.size("ids") * F.col("size")).alias("whole"), total.alias("total"))
    return rows.groupBy("label").agg(F.min("ordinal").alias("first"), F.max("ordinal").alias("last"), F.count("*").alias("vectors"), F.max("size").alias("size"), F.bool_and("whole").alias("whole"), F.round(F.sum(F.col("total") / F.col("n")), 4).alias("total"))


#: Changes shown at most, files taken at most: a list's limit is what it is for.
MOST_CHANGES, MOST_FILES = 200, 20


def changed_files(status: DataFrame, stats: DataFrame) -> DataFrame:
    """status (change_id, code: A, M, D or R with a share, path, new_path of a renamed file), stats (path: of a renamed file old => new, added, removed; null if binary): by the path that a file has
    now, with the one it had, and whether it is binary or has no statistics."""
    renamed = F.startswith("code", F.lit("R"))
    now = F.when(renamed, F.col("new_path")).otherwise(F.col("path"))
    named = status.select("change_id", F.substring("code", 1, 1).alias("code"), now.alias("now"), F.when(renamed, F.col("path")).alias("was"))
    to = stats.select(F.element_at(F.split("path", " => "), -1).alias("now"), "added", "removed", F.lit(True).alias("known"))
    return named.join(to, "now", "left").select("change_id", "code", F.col("now").alias("path"), "was", "added", "removed", F.coalesce(F.col("known") & F.col("added").isNull(), F.lit(False)).alias("binary"), F.col("known").isNull().alias("uncounted"))


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders")
    path = F.concat(F.lit("src/"), F.col("o_custkey"), F.lit("/f"), n, F.when(n % 5 == 0, ".png").otherwise(".py"))
    new = F.concat(F.lit("moved/f"), n, F.lit(".py"))
    code = F.when(n % 7 == 0, "R090").when(n % 7 == 1, "D").when(n % 7 == 2, "A").otherwise("M")
    status = orders.select(n.alias("change_id"), code.alias("code"), path.alias("path"), F.when(n % 7 == 0, new).alias("new_path"))
    counted = orders.filter(n % 11 != 0)
    stats = counted.select(F.when(n % 7 == 0, F.concat(path, F.lit(" => "), new)).otherwise(path).alias("path"), F.when(n % 5 != 0, F.floor(F.col("o_totalprice") / 1000)).alias("added"), F.when(n % 5 != 0, n % 9).alias("removed"))
    return changed_files(status, stats)


def s16_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(spark, sf_dir).orderBy("path").limit(MOST_CHANGES)


def f15_chosen_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of a change that a review reads: not binary, not deleted, not by an excluded path; those with most changed lines."""
    rows = _changes(spark, sf_dir).filter("NOT binary AND NOT uncounted AND code <> 'D'").filter(~F.col("path").rlike(r"^src/1[^/]*/.*$") & ~F.col("path").rlike(r"^.*\.lock$"))
    return rows.select("path", (F.col("added") + F.col("removed")).alias("lines")).orderBy(F.desc("lines"), "path").limit(MOST_FILES)


def r20_rewritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two distinct questions of a rewrite: list marks and matching quotation marks go, layer after layer."""
    line = F.btrim(F.col("line"))
    layers = F.concat(F.when(F.col("turn") % 2 == 0, "- ").otherwise("1. "), F.when(F.col("turn") % 3 == 0, "* ").otherwise(""), F.lit('"«'), line, F.lit('»"'))
    said = table(spark, sf_dir, "conversations").filter("text IS NOT NULL").select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    rows = said.select("conv_id", "turn", "at", F.when(F.col("at") % 2 == 0, layers).otherwise(line).alias("line"))
    bare = F.col("line")
    for _ in range(4):  # a layer is a mark, then a pair of quotation marks; lines have no more
        bare = F.btrim(F.regexp_replace(F.btrim(bare), r"^(?:[-*•]|[0-9]+[.)]) +", ""))
        bare = F.regexp_replace(bare, '^(?:"(.*)"|«(.*)»|“(.*)”)$', "$1$2$3")
    kept = rows.select("conv_id", "turn", "at", bare.alias("q")).filter("q <> ''").groupBy("conv_id", "turn", "q").agg(F.min("at").alias("at"))
    return kept.groupBy("conv_id", "turn").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("at", "q"))), lambda x: x["q"]), 1, 2).alias("queries")).select("conv_id", "turn", F.array_join("queries", "|").alias("queries"))


QUERIES = {"K9_saved_notes": k9_notes, "K6_search_log_kept": k6_search_log, "K13_json_export": k13_export, "K14_migrated": k14_migrated, "S4_stacked_index": s4_stacked, "S16_changed_files": s16_changes, "F15_chosen_files": f15_chosen_files,
           "R20_rewritten_queries": r20_rewritten}

_CHANGES_SQL = """
    WITH o AS (
        SELECT o_orderkey AS n, 'src/' || o_custkey || '/f' || o_orderkey || CASE WHEN o_orderkey % 5 = 0 THEN '.png' ELSE '.py' END AS was, 'moved/f' || o_orderkey || '.py' AS new, floor(o_totalprice / 1000)::BIGINT AS price FROM orders),
    c AS (
        SELECT n AS change_id, CASE n % 7 WHEN 0 THEN 'R' WHEN 1 THEN 'D' WHEN 2 THEN 'A' ELSE 'M' END AS code, CASE WHEN n % 7 = 0 THEN new ELSE was END AS path, CASE WHEN n % 7 = 0 THEN was END AS was,
               CASE WHEN n % 11 <> 0 AND n % 5 <> 0 THEN price END AS added, CASE WHEN n % 11 <> 0 AND n % 5 <> 0 THEN n % 9 END AS removed, n % 11 <> 0 AND n % 5 = 0 AS "binary", n % 11 = 0 AS uncounted FROM o)"""


def _oracles() -> dict[str, str]:
    from tarnsift.plans.search import LIMIT, ORACLE_SQL as SEARCHES

    return {
        "K9_saved_notes": """
    SELECT p_partkey AS note_id, '2024-01-01-' || slug || CASE WHEN n > 1 THEN '-' || n ELSE '' END || '.md' AS name, TRUE AS saved FROM (
        SELECT *, row_number() OVER (PARTITION BY slug ORDER BY p_partkey % 2, p_partkey) AS n FROM (SELECT p_partkey, trim(substr(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-'), 1, 40), '-') AS slug FROM part))""",
        "K6_search_log_kept": f"""
    WITH found AS ({SEARCHES["R12_turns_against_documents"].replace(f"<= {LIMIT}", "<= 10")}), turns AS (SELECT concat_ws('/', conv_id, turn) AS search_id, text FROM conversations WHERE role = 'user' AND conv_id % 20 = 0)
    SELECT search_id, any_value(length(text))::INTEGER AS letters, coalesce(string_agg(doc_id::VARCHAR, ',' ORDER BY place), '') AS articles FROM turns LEFT JOIN found ON query_id = search_id GROUP BY search_id""",
        "K13_json_export": "SELECT user_id, count(*) AS calls, round(sum(value), 4) AS cost, list_sort(list(DISTINCT event_type)) AS kinds, arg_max(props, event_id) AS last FROM events GROUP BY user_id",
        "K14_migrated": "SELECT event_id, event_type, length(event_type)::INTEGER AS letters, 'copy' AS source FROM events",
        "S4_stacked_index": """
    SELECT label, min(n) AS first, max(n) AS last, count(*) AS vectors, max(len(embedding))::INTEGER AS size, TRUE AS whole, round(sum(total), 4) AS total FROM (
        SELECT *, row_number() OVER (ORDER BY label, vec_id) AS n, list_sum([x::DOUBLE for x in embedding]) AS total FROM embeddings) GROUP BY label""",
        "S16_changed_files": f"{_CHANGES_SQL} SELECT * FROM c ORDER BY path LIMIT {MOST_CHANGES}",
        "F15_chosen_files": f"""{_CHANGES_SQL}
    SELECT path, added + removed AS lines FROM c WHERE NOT "binary" AND NOT uncounted AND code <> 'D' AND NOT regexp_matches(path, '^src/1[^/]*/') AND NOT path GLOB '*.lock' ORDER BY lines DESC, path LIMIT {MOST_FILES}""",
        "R20_rewritten_queries": """
    WITH l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM conversations WHERE text IS NOT NULL),
    q AS (SELECT conv_id, turn, trim(line, ' ') AS q, min(n) AS n FROM l WHERE trim(line, ' ') <> '' GROUP BY ALL)
    SELECT conv_id, turn, array_to_string((list(q ORDER BY n))[1:2], '|') AS queries FROM q GROUP BY conv_id, turn""",
    }


ORACLE_SQL = _oracles()
