"""Retrieval queries: exact cosine top-k and what is built on it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnsift.operators.similarity import top_cosine
from tarnsift.session import table

TOP = 5
#: Query vectors are a stated set: every row whose id this number divides, against all rows.
QUERY_STEP = 20


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    vectors = table(spark, sf_dir, "embeddings")
    queries = vectors.filter(F.col("vec_id") % QUERY_STEP == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"), F.col("label").alias("query_label"))
    chunks = vectors.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), F.col("label").alias("chunk_label"))
    return queries, chunks


def r1_topk_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, chunks = _sides(spark, sf_dir)
    return top_cosine(queries, chunks, TOP, masked=True).select("query_id", "chunk_id", "score", "rank")


_SCORED = """
    SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, q.label AS query_label, c.label AS chunk_label,
           round(list_inner_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS score
    FROM embeddings q JOIN embeddings c ON {on} WHERE q.vec_id % 20 = 0"""

QUERIES = {"R1_topk_cosine": r1_topk_cosine}
ORACLE_SQL = {
    "R1_topk_cosine": f"""
    SELECT query_id, chunk_id, score, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
        FROM ({_SCORED.format(on='q.label = c.label')})) WHERE rank <= 5""",
}


def _answer(body: str) -> str:
    """SQL over the scored candidates of every query, ranked by score, ties by chunk."""
    scored = _SCORED.format(on="true")
    return f"""
    WITH scored AS ({scored}),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS place FROM scored),
    candidates AS (SELECT *, CAST(round(score * 1000000) AS BIGINT) * (20 - abs(query_label - chunk_label)) / 20000000.0::DOUBLE AS second_score FROM ranked WHERE place <= 20),
    reranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY second_score DESC, place) AS second_place FROM candidates)
    {body}"""


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage 1: 20 candidates of every query; stage 2 rescoring by a stand-in for a pair scorer."""
    queries, chunks = _sides(spark, sf_dir)
    rows = top_cosine(queries, chunks, CANDIDATES).withColumnRenamed("rank", "place")
    rows = rows.withColumn("second_score", F.round(F.col("score") * 1000000).cast("long") * (20 - F.abs(F.col("query_label") - F.col("chunk_label"))) / F.lit(20000000.0))
    return rows.withColumn("second_place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("second_score"), "place")).cast("long"))


def r9_two_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _candidates(spark, sf_dir).filter((F.col("second_score") >= THRESHOLD) & (F.col("second_place") <= TOP))
    return rows.select("query_id", "chunk_id", "second_score", "second_place")


def f20_fate(spark: SparkSession, sf_dir: str) -> DataFrame:
    fate = F.when(F.col("second_score") < THRESHOLD, "below threshold").when(F.col("second_place") > TOP, "beyond top").otherwise("kept")
    return _candidates(spark, sf_dir).select("query_id", "chunk_id", fate.alias("fate"))


def r6_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries of one label are spellings of one question: the best score of each chunk, and the first query with it."""
    best = Window.partitionBy("query_label", "chunk_id").orderBy(F.desc("second_score"), "query_id")
    rows = _candidates(spark, sf_dir).withColumn("n", F.row_number().over(best)).filter("n = 1")
    return rows.select("query_label", "chunk_id", "query_id", "second_score")


def r7_score_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir).groupBy("query_label", "chunk_id").agg(F.max("score").alias("score"))


def r11_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of the first chunk of the expected label before and after the second stage."""
    same = F.col("query_label") == F.col("chunk_label")
    return _candidates(spark, sf_dir).groupBy("query_id").agg(F.min(F.when(same, F.col("place"))).alias("before"), F.min(F.when(same, F.col("second_place"))).alias("after"))


def g12_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = spark.createDataFrame([(t,) for t in SWEEP], "threshold double")
    rows = _candidates(spark, sf_dir).join(F.broadcast(steps), F.col("second_score") >= F.col("threshold"))
    kept = rows.filter(F.col("second_place") <= TOP)
    return kept.groupBy("threshold").agg(F.count("*").alias("excerpts"), F.countDistinct("query_id").alias("answered"))


def r2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage 1 of one strategy: the nearest chunks of the query's label, or the reason why there are none."""
    queries, chunks = _sides(spark, sf_dir)
    found = top_cosine(queries, chunks.filter("chunk_label < 5"), 3, masked=True).select("query_id", "chunk_id", "rank")
    rows = queries.select("query_id", "query_label").join(found, "query_id", "left")
    return rows.select("query_id", "chunk_id", "rank", F.when(F.col("chunk_id").isNull(), F.concat(F.lit("no chunks of label "), "query_label")).alias("problem"))


def r3_batch_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every query on every strategy (here: the half of the chunks by parity), three best of each, with second scores."""
    queries, chunks = _sides(spark, sf_dir)
    halves = [top_cosine(queries, chunks.filter(F.col("chunk_id") % 2 == half), 3).withColumn("strategy", F.lit(half)) for half in (0, 1)]
    return halves[0].unionByName(halves[1]).select("strategy", "query_id", "chunk_id", "rank", "score")


def r5_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-stage search that falls back to stage 1 where the second score of any candidate is not finite (here: of
    queries with an odd label), and may rightly be empty otherwise."""
    rows = _candidates(spark, sf_dir)
    broken = F.max((F.col("query_label") % 2 == 1).cast("int")).over(Window.partitionBy("query_id")) == 1
    rows = rows.withColumn("broken", broken)
    kept = rows.filter(F.when(F.col("broken"), F.col("place") <= TOP).otherwise((F.col("second_score") >= 0.5) & (F.col("second_place") <= TOP)))
    return kept.select("query_id", "chunk_id", "broken", F.when(F.col("broken"), F.col("place")).otherwise(F.col("second_place")).alias("n"))


def r10_two_corpora(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three best of one corpus, then five of the other without excluded sources, numbered on."""
    queries, chunks = _sides(spark, sf_dir)
    first = top_cosine(queries, chunks.filter("chunk_label < 3"), 3).select("query_id", "chunk_id", F.col("rank").alias("n"))
    second = top_cosine(queries, chunks.filter("chunk_label >= 3 AND chunk_label <> 7"), 5).select("query_id", "chunk_id", (F.col("rank") + 3).alias("n"))
    return first.unionByName(second)


def f1_masked_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many chunks the mask leaves for each query."""
    queries, chunks = _sides(spark, sf_dir)
    per_label = chunks.groupBy(F.col("chunk_label").alias("query_label")).agg(F.count("*").alias("chunks"))
    return queries.select("query_id", "query_label").join(F.broadcast(per_label), "query_label").select("query_id", "chunks")


#: Candidates of stage 1, least second score, thresholds of the sweep.
CANDIDATES, THRESHOLD, SWEEP = 20, 0.10, (0.02, 0.05, 0.10, 0.20, 0.30, 0.50)
_EXTRA = {
    "R9_two_stage": (r9_two_stage, "SELECT query_id, chunk_id, second_score, second_place FROM reranked WHERE second_score >= 0.1 AND second_place <= 5"),
    "F20_fate": (f20_fate, "SELECT query_id, chunk_id, CASE WHEN second_score < 0.1 THEN 'below threshold' WHEN second_place > 5 THEN 'beyond top' ELSE 'kept' END AS fate FROM reranked"),
    "R6_multi_query_fusion": (r6_fusion, "SELECT query_label, chunk_id, query_id, second_score FROM (SELECT *, row_number() OVER (PARTITION BY query_label, chunk_id ORDER BY second_score DESC, query_id) AS n FROM reranked) WHERE n = 1"),
    "R7_score_fusion": (r7_score_fusion, "SELECT query_label, chunk_id, max(score) AS score FROM candidates GROUP BY ALL"),
    "R11_placement": (r11_placement, "SELECT query_id, min(CASE WHEN query_label = chunk_label THEN place END) AS before, min(CASE WHEN query_label = chunk_label THEN second_place END) AS after FROM reranked GROUP BY query_id"),
    "G12_retrieval_sweep": (g12_sweep, "SELECT t.threshold::DOUBLE AS threshold, count(*) AS excerpts, count(DISTINCT query_id) AS answered FROM reranked JOIN (VALUES (0.02), (0.05), (0.1), (0.2), (0.3), (0.5)) t(threshold) ON second_score >= t.threshold WHERE second_place <= 5 GROUP BY 1"),
}
_TOP_OF = """SELECT query_id, chunk_id, n{more} FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS n FROM scored WHERE {rows}) WHERE n <= {k}"""
_EXTRA |= {
    "F1_masked_counts": (f1_masked_counts, "SELECT query_id, count(*) AS chunks FROM scored WHERE query_label = chunk_label GROUP BY query_id"),
    "R2_nearest": (r2_nearest, f"""SELECT q.vec_id AS query_id, t.chunk_id, t.n AS rank, CASE WHEN t.chunk_id IS NULL THEN 'no chunks of label ' || q.label END AS problem
        FROM embeddings q LEFT JOIN ({_TOP_OF.format(more="", rows="query_label = chunk_label AND chunk_label < 5", k=3)}) t ON t.query_id = q.vec_id WHERE q.vec_id % 20 = 0"""),
    "R3_batch_probe": (r3_batch_probe, " UNION ALL ".join(f"SELECT {half} AS strategy, query_id, chunk_id, n AS rank, score FROM ({_TOP_OF.format(more=', score', rows=f'chunk_id % 2 = {half}', k=3)})" for half in (0, 1))),
    "R5_fallback": (r5_fallback, """SELECT query_id, chunk_id, query_label % 2 = 1 AS broken, CASE WHEN query_label % 2 = 1 THEN place ELSE second_place END AS n FROM reranked
        WHERE CASE WHEN query_label % 2 = 1 THEN place <= 5 ELSE second_score >= 0.5 AND second_place <= 5 END"""),
    "R10_two_corpora": (r10_two_corpora, f"{_TOP_OF.format(more='', rows='chunk_label < 3', k=3)} UNION ALL SELECT query_id, chunk_id, n + 3 FROM ({_TOP_OF.format(more='', rows='chunk_label >= 3 AND chunk_label <> 7', k=5)})"),
}
QUERIES |= {k: f for k, (f, _) in _EXTRA.items()}
ORACLE_SQL |= {k: _answer(sql) for k, (_, sql) in _EXTRA.items()}
