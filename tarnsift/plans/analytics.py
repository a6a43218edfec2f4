"""Evaluation roll-ups, run statistics, windows and accounting over event logs and conversations.

event_type stands for the mode, the hour for the repeat, value for the elapsed seconds; a value under 5 is a
failed turn where a rule needs one.
"""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnsift.plans.sql import pairs
from tarnsift.session import table

QUERIES, ORACLE_SQL = pairs({
    "G9_answer_stats": """
        SELECT count(*) AS turns, count_if(role = 'assistant') AS answers, count_if(length(text) < 200) AS short_turns,
               count_if(role = 'assistant' AND length(text) < 200) AS short_answers, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations""",
    "G11_mode_summary": """
        SELECT event_type, count(*) AS turns, count_if(value < 5) AS failed, round(sum(CASE WHEN value >= 5 THEN value END), 4) AS total
        FROM events GROUP BY event_type""",
    "G12_threshold_sweep": """
        SELECT t.threshold, count(e.event_id) AS kept, count(DISTINCT e.user_id) AS users
        FROM (VALUES (2.0), (5.0), (10.0), (20.0), (30.0), (50.0)) AS t(threshold)
        LEFT JOIN events e ON e.value >= t.threshold GROUP BY t.threshold""",
    "G15_quality": """
        SELECT source, count(*) AS n, count(quality) AS judged, count_if(quality = 1) AS good, count_if(toxic = 1) AS toxic
        FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""",
    "G16_speed": """
        SELECT event_type, round(median(CASE WHEN value >= 5 THEN value END), 6) AS usable_median, round(max(value), 6) AS longest,
               round(sum(value), 4) AS cost FROM events GROUP BY event_type""",
    "G18_stability": """
        SELECT user_id, event_type, count(*) AS repeats, count(DISTINCT props) AS texts, count(DISTINCT props) = 1 AS all_same
        FROM events GROUP BY user_id, event_type HAVING count(*) >= 2""",
    "G19_rollup": """
        SELECT event_type, count(*) AS questions, count_if(texts = 1) AS stable, CAST(max(texts) AS BIGINT) AS worst FROM (
            SELECT user_id, event_type, count(DISTINCT props) AS texts FROM events GROUP BY user_id, event_type) x GROUP BY event_type""",
    "G20_pivot": """
        SELECT user_id, count_if(event_type = 'click') AS clicks, count_if(event_type = 'view') AS views,
               count_if(event_type NOT IN ('click', 'view')) AS others FROM events GROUP BY user_id""",
    "G23_load_rollup": """
        SELECT event_type, min(value) AS fastest, max(value) AS slowest, count(*) AS n, count_if(value > 50) AS unexpected FROM events GROUP BY event_type""",
    "G24_agent_rollup": """
        SELECT user_id, count(*) AS turns, round(avg(value), 6) AS mean_value, CAST(sum(length(props)) AS BIGINT) AS tokens FROM events GROUP BY user_id""",
    "G25_running_totals": "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ROLLUP (event_type)",
    "G26_calibration": """
        SELECT event_type, round(sum(value) / nullif(CAST(sum(length(props)) AS DOUBLE), 0), 8) AS calibration FROM events GROUP BY event_type""",
    "G28_G29_null_sums": """
        SELECT user_id, round(sum(cost), 4) AS any_known, round(CASE WHEN count(*) = count(cost) THEN sum(cost) END, 4) AS all_known
        FROM (SELECT user_id, CASE WHEN value >= 5 THEN value END AS cost FROM events) x GROUP BY user_id""",
    "G31_tool_counts": "SELECT role, count(*) AS calls FROM conversations GROUP BY role",
    "G32_dominant": """
        SELECT source, lang FROM (
            SELECT source, lang, row_number() OVER (PARTITION BY source ORDER BY sum(n_chars) DESC, lang) AS n FROM documents GROUP BY source, lang) x WHERE n = 1""",
    "G33_heaviest_message": """
        SELECT conv_id, turn FROM (
            SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS n FROM conversations) x WHERE n = 1""",
    "G35_column_minima": """
        SELECT supplier.s_suppkey, s_nationkey, s_acctbal FROM supplier JOIN (
            SELECT s_nationkey AS k, min(s_acctbal) AS least FROM supplier GROUP BY s_nationkey) m ON k = s_nationkey AND s_acctbal = least""",
    "G1_chunk_metrics": """
        SELECT lang, source, count(*) AS n, min(n_chars) AS least, CAST(median(n_chars) AS DOUBLE) AS mid, max(n_chars) AS most, count_if(n_chars > 1600) AS over_limit
        FROM documents GROUP BY GROUPING SETS ((lang), (lang, source))""",
    "G7_run_stats": """
        SELECT user_id, count(*) AS total, count_if(value >= 5) AS ok, count_if(value < 5) AS failed, max(CASE WHEN value < 5 THEN event_id END) AS last_failed,
               min(CASE WHEN value >= 5 THEN event_id END) AS first_ok FROM events GROUP BY user_id""",
    "G8_section_totals": """
        SELECT source, count(*) AS declared, count(l.doc_id) AS read_rows, count(*) <> count(l.doc_id) AS incomplete
        FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY source""",
    "W2_last_n": """
        SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) x WHERE n <= 6""",
    "W4_tail": """
        SELECT conv_id, least(greatest(count(*) - 6, 0), CAST(floor(count(*) / 6) * 6 AS BIGINT)) AS tail_start FROM conversations GROUP BY conv_id""",
    "W5_cumulative": """
        SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS cost FROM events""",
    "W6_change_points": """
        SELECT event_id, user_id, event_type FROM (
            SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events) x WHERE was IS DISTINCT FROM event_type""",
    "W8_previous_run": """
        SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events WHERE value >= 5""",
    "W10_last_user_message": """
        SELECT conv_id, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations WHERE role = 'user') x WHERE n = 1""",
    "W11_retry_estimate": """
        SELECT event_id, greatest(1, CAST(ceil(3 * avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) AS BIGINT)) AS wait FROM events""",
    "W12_islands": """
        SELECT l_suppkey, min(l_partkey) AS first_key, max(l_partkey) AS last_key FROM (
            SELECT l_suppkey, l_partkey, l_partkey - row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey) AS island
            FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) d) x GROUP BY l_suppkey, island""",
    "W13_steps": """
        SELECT user_id, step, min(event_id) AS first_event, count(*) AS calls FROM (
            SELECT *, sum(CASE WHEN was = event_type THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS step
            FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events) y) x GROUP BY user_id, step""",
    "L4_char_budget": """
        SELECT conv_id, turn FROM (
            SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used FROM conversations) x WHERE used <= 2000""",
    "U7_kv_merge": """
        SELECT user_id, event_type AS k, v FROM (
            SELECT user_id, event_type, CASE WHEN value >= 5 THEN props END AS v, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) x
        WHERE n = 1 AND v IS NOT NULL""",
    "U11_branch": "SELECT conv_id, turn, role, 'branch-1' AS branch_id FROM conversations WHERE turn < 3",
    "U10_first_occurrence": """
        SELECT doc_id, text FROM documents WHERE doc_id IN (SELECT min(doc_id) FROM documents GROUP BY md5(text))""",
    "F10_period_filter": """
        SELECT event_id, value >= 5 AS ok FROM events, (SELECT max(ts) AS now FROM events) m WHERE ts >= now - INTERVAL 7 DAY""",
    "F12_freshness": """
        SELECT user_id, max(ts) >= max(now) - INTERVAL 2 DAY AS fresh FROM events, (SELECT max(ts) AS now FROM events) m GROUP BY user_id""",
    "F13_usable_turns": """
        SELECT event_id FROM (SELECT *, lag(value >= 5) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev_ok FROM events) x
        WHERE value >= 5 AND coalesce(prev_ok, true)""",
    "F15_file_selection": """
        SELECT l_orderkey, changes FROM (SELECT l_orderkey, count(*) AS changes FROM lineitem WHERE l_returnflag <> 'R' GROUP BY l_orderkey) x
        ORDER BY changes DESC, l_orderkey LIMIT 20""",
    "F24_strictest_guard": """
        SELECT user_id, event_type FROM (
            SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN value < 5 THEN 0 ELSE 1 END, ts, event_id) AS n FROM events) x WHERE n = 1""",
    "Z1_next_due": """
        SELECT user_id, CASE WHEN max_by(value, event_id) < 5 THEN max(ts) + INTERVAL 15 MINUTE ELSE max(ts) + INTERVAL 1 DAY END AS due FROM events GROUP BY user_id""",
    "Z5_admission": """
        SELECT event_id, CASE WHEN user_id % 7 = 0 THEN 401 WHEN length(props) > 40 THEN 413 WHEN value < 0 THEN 400 WHEN value > 90 THEN 503 ELSE 200 END AS status FROM events""",
    "T37_plural": """
        SELECT c_custkey, CASE WHEN c_custkey % 10 = 1 AND c_custkey % 100 <> 11 THEN 'one'
               WHEN c_custkey % 10 BETWEEN 2 AND 4 AND NOT c_custkey % 100 BETWEEN 12 AND 14 THEN 'few' ELSE 'many' END AS form FROM customer""",
})

#: Rows of lineitem in a task of the islands, about.
ISLAND_ROWS = 500_000


def w12_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of part numbers without a gap, by supplier. Equal rows have one dense rank, so they need not be taken out first; tasks are as
    many as the rows ask for, each with whole suppliers."""
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey")
    dealt = rows.repartition(max(spark.sparkContext.defaultParallelism, -(-rows.count() // ISLAND_ROWS)), "l_suppkey")
    island = F.col("l_partkey") - F.dense_rank().over(Window.partitionBy("l_suppkey").orderBy("l_partkey"))
    return dealt.withColumn("island", island).groupBy("l_suppkey", "island").agg(F.min("l_partkey").alias("first_key"), F.max("l_partkey").alias("last_key")).drop("island")


QUERIES["W12_islands"] = w12_islands
