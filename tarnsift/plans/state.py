"""Stateful queries over events: limiter, state machine, event-time windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnsift.operators.state import candidate_queue, queued, rate_limited, state_machine
from tarnsift.session import scratch_dir, table
from tarnsift.streaming.ordered import PROVIDER, candidates, tasks
from tarnsift.streaming.windows import sessions, tumbling_counts


def z3_rate_limiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event-log hour stands for a minute, so that limits are met."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("client"), (F.col("ts").cast("timestamp").cast("double") / 3600).alias("seconds"), F.col("event_id").alias("request_id"))
    return rate_limited(rows, 2)


#: A run through a task that meets every transition; events take their turns from it.
_SCRIPT = ("start", "plan approved", "step done", "pause", "step done", "resume", "step done", "back to step", "step done", "step done", "check passed", "back to plan",
           "plan approved", "step done", "step done", "step done", "check passed", "check passed", "reopen", "check passed", "cancel", "check passed")


def task_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users stand for tasks. Some events come from the wrong side, some are guarded."""
    events = table(spark, sf_dir, "events")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    rows = events.withColumn("n", n).withColumn("event", F.get(F.array(*[F.lit(e) for e in _SCRIPT]), F.col("n") % len(_SCRIPT)))
    human = F.col("event").isin("start", "cancel", "reopen")
    data = F.when(F.col("event") == "plan approved", F.array(F.lit("3"), F.lit("2"))).when(F.col("event") == "back to step", F.array((F.col("n") % 3 + 1).cast("string"))).otherwise(F.array("event_type"))
    return rows.select(
        F.col("user_id").alias("task"), F.col("event_id").alias("seq"), "event", F.when(human != (F.col("value") < 1), "human").otherwise("tracker").alias("source"), data.alias("data"),
        F.when(F.col("value") > 80, "forbid").when(F.col("value") > 60, "confirm").otherwise("").alias("guard"), (F.col("event_id") % 2 == 0).alias("confirmed"),
    )


def z6_state_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state_machine(task_events(spark, sf_dir))


def z4_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users stand for servers, an hour for a second; a request works as long as its value says."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("server"), F.col("event_id").alias("request_id"), (F.col("ts").cast("timestamp").cast("double") / 3600).alias("arrived"), F.col("value").alias("work"))
    return queued(rows)


def z5_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first check that fails decides: key, size, shape, rate, then the queue before the model."""
    events = table(spark, sf_dir, "events")
    early = F.when(F.col("user_id") % 7 == 0, 401).when(F.length("props") > 40, 413).when(F.get_json_object("props", "$.k").isNull(), 400)
    rows = events.select("event_id", "user_id", "value", (F.col("ts").cast("timestamp").cast("double") / 3600).alias("seconds"), early.alias("early"))
    passed = rows.filter(F.col("early").isNull())
    limited = rate_limited(passed.select(F.col("user_id").alias("client"), "seconds", F.col("event_id").alias("request_id")), 10).select(F.col("request_id").alias("event_id"), "admitted", "retry_after")
    let_in = passed.join(limited.filter("admitted"), "event_id")
    fates = queued(let_in.select(F.col("user_id").alias("server"), F.col("event_id").alias("request_id"), F.col("seconds").alias("arrived"), F.col("value").alias("work")))
    out = rows.join(limited, "event_id", "left").join(fates.select(F.col("request_id").alias("event_id"), "fate"), "event_id", "left")
    status = F.coalesce("early", F.when(~F.col("admitted"), 429), F.when(F.col("fate") != "served", 503), F.lit(200))
    return out.select("event_id", status.alias("status"), F.when(status == 429, F.col("retry_after")).alias("retry_after"))


def candidate_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("session"), F.col("event_id").alias("seq"), F.col("event_type").alias("key"), (F.col("value") % 3).cast("int").cast("string").alias("value"),
        F.when(F.col("event_id") % 3 == 0, "accept").when(F.col("event_id") % 7 == 0, "reject").otherwise("propose").alias("action"))


def u8_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidate_queue(candidate_moves(spark, sf_dir))


#: Arrivals that a stream is run over one after another; seconds that an event comes late at most.
ARRIVALS, LATE = 3, 1800


def streamed(rows: DataFrame, key: str, fold: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """What fold makes of rows as a stream: they come in ARRIVALS parts, up to LATE seconds late, a fifth of them twice. The
    stream is stopped and started again between the parts; a last event far in the future lets all others through."""
    spark, folder = rows.sparkSession, scratch_dir(rows.sparkSession)
    first, last = rows.agg(F.min(F.col("at").cast("double")), F.max(F.col("at").cast("double"))).first()
    if first is None:
        return spark.createDataFrame([], fold(rows, "1 hour").schema)
    shift = lambda salt: F.pmod(F.xxhash64("seq", F.lit(salt)), F.lit(LATE))
    part = lambda salt: F.floor((F.col("at").cast("double") + shift(salt) - first) / (last - first + 1) * ARRIVALS)
    both = rows.withColumn("_part", part(1)).union(rows.filter("seq % 5 = 0").withColumn("_part", part(2)))
    end = rows.limit(1).withColumn(key, F.lit(-1).cast(dict(rows.dtypes)[key])).withColumn("at", F.timestamp_seconds(F.lit(last + 10 * 86400)))
    provider = spark.conf.get(PROVIDER[0])
    spark.conf.set(*PROVIDER)
    try:
        for k in range(ARRIVALS + 1):
            arrived = both.filter(F.col("_part") == k) if k < ARRIVALS else both.filter(F.col("_part") >= k)
            arrived = arrived.drop("_part").union(end) if k == ARRIVALS else arrived.drop("_part")
            arrived.write.mode("append").parquet(f"{folder}/arrived")
            stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/arrived")
            out = fold(stream, f"{2 * LATE} seconds").writeStream.format("parquet").option("path", f"{folder}/folded").option("checkpointLocation", f"{folder}/checkpoint")
            out.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(PROVIDER[0], provider)
    return spark.read.schema(fold(rows.limit(0), "1 hour").schema).parquet(f"{folder}/folded").filter(F.col(key) != -1)


def z6_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The task state machine as a stream: late and repeated events give what the ordered table gives."""
    times = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("at"))
    events = task_events(spark, sf_dir).withColumn("position", F.col("seq")).join(times, "seq")
    return streamed(events, "task", tasks)


def u8_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidate queue as a stream: late and repeated moves give what the ordered table gives."""
    times = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("at"))
    return streamed(candidate_moves(spark, sf_dir).join(times, "seq"), "session", candidates)


def window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tumbling_counts(table(spark, sf_dir, "events"))


def window_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(table(spark, sf_dir, "events"))


QUERIES = {"Z3_rate_limiter": z3_rate_limiter, "Z6_state_machine": z6_state_machine, "Z4_queue": z4_queue, "Z5_admission_pipeline": z5_admission, "U8_candidates": u8_candidates, "Z6_state_machine_stream": z6_stream, "U8_candidates_stream": u8_stream, "X1_tumbling_windows": window_counts, "X2_sessions": window_sessions}
_CANDIDATES_SQL = """
    WITH RECURSIVE moves AS (
        SELECT user_id AS session, event_id AS seq, event_type AS key, trunc(value % 3)::INTEGER::VARCHAR AS value,
               CASE WHEN event_id % 3 = 0 THEN 'accept' WHEN event_id % 7 = 0 THEN 'reject' ELSE 'propose' END AS action,
               row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events),
    fold AS (
        SELECT session, key, n, seq, 0 AS was, CASE WHEN action = 'propose' THEN 'proposed' ELSE 'nothing waits' END AS outcome,
               NULL::VARCHAR AS stored, CASE WHEN action = 'propose' THEN value END AS waiting FROM moves WHERE n = 1
        UNION ALL
        SELECT m.session, m.key, m.n, m.seq, (f.waiting IS NOT NULL)::INT,
               CASE WHEN action = 'propose' THEN CASE WHEN m.value = f.stored THEN 'same as stored' WHEN f.waiting IS NOT NULL THEN 'supersedes' ELSE 'proposed' END
                    WHEN f.waiting IS NULL THEN 'nothing waits' ELSE action || 'ed' END,
               CASE WHEN action = 'accept' AND f.waiting IS NOT NULL THEN f.waiting ELSE f.stored END,
               CASE WHEN action = 'propose' AND m.value IS DISTINCT FROM f.stored THEN m.value END
        FROM fold AS f JOIN moves AS m ON m.session = f.session AND m.key = f.key AND m.n = f.n + 1)
    SELECT session, seq, key, outcome, stored, waiting, (sum((waiting IS NOT NULL)::INT - was) OVER (PARTITION BY session ORDER BY seq))::BIGINT AS queue FROM fold"""

ORACLE_SQL = {
    "U8_candidates": _CANDIDATES_SQL,
    "U8_candidates_stream": _CANDIDATES_SQL,
    "X1_tumbling_windows": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL",
    "X2_sessions": """
    SELECT user_id, min(ts) AS session_start, count(*) AS n FROM (
        SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM (
            SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events))
    GROUP BY user_id, session""",
}
