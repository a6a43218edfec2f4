import math
import random
from collections import deque
from functools import reduce

import duckdb
import pytest
from pyspark.sql import functions as F

from tarnsift import queries as core
from tarnsift.operators import cleaned
from tarnsift.operators.state import Task, admit, advance, candidate_queue, queue_fates, queued, rate_limited, state_machine
from tarnsift.plans import analytics, cleaning, lookups, records
from tarnsift.plans import state as plans
from tarnsift.plans.sql import TABLES
from tarnsift.streaming.limiter import limited_stream

SF = "/root/testdata/sf0.001"
SAMPLE = [*records.ORACLE_SQL, *cleaning.ORACLE_SQL, *lookups.ORACLE_SQL, "J11_page_at_offset", "R1_topk_cosine", "R9_two_stage", "U3_snapshot_diff", "G12_threshold_sweep", "W12_islands", "R12_keyword_score", "J22_branch_tree", "X2_sessions", "L4_char_budget"]


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("key", SAMPLE)
def test_query_equals_sql(spark, key):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    frame = core.QUERIES[key](spark, SF)
    columns = sorted(frame.columns)
    got = sorted([tuple(plain(v) for v in r) for r in frame.select(columns).collect()], key=str)
    rel = db.sql(core.ORACLE_SQL[key])
    at = [list(rel.columns).index(c) for c in columns]
    want = sorted([tuple(plain(r[i]) for i in at) for r in rel.fetchall()], key=str)
    assert got == want


def test_every_oracle_has_a_query():
    assert set(core.ORACLE_SQL) <= set(core.QUERIES)


def test_limiter_never_admits_more_than_the_rate(spark):
    rows = [(c, float(s * 7 % 200), s) for c in (1, 2) for s in range(120)]
    out = rate_limited(spark.createDataFrame(rows, "client long, seconds double, request_id long"), 5)
    when = {(c, r): s for c, s, r in rows}
    for client in (1, 2):
        times = sorted(when[client, r["request_id"]] for r in out.collect() if r["admitted"] and r["client"] == client)
        assert times and all(b - a >= 60 for a, b in zip(times, times[5:]))
    log: deque = deque()
    assert [admit(log, t, 2)[0] for t in (0, 1, 2, 60, 61)] == [True, True, False, True, True]
    assert admit(deque([0.5, 1.0]), 2.0, 2) == (False, math.ceil(58.5))


def plain_queue(arrivals, places, most, patience):
    """The queue in steps of a quarter second."""
    out, busy, waiting, t = {}, [], [], 0.0
    pending = list(enumerate(arrivals))
    while pending or waiting:
        busy = [b for b in busy if b > t]
        while waiting and len(busy) < places and t <= arrivals[waiting[0]][0] + patience:
            k = waiting.pop(0)
            out[k] = ("served", t)
            busy.append(t + arrivals[k][1])
        while waiting and t >= arrivals[waiting[0]][0] + patience:
            out[waiting.pop(0)] = ("timed out", None)
            while waiting and len(busy) < places:
                k = waiting.pop(0)
                out[k] = ("served", t)
                busy.append(t + arrivals[k][1])
        while pending and pending[0][1][0] <= t:
            k, (_, work) = pending.pop(0)
            if len(busy) < places and not waiting:
                out[k] = ("served", t)
                busy.append(t + work)
            elif len(waiting) >= most:
                out[k] = ("full", None)
            else:
                waiting.append(k)
        t += 0.25
    return [out[k] for k in range(len(arrivals))]


def test_queue_against_small_steps():
    rng = random.Random(4)
    for _ in range(200):
        arrivals = sorted((rng.randrange(0, 200) / 4, rng.randrange(1, 60) / 4) for _ in range(rng.randrange(12)))
        places, most = rng.choice((1, 2)), rng.choice((1, 2, 4))
        assert queue_fates(arrivals, places, most, 10.0) == plain_queue(arrivals, places, most, 10.0)
    assert queue_fates([(0.0, 5.0), (1.0, 1.0)]) == [("served", 0.0), ("served", 5.0)]


def test_queue_and_candidates_as_frames(spark):
    rows = [(s, 10 * s + k, float(k), 1.5) for s in (1, 2) for k in range(8)]
    out = {r["request_id"]: (r["fate"], r["began"]) for r in queued(spark.createDataFrame(rows, "server long, request_id long, arrived double, work double")).collect()}
    for s in (1, 2):
        assert [out[10 * s + k] for k in range(8)] == queue_fates([(float(k), 1.5) for k in range(8)])
    moves = [(1, 1, "a", "x", "propose"), (1, 2, "a", "y", "propose"), (1, 3, "a", None, "accept"), (1, 4, "a", "y", "propose"), (1, 5, "a", None, "reject"), (1, 6, "b", "z", "propose"), (1, 7, "b", None, "reject")]
    got = [tuple(r)[3:] for r in candidate_queue(spark.createDataFrame(moves, "session long, seq long, key string, value string, action string")).orderBy("seq").collect()]
    assert got == [("proposed", None, "x", 1), ("supersedes", None, "y", 1), ("accepted", "y", None, 0), ("same as stored", "y", None, 0), ("nothing waits", "y", None, 0), ("proposed", None, "z", 1), ("rejected", None, None, 0)]


def test_limiter_on_a_stream(spark, tmp_path):
    rows = [(k, k % 3, float(k * 7 % 40 + 40 * (k // 40))) for k in range(120)]
    for part in range(3):
        spark.createDataFrame(rows[part * 40 : part * 40 + 40], "request_id long, client long, seconds double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("request_id long, client long, seconds double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = limited_stream(stream, 4).writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    whole = rate_limited(spark.createDataFrame(rows, "request_id long, client long, seconds double"), 4)
    order = ["request_id", "client", "admitted", "retry_after"]
    assert sorted(map(tuple, spark.table("limited").select(order).collect())) == sorted(map(tuple, whole.select(order).collect()))


def test_state_machine_steps():
    play = lambda *events: reduce(lambda t, e: advance(t, *e)[0], events, Task())
    plan = (("start",), ("plan approved", "tracker", (2, 1)))
    task = play(*plan, ("step done", "tracker", ("first",)), ("step done", "tracker", ("second",)))
    assert task == Task("validation", 1, False, 2, 1, ("first", "second"))
    assert advance(task, "check passed", "tracker")[0].stage == "done" and advance(task, "back to step", "tracker", (2,))[0] == Task("execution", 2, False, 2, 1, ("first", ""))
    assert advance(task, "back to plan", "human")[0] == Task("planning", 1, False, 2, 1, ("", ""))
    one = play(*plan)
    why = {
        ("begin",): "unknown event", ("start",): "not from execution", ("step done", "human"): "not by human", ("resume", "human"): "not paused", ("back to step", "tracker", (3,)): "no such step",
        ("back to step", "tracker", (1,)): "not a step back", ("cancel", "human", (), "forbid"): "forbidden", ("step done", "tracker", (), "confirm"): "waits for confirmation",
    }
    assert {e: advance(one, *e)[1] for e in why} == why
    assert advance(one, "step done", "tracker", (), "confirm")[0].pending == "step done" and advance(one, "step done", "tracker", (), "confirm", True)[1] == "ok"
    assert advance(play(*plan, ("pause",)), "step done", "tracker")[1] == "paused" and advance(play(*plan, ("pause",)), "resume")[0] == one
    assert advance(Task("planning", 1), "plan approved", "tracker", (11, 1))[1] == "plan out of bounds" and advance(Task("done"), "reopen")[1] == "no checks"


def test_state_machine_over_events(spark):
    events = plans.task_events(spark, SF)
    got = {(r["task"], r["seq"]): (r["stage"], r["step"], r["paused"], r["results"], r["pending"], r["outcome"]) for r in state_machine(events).collect()}
    now, outcomes = {}, set()
    for r in sorted(events.collect(), key=lambda r: (r["task"], r["seq"])):
        data = tuple(map(int, r["data"])) if r["event"] in ("plan approved", "back to step") else tuple(r["data"])
        task, outcome = advance(now.get(r["task"], Task()), r["event"], r["source"], data, r["guard"], r["confirmed"])
        now[r["task"]] = task
        outcomes.add(outcome)
        assert got[r["task"], r["seq"]] == (task.stage, task.step, task.paused, list(task.results), task.pending, outcome)
    assert len(outcomes) > 6


def test_islands_are_dealt_by_their_rows(spark, tmp_path, monkeypatch):
    """Tasks follow the rows, with whole suppliers in each; rows repeated do not break an island."""
    rows = [(s, k) for s in range(40) for k in range(30) if (s + k) % 7] * 2
    spark.createDataFrame(rows, "l_suppkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(analytics, "ISLAND_ROWS", 100, raising=False)
    found = analytics.QUERIES["W12_islands"](spark, str(tmp_path))
    assert found.rdd.getNumPartitions() == -(-len(rows) // 100)
    have, want = set(rows), set()
    for s, k in have:
        if (s, k - 1) not in have:
            last = k
            while (s, last + 1) in have:
                last += 1
            want.add((s, k, last))
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_places_are_told_by_their_pieces(spark):
    """Every place of a clean text, at joints, cut words and removed signs too, as raw_places and the whole texts say; one shuffle."""
    raw = ["First line.\nsecond goes on-\nhere  and\u00adthere \u00ad x\n\n 12\n-- Third\nLast-\nA", "one", "cut-\nword-\nagain\n•\n\tTab  two", "\u00ad\n \n"]
    docs = spark.createDataFrame(list(enumerate(raw)), "doc_id long, text string")
    lines = cleaned.raw_lines(docs).withColumn("page", F.lit(1)).withColumn("size", F.lit(9.0))
    kept = cleaned.pieces(cleaned.dropped(lines))
    texts = {r["doc_id"]: r["text"] for r in cleaned.clean_texts(kept).collect()}
    for step in (1, 4):
        asked = [(d, p) for d, t in texts.items() for p in range(0, len(t), step)]
        led = {(r["doc_id"], r["place"]): r["raw_place"] for r in cleaned.raw_places(kept, spark.createDataFrame(asked, "doc_id long, place long")).collect()}
        found = cleaned.places_every(kept, step)
        assert sorted(map(tuple, found.collect())) == sorted((d, p, at, texts[d][p], raw[d][at : at + 1]) for (d, p), at in led.items())
        assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 2  # printed twice: initial and final
