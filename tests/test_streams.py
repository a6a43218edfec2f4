"""Folds on streams against the same folds over ordered tables: late events, repeats, restarts."""

import datetime
import random
from types import SimpleNamespace

import pandas as pd
import pytest

from tarnsift.operators.state import candidate_queue, state_machine
from tarnsift.plans import state
from tarnsift.streaming import ordered

SF = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def provider(spark):
    was = spark.conf.get(ordered.PROVIDER[0])
    spark.conf.set(*ordered.PROVIDER)
    yield
    spark.conf.set(ordered.PROVIDER[0], was)


def run(spark, tmp_path, parts, schema, fold, delay):
    """What a stream that is started once a part has written after the last."""
    for part in parts:
        spark.createDataFrame(part, schema).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        out = fold(stream, delay).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "checkpoint"))
        out.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(str(tmp_path / "out"))


def test_candidates_in_any_order_within_the_delay(spark, tmp_path):
    rng, begin = random.Random(6), datetime.datetime(2024, 1, 1)
    moves = [(k % 3, k, begin + datetime.timedelta(minutes=k), rng.choice("ab"), rng.choice("12"), rng.choice(("propose", "propose", "accept", "reject"))) for k in range(90)]
    schema = "session long, seq long, at timestamp, key string, value string, action string"
    arrival = sorted(moves + rng.sample(moves, 20), key=lambda m: m[1] + rng.random() * 25)
    parts = [arrival[:40], arrival[40:80], [*arrival[80:], (-1, -1, begin + datetime.timedelta(days=9), "x", "x", "propose")]]
    got = run(spark, tmp_path, parts, schema, ordered.candidates, "30 minutes")
    want = candidate_queue(spark.createDataFrame(moves, schema).select("session", "seq", "key", "value", "action"))
    columns = want.columns
    assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, want.collect()))


def test_positions_count_once_and_late_events_are_dropped(spark, tmp_path):
    at = lambda m: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m)
    schema = "task long, seq long, position long, at timestamp, event string, source string, data array<string>, guard string, confirmed boolean"
    row = lambda seq, position, minute, event: (1, seq, position, at(minute), event, "human", None, "", False)
    parts = [
        [row(2, 2, 20, "cancel"), row(1, 1, 10, "start")],
        [row(3, 2, 21, "cancel"), row(4, 3, 200, "start")],  # position 2 comes again
        [row(5, 4, 30, "pause"), row(6, 5, 2000, "cancel")],  # 30 is long past
    ]
    got = run(spark, tmp_path, parts, schema, ordered.tasks, "15 minutes")
    assert [(r["seq"], r["stage"], r["outcome"]) for r in got.orderBy("seq").collect()] == [(1, "planning", "ok"), (2, "cancelled", "ok"), (4, "planning", "ok")]


class Kept:
    """A state variable, and the handle that gives it, that count what is asked of them."""

    def __init__(self):
        self.calls, self.timers, self.rows, self.value = 0, [], [], None

    def getValueState(self, *_):
        return self

    getListState = getMapState = getValueState

    def __getattr__(self, name):
        def call(*args):
            self.calls += 1
            if name == "registerTimer":
                self.timers.append(args[0])
            elif name == "appendList":
                self.rows += args[0]
            elif name == "put":
                self.rows = list(args[0])
            elif name == "clear":
                self.rows = []
            elif name == "update":
                self.value = args[0]
            return {"exists": self.value is not None, "get": iter(self.rows)}.get(name)

        return call


def test_state_is_asked_for_once_a_batch():
    fold, kept = ordered.OrderedFold(lambda s, e: (s, (e["x"],)), ["key", "number", "x"]), Kept()
    fold.init(kept)
    frame = pd.DataFrame({"fold_at": range(500, 0, -1), "fold_number": range(500), "fold_event": [f'{{"x": {k}}}' for k in range(500)]})
    list(fold.handleInputRows((1,), iter([frame]), None))
    assert kept.calls < 10 and kept.timers == [1]
    times = SimpleNamespace(getCurrentWatermarkInMs=lambda: 401)
    out = pd.concat(fold.handleExpiredTimer((1,), times, SimpleNamespace(getExpiryTimeInMs=lambda: 1)))
    assert out["x"].tolist() == list(range(499, 99, -1)) and kept.calls < 20 and kept.timers == [1, 401] and len(kept.rows) == 100


def test_the_stream_over_events_equals_the_table(spark):
    got, want = state.z6_stream(spark, SF), state_machine(state.task_events(spark, SF))
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
