"""Folds over a stream in the order of events, though these come late and twice.

A key's events wait in its state until the watermark has passed them; a timer then lets them through in order of
(time, number), one after another, through a step function. What waits is what came within the watermark's delay, what is
kept beyond that is the state of the fold. An event is known by the columns of once (a task's position
in its history): repeats within the delay are dropped before they get to the fold. Events that come after the watermark has
passed them are dropped by Spark, as late ones.

Each event's output comes once, when it is certain that nothing goes before it. So the result is that of the fold over the
whole table in order, for every order of arrival within the delay.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import asdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tarnsift.operators.state import Task, advance, move_candidate

#: The state store that keyed state with timers needs.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: (state as JSON has it, event as a dict) -> (state afterwards, output)
Step = Callable[[dict, dict], tuple[dict, tuple]]


class OrderedFold(StatefulProcessor):
    """Events of a key wait as JSON with (milliseconds, number); a timer at the earliest of them folds all that the watermark
    has passed, and is set again for what is left. State is read and written once a batch, not once an event."""

    def __init__(self, step: Step, columns: list[str]) -> None:
        self.step, self.columns = step, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "json string")
        self.waiting = handle.getListState("waiting", "at long, number long, event string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        came = [(int(a), int(n), e) for frame in rows if not frame.empty for a, n, e in zip(frame["fold_at"], frame["fold_number"], frame["fold_event"])]
        if came:
            self.waiting.appendList(came)
            self.handle.registerTimer(min(came)[0])
        yield pd.DataFrame()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto, out = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1), []
        waiting = sorted(tuple(w) for w in self.waiting.get())
        ready = [w for w in waiting if w[0] <= upto]
        if ready:
            state = json.loads(self.state.get()[0]) if self.state.exists() else {}
            for _, number, event in ready:
                state, made = self.step(state, json.loads(event))
                out.append((*key, number, *made))
            self.state.update((json.dumps(state),))
            left = waiting[len(ready):]
            if left:
                self.waiting.put(left)
                self.handle.registerTimer(left[0][0])
            else:
                self.waiting.clear()
        yield pd.DataFrame(out, columns=self.columns) if out else pd.DataFrame()

    def close(self) -> None:
        pass


def in_order(events: DataFrame, key: str, time: str, number: str, once: list[str], step: Step, schema: str, delay: str = "1 hour") -> DataFrame:
    """The stream events folded by key: key, number and what step makes of each event (schema: of that)."""
    known = events.withWatermark(time, delay).dropDuplicatesWithinWatermark([key, *once])
    given = known.select(key, time, F.unix_millis(time).alias("fold_at"), F.col(number).alias("fold_number"), F.to_json(F.struct(*[c for c in events.columns if c != time])).alias("fold_event"))
    kinds = dict(events.dtypes)
    made = f"{key} {kinds[key]}, {number} {kinds[number]}, {schema}"
    columns = [f.name for f in events.sparkSession.createDataFrame([], made).schema]
    return given.groupBy(key).transformWithStateInPandas(OrderedFold(step, columns), made, "Append", "EventTime")


def task_step(state: dict, event: dict) -> tuple[dict, tuple]:
    task = Task(**state | {"results": tuple(state["results"])}) if state else Task()
    data = tuple(event.get("data") or ())
    data = tuple(int(x) for x in data) if event["event"] in ("plan approved", "back to step") else data
    task, outcome = advance(task, event["event"], event["source"], data, event.get("guard") or "", bool(event.get("confirmed")))
    return asdict(task), (event["event"], task.stage, task.step, task.paused, list(task.results), task.pending, outcome)


def candidate_step(state: dict, move: dict) -> tuple[dict, tuple]:
    stored, waits = state.get("stored", {}), state.get("waits", {})
    done = move_candidate(stored, waits, move["key"], move.get("value"), move["action"])
    return {"stored": stored, "waits": waits}, (move["key"], done, stored.get(move["key"]), waits.get(move["key"]), len(waits))


def tasks(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """events (task, seq, position, at, event, source, data, guard, confirmed), a stream: each event with the task's state
    after it. An event at a position of a task's history counts once."""
    return in_order(events, "task", "at", "seq", ["position"], task_step, "event string, stage string, step long, paused boolean, results array<string>, pending string, outcome string", delay)


def candidates(moves: DataFrame, delay: str = "1 hour") -> DataFrame:
    """moves (session, seq, at, key, value, action), a stream: each move with what is stored and waits after it."""
    return in_order(moves, "session", "at", "seq", ["seq"], candidate_step, "key string, outcome string, stored string, waiting string, queue long", delay)
