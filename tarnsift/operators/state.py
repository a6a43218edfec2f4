"""Stateful rules: one pure step function each, used in batch (ordered groups) and in streams."""

from __future__ import annotations

import heapq
import math
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame

#: Fixed values of the task state machine: event -> (who may send it, stages it may come from, pause it needs or None,
#: stages it may lead to).
ACTIVE = ("planning", "execution", "validation")
TRANSITIONS = {
    "start": (("human",), ("none", "done", "cancelled"), None, ("planning",)),
    "plan approved": (("tracker",), ("planning",), False, ("execution",)),
    "step done": (("tracker",), ("execution",), False, ("execution", "validation")),
    "check passed": (("tracker",), ("validation",), False, ("validation", "done")),
    "back to step": (("tracker",), ("execution", "validation"), False, ("execution",)),
    "back to plan": (("tracker", "human"), ("execution", "validation"), False, ("planning",)),
    "pause": (("human", "tracker"), ACTIVE, False, ACTIVE),
    "resume": (("human", "tracker"), ACTIVE, True, ACTIVE),
    "cancel": (("human",), ACTIVE, None, ("cancelled",)),
    "reopen": (("human",), ("done",), None, ("validation",)),
}
MOST_STEPS, MOST_CHECKS = 10, 5


@dataclass(frozen=True)
class Task:
    """Where a task stands: stage, step or check from 1, pause, number of steps and checks, results by step, and what
    waits for a human's word."""

    stage: str = "none"
    step: int = 0
    paused: bool = False
    steps: int = 0
    checks: int = 0
    results: tuple[str, ...] = ()
    pending: str = ""


def admit(times: deque, now: float, rate: int, span: float = 60.0) -> tuple[bool, int]:
    """Sliding-log limiter: (admitted, seconds to wait). Denied requests leave no trace."""
    while times and times[0] <= now - span:
        times.popleft()
    if len(times) < rate:
        times.append(now)
        return True, 0
    return False, max(1, math.ceil(times[0] + span - now))


def advance(task: Task, event: str, source: str = "human", data: tuple = (), guard: str = "", confirmed: bool = False) -> tuple[Task, str]:
    """(task afterwards, "ok" or why not). Reasons go from the table over guards to the event's own condition.

    data: (steps, checks) of an approved plan, (result,) of a step, (number,) to go back to. guard: "", "confirm" or
    "forbid", the strictest that the session's rules have for the event."""
    if event not in TRANSITIONS:
        return task, "unknown event"
    sources, stages, paused, leads_to = TRANSITIONS[event]
    if task.stage not in stages:
        return task, f"not from {task.stage}"
    if paused is not None and task.paused != paused:
        return task, "paused" if task.paused else "not paused"
    if source not in sources:
        return task, f"not by {source}"
    if guard == "forbid":
        return task, "forbidden"
    if guard == "confirm" and source == "tracker" and not confirmed:
        return replace(task, pending=event), "waits for confirmation"
    blank = ("",) * task.steps
    if event == "start":
        after = Task("planning", 1)
    elif event == "plan approved":
        steps, checks = (*data, 0, 0)[:2]
        if not (1 <= steps <= MOST_STEPS and 1 <= checks <= MOST_CHECKS):
            return task, "plan out of bounds"
        after = replace(task, stage="execution", step=1, steps=steps, checks=checks, results=("",) * steps)
    elif event == "step done":
        results = task.results[: task.step - 1] + (str(data[0]).strip() if data else "",) + task.results[task.step :]
        last = task.step >= task.steps
        after = replace(task, stage="validation" if last else "execution", step=1 if last else task.step + 1, results=results)
    elif event == "check passed":
        last = task.step >= task.checks
        after = replace(task, stage="done" if last else "validation", step=0 if last else task.step + 1)
    elif event == "back to step":
        number = data[0] if data else 0
        if not 1 <= number <= task.steps:
            return task, "no such step"
        if task.stage == "execution" and number >= task.step:
            return task, "not a step back"
        after = replace(task, stage="execution", step=number, results=task.results[: number - 1] + blank[number - 1 :])
    elif event == "back to plan":
        after = replace(task, stage="planning", step=1, results=blank)
    elif event == "cancel":
        after = replace(task, stage="cancelled", step=0, paused=False)
    elif event == "reopen":
        if not task.checks:
            return task, "no checks"
        after = replace(task, stage="validation", step=1, paused=False)
    else:
        after = replace(task, paused=event == "pause")
    if after.stage not in leads_to:
        return task, f"leads to {after.stage}"
    return replace(after, pending=""), "ok"


def queue_fates(arrivals: list[tuple[float, float]], places: int = 1, most_waiting: int = 4, patience: float = 60.0) -> list[tuple[str, float | None]]:
    """First in, first out before a model with places: (served, timed out or full; when it began) of arrivals (time,
    seconds of work), in order of time. A freed place goes straight to the one who waits longest."""
    out: list[tuple[str, float | None]] = [("", None)] * len(arrivals)
    busy: list[float] = []
    waiting: deque[int] = deque()

    def settle(now: float) -> None:
        while waiting:
            first = waiting[0]
            limit = arrivals[first][0] + patience
            if busy and busy[0] <= min(now, limit):
                begin = max(heapq.heappop(busy), arrivals[first][0])
                out[waiting.popleft()] = ("served", begin)
                heapq.heappush(busy, begin + arrivals[first][1])
            elif limit <= now:
                out[waiting.popleft()] = ("timed out", None)
            else:
                return
        while busy and busy[0] <= now:
            heapq.heappop(busy)

    for k, (time, work) in enumerate(arrivals):
        settle(time)
        if len(busy) < places and not waiting:
            out[k] = ("served", time)
            heapq.heappush(busy, time + work)
        elif len(waiting) >= most_waiting:
            out[k] = ("full", None)
        else:
            waiting.append(k)
    settle(math.inf)
    return out


def rate_limited(requests: DataFrame, rate: int = 10) -> DataFrame:
    """requests (client, seconds, request_id): every request with admitted and retry_after.

    Rows stream in order of client and time, so a client's history is never held, only its last rate times."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, times = None, deque()
        for batch in batches:
            out = []
            for c, s in zip(batch["client"], batch["seconds"]):
                if c != client:
                    client, times = c, deque()
                out.append(admit(times, s, rate))
            yield batch.assign(admitted=[x[0] for x in out], retry_after=[x[1] for x in out])[["request_id", "client", "admitted", "retry_after"]]

    ordered = requests.repartition("client").sortWithinPartitions("client", "seconds", "request_id")
    return ordered.mapInPandas(run, "request_id long, client long, admitted boolean, retry_after long")


_STATE = "stage string, step long, paused boolean, results array<string>, pending string, outcome string"


def state_machine(events: DataFrame) -> DataFrame:
    """events (task, seq, event, source, data array<string>, guard, confirmed): every event with the state afterwards.

    Rows stream in order of task and seq, so one task is one task's work and only its state is held."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, state = None, Task()
        for batch in batches:
            out = []
            for t, e, source, data, guard, ok in zip(*(batch[c] for c in ("task", "event", "source", "data", "guard", "confirmed"))):
                if t != task:
                    task, state = t, Task()
                given = tuple(data) if data is not None else ()
                given = tuple(int(x) for x in given) if e in ("plan approved", "back to step") else given
                state, outcome = advance(state, e, source, given, guard or "", bool(ok))
                out.append((state.stage, state.step, state.paused, list(state.results), state.pending, outcome))
            made = pd.DataFrame(out, columns=[c.split()[0] for c in _STATE.split(", ")])
            yield pd.concat([batch[["task", "seq", "event"]].reset_index(drop=True), made], axis=1)

    ordered = events.repartition("task").sortWithinPartitions("task", "seq")
    return ordered.mapInPandas(run, f"task long, seq long, event string, {_STATE}")


def queued(requests: DataFrame, patience: float = 60.0) -> DataFrame:
    """requests (server, request_id, arrived, work): fate and begin of each; a server's requests of one run between
    idle times are simulated together, so what is held is one busy stretch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        server, free_at = None, -math.inf

        def closed() -> pd.DataFrame:
            fates = queue_fates([(a, w) for _, _, a, w in held], patience=patience)
            return pd.DataFrame([(s, r, f, b) for (s, r, _, _), (f, b) in zip(held, fates)], columns=["server", "request_id", "fate", "began"])

        for batch in batches:
            for row in zip(batch["server"], batch["request_id"], batch["arrived"], batch["work"]):
                if held and (row[0] != server or row[2] >= free_at):
                    yield closed()
                    held = []
                if not held:
                    server, free_at = row[0], row[2]
                held.append(row)
                free_at += row[3]  # no later than if all were served one after another
        if held:
            yield closed()

    ordered = requests.repartition("server").sortWithinPartitions("server", "arrived", "request_id")
    return ordered.select("server", "request_id", "arrived", "work").mapInPandas(run, "server long, request_id long, fate string, began double")


def move_candidate(stored: dict, waits: dict, key: str, value: str | None, action: str) -> str:
    """Propose, accept or reject an entry for key in the memory stored, where proposals wait in waits; what came of it."""
    if action == "propose":
        done = "same as stored" if key in stored and stored[key] == value else "supersedes" if key in waits else "proposed"
        waits.pop(key, None)
        if done != "same as stored":
            waits[key] = value
        return done
    if key not in waits:
        return "nothing waits"
    proposed = waits.pop(key)
    if action == "accept":
        stored[key] = proposed
    return f"{action}ed"


def candidate_queue(moves: DataFrame) -> DataFrame:
    """moves (session, seq, key, value, action): propose, accept or reject of memory entries. A new proposal for a key
    replaces the one before; one that equals the stored entry removes it; every move with what is stored and waits."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, stored, waits = None, {}, {}
        for batch in batches:
            out = []
            for s, key, value, action in zip(batch["session"], batch["key"], batch["value"], batch["action"]):
                if s != session:
                    session, stored, waits = s, {}, {}
                done = move_candidate(stored, waits, key, value, action)
                out.append((done, stored.get(key), waits.get(key), len(waits)))
            made = pd.DataFrame(out, columns=["outcome", "stored", "waiting", "queue"])
            yield pd.concat([batch[["session", "seq", "key"]].reset_index(drop=True), made], axis=1)

    ordered = moves.repartition("session").sortWithinPartitions("session", "seq")
    return ordered.mapInPandas(run, "session long, seq long, key string, outcome string, stored string, waiting string, queue long")
