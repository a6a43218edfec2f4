"""Token estimates by part, running folds, recovered objects, sentences and counters of dialogs."""

import random
import time

from pyspark.sql import functions as F

from tarnsift.operators import accounts


def test_parts_of_a_request(spark):
    rows = [(1, "Привет мир", ["abcd efgh", "", None], "??", None, "tool"), (2, None, None, "", "x" * 8, None)]
    frame = spark.createDataFrame(rows, "id long, system string, history array<string>, question string, memory string, tools string")
    got = {r["id"]: r for r in accounts.request_tokens(frame, "id").collect()}
    a, b = got[1], got[2]
    assert (a["system"], a["per_message"], a["history"], a["question"], a["memory"], a["tools"], a["rag"]) == (4, [2, 0, 0], 2, 1, 0, 1, 0)
    assert a["overhead"] == (1 + 3 + 1) * 4 + 3 and a["total"] == 4 + 2 + 1 + 1 + a["overhead"]
    assert (b["system"], b["history"], b["memory"], b["overhead"], b["total"]) == (0, 0, 2, 2 * 4 + 3, 13)
    halves = spark.createDataFrame([("ab",), ("abcdef",), ("!",), ("!!!",)], "t string").select(accounts.estimated_tokens(F.col("t")).alias("n")).collect()
    assert [r["n"] for r in halves] == [0, 2, 0, 2]  # 0.5, 1.5, 0.5, 1.5, half to even


def test_folds_try_again(spark):
    rng = random.Random(5)
    rows = [(key, n, rng.choice((True, True, False, None))) for key in range(20) for n in range(rng.randrange(60))]
    got = {(r["key"], r["n"]): (r["covered"], r["tried"], r["done"]) for r in accounts.folds(spark.createDataFrame(rows, "key long, at long, answered boolean").repartition(3), "key", ["at"], 4, 3).collect()}
    want = {}
    for key in range(20):
        covered = tried = done = 0
        for n, (_, _, answered) in enumerate([r for r in rows if r[0] == key], 1):
            if n - 3 - covered >= 4:
                tried += 1
                if answered:
                    covered, done = n - 3, done + 1
            want[key, n] = (covered, tried, done)
    assert got == want and len(want) == len(rows)


def test_objects_in_free_text(spark):
    cases = {
        'Sure: {"a": {"b": "}"}} and more }': '{"a": {"b": "}"}}', "{torn": None, "none": None, "": None, None: None, '} {"k": []}': '{"k": []}', '{"a": 1': None,
        '{not json} {"a": 1}': None, '{"a": "{", "b": 2}': '{"a": "{", "b": 2}',
    }
    frame = spark.createDataFrame([(t,) for t in cases], "t string")
    assert {r["t"]: r["j"] for r in frame.select("t", accounts.recovered_json(F.col("t")).alias("j")).collect()} == cases
    numbers = spark.createDataFrame([("41",), (" 7 ",), ("4.1",), ("x",), (None,)], "t string").select(accounts.as_integer(F.col("t")).alias("n")).collect()
    assert [r["n"] for r in numbers] == [41, 7, None, None, None]


def test_sentences_know_their_places(spark):
    text = "  One. Two?! «Three.» four 3.14 stays… \"Five.\" end"
    found = spark.createDataFrame([(text,), ("",), (" ",), ("No end",)], "t string").select("t", accounts.sentences(F.col("t")).alias("s")).collect()
    assert [x["text"] for x in found[0]["s"]] == ["One.", "Two?!", "«Three.»", "four 3.14 stays…", '"Five."', "end"]
    assert all(r["t"][x["start"] : x["end"]] == x["text"] for r in found for x in r["s"]) and [len(r["s"]) for r in found] == [6, 0, 0, 1]


def test_kinds_of_turns_exclude_one_another(spark):
    base = {"scenario": 1, "turn_id": 1, "ok": True, "search_ok": True, "checked": True, "empty": False, "kind": "answer", "refs": 1, "memory_refs": 2, "missing": 1, "sources_found": 1, "sources_asked": 2, "keys_found": 1,
            "keys_asked": 3, "repaired": True, "violated": True, "prompt": 10, "completion": 5} | {f"{w}_{c}": 0.5 for w in ("cost", "seconds") for c in ("main", "rewrite", "memory", "search")}
    turns = [base, base | {"turn_id": 2, "ok": False}, base | {"turn_id": 3, "search_ok": False}, base | {"turn_id": 4, "checked": False}, base | {"turn_id": 5, "kind": "unknown", "empty": True}, base | {"turn_id": 6, "kind": "none", "violated": False}]
    r = accounts.dialog_statistics(spark.createDataFrame(turns), ["scenario"]).first()
    assert [r[k] for k in ("turns", "ok", "search_failed", "unchecked", "by_excerpts", "by_memory", "unknown_nothing_found", "unknown_by_content", "no_references")] == [6, 5, 1, 1, 1, 0, 1, 0, 1]
    assert (r["violated"], r["repaired"], r["memory_ok"], r["keys_asked"], r["prompt"], r["cost_main"], r["seconds_search"], r["empty"], r["unknown_with_references"]) == ([1, 5], 3, 6, 18, 50, 2.5, 2.0, 1, 1)


def test_many_sentences_in_a_line_take_their_share_of_time(spark):
    said = [f"Sentence {k}{'.' if k % 3 else '!»'}" for k in range(6000)]
    text, begin = " ".join(said), time.monotonic()
    found = spark.createDataFrame([(text,), (None,)], "t string").select(F.inline(accounts.sentences(F.col("t")))).collect()
    assert time.monotonic() - begin < 20  # splitting anew for each sentence took minutes
    assert [r["text"] for r in found] == said and all(text[r["start"]:r["end"]] == r["text"] for r in found)
