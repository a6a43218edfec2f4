"""Answer checks on literal answers."""

import re

import pytest
from pyspark.sql import functions as F

from tarnsift import queries as core
from tarnsift.operators import answers
from tarnsift.plans import answers as plans

EXCERPTS = ["The Warden keeps ёлки and three keys in the tower.", "A guard sleeps at noon by the gate."]
SCHEMA = "answer_id long, raw string, excerpts array<string>, memory array<string>, memory_keys array<string>"


@pytest.fixture
def check(spark):
    """{raw: checked row} of literal answers."""

    def run(raws, excerpts=EXCERPTS, memory=("goal",), keys=("goal", "Party List")):
        frame = spark.createDataFrame([(k, raw, list(excerpts), list(memory), list(keys)) for k, raw in enumerate(raws)], SCHEMA)
        return {raws[r["answer_id"]]: r for r in answers.checked(frame).collect()}

    return run


def test_words_and_parts_in_order(spark):
    row = spark.range(1).select(
        answers.words(F.lit("Ёлки, №5_x # «да»")).alias("words"), answers.normal_key(F.lit(" Party   Ёж ")).alias("key"),
        *[answers.holds(answers.spaced(F.array(*map(F.lit, "abcabd"))), F.array(*map(F.lit, parts))).alias(name)
          for name, parts in (("there", ["a b", "b d"]), ("missing", ["a b d", "a b"]), ("again", ["a b", "c a", "b d"]), ("overlap", ["a b c", "c a"]), ("inside", ["abc"]))],
        answers.holds(F.lit(" a "), F.array().cast("array<string>")).alias("nothing"),
    ).first()
    assert row["words"] == ["елки", "5", "x", "#", "да"] and row["key"] == "party еж"
    assert [row[c] for c in ("there", "missing", "again", "overlap", "inside", "nothing")] == [True, False, True, False, False, True]


def test_parts_references_and_sentences(check):
    first = "Body [1].\n\n**Quotes:**\n- [1]: «three keys\nin the tower».\n\nleft over\nSources:\n[1] book"
    second = "a [1; 2] b [goal, 3] c [see, 1] [x](y) [4](z) [party  LIST]"
    third = "One. [1] [goal] Two [2].\nThree"
    got = check([first, second, third, "[goal](link)"])
    assert (got[first]["body"], [q["quote"] for q in got[first]["quotes"]], got[first]["own_sources"]) == ("Body [1].\n\nleft over", ["three keys in the tower"], True)
    assert got[second]["refs"] == [1, 2, 3, 4] and got[second]["memory_refs"] == ["goal"] and got[second]["violations"][-1] == "no memory Party List"
    assert [(c["ref"], c["sentence"]) for c in got[third]["claims"]] == [("1", "One."), ("goal", "One."), ("2", "Two [2].")]
    assert got["[goal](link)"]["memory_refs"] == []


def test_quotations(check):
    quotes = {
        (1, "keeps елки and three"): ("ok", 1, None), (1, "three keys"): ("short", 1, None), (1, "the warden … in the TOWER!"): ("ok", 1, None),
        (1, "a guard sleeps at"): ("other", 2, None), (3, "a"): ("none", None, None), (2, "a guard runs away"): ("loose", None, 0.5), (1, "tower … the warden keeps it"): ("loose", None, 0.8),
    }
    got = check([f"Quotes:\n[{n}] «{q}»" for n, q in quotes])
    assert [(q["status"], q["found_in"], q["coverage"]) for r in got.values() for q in r["quotes"]] == list(quotes.values())


def test_kinds_and_violations(check):
    good = "It has keys [1].\nQuotes:\n[1] «three keys in the tower»"
    cases = {
        good: ("answer", []),
        "It has keys [1].": ("answer", ["no quotations"]), "It has keys [1].\nQuotes:\nnothing": ("answer", ["quotations without numbers"]),
        "Keys.\nQuotes:\n[1] «three keys in the tower»": ("answer", ["no references in text"]),
        "Keys [1, 2, 5].\nQuotes:\n[1] «three keys in the tower»": ("answer", ["no excerpt 5", "no quotation of 2"]), "Nothing.": ("none", ["no reference"]), "": ("none", ["no reference"]),
        "I don’t know.": ("unknown", ["no question"]), "I don't know. Why?": ("unknown", []), "As said [goal].": ("memory", []),
        "As said [Party list].": ("none", ["no reference", "no memory Party List"]), "Keys [1].\nQuotes:\n[1] «keys»": ("answer", ["quotation 1 short"]),
    }
    got = check(list(cases))
    assert {raw: (r["kind"], r["violations"]) for raw, r in got.items()} == cases and got[good]["sources"] == [1]
    empty = check(["Yes [1].", "Не знаю. Что?"], [])
    assert empty["Yes [1]."]["violations"] == ["cites nothing given", "does not say unknown"] and empty["Не знаю. Что?"]["violations"] == []


def test_over_conversations(spark):
    """What is known of the made answers by how they are made."""
    sf = "/root/testdata/sf0.001"
    given = {r["answer_id"]: r for r in plans.made_answers(spark, sf).collect()}
    got = {r["answer_id"]: r for r in plans.t31_answer_check(spark, sf).collect()}
    kinds = ["answer", "answer", "answer", "unknown", "memory", "none", "answer"]
    assert set(got) == set(given) and len(given) > 10 and all(r["kind"] == kinds[k % 7] for k, r in got.items())
    assert all(r["violations"] == (["no memory party"] if k % 7 == 4 else []) for k, r in got.items() if k % 7 in (3, 4))
    assert {r["quotes"][0]["status"] for k, r in got.items() if k % 7 == 1 and k % 5 != 1} == {"ok"}
    total = next(r for r in plans.g9_answer_counters(spark, sf).collect() if r["half"] is None)
    assert total["answers"] == len(given) and total["clean"] == sum(not r["violations"] for r in got.values())
    odd = spark.createDataFrame([(1, None, None, None, None)], SCHEMA)
    assert answers.checked(odd).first()["kind"] == "none" and answers.checked(odd.limit(0)).count() == 0
    assert "Python" not in answers.checked(odd)._jdf.queryExecution().toString()


@pytest.mark.parametrize("key, again", [("T29_claims", r"size\("), ("T30_quotes", r"size\("), ("P3_claim_table", r"size\("), ("T11_sentence_spans", r"size\("), ("T26_benchmark_parts", "xxhash64")])
def test_no_filter_works_out_again_what_is_exploded(spark, key, again):
    plan = core.QUERIES[key](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(rf"Filter [^\n]*{again}", plan)
