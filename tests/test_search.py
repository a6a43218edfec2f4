"""Keyword retrieval against a plain double loop."""

import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarnsift.operators import inverted, similarity
from tarnsift.queries import QUERIES
from tarnsift.session import scratch_dir

SF = "/root/testdata/sf0.001"


def cut(text):
    return [w for w in re.findall("[a-z0-9']+", (text or "").lower()) if len(w) >= 3 and w not in inverted.STOP_WORDS]


def plain_search(docs, queries, weights, limit=None):
    """{(query, doc): (score, place)} of docs [(id, *fields)] in order, queries {id: text}."""
    out = {}
    for q, text in queries.items():
        scored = []
        for doc, *fields in docs:
            found = [cut(f) for f in fields]
            score = sum(w for word in cut(text) for f, w in zip(found, weights) if any(t.startswith(word) for t in f))
            if score:
                scored.append((doc, score))
        scored.sort(key=lambda x: -x[1])
        out |= {(q, doc): (score, k) for k, (doc, score) in enumerate(scored[:limit], 1)}
    return out


def got(frame):
    return {(r["query_id"], r["doc_id"]): (r["score"], r["place"]) for r in frame.collect()}


@pytest.mark.parametrize("limit", [None, 3])
def test_search_equals_a_double_loop(spark, limit):
    rng = random.Random(3)
    letters = lambda: "".join(rng.choices("ab'", k=rng.choice((1, 2, 3, 4, 6))))
    docs = [(k, " ".join(letters() for _ in range(3)), rng.choice((None, "", " ".join(letters() for _ in range(40))))) for k in range(80)]
    docs += [(100, "x" * 40 + "a", "the and for"), (101, "x" * 40 + "b", "x" * 23), (102, None, None)]
    queries = {k: " ".join(letters() for _ in range(rng.choice((1, 2, 9)))) for k in range(30)} | {50: "x" * 40, 51: "x" * 41, 52: "the aba aba ABA!", 53: "", 54: None, 55: "xxx"}
    frame = spark.createDataFrame(docs, "doc_id long, title string, text string").repartition(3)
    index = inverted.build(frame, f"{scratch_dir(spark)}/index", {"title": 3, "text": 1}, ranges=5)
    asked = spark.createDataFrame(list(queries.items()), "query_id long, text string")
    assert got(inverted.search(index, asked, limit)) == plain_search(docs, queries, (3, 1), limit)
    assert inverted.search(index, asked.limit(0), limit).collect() == []


def test_search_of_all_turns(spark):
    docs = [(r["doc_id"], r["text"].split("\n")[0], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    turns = spark.read.parquet(f"{SF}/conversations.parquet").filter("role = 'user'").select(F.concat_ws("/", "conv_id", "turn").alias("query_id"), "text")
    index = inverted.build(spark.createDataFrame(docs, "doc_id long, title string, text string"), f"{scratch_dir(spark)}/index", {"title": 3, "text": 1})
    assert got(inverted.search(index, turns, 10)) == plain_search(docs, {r["query_id"]: r["text"] for r in turns.collect()}, (3, 1), 10)


def test_a_search_reads_only_ranges_of_its_words(spark):
    rows = [(k, f"{a}{b}{c}") for k, (a, b, c) in enumerate((a, b, c) for a in "abcdefgh" for b in "abcdefgh" for c in "xyz")]
    index = inverted.build(spark.createDataFrame(rows, "doc_id long, text string"), f"{scratch_dir(spark)}/index", {"text": 1}, ranges=8)
    asked = spark.createDataFrame([(1, "aax aay")], "query_id long, text string")
    found = inverted.search(index, asked)
    assert {r["doc_id"] for r in found.collect()} == {0, 1}
    terms = inverted.matched_terms(index, inverted.query_words(asked, index.words))
    assert {r for x in terms.collect() for r in x["ranges"]} < set(range(8))
    assert "PartitionFilters: [" in found._jdf.queryExecution().toString() and "range" in found._jdf.queryExecution().toString()


def test_first_listing_wins_and_newest_first(spark):
    rows = spark.createDataFrame([(7, 2, "late words"), (7, 1, "early words"), (8, 3, "words")], "doc_id long, at long, text string")
    assert sorted(map(tuple, inverted.first_listed(rows, F.col("at")).select("doc_id", "text").collect())) == [(7, "early words"), (8, "words")]
    index = inverted.build(rows, f"{scratch_dir(spark)}/index", {"text": 1}, words=inverted.any_words, order=F.col("at"))
    found = inverted.search(index, spark.createDataFrame([(1, "words words early")], "query_id long, text string"), distinct=True, newest=True).orderBy("place").collect()
    assert [(r["doc_id"], r["score"]) for r in found] == [(7, 2), (8, 1)]


def test_blocks_are_scored_without_an_object_a_row(spark):
    n, size = 4096, 64
    values = pa.ListArray.from_arrays(pa.array(range(0, (n + 1) * size, size), pa.int32()), pa.array(np.ones(n * size, np.float32)))
    block = pa.StructArray.from_arrays([pa.array(range(n)), pa.array([0] * n, pa.int32()), values], ["id", "label", "v"])
    tracemalloc.start()
    assert similarity._matrix(block)[2].shape == (n, size) and tracemalloc.get_traced_memory()[1] < 2 * n * size * 8
    tracemalloc.stop()
    rows = [(1, [1.0, 0.0], None), (2, [0.6, 0.8], 3), (3, None, 3), (4, [1.0], 3), (5, [float("nan"), 1.0], 3), (6, [None, 1.0], 3), (7, [0.6, 0.8], 4)]
    vectors = spark.createDataFrame(rows, "id long, v array<float>, label int")
    found = similarity.top_cosine(vectors.toDF("query_id", "query_vector", "query_label").filter("query_id < 3"), vectors.toDF("chunk_id", "vector", "chunk_label"), 2)
    got = sorted(tuple(r[c] for c in ("query_id", "rank", "chunk_id", "score", "query_label", "chunk_label")) for r in found.collect())
    assert got == [(1, 1, 1, 1.0, None, None), (1, 2, 2, 0.6, None, 3), (2, 1, 2, 1.0, 3, 3), (2, 2, 7, 1.0, 3, 4)]


def test_beginnings_of_terms_are_never_broadcast(spark):
    index = inverted.build(spark.createDataFrame([(1, "alpha beta gamma")], "doc_id long, text string"), scratch_dir(spark), {"text": 1})
    found = inverted.matched_terms(index, spark.createDataFrame([("al",), ("bet",)], "word string"))
    assert [tuple(r)[:2] for r in found.collect()] == [("bet", "beta")]
    assert "BroadcastExchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_a_common_word_are_dealt_to_tasks(spark, monkeypatch):
    """A word of all queries and all documents: its pairs come in many tasks, and the scores are those of the plain loop."""
    monkeypatch.setattr(inverted, "PAIRS", 200, raising=False)
    docs = [(k, "common " + "ab" * (k % 5 + 2)) for k in range(90)]
    queries = {k: "common abab" if k % 2 else "common" for k in range(40)}
    index = inverted.build(spark.createDataFrame(docs, "doc_id long, text string"), f"{scratch_dir(spark)}/index", {"text": 1})
    asked = spark.createDataFrame(list(queries.items()), "query_id long, text string")
    found = inverted.search(index, asked, 20)
    assert got(found) == plain_search(docs, queries, (1,), 20)
    assert found.rdd.getNumPartitions() == 27  # 3,600 and 1,800 pairs in tasks of 200
    every = inverted.search(index, asked)
    assert max(every.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()) <= 90 * 7


def shuffled(spark, run):
    """What run gives, and how many rows its stages have written for others to read."""
    group = f"shuffled-{id(run)}-{random.random()}"
    spark.sparkContext.setJobGroup(group, group)
    out = run()
    jobs, store = spark.sparkContext.statusTracker(), spark.sparkContext._jsc.sc().statusStore()
    stages = {k for job in jobs.getJobIdsForGroup(group) for k in jobs.getJobInfo(job).stageIds}
    return out, sum(store.lastStageAttempt(k).shuffleWriteRecords() for k in stages)


@pytest.mark.parametrize("name", ["R12_turns_against_documents", "K6_search_log_kept", "R15_titles_against_tickets", "R4_rescored_turns"])
def test_pairs_of_queries_and_documents_are_not_shuffled(spark, tmp_path, name):
    """Every query finds every document by every word."""
    words = " ".join(f"word{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(60))
    spark.createDataFrame([(20 * k, words) for k in range(100)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(20 * k, 0, "user", words) for k in range(100)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    rows, n = shuffled(spark, lambda: QUERIES[name](spark, str(tmp_path)).collect())
    assert len(rows) == 100 * {"K6_search_log_kept": 1, "R4_rescored_turns": 5}.get(name, 50)
    assert n < 100 * 100 * 60 / 4


@pytest.mark.parametrize("limit, newest", [(None, False), (3, False), (3, True)])
def test_blocks_and_parts_of_queries_give_the_order_of_one(spark, monkeypatch, limit, newest):
    """Ids are strings, some documents have no place or no id; many blocks, parts of the queries, and lists of a term over several ranges."""
    for name, most in (("LETTERS", 150), ("QUERY_WORDS", 40), ("PAIRS", 300), ("RANKED", 200)):
        monkeypatch.setattr(inverted, name, most, raising=False)
    rng = random.Random(5)
    text = lambda n: " ".join("".join(rng.choices("ab", k=rng.choice((3, 4, 5)))) for _ in range(n))
    docs = [(f"d{k:02}", None if k % 9 == 0 else k % 7, text(1), text(4)) for k in range(60)]
    queries = {f"q{k}": text(5) for k in range(20)}
    frame = spark.createDataFrame([*docs, (None, 0, "aaa", "bbb")], "doc_id string, at int, title string, text string").repartition(3)
    index = inverted.build(frame, f"{scratch_dir(spark)}/index", {"title": 3, "text": 1}, order=F.col("at"), ranges=4)
    assert index.blocks > 5
    asked = spark.createDataFrame(list(queries.items()), "query_id string, text string")
    place = lambda d: -1 if d[1] is None else d[1]  # noqa: E731  null is first, and last if the newest are first
    order = sorted(docs, key=lambda d: (place(d), d[0]), reverse=newest)
    assert got(inverted.search(index, asked, limit, newest=newest)) == plain_search([(d[0], *d[2:]) for d in order], queries, (3, 1), limit)
