"""Versions, merges, runs taken in by a stream, incremental builds: what is left when a step fails or is repeated."""

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tarnsift.operators import incremental
from tarnsift.sources import store, versions
from tarnsift.streaming import snapshots


class Killed(Exception):
    pass


@pytest.fixture
def killing(monkeypatch):
    """kill(n): the n-th version from now on is not made; everything before it is."""

    def kill(n=1):
        plain, left = versions.commit, [n]

        def commit(*args):
            left[0] -= 1
            if left[0] == 0:
                raise Killed()
            return plain(*args)

        monkeypatch.setattr(versions, "commit", commit)

    kill.undo = monkeypatch.undo
    return kill


def test_a_number_is_given_once(spark, tmp_path):
    path = str(tmp_path)
    assert versions.current(spark, path) == (0, {})
    assert versions.commit(spark, path, 0, {"a": 1}) == 1 and versions.commit(spark, path, 1, {"a": 2}) == 2
    with pytest.raises(versions.Conflict):
        versions.commit(spark, path, 1, {"a": 3})
    assert versions.current(spark, path) == (2, {"a": 2}) and versions.numbers(spark, path) == [1, 2]


def test_publish_leaves_old_or_new(spark, tmp_path, killing):
    path, rows = str(tmp_path / "t"), spark.range(9)
    with pytest.raises(ValueError):
        store.published(spark, path, "id long")
    store.publish(rows, path)
    reader = store.published(spark, path, "id long")
    killing()
    with pytest.raises(Killed):
        store.publish(rows.limit(1), path)
    assert store.published(spark, path, "id long").count() == 9
    killing.undo()
    store.publish(rows.limit(2), path)
    assert reader.count() == 9 and store.published(spark, path, "id long").count() == 2  # one who reads still can
    with pytest.raises(ValueError):
        store.published(spark, path, "id long", version=2)


def test_merge_rewrites_touched_buckets_only(spark, tmp_path, killing):
    folder = str(tmp_path / "settings")
    rows = lambda *pairs: spark.createDataFrame(list(pairs), "key string, value long")
    state = lambda: {r["key"]: r["value"] for r in store.merged(spark, folder).collect()}
    store.merge(rows(*((f"k{i}", i) for i in range(40)), (None, 1)), folder, "key", buckets=8)
    before = versions.current(spark, folder)[1]["held"]
    assert state() == {f"k{i}": i for i in range(40)}
    touched = store.merge(rows(("k3", 33), ("new", 1)), folder, "key", gone=spark.createDataFrame([("k4",)], "key string"))
    after = versions.current(spark, folder)[1]["held"]
    assert {b for b in after if after[b] != before.get(b)} == {str(b) for b in touched} and len(touched) <= 3
    want = {f"k{i}": i for i in range(40) if i != 4} | {"k3": 33, "new": 1}
    assert state() == want
    killing()
    with pytest.raises(Killed):
        store.merge(rows(("k3", 0)), folder, "key")
    assert state() == want
    killing.undo()
    store.merge(rows(("x", 0)).limit(0), folder, "key", gone=spark.createDataFrame([(k,) for k in want], "key string"))
    assert state() == {}


def test_sessions_are_replaced_or_emptied(spark, tmp_path):
    folder = str(tmp_path / "sessions")
    said = spark.createDataFrame([(c, t, "user", f"{c}-{t}") for c in range(30) for t in range(3)], "conv_id long, turn long, role string, text string")
    store.save_sessions(said, folder)
    store.save_sessions(said.filter("conv_id = 4 AND turn = 0"), folder, emptied=said.filter("conv_id = 5").select("conv_id"))
    counts = {r["conv_id"]: r["count"] for r in store.merged(spark, folder).groupBy("conv_id").count().collect()}
    assert counts == {c: 1 if c == 4 else 3 for c in range(30) if c != 5}
    parts = {p.name for d in tmp_path.glob("sessions/part-*") for p in d.iterdir() if p.is_dir()}
    assert len(parts) <= store.BUCKETS  # no folder for each conversation


def listing(spark, path, rows, declared=None):
    sizes = {s: sum(r[0] == s and r[1] is not None for r in rows) for s in {r[0] for r in rows}} | (declared or {})
    spark.createDataFrame([(s, sizes[s], k, a, q, t) for k, (s, a, q, t) in enumerate(rows)], snapshots.LISTING).write.parquet(path)
    return path


FIRST = [("s", 1, "q1", "one"), ("s", 2, "q2", "two"), ("t", 3, "q3", None), ("t", 1, "other", "one"), ("u", None, None, None)]
SECOND = [("s", 1, "q1", "one"), ("s", 4, "q4", "two"), ("u", 3, "q3", ""), ("s", 2, "q2", "TWO")]


def taken(spark, folder):
    """All that readers of a folder see."""
    cut = lambda df, *c: sorted(map(tuple, df.select(*c).collect()), key=str)
    return (cut(snapshots.runs(spark, folder), "run", "source", "ok", "reason", "articles", "twice"), cut(snapshots.articles(spark, folder), "run", "article_id", "section", "question", "chars"),
            cut(snapshots.texts(spark, folder), "run", "text"), cut(snapshots.changes(spark, folder), "run", "article_id", "kind"))


WANT = (
    [(1, "a", True, None, 3, 1), (2, "b", False, "section s: 9 declared, 3 read", 0, 0), (3, "c", False, "listing not read: PATH_NOT_FOUND", 0, 0), (4, "d", True, None, 4, 0)],
    sorted([(1, 1, "s", "q1", 3), (1, 2, "s", "q2", 3), (1, 3, "t", "q3", 0), (4, 1, "s", "q1", 3), (4, 2, "s", "q2", 3), (4, 3, "u", "q3", 0), (4, 4, "s", "q4", 3)], key=str),
    sorted([(1, "one"), (1, "two"), (1, ""), (4, "TWO")], key=str),
    sorted([(4, 2, "changed"), (4, 3, "moved"), (4, 4, "new")], key=str),
)


def announced(spark, tmp_path):
    place = str(tmp_path / "announced")
    paths = {"a": listing(spark, str(tmp_path / "a"), FIRST), "b": listing(spark, str(tmp_path / "b"), SECOND, {"s": 9}), "c": str(tmp_path / "missing"), "d": listing(spark, str(tmp_path / "d"), SECOND)}
    for source, path in paths.items():
        snapshots.announce(spark, place, source, path)
    return place


def test_runs_are_taken_in_once(spark, tmp_path):
    place, folder = announced(spark, tmp_path), str(tmp_path / "site")
    snapshots.ingest(spark, place, folder, files_at_once=10).awaitTermination()
    assert taken(spark, folder) == WANT
    snapshots.ingest(spark, place, folder).awaitTermination()
    batch = spark.read.schema(snapshots.ANNOUNCED).json(place)
    snapshots.taking_in(folder)(batch, 0)  # a batch that comes again, as after a lost checkpoint
    assert taken(spark, folder) == WANT


@pytest.mark.parametrize("killed", [1, 4])
def test_a_killed_batch_leaves_nothing_and_is_taken_in_later(spark, tmp_path, killing, killed):
    place, folder = announced(spark, tmp_path), str(tmp_path / "site")
    killing(killed)
    with pytest.raises(StreamingQueryException):
        snapshots.ingest(spark, place, folder, files_at_once=10).awaitTermination()
    killing.undo()
    seen = taken(spark, folder)
    assert seen[0] == WANT[0][: killed - 1] and all(r[0] < killed for part in seen for r in part)
    snapshots.ingest(spark, place, folder, files_at_once=10).awaitTermination()
    assert taken(spark, folder) == WANT


def test_only_changed_documents_are_computed(spark, tmp_path, killing):
    folder, seen = str(tmp_path / "build"), []

    def build(texts, params=None, **more):
        docs = spark.createDataFrame([(k, t, f"{t}" if stamps else "same") for k, t in texts.items()], "doc_id long, text string, at string").repartition(3)

        def compute(given):
            seen.append(sorted(r["doc_id"] for r in given.collect()))
            return given.select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), " ")).alias("word"))

        return incremental.rebuild(docs, folder, params or {"cut": "1"}, compute, stamp=F.col("at") if stamps else None, **more)

    rows = lambda: sorted(map(tuple, incremental.rows(spark, folder).select("doc_id", "word").collect()))
    full = lambda texts: sorted((k, w) for k, t in texts.items() for w in (t or "").split(" "))
    stamps = False
    texts = {1: "a b", 2: "c", 3: None, 4: "d"}
    report = build(texts)
    assert (report["reason"], report["kept"], report["recomputed"]) == ("no build yet", 0, 4) and rows() == full(texts)
    texts = {1: "a b", 2: "c c", 3: None, 5: "e"}
    report = build(texts)
    assert {k: report[k] for k in ("reason", "kept", "recomputed", "deleted", "hashed")} == {"reason": None, "kept": 2, "recomputed": 2, "deleted": 1, "hashed": 4}
    assert seen[-1] == [2, 5] and rows() == full(texts)
    killing()
    with pytest.raises(Killed):
        build(texts | {1: "lost"})
    killing.undo()
    assert rows() == full(texts)
    stamps = True
    build(texts)
    report = build(texts | {1: "x"})
    assert report["hashed"] == 1 and seen[-1] == [1] and rows() == full(texts | {1: "x"})
    assert build(texts, {"cut": "2"})["reason"] == "other cut" and len(seen[-1]) == 4 and rows() == full(texts)
    assert build(texts, {"cut": "2"}, full=True)["reason"] == "asked for"
    build(texts | {2: "y", 9: "z"}, {"cut": "2"})
    incremental.compact(spark, folder)
    assert rows() == full(texts | {2: "y", 9: "z"}) and build(texts | {2: "y", 9: "z"}, {"cut": "2"})["recomputed"] == 0
    assert build({}, {"cut": "2"})["deleted"] == 5 and rows() == []


def test_notes_never_overwrite(spark, tmp_path):
    folder = str(tmp_path / "notes")
    notes = lambda *rows: spark.createDataFrame(list(rows), "note_id long, day string, title string, text string")
    names = lambda frame: {r["note_id"]: (r["name"], r["saved"]) for r in frame.collect()}
    first = names(store.save_notes(notes((1, "d", "Über  uns!", "a"), (2, "d", "ber-uns", "b"), (3, "d", "???", None), (4, "d", "x" * 60, "long")), folder))
    assert first == {1: ("d-ber-uns.md", True), 2: ("d-ber-uns-2.md", True), 3: ("d-note.md", True), 4: (f"d-{'x' * 40}.md", True)}
    assert names(store.save_notes(notes((9, "d", "ber uns", "c"), (8, "d", "new", "d")), folder)) == {9: ("d-ber-uns-3.md", True), 8: ("d-new.md", True)}
    kept = {r["name"]: r["text"] for r in store.merged(spark, folder).collect()}
    assert kept["d-ber-uns.md"] == "a" and kept["d-ber-uns-3.md"] == "c" and len(kept) == 6


def test_migrations_go_step_by_step(spark, tmp_path, killing):
    path = str(tmp_path / "table")
    store.publish(spark.range(3), path, 1)
    steps = {1: lambda t: t.withColumn("a", F.col("id") + 1), 2: lambda t: t.withColumn("b", F.col("a") * 2)}
    killing()
    with pytest.raises(Killed):
        store.migrate(spark, path, 3, steps)
    killing.undo()
    assert store.published(spark, path, "id long", 1).count() == 3
    assert store.migrate(spark, path, 3, steps) == 1 and store.migrate(spark, path, 3, steps) == 3
    assert sorted(map(tuple, store.published(spark, path, "id long, a long, b long", 3).collect())) == [(0, 1, 2), (1, 2, 4), (2, 3, 6)]
    with pytest.raises(ValueError):
        store.migrate(spark, path, 2, steps)


def test_vectors_are_stacked_by_group(spark):
    rows = [(k, k % 3, [float(k), 1.0]) for k in range(50)] + [(90, 0, None), (91, 0, [1.0])]
    blocks = store.stacked(spark.createDataFrame(rows, "id long, label int, v array<float>"), "label", "id", "v", most=10).collect()
    got = {i: r["values"][k * r["size"] : (k + 1) * r["size"]] for r in blocks for k, i in enumerate(r["ids"])}
    assert got == {i: v for i, _, v in rows if v is not None} and all(r["ids"] == sorted(r["ids"]) for r in blocks)


def test_rows_at_marks(spark, tmp_path, monkeypatch):
    """Marks give back the rows that were chosen, in every block and at its edges, broadcast or not."""
    path = str(tmp_path / "t")
    spark.range(0, 80_000, 1, 2).write.parquet(path)
    rows = spark.read.parquet(path).selectExpr("id", "_metadata.file_path AS file", "_metadata.row_index AS row")
    wanted = rows.filter("id % 7 = 3 OR row IN (0, 7, 8, 32767, 32768, 39999)")
    marks = snapshots._marked(wanted.select("file", "row"))
    expected = sorted(r["id"] for r in wanted.collect())
    assert sorted(r["id"] for r in snapshots._rows_at(rows, marks).collect()) == expected
    monkeypatch.setattr(snapshots, "BROADCAST_MARKS", 0)
    assert sorted(r["id"] for r in snapshots._rows_at(rows, marks).collect()) == expected


def test_a_run_moves_no_texts(spark, tmp_path):
    """What a run shuffles and spills is narrow: texts go from the listing to their place without one."""
    listing = str(tmp_path / "listing")
    text = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(299)), lambda i: F.sha2(F.concat_ws("-", "id", i.cast("string")), 256)), " ")
    rows = spark.range(0, 400, 1, 4).select(F.lit("s").alias("section"), F.lit(400).cast("long").alias("declared"), F.col("id").alias("place"), F.col("id").alias("article_id"), F.lit("q").alias("question"), text.alias("text"))
    rows.write.parquet(listing)  # 7.8 MB of texts that hardly pack
    store_, sc = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext
    arrays = sc._jvm.java.util.ArrayList
    stages = lambda: store_.stageList(arrays(), False, False, sc._gateway.new_array(sc._jvm.double, 0), arrays())
    each = lambda s: {s.apply(i).stageId(): s.apply(i).shuffleWriteBytes() + s.apply(i).diskBytesSpilled() for i in range(s.size())}
    before = set(each(stages()))
    snapshots.take_in(spark, str(tmp_path / "f"), "a", listing)
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    assert sum(v for k, v in each(stages()).items() if k not in before) < 1_000_000
    assert snapshots.texts(spark, str(tmp_path / "f")).count() == 400
