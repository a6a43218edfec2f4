"""Cleaning, glossary units, budgets, ordered parts and profiles against plain loops and literals."""

import random

from pyspark.sql import functions as F

from tarnsift.operators import budgets, cleaned, ordered_parts, profiles
from tarnsift.plans import reading

SF = "/root/testdata/sf0.001"


def test_cleaning_on_literal_lines(spark):
    text = "A first line that is cut exam-\nple of it. Next\n  and  on \n\n12\n•\nNew one:\n(not a start)\n— dash\nAn end.\n«after»\nsmall print\non page two\n\x07\x08"
    pages, sizes = [1] * 12 + [2, 1], [10.0] * 11 + [5.0, 10.0, 10.0]
    lines = cleaned.raw_lines(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string"))
    extra = spark.createDataFrame([(1, k + 1, p, s) for k, (p, s) in enumerate(zip(pages, sizes))], "doc_id long, n int, page int, size double")
    told = cleaned.dropped(lines.join(extra, ["doc_id", "n"]), (2,), 8.0)
    assert {(r["rule"], r["n"], r["gone"]) for r in told.filter("rule IS NOT NULL").collect()} == {("digits", 5, 2), ("bullet", 6, 1), ("small", 12, 11), ("page", 13, 11), ("control", 14, 2)}
    row = cleaned.clean_texts(cleaned.pieces(told)).first()
    assert row["text"] == "A first line that is cut example of it. Next and on\nNew one:\n(not a start)\n— dash\nAn end.\n«after»"
    assert (row["paragraphs"], row["hyphens"]) == (6, 1)


def test_places_lead_back(spark):
    rows = reading.t1_places(spark, SF).collect()
    assert len(rows) > 200 and all(r["clean_char"] == r["raw_char"] for r in rows if not r["clean_char"].isspace())
    told, kept = reading._told(spark, SF), cleaned.pieces(reading._told(spark, SF))
    sizes = {r["doc_id"]: r["n"] for r in told.groupBy("doc_id").agg(F.sum(F.length("said")).alias("n")).collect()}
    shown = {r["doc_id"]: r["n"] for r in kept.groupBy("doc_id").agg((F.sum(F.length("piece")) + F.count_if(F.col("joined") == "hyphen")).alias("n")).collect()}
    lost = {r["doc_id"]: r["n"] for r in told.filter("rule IS NOT NULL").groupBy("doc_id").agg(F.sum(F.length("said")).alias("n")).collect()}
    assert all(sizes[d] == shown.get(d, 0) + lost.get(d, 0) for d in sizes)  # nothing is lost but what a rule takes


def test_glossary_units(spark):
    kinds = [("heading", "A", ""), ("heading", "B", ""), ("entry", "x is", "x"), ("text", "more", ""), ("text", "still", ""), ("entry", "y is", "y"), ("heading", "C", ""), ("text", "plain", ""), ("heading", "D", "")]
    rows = [(1, k, kind, t, name, 10 * k, 10 * k + 5) for k, (kind, t, name) in enumerate(kinds)] + [(2, 0, "heading", "Alone", "", 0, 5), (3, 0, "text", "bare", "", 0, 4)]
    got = cleaned.glossary_units(spark.createDataFrame(rows, "doc_id long, n int, kind string, text string, name string, start int, end int"))
    assert sorted(map(tuple, got.collect())) == [
        (1, 1, "entry", "A · B › x", 0, 25), (1, 2, "group", "A · B", 30, 45), (1, 3, "entry", "A · B › y", 50, 55), (1, 4, "group", "C", 60, 85), (2, 1, "group", "Alone", 0, 5), (3, 1, "group", "", 0, 4)]


def test_lists_are_shortened_before_they_stop(spark):
    rng = random.Random(2)
    rows = [(key, n, "x" * rng.choice((3, 20, 60, 200))) for key in range(60) for n in range(rng.randrange(1, 15))]
    got = budgets.degraded_lists(spark.createDataFrame(rows, "key long, n long, text string"), "key", ["n"], F.col("text"), F.substring("text", 1, 10), 250, most=9, reserve=30)
    for r in got.collect():
        items, left, shown, short = [t for k, _, t in rows if k == r["key"]], 220, [], 0
        for t in items[:9]:
            block = t if len(t) + 1 <= left else t[:10]
            if len(block) + 1 > left:
                break
            shown.append(block)
            short += block != t
            left -= len(block) + 1
        assert (r["shown"], r["shortened"], r["left_out"], r["used"]) == ("\n".join(shown), short, len(items) - len(shown), 220 - left)


def test_tickets_lose_old_messages_then_letters(spark):
    rows = [(1, n, "user" if n % 2 else "staff", "m" * 50) for n in range(10)] + [(2, 0, "user", "q" * 900), (3, 0, "staff", None)]
    got = {r["ticket"]: r for r in budgets.tickets(spark.createDataFrame(rows, "ticket long, n long, sender string, text string"), 400, 200).collect()}
    assert (got[1]["kept"], got[1]["field_limit"], got[1]["fits"]) == (3, None, True) and "… 6 earlier not shown" in got[1]["shown"] and len(got[1]["shown"]) <= 400
    assert (got[2]["kept"], got[2]["field_limit"], got[2]["fits"]) == (0, 100, True) and got[2]["shown"].count("… [cut]") == 3
    assert got[3]["shown"] == "Ticket 3\nSubject: \nQuestion: \nMessages:\nstaff: "
    tight = budgets.tickets(spark.createDataFrame(rows[:10], "ticket long, n long, sender string, text string"), 20, 8).first()
    assert not tight["fits"] and tight["field_limit"] == 1


def test_parts_in_order_equal_a_plain_search(spark):
    rng = random.Random(7)
    texts = [(k, " ".join(rng.choices("abc", k=rng.randrange(40)))) for k in range(120)] + [(500, None), (501, "")]
    items = {k: [" ".join(rng.choices("abc", k=rng.choice((1, 2, 3, 5, 7)))) for _ in range(rng.choice((1, 2, 3)))] for k in range(25)} | {90: ["", "A b!"], 91: [""]}
    parts = [(i, n, t) for i, ts in items.items() for n, t in enumerate(ts, 1)]
    got = ordered_parts.found_in_order(spark.createDataFrame(texts, "doc_id long, text string").repartition(3), spark.createDataFrame(parts, "item_id long, part int, text string"))
    want = {}
    for doc, text in texts:
        w = (text or "").split()
        for item, ts in items.items():
            at, first, needles = 0, None, [n for n in (t.lower().replace("!", "").split() for t in ts) if n]
            for n in needles:
                place = next((k for k in range(at, len(w) - len(n) + 1) if w[k : k + len(n)] == n), None)
                if place is None:
                    break
                first, at = place if first is None else first, place + len(n)
            else:
                if needles:
                    want[doc, item] = (first, at)
    assert {(r["doc_id"], r["item_id"]): (r["first"], r["last"]) for r in got.collect()} == want and len(want) > 100
    assert ordered_parts.found_in_order(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([], "item_id long, part int, text string")).collect() == []


def test_profiles_field_by_field(spark):
    old = [("Teach  Me", {"a": "1", "b": "2", "c": None}), ("Gone", {}), ("Same", {"x": "y"}), ("None", None)]
    new = [(" teach me", {"a": "1", "b": "3", "d": "4", "c": "5"}), ("Fresh", {"q": "r"}), ("SAME", {"x": "y"}), ("none", {})]
    frame = lambda rows: spark.createDataFrame(rows, "mode string, fields map<string,string>")
    assert {r["mode"]: (r["status"], r["fields"]) for r in profiles.compared(frame(old), frame(new)).collect()} == {
        " teach me": ("changed", ["b changed", "c changed", "d added"]), "Gone": ("removed", []), "Fresh": ("added", []), "SAME": ("same", []), "none": ("same", [])}
