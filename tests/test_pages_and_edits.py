"""Pages, diffs and tables that are written, on small cases."""

import pytest
from pyspark.sql import functions as F

from tarnsift.operators import html
from tarnsift.plans import lookups
from tarnsift.sources import store


def read(spark, *pages):
    rows = html.pages_read(spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")).collect()
    return [r for _, r in sorted((r["page_id"], r) for r in rows)]


def test_page_parts(spark):
    page = ("<head><title>T &amp; U</title></head><body><p>One<br>two <b>three<p class='x y' id=z>four</div></p><ul><li>a</li><li>b</ul><img src=q><script>no('<p>')</script><!-- <p> -->"
            "<table><tr><th>Name</th><td>Value</td></tr><tr><td></td><td>x</td></tr><tr><td><input></td></tr></table><dl><dt>k</dt><dd>v</dd></dl><a href='/u'>li nk</a></body>")  # fmt: skip
    got, text, missing, empty, deep = read(spark, page, "<p>One<br>two</p><ul><li>a</li><li>b</li></ul><p>x <img> y</p><script>no()</script>", None, "", "<div>" * 5000 + "deep")
    assert (got["title"], got["nodes"], [tuple(x) for x in got["links"]]) == ("T & U", 26, [("/u", "li nk")])
    assert got["body"].split("\n\n") == ["One\ntwo three\nfour", "- a", "- b\n[image]", "NameValue", "x", "k", "v", "li nk"]
    assert got["cells"] == [["Name", "Value"], ["—", "x"]] and [tuple(x) for x in got["fields"]] == [("k", "v"), ("Name", "Value")]
    assert text["body"] == "One\ntwo\n\n- a\n\n- b\n\nx [image] y" and deep["body"] == "deep" and deep["nodes"] == 5000
    assert [(r["problem"], r["nodes"], r["body"]) for r in (missing, empty)] == [("not found", 0, None)] * 2


def test_open_ends_references_and_quoted_signs(spark):
    got = read(spark, "<table><tr><td>a<td>b<tr><th>c<td>d</table><dl><dt>n<dd>1<dd>2<dt>m<dd>3</dl><meta name=k content='v v'><a title='>' href=\"x>y\">q &#x41;&#66; &lt;b&gt; &nope; 1 < 2 &</a>")[0]
    assert got["cells"] == [["a", "b"], ["c", "d"]] and [tuple(x) for x in got["fields"]] == [("n", "1"), ("n", "2"), ("m", "3"), ("c", "d"), ("k", "v v")]
    assert [tuple(x) for x in got["links"]] == [("x>y", "q AB <b> &nope; 1 < 2 &")]
    row = spark.createDataFrame([("<p class='x y' id=z><b class=y><p id='z w'>",)], "h string")
    for selector, n in (("p", 2), (".y", 2), ("p.x", 1), ("p#z", 2), ("b.x", 0), ("#w", 1)):
        assert len(row.select(html.selected(F.col("h"), selector).alias("s")).first()["s"]) == n, selector


def test_references_cut_off_stay(spark):
    got = read(spark, "<title>a &amp;&amp;&amp</title><body><p>x &lt;&lt</p></body>")[0]
    assert (got["title"], got["body"]) == ("a &&&amp", "x <&lt")


def test_diffs():
    assert lookups.text_diff("a\nb\n\nc", "a\nB\nc") == ["- b", "+ B"] and lookups.text_diff("x", "x") == []
    many = lookups.text_diff("", "\n".join(f"line {k} " + "x" * 300 for k in range(20)))
    assert len(many) == 13 and many[-1] == "… and 8 more" and all(len(x) <= 203 for x in many)
    patch, added, removed = lookups.unified("a\nb", "a\nc\n", "f.txt")
    assert (added, removed) == (1, 1) and patch.startswith("--- a/f.txt\n+++ b/f.txt\n") and "-b\n\\ No newline at end of file\n+c\n" in patch


def test_published_tables(spark, tmp_path):
    path = str(tmp_path / "index")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, t string")
    store.publish(rows, path)
    store.publish(rows.limit(1), path)
    assert store.published(spark, path, "id long, t string").count() == 1
    with pytest.raises(ValueError):
        store.published(spark, path, "id long, other string")
    with pytest.raises(ValueError):
        store.published(spark, path, "id long", version=2)
    with pytest.raises(Exception):
        store.publish(rows.selectExpr("id", "CAST(raise_error('no') AS string) AS t"), path)
    assert store.published(spark, path, "id long, t string").count() == 1
    edits = spark.createDataFrame([(1, None, "x"), (2, "wrong", "y")], "doc_id long, sha string, text string")
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "doc_id long, text string")
    assert {r["doc_id"]: r["fate"] for r in store.guarded(edits, docs).collect()} == {1: "unchanged", 2: "refused", 3: "unchanged"}
