"""The site source against a server that serves pages, and functions that SQL calls."""

import hashlib
import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from tarnsift.functions import tables
from tarnsift.operators import rerank
from tarnsift.sources.site import SiteSource

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def site(spark):
    """The pages of the table as folders of 100, each page with a link to the next; a count of what was asked for."""
    rows = [(r["page_id"], r["html"]) for r in spark.read.parquet(f"{SF}/pages.parquet").orderBy("page_id").collect()]
    last, asked = len(rows) - 1, []
    pages = {f"/p{k}": html + ("" if k % 100 == 99 or k == last else f'<a class=x rel="next" href="p{k + 1}">next</a>') for k, (_, html) in enumerate(rows)}
    pages |= {"/round": '<link rel=next href="/round2">', "/round2": "<a href='/round' rel='next'>", "/torn": "<a rel=next href=/missing>"}
    tools = {f"/tools?cursor={k}" if k else "/tools": json.dumps({"tools": [k]} | ({"nextCursor": k + 1} if k < 60 else {})) for k in range(61)}
    tools |= {"/bad": '{"nextCursor": "a"}', "/bad?cursor=a": '{"nextCursor": "b"}', "/bad?cursor=b": '{"nextCursor": "a"}'}
    flaky = set()

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append(self.path)
            text = (pages | tools).get(self.path)
            tag = hashlib.md5((text or "").encode()).hexdigest()
            status = 404 if text is None else 304 if self.headers.get("If-None-Match") == tag else 200
            if self.path == "/p1" and "/p1" not in flaky:  # fails once
                flaky.add("/p1")
                status = 503
            self.send_response(status)
            self.send_header("ETag", tag)
            self.end_headers()
            if status == 200:
                self.wfile.write(text.encode())

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(SiteSource)
    yield f"http://127.0.0.1:{server.server_port}", pages, asked
    server.shutdown()


def read(spark, base, starts, **options):
    return spark.read.format("site").options(base=base, starts=",".join(starts), **options).load()


def test_all_pages_of_all_folders(spark, site):
    base, pages, asked = site
    count = sum(p.startswith("/p") for p in pages)
    starts = [f"/p{k}" for k in range(0, count, 100)]
    rows = read(spark, base, starts, at_once=3)
    assert rows.rdd.getNumPartitions() == min(3, len(starts))
    got = rows.collect()
    assert {r["path"]: r["text"] for r in got} == {p: t for p, t in pages.items() if p.startswith("/p")}  # no cap: folders have up to 100 pages
    assert all(r["n"] == int(r["path"][2:]) % 100 + 1 and r["folder"] == f"/p{int(r['path'][2:]) // 100 * 100}" for r in got)
    assert max(r["requests"] for r in got if r["folder"] == "/p0") == min(100, count) + 1  # one was asked for twice


def test_missing_and_revisited_pages_and_stamps(spark, site):
    base, pages, _ = site
    got = {r["path"]: r for r in read(spark, base, ["/round", "/torn", "/none"]).collect()}
    assert {p: r["status"] for p, r in got.items()} == {"/round": 200, "/round2": 200, "/torn": 200, "/missing": 404, "/none": 404} and got["/missing"]["text"] is None
    stamps = {p: hashlib.md5(pages[p].encode()).hexdigest() for p in ("/round", "/torn")} | {"/torn": "old"}
    again = {r["path"]: (r["status"], r["text"] is None) for r in read(spark, base, ["/round", "/torn"], stamps=json.dumps(stamps), most_pages=1).collect()}
    assert again == {"/round": (304, True), "/torn": (200, False)}


def test_cursors(spark, site):
    base, *_ = site
    got = read(spark, base, ["/tools"], next="cursor").select("n", F.get_json_object("text", "$.tools[0]").cast("int").alias("tool")).orderBy("n").collect()
    assert [r["tool"] for r in got] == list(range(61))
    with pytest.raises(Exception, match="RepeatedCursor"):
        read(spark, base, ["/bad"], next="cursor").collect()


def test_functions_called_from_sql(spark):
    spark.createDataFrame([("a/x.py", "def f\n  pass\nclass A"), ("b/y.md", "# def\n" + "z" * 300), ("c.py", None)], "path string, text string").createOrReplaceTempView("files")
    spark.createDataFrame([(1, 7, "open", 5, "Some keys, ключи"), (2, 7, "closed", 6, "monkey"), (3, 8, "open", 9, "keys and some more")], "ticket long, user_id long, status string, created long, text string").createOrReplaceTempView("tickets")
    tables.register(spark)
    rows = lambda text: [tuple(r) for r in spark.sql(text).collect()]
    assert rows("SELECT path, line_no FROM grep('^def|class')") == [("a/x.py", 1), ("a/x.py", 3)]
    assert rows("SELECT path, line_no FROM grep('def', fixed => true, glob => '?/*')") == [("a/x.py", 1), ("b/y.md", 1)]
    assert rows("SELECT length(line) FROM grep('zzz')") == [(200,)] and len(rows("SELECT * FROM grep('', most => 2)")) == 2 and rows("SELECT * FROM grep('a', glob => 'a.x.py')") == []
    assert rows("SELECT * FROM show_range('a/x.py', 2)") == [(2, "  pass"), (3, "class A")] and rows("SELECT line_no FROM show_range('a/x.py', most_chars => 14)") == [(1,), (2,)]
    assert rows("SELECT ticket, score FROM find_tickets('key KEY some a')") == [(3, 2), (1, 2)] and rows("SELECT ticket, score FROM find_tickets('ключ', wanted => 'open')") == [(1, 1)]
    assert rows("SELECT ticket FROM find_tickets(user => 7)") == [(2,), (1,)] and rows("SELECT ticket FROM find_tickets(most => 1)") == [(3,)]
    assert rows("""SELECT a, b FROM VALUES ('{"a": 1, "b": "x"}'), ('no json'), (NULL), ('[1]') AS v(t), LATERAL json_fields(t, 'a, b')""") == [("1", "x"), (None, None), (None, None), (None, None)]
    plan = spark.sql("SELECT line_no FROM grep('def', fixed => true)")._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains" in plan and "RLIKE(line" not in plan  # the branch that was not asked for is gone


def test_any_scorer_reranks(spark):
    pairs = spark.createDataFrame([(1, "a b", 10, "a c", 1), (1, "a b", 11, "b a", 2), (1, "a b", 12, None, 3), (2, None, 10, "a c", 1), (2, None, 13, None, 2)], "query_id long, query string, doc_id long, text string, place long").repartition(3)
    got = rerank.rescored(pairs, rerank.shared_words).collect()
    assert sorted((r["query_id"], r["second"], r["doc_id"]) for r in got) == [(1, 1, 11), (1, 2, 10), (1, 3, 12), (2, 1, 10), (2, 2, 13)]
    longest = lambda: lambda queries, texts: [len(t) for t in texts]
    assert sorted((r["query_id"], r["doc_id"], r["score"]) for r in rerank.rescored(pairs, longest, limit=1, threshold=1.0).collect()) == [(1, 10, 3.0), (2, 10, 3.0)]
