import gc
import time
import tracemalloc

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from searchmill.functions import markup
from searchmill.operators import extract as X

PAGE = """<!doctype html><html lang="en" class="x"><head><meta charset="utf-8"><title> Sample
 Document </title><meta content="Example summary" name="description"><meta content="python, search,,engine" name="keywords">
<link rel="canonical" href="https://example.com/canon"><meta property="article:published_time" content="bad"><meta name="date" content="2024-03-04">
<script type="application/ld+json">{"@type": "Thing", "dateModified": "2024-05-06T07:08:09Z"}</script><script>var x = "<a href='/no'>";</script></head>
<body><nav aria-label="Breadcrumbs"><a href="/">Home</a><a href="/docs">Docs</a></nav>
<main><h1>First</h1><p>One <b>two</b><p>three <a href="/next">next</a><h2></h2><pre>code</pre><code>this inline code is longer than thirty characters</code><pre><code>this code is inside a block, so it doesn't count twice</code></pre>
<p>Last updated <time datetime="2024-07-08">July</time></p></main><footer>foot</footer></body></html>"""


def one(spark, html, url="https://example.com/start"):
    return X.parse_pages(spark.createDataFrame([(1, url, html)], "page_id long, url string, html string")).first()


def test_sample_page(spark):
    r = one(spark, PAGE)
    assert (r.title, r.meta_description, r.language, r.canonical_url) == ("Sample Document", "Example summary", "en", "https://example.com/canon")
    assert r.links == ["https://example.com/", "https://example.com/docs", "https://example.com/next"]
    assert r.headings == ["First"] and r.tags == "python search engine".split()
    assert str(r.published_at) == "2024-03-04 00:00:00" and str(r.last_updated_at) == "2024-07-08 00:00:00"
    assert r.code_block_count == 3 and r.section_path == "Home > Docs"
    assert r.body.startswith("First One two three next code") and "foot" not in r.body and r.word_count == len(r.body.split())


def test_fallbacks(spark):
    r = one(spark, "<h1>Only <i>heading</i></h1><p>Para</p>", "https://example.com/docs/a-b/c_d.html")
    assert (r.title, r.meta_description, r.language, r.section_path) == ("Only heading", "Para", None, "A B > C D")
    assert r.published_at is None and r.schema_json == "{}" and r.canonical_url.endswith("c_d.html")


def test_breadcrumb_schema(spark):
    ld = '{"@graph": [{"@type": "BreadcrumbList", "itemListElement": [{"name": "A"}, {"name": " B  C "}]}]}'
    assert one(spark, f'<script type="application/ld+json">{ld}</script>x').section_path == "A > B C"


def test_empty_null_and_odd_pages(spark):
    for html in (None, "", "plain text", "<p", "<div>" * 3000 + "deep"):
        r = one(spark, html)
        assert r.page_id == 1 and r.links == []
    assert one(spark, "<div>" * 3000 + "deep").body == "deep"
    assert X.parse_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_long_body_is_cut_where_the_record_says(spark):
    r = one(spark, "<main>" + "word " * 20000 + "</main>")
    assert len(r.body) == X.BODY_CHARS and r.word_count == len(r.body.split())


def test_first_date(spark):
    d = spark.createDataFrame([(["x", "2024-01-01", "2024-02-02"],), ([],)], "c array<string>")
    got = [r[0] for r in d.select(F.when(F.size("c") > 0, X.first_date(F.col("c")))).collect()]
    assert str(got[0]) == "2024-01-01 00:00:00" and got[1] is None


def test_hostile_pages_take_time_in_proportion():
    began = time.perf_counter()
    for html in ("<a " * 350_000, "<time datetime='2024-01-01'>" * 10_000 + "updated", '<a ">" ' * 50_000 + "'", "<script " * 50_000, "<div>" * 20_000 + "</x>" * 20_000, "<code>x " * 10_000):
        X.parse("https://example.com/a", html)
    assert time.perf_counter() - began < 20
    r = X.parse("https://example.com/a", "<p>edited <time datetime='2024-01-01'>" * 10_000)
    assert len(r["updated"]) == 10_000


def test_markup():
    got = list(markup.tokens("a<!-- x --><B C='1>2' c=3 d>t&amp;</b ><br/><script x>if (a<b) '</p>'</script>z<i", frozenset(("script",))))
    assert got == [("text", "a", ""), ("open", "b", " C='1>2' c=3 d"), ("text", "t&amp;", ""), ("close", "b", ""), ("alone", "br", "/"), ("open", "script", " x"), ("raw", "script", "if (a<b) '</p>'"), ("text", "z", ""), ("text", "<i", "")]
    assert markup.attributes(" C='1>2' c=3 d e = \"&amp;\"") == {"c": "1>2", "d": "", "e": "&"}


CUT = """<!DOCTYPE html><html lang="en"><head><title>A &amp; B &amp</title></head><body><article><h1>A &amp; B &quot</h1><p>x &copy; y &am &ltz &amp;lt; &nosuch;</p><a href="/q?a=1&copy=2">l</a></article></body></html>"""


@pytest.fixture(scope="module")
def cut_pages(spark, tmp_path_factory):
    """Pages with entities cut off before their semicolon."""
    d = tmp_path_factory.mktemp("cut")
    spark.createDataFrame([(1, "https://a.example.com/docs/x/y", CUT), (2, "https://a.example.com/", CUT.replace("&quot", "&qu"))], "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    return d


def _rows_and_sql(spark, d, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{d}/pages.parquet/*.parquet')")
    rel = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in rel.description]
    return sorted(map(repr, map(tuple, entry.queries()[name](spark, str(d)).select(*columns).collect()))), sorted(map(repr, rel.fetchall()))


def test_body_keeps_cut_entities_as_its_sql_does(spark, cut_pages):
    ours, theirs = _rows_and_sql(spark, cut_pages, "extract_body")
    assert ours == theirs and "x © y &am &ltz &lt; &nosuch;" in ours[0]


def test_headings_keep_cut_entities_as_their_sql_does(spark, cut_pages):
    ours, theirs = _rows_and_sql(spark, cut_pages, "extract_headings")
    assert ours == theirs and "A & B &quot" in ours[0]


def test_title_keeps_cut_entities_as_its_sql_does(spark, cut_pages):
    ours, theirs = _rows_and_sql(spark, cut_pages, "extract_title")
    assert ours == theirs and "A & B &amp" in ours[0]


def test_records_keep_cut_entities_as_their_sql_does(spark, cut_pages):
    ours, theirs = _rows_and_sql(spark, cut_pages, "parse_pages")
    assert ours == theirs and "/q?a=1&copy=2" in ours[0]


def test_memory_does_not_grow_with_the_pages_of_a_batch():
    page = "<html><body><main>" + "<p>some words of a page <a href='/x'>x</a></p>" * 400 + "</main></body></html>"

    def peak(n: int) -> int:
        tracemalloc.start()
        got = X._records(pa.array(["https://example.com/a"] * n), pa.array([page] * (n - 1) + [None]))
        out = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert len(got) == n and got[0]["body"].as_py() == got[n - 2]["body"].as_py() != "" == got[n - 1]["body"].as_py()
        return out

    X._records(pa.array([], pa.string()), pa.array([], pa.string()))
    assert peak(320) < 1.5 * peak(40)


def test_a_parsed_page_is_freed_at_once():
    gc.collect()
    gc.disable()
    try:
        X.parse("https://example.com/a", PAGE)
        assert not any(isinstance(o, X.Node) for o in gc.get_objects())
    finally:
        gc.enable()


def test_pages_come_in_small_batches(spark):
    was = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    try:
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
        X.record(F.col("url"), F.col("html"))
        assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(4 << 20)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", was)
