import time

import duckdb
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from searchmill.functions import columns as C
from searchmill.sources import index_settings, stores
from searchmill.sources import requests as R


def test_strict_request():
    R.Request(q=" x ", page=1, limit=50, content_type=("api",)).checked()
    for bad in (dict(page=0), dict(limit=100), dict(q="x" * 201), dict(tags=("x",) * 21), dict(content_type=("zip",)), dict(sort="random"), dict(published_from="1.2.2024"), dict(published_from="2024-02-01", published_to="2024-01-01")):
        with pytest.raises(ValueError):
            R.Request(**bad).checked()


def test_lenient_address():
    r = R.parse_address("page=-4&limit=500&sort=random&from=x")
    assert (r.page, r.limit, r.sort, r.published_from) == (1, 10, "relevance", None)
    many = "&".join(f"tags=t{i % 24}" for i in range(25))
    assert len(R.parse_address(many).tags) == 20
    assert R.parse_address("contentType=api&contentType=zip&contentType=api").content_type == ("api",)


@given(st.text(max_size=30), st.integers(1, 10_000), st.lists(st.sampled_from(["a", "b b", "c&d", "é"]), max_size=4, unique=True), st.sampled_from(R.SORTS), st.sampled_from([None, *R.WINDOWS]))
def test_round_trip(q, page, tags, sort, within):
    r = R.Request(q=q.strip(), page=page, tags=tuple(tags), sort=sort, updated_within=within)
    assert R.parse_address(r.address()) == r


def test_toggle_and_guard():
    r = R.Request(page=5).toggled("source", "a")
    assert (r.source, r.page) == (("a",), 1) and r.toggled("source", "a").source == ()
    assert not R.Request(published_from="2024-01-01").worth_running() and r.worth_running()


def test_click():
    good = "0a1b2c3d-0000-4000-8000-0123456789ab"
    R.Click(good, good, 4).checked()
    for bad in (R.Click("x", good, 4), R.Click(good, good, 0)):
        with pytest.raises(ValueError):
            bad.checked()


def test_settings_and_modes():
    s = R.CrawlSettings.of({"MAX_DEPTH": " ", "CONCURRENCY": "0"}, {"defaults": {"max_depth": 1}, "sources": [{"allowed_domains": ["A.org", "b.org"]}, {"allowed_domains": ["a.org"]}]})
    assert (s.max_depth, s.concurrency, s.allowed_domains) == (1, 1, ("a.org", "b.org"))
    assert [R.mode(*m) for m in ((True, True, False), (True, False, False), (False, False, True), (False, False, False))] == ["live", "degraded", "demo", "unavailable"]
    assert R.flag(None, True) and not R.flag("", True) and R.flag(" Yes ")


def test_index_reads_only_its_buckets(spark, tmp_path):
    docs = spark.createDataFrame([(1, "one two", "", "", "three", ["t"]), (2, "two", "", "", "", [])], "id long, title string, section_path string, meta_description string, body string, tags array<string>")
    _, path = stores.write_index(docs, str(tmp_path), "1", buckets=8)
    p = spark.read.parquet(path)
    hits = stores.read_postings(p, ["two"], buckets=8)
    assert sorted(r.id for r in hits.collect()) == [1, 2]
    assert stores.read_postings(p, [], buckets=8).count() == 0
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1]
    with pytest.raises(Exception):
        stores.write_index(docs, str(tmp_path), "1", buckets=8)


def test_postings_of_a_frequent_term_are_written_by_many_tasks(spark, tmp_path):
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    words = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(20)), lambda i: F.concat(F.lit("the w"), (F.col("id") * i % 997).cast("string"))), " ")
    docs = spark.range(0, 4000, 1, 8).select("id", F.lit("").alias("title"), F.lit("").alias("section_path"), F.lit("").alias("meta_description"), words.alias("body"), F.array().cast("array<string>").alias("tags"))
    was, split = spark.conf.get(size), spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set(size, "32k")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
        _, path = stores.write_index(docs, str(tmp_path), "1", buckets=8)
    finally:
        spark.conf.set(size, was)
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    the = stores.read_postings(spark.read.parquet(path), ["the"], buckets=8)
    rows = the.groupBy(F.input_file_name().alias("f")).count().collect()
    assert sum(r["count"] for r in rows) == the.select("id", "pos").distinct().count() == 80_000
    assert len(rows) > 2 and max(r["count"] for r in rows) < 40_000
    for r in rows:
        terms = [x.term for x in spark.read.parquet(r.f).collect()]
        assert terms == sorted(terms)


def test_robots(spark):
    frontier = spark.createDataFrame([("http://a/x", "a"), ("http://a/private/y", "a"), ("http://b/", "b"), ("http://c/", "c")], "url string, domain string")
    robots = spark.createDataFrame([("a", "User-agent: *\nDisallow: /private"), ("b", "")], "domain string, robots string")
    got = {r.url: r.allowed for r in stores.allowed_by_robots(frontier, robots).collect()}
    assert got == {"http://a/x": True, "http://a/private/y": False, "http://b/": True, "http://c/": False}


def test_within(spark):
    assert stores.within(spark, lambda: spark.range(10).count(), 60, "search") == 10
    began = time.perf_counter()
    with pytest.raises(TimeoutError, match="search service unavailable"):
        stores.within(spark, lambda: spark.range(10**13).selectExpr("sum(hash(id) % 7)").collect(), 2, "search")
    assert time.perf_counter() - began < 30
    assert spark.range(3).count() == 3


def test_index_settings(spark):
    same = spark.createDataFrame([(k, list(v)) for k, v in index_settings.WANTED.items()], index_settings.KIND)
    assert index_settings.reconcile(same).count() == 0
    assert index_settings.reconcile(same.limit(0)).count() == len(index_settings.WANTED)


def test_compact_numbers(spark):
    n = [0, 999, 9_999, 10_000, 12_345, 99_949, 99_950, 999_949, 999_950, 1_000_000, 1_250_000, 999_950_000, 7 * 10**12]
    got = [r[0] for r in spark.createDataFrame([(i,) for i in n], "n long").select(C.compact_number(F.col("n"))).collect()]
    assert got == ["0", "999", "9,999", "10K", "12.3K", "99.9K", "100K", "999.9K", "1M", "1M", "1.3M", "1B", "7T"]


def test_compact_number_query_keeps_to_the_units_of_its_sql(spark, tmp_path):
    ids = [0, 17, 5_199, 164_396, 164_397, 164_399, 164_400, 600_000, 5_999_999, 16_000_000, 400_000_000]
    spark.createDataFrame([(i,) for i in ids], "event_id long").write.parquet(str(tmp_path / "events.parquet"))
    got = {r.id: r.shown for r in entry.queries()["compact_number"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    assert got == dict(con.execute(entry.oracle_sql()["compact_number"]).fetchall())
    assert got[600_000] == "13320B"
