import random

from pyspark.sql import functions as F

from searchmill.operators import analytics as A
from searchmill.operators import evaluation as E
from searchmill.operators import state as T
from searchmill.sources import seeds

NOW = "2024-02-05 00:00:00"
QUEUE = "id long, url string, normalized_url string, domain string, depth int, source_url string, source_slug string, status string, priority int, retry_count int, scheduled_at timestamp_ntz, processed_at timestamp_ntz"
BATCH = "url string, normalized_url string, domain string, depth int, source_url string, source_slug string, priority int, arrival long"


def test_enqueue_gives_a_source_to_an_old_row(spark):
    q = spark.createDataFrame([(1, "U", "u", "d", 2, None, None, "done", 50, 1, None, None), (2, "V", "v", "d", 0, None, "s", "done", 50, 0, None, None)], QUEUE)
    b = spark.createDataFrame([("U2", "u", "d2", 3, "x", None, 70, 1), ("U3", "u", "d3", 1, "y", "t", 60, 2), ("W", "w", "d", 1, "z", None, 9, 4), ("W2", "w", "e", 0, "zz", "r", 10, 5), ("V9", "v", "d", 0, None, "other", 1, 6)], BATCH)
    got = {r.normalized_url: r for r in T.enqueue_merge(q, b, NOW).collect()}
    u, v, w = got["u"], got["v"], got["w"]
    assert (u.url, u.domain, u.depth, u.priority, u.source_slug, u.status) == ("U", "d", 1, 50, "t", "pending")
    assert (v.source_slug, v.status, v.priority) == ("s", "done", 1)
    assert (w.url, w.source_url, w.depth, w.priority, w.source_slug, w.status) == ("W", "z", 0, 9, "r", "pending")
    assert T.enqueue_merge(q, b.limit(0), NOW).count() == 2


def test_slots_equal_the_recurrence(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice("ab"), float(rng.randrange(20))) for i in range(200)]
    got = {r.id: r.slot for r in T.domain_slots(spark.createDataFrame(rows, "id long, domain string, t double"), 1.5).collect()}
    last: dict[str, float] = {}
    for i, d, t in sorted(rows, key=lambda r: (r[2], r[0])):
        last[d] = max(t, last[d] + 1.5) if d in last else t
        assert got[i] == last[d]


def test_bfs(spark):
    pages = spark.createDataFrame([("http://a.org/", ["http://a.org/b/", "http://a.org/c#x"]), ("http://a.org/b", ["http://a.org/d", "http://a.org/"]), ("http://a.org/d", ["http://a.org/e"])], "normalized_url string, links array<string>")
    got = {r.normalized_url: r.depth for r in T.bfs_frontier(pages.limit(1).select("normalized_url"), pages, 2).collect()}
    assert got == {"http://a.org/": 0, "http://a.org/b": 1, "http://a.org/c": 1, "http://a.org/d": 2}


def test_only_the_first_links_count(spark):
    pages = spark.createDataFrame([("p", [f"http://a.org/{i}" for i in range(60)])], "normalized_url string, links array<string>")
    assert T.discover(pages.select("normalized_url"), pages, 1).count() == T.LINKS


def test_health(spark):
    o = spark.createDataFrame([("a", 3, 0, 0), ("b", 1, 1, 1), ("c", 1, 1, 0), ("d", 0, 0, 0)], "source_slug string, done long, failed long, remaining long")
    got = {r.source_slug: (r.crawl_status, r.successful) for r in A.source_health(o).collect()}
    assert got == {"a": ("healthy", True), "b": ("crawling", True), "c": ("failing", True), "d": ("healthy", False)}


def test_index_status_is_checked(spark):
    docs = spark.createDataFrame([(1, "stored"), (2, "stored"), (3, "stored")], "id long, status string")
    up = spark.createDataFrame([(1, "indexed"), (2, "lost")], "id long, index_status string")
    assert {r.id: r.status for r in T.mark_index_status(docs, up).collect()} == {1: "indexed", 2: "stored", 3: "stored"}


def test_taking_a_batch(spark):
    q = spark.createDataFrame([(i, "pending" if i else "done", i % 2) for i in range(5)], "id long, status string, priority int").withColumn("scheduled_at", F.lit(NOW).cast("timestamp_ntz"))
    got = {r.id: r.status for r in T.take_batch(q, NOW, 2).collect()}
    assert got == {0: "done", 1: "pending", 2: "processing", 3: "pending", 4: "processing"}


def test_hit_at_k(spark):
    results = spark.createDataFrame([("q", 1, "http://x/A"), ("q", 6, "http://x/B")], "query string, rank int, url string")
    specs = spark.createDataFrame([("q", "s", ["/a"], 5), ("p", "s", ["/a"], 5), ("r", "t", ["/b"], 5)], "query string, source string, fragments array<string>, k int")
    hits = E.hit_at_k(results, specs)
    assert {r.query: r.hit for r in hits.collect()} == {"q": 1, "p": 0, "r": 0}
    assert {r.source: (r.rate, r.passed) for r in E.pass_rate(hits, "source").collect()} == {"s": (0.5, False), "t": (0.0, False)}


def test_empty_insights(spark):
    s = spark.createDataFrame([], "search_id string, query string, results_count long, latency_ms double")
    r = A.insights_totals(s, s.select("search_id")).first()
    assert (r.total_searches, r.avg_latency, r.p95_latency, r.click_through_rate) == (0, 0.0, 0.0, 0.0)


def test_seed_configuration(spark):
    import pytest

    config = {"defaults": {"max_depth": 1}, "sources": [{"slug": "a", "allowed_domains": ["X.org"], "seeds": [dict(url="https://x.org/docs/", priority=7), dict(url="https://x.org/")]}]}
    assert seeds.check(config) is config
    got = seeds.seeds_frame(spark, config).orderBy("arrival").collect()
    assert [(r.normalized_url, r.priority, r.source_slug) for r in got] == [("https://x.org/docs", 7, "a"), ("https://x.org/", 100, "a")]
    assert seeds.registry_frame(spark, config).first().max_depth == 1
    config["sources"][0]["seeds"].append({"url": "https://y.org/"})
    with pytest.raises(ValueError, match="outside allowed_domains"):
        seeds.check(config)
    assert [r.priority for r in seeds.seeds_frame(spark, {"seeds": [{"url": "http://z.org"}]}).collect()] == [100]
