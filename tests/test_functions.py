import pytest
from pyspark.sql import functions as F

from searchmill.functions import columns as C


def values(spark, rows, schema, *cols):
    return [tuple(r) if len(cols) > 1 else r[0] for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_clean_text(spark):
    got = values(spark, [(" a \n  b\tc ",), (None,), ("a b　",)], "x string", C.clean_text(F.col("x")))
    assert got == ["a b c", "", "a b"]


@pytest.mark.parametrize(
    "url,want",
    [
        ("HTTPS://Example.COM/docs/?utm_source=t&id=1#top", "https://example.com/docs?id=1"),
        ("//Host.org//a//b/", "https://host.org/a/b"),
        ("http://h.org", "http://h.org/"),
        ("http://h.org/?a=&UTM_x=1&b=1+2&fbclid=z", "http://h.org/?a=&b=1+2"),
        ("http://h.org/p;v=1?q=%C3%A9", "http://h.org/p?q=%C3%A9"),
        ("http://U@h.org:80/x", "http://u@h.org:80/x"),
    ],
)
def test_normalize_url(spark, url, want):
    assert values(spark, [(url,)], "x string", C.normalize_url(F.col("x"))) == [want]


def test_boost_score(spark):
    rows = [("Title", "Description", 550, 0, "", 1, 8.0), ("Title", "Description", 550, 3, "Docs > Guide", 1, 0.0), ("", "", 200, 5, "", 0, 0.0), (None, None, None, None, None, None, None)]
    names = ["title", "description", "words", "code", "section", "depth", "authority"]
    got = values(spark, rows, "title string, description string, words int, code int, section string, depth int, authority double", C.boost_score(*[F.col(n) for n in names]))
    assert got == [10, 8, 2, 0]


def test_retries_and_depth(spark):
    assert values(spark, [(1,), (2,), (10,)], "n int", C.retry_delay(F.col("n"))) == [5, 10, 300]
    rows = [(500, 0), (429, 0), (404, 0), (None, 0), (500, 3)]
    assert values(spark, rows, "code int, n int", C.should_retry(F.col("n"), F.col("code"))) == [True, True, False, True, False]
    assert values(spark, [(3, 1), (1, 3), (None, 2)], "a int, b int", C.depth_cap(F.col("a"), F.col("b"))) == [1, 1, 2]


def test_freshness_counts_whole_periods(spark):
    rows = [("2024-01-28 01:00:00",), ("2024-01-27 01:00:00",), ("2024-01-01 00:00:00",), (None,)]
    x = F.col("x").cast("timestamp_ntz")
    assert values(spark, rows, "x string", C.freshness(x, "2024-02-05 00:00:00")) == ["fresh", "ok", "stale", "unknown"]  # the first is 7 days and 23 hours old


def test_parse_datetime(spark):
    got = values(spark, [("2024-01-02T03:04:05Z",), ("2024-01-02",), ("nope",), ("",), (None,)], "x string", C.parse_datetime(F.col("x")).cast("string"))
    assert got == ["2024-01-02 03:04:05", "2024-01-02 00:00:00", None, None, None]


def test_content_type(spark):
    rows = [("https://x.org/blog/a", "t", 0), ("https://x.org/a", "An Overview", 0), ("https://x.org/api-docs/x", "", 0), ("https://x.org/a", "", 5), ("https://x.org/a", None, 0)]
    got = values(spark, rows, "u string, t string, n int", C.content_type(F.col("u"), F.col("t"), F.col("n")))
    assert got == ["blog", "guide", "reference", "reference", "guide"]


def test_entities_decode_twice_and_by_number(spark):
    got = values(spark, [("a &amp;lt; <b>x</b> <em>y</em> &#233;",)], "x string", C.decode_entities(F.col("x")))
    assert got == ["a < x <em>y</em> é"]


def test_display_url(spark):
    assert values(spark, [("https://u:p@X.org:8/a/?q#f",), ("not a url",)], "x string", C.display_url(F.col("x"))) == ["x.org/a", "not a url"]


def test_section_path(spark):
    rows = [("https://x.org/docs/en/getting-started/install_it.html",), ("https://x.org/a",)]
    assert values(spark, rows, "x string", C.url_section_path(F.col("x"))) == ["Getting Started > Install It", ""]
