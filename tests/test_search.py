import pytest
from pyspark.sql import functions as F

from searchmill.operators import search as S

DOCS = [
    (1, "State hooks", "Reference > Hooks", "Keep state in a component", "A hook keeps state. Call it at the top.", ["hooks", "state"], "2024-01-15", 9.0, 12, "reference", "en"),
    (2, "Array methods", "Language > Array", "Lists of values", "An array stores values under one name.", ["arrays"], "2023-06-10", 10.0, 14, "reference", "en"),
    (3, "Routing", "Docs > Routing", "Pages and layouts", "The router uses state and layouts. State again.", ["routing", "hooks-later"], "2023-05-04", 9.0, 11, "guide", "de"),
    (4, None, None, None, None, None, None, None, None, None, None),
]
KIND = "id long, title string, section_path string, meta_description string, body string, tags array<string>, day string, authority double, boost_score int, content_type string, language string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, KIND).withColumn("published_at", F.col("day").cast("timestamp_ntz")).drop("day").cache()


def ids(df):
    return [r.id for r in df.orderBy("rank").collect()]


def test_rules(docs):
    found, keys = S.ranked(docs, "state hooks")
    assert ids(S.page(found, keys)) == [1, 3]
    m = {r.id: r for r in S.rule_metrics(docs, ["state", "hooks"]).collect()}
    assert (m[1].words, m[1].typos, m[1].proximity, m[1].attribute) == (2, 0, 1, 0)
    assert m[3].exactness == 2


def test_typos(docs):
    assert ids(S.page(*S.ranked(docs, "arrry"))) == [2]
    assert ids(S.page(*S.ranked(docs, "aray"))) == []  # four letters: none allowed


def test_sort_comes_after_relevance(docs):
    assert ids(S.page(*S.ranked(docs, "", sort="oldest"))) == [3, 2, 1, 4]
    assert ids(S.page(*S.ranked(docs, "", sort="newest"))) == [1, 2, 3, 4]
    assert ids(S.page(*S.ranked(docs, "state hooks", sort="oldest"))) == [1, 3]


def test_pages(docs):
    assert ids(S.page(*S.ranked(docs, ""), 2, 3)) == [4]
    assert S.page_bounds(docs, 9, 3).first().asDict() == {"total": 4, "pages": 2, "page": 2}
    assert S.page_bounds(docs.limit(0), 9, 3).first().asDict() == {"total": 0, "pages": 1, "page": 1}


def test_filters(docs):
    assert [r.id for r in docs.where(S.filters()).orderBy("id").collect()] == [1, 2, 3, 4]
    assert [r.id for r in docs.where(S.filters(languages=("de",), tags=("routing", "x"))).collect()] == [3]
    assert [r.id for r in docs.where(S.filters(published_to="2023-06-10")).orderBy("id").collect()] == [2, 3]


def test_demo_search(docs):
    found, keys = S.demo_search(docs, " STATE ")
    assert ids(S.page(found, keys)) == [1, 3]
    assert ids(S.page(*S.demo_search(docs, ""))) == [2, 1, 3, 4]


def test_autocomplete(docs):
    assert [r.title for r in S.autocomplete(docs, "rout").orderBy("rank").collect()] == ["Routing"]
    assert S.autocomplete(docs, " ").count() == 0
    assert [r.title for r in S.autocomplete_demo(docs, "ARR").collect()] == ["Array methods"]


def test_texts(docs):
    r = docs.where("id = 1").select(S.highlight(F.col("title"), ["state"]).alias("h"), S.snippet(F.col("body"), ["call"], 5).alias("s"), S.highlight(F.lit("estate"), ["state"]).alias("none")).first()
    assert (r.h, r.s, r.none) == ("<em>State</em> hooks", "keeps state. Call it at", "estate")
    w = docs.where("id = 1").select(S.why_matched({"title": S.highlight(F.col("title"), ["top"]), "body": S.highlight(F.col("body"), ["top"])}).alias("w")).first().w
    assert w == ["body"]


def test_suggestions(spark):
    q = spark.createDataFrame([("React x", 0), ("zzz", 0), ("css", 3), ("", 0)], "q string, n int")
    got = [r[0] for r in q.select(S.recovery_suggestions(F.col("q"), F.col("n"))).collect()]
    assert got[0][0] == "useState" and len(got[0]) == 4 and got[1][1] == "async/await" and got[2] == [] and got[3] == []


def test_empty_corpus(docs):
    none = docs.limit(0)
    assert S.page(*S.ranked(none, "state hooks")).count() == 0
    assert S.facets(none, ("language", "tags")).count() == 0


def test_facet_cap(docs):
    got = S.facets(docs, ("tags", "language"), 1).orderBy("facet").collect()
    assert [(r.facet, r.value, r.n) for r in got] == [("language", "en", 2), ("tags", "arrays", 1)]
