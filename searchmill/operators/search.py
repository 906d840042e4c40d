"""Ranked, filtered, faceted text search over a document DataFrame.

A document is matched and measured by one pass over its own tokens, without a
shuffle; then only the top of the order is kept. The rules rank lexicographically:
words matched, typos, proximity, attribute, the user's sort, exactness, authority,
boost, id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from searchmill.functions import columns as C

ATTRIBUTES = ("title", "headings", "section_path", "source_name", "meta_description", "body", "tags")  # in order of weight
FAR = 8  # a pair of terms that never meet counts as this far apart


def typos_allowed(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


def query_terms(q: str) -> list[str]:
    import regex

    return list(dict.fromkeys(regex.findall(r"[\p{L}\p{N}]+", q.lower())))


def filters(
    sources=(), content_types=(), domains=(), languages=(), tags=(), published_from: str | None = None, published_to: str | None = None, updated_within: str | None = None, as_of: Column | None = None
) -> Column:
    """Conjunction of what is asked for; nothing asked keeps all. Null dates never pass a date bound."""
    parts: list[Column] = []
    for name, values in (("source_slug", sources), ("content_type", content_types), ("domain", domains), ("language", languages)):
        if values:
            parts.append(F.col(name).isin(list(values)))
    if tags:
        parts.append(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])))
    if published_from:
        parts.append(F.col("published_at") >= F.lit(published_from).cast("timestamp_ntz"))
    if published_to:
        parts.append(F.col("published_at") <= F.lit(published_to).cast("timestamp_ntz"))
    days = int(updated_within[:-1]) if updated_within in ("7d", "30d", "90d") else 0
    if days:
        parts.append(F.col("last_updated_at") >= as_of - F.make_dt_interval(F.lit(days)))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def _listed(docs: DataFrame, split=C.tokens) -> list[tuple[int, Column]]:
    """(number by weight, tokens) of each searchable attribute that docs has."""
    kinds = dict(docs.dtypes)
    return [(i, split(F.array_join(a, " ") if kinds[a].startswith("array") else F.col(a))) for i, a in enumerate(ATTRIBUTES) if a in kinds]


def postings(docs: DataFrame) -> DataFrame:
    """(id, attr, pos, term): every token of every searchable attribute; attr numbers them by weight.

    Each token carries its own place, so no row ever holds the list that it came from beside it.
    """

    def placed(i: int, words: Column) -> Column:
        return F.transform(words, lambda w, p: F.struct(F.lit(i).alias("attr"), p.alias("pos"), w.alias("term")))

    return docs.select("id", F.inline(F.flatten(F.array(*[placed(i, w) for i, w in _listed(docs)]))))


def _typos(word: Column, term: str, prefix: bool) -> Column:
    """Typos between a token and a term, -1 for too many."""
    k = typos_allowed(term)
    near = F.levenshtein(word, F.lit(term), k) if k else F.when(word == term, F.lit(0)).otherwise(F.lit(-1))
    near = F.when(F.abs(F.length(word) - len(term)) > k, F.lit(-1)).otherwise(near)
    return F.when(F.startswith(word, F.lit(term)), F.lit(0)).otherwise(near) if prefix else near


_APART = 1 << 32  # places of two attributes differ by more than any gap that counts


def matched(docs: DataFrame, terms: list[str], prefix_last: bool = False) -> DataFrame:
    """Documents with at least one term, all columns kept, and their words, typos, proximity, attribute and exactness.

    A document holds all that its metrics need, so they are one pass over its own
    tokens: nothing is shuffled or joined, and work is in proportion to its length.
    Tokens are reduced to hits first; a fold over the hits, in order of attribute and
    place, keeps for each term the least typos and the last place, and for each pair
    of neighbouring terms the least gap so far.
    """
    n = len(terms)

    def hits(i: int, words: Column) -> Column:
        def hit(w: Column, p: Column) -> Column:
            typos = [_typos(w, t, prefix_last and j == n - 1) for j, t in enumerate(terms)]
            return F.when(reduce(lambda a, b: a | b, (k >= 0 for k in typos)), F.struct((p + F.lit(i * _APART)).alias("at"), F.array(*typos).alias("k")))

        return F.filter(F.transform(words, hit), lambda h: h.isNotNull())

    never, none = F.lit(-(1 << 60)), F.lit(1 << 20)
    start = F.struct(*[none.alias(f"k{t}") for t in range(n)], *[(never * (t % 2 + 1)).alias(f"at{t}") for t in range(n)], *[F.lit(FAR).cast("bigint").alias(f"gap{t}") for t in range(n - 1)], none.cast("bigint").alias("attr"))

    def fold(s: Column, h: Column) -> Column:
        k = [F.when(h["k"][t] >= 0, F.least(s[f"k{t}"], h["k"][t])).otherwise(s[f"k{t}"]) for t in range(n)]
        at = [F.when(h["k"][t] >= 0, h["at"]).otherwise(s[f"at{t}"]) for t in range(n)]
        gap = [F.least(s[f"gap{t}"], F.abs(at[t] - at[t + 1])) for t in range(n - 1)]
        return F.struct(*[c.alias(f"k{t}") for t, c in enumerate(k)], *[c.alias(f"at{t}") for t, c in enumerate(at)], *[c.alias(f"gap{t}") for t, c in enumerate(gap)], F.least(s["attr"], F.floor(h["at"] / _APART)).alias("attr"))

    def metrics(s: Column) -> Column:
        add = lambda xs: reduce(lambda a, b: a + b, xs, F.lit(0).cast("bigint"))
        found = [s[f"k{t}"] < none for t in range(n)]
        return F.struct(
            add(f.cast("bigint") for f in found).alias("words"),
            add(F.when(f, s[f"k{t}"]).otherwise(F.lit(0)) for t, f in enumerate(found)).alias("typos"),
            add(s[f"gap{t}"] for t in range(n - 1)).alias("proximity"),
            s["attr"].alias("attribute"),
            add((s[f"k{t}"] == 0).cast("bigint") for t in range(n)).alias("exactness"),
        )

    all_hits = F.flatten(F.array(*[hits(i, w) for i, w in _listed(docs, C.parts)]))
    # unfolding a list of one or none drops what doesn't match and computes the metrics once, where a filter would be pushed below and do it twice
    found = F.filter(F.array(F.aggregate(all_hits, start, fold, metrics)), lambda m: m["words"] > 0)
    return docs.select("*", F.inline(found))


def rule_metrics(docs: DataFrame, terms: list[str], prefix_last: bool = False) -> DataFrame:
    """Per matching document: words, typos, proximity, attribute, exactness."""
    return matched(docs, terms, prefix_last).select("id", "words", "typos", "proximity", "attribute", "exactness")


SORTS = {"relevance": (), "newest": (("published_at", True), ("authority", True)), "oldest": (("published_at", False),)}


def sort_keys(sort: str) -> list[Column]:
    return [F.desc_nulls_last(c) if down else F.asc_nulls_last(c) for c, down in SORTS[sort]]


def ranked(docs: DataFrame, q: str, where: Column | None = None, sort: str = "relevance", prefix_last: bool = False) -> tuple[DataFrame, list[Column]]:
    """Matching documents with their rule metrics, and the keys that order them. An empty query matches all, and only the sort and the tail of the rules count."""
    docs = docs if where is None else docs.where(where)
    terms = query_terms(q)
    tail = [F.desc_nulls_last("authority"), F.desc_nulls_last("boost_score"), F.asc("id")]
    if not terms:
        zero = {c: F.lit(0).cast("bigint") for c in ("words", "typos", "proximity", "attribute", "exactness")}
        return docs.withColumns(zero), [*sort_keys(sort), *tail]
    keys = [F.desc("words"), F.asc("typos"), F.asc("proximity"), F.asc("attribute"), *sort_keys(sort), F.desc("exactness"), *tail]
    return matched(docs, terms, prefix_last), keys


def page(found: DataFrame, keys: list[Column], number: int = 1, size: int = 10) -> DataFrame:
    """One page, with the absolute rank of each hit. Only the rows up to the page's end are ever sorted whole."""
    top = found.orderBy(*keys).limit(number * size)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*keys)).cast("bigint")).where(F.col("rank") > (number - 1) * size)


def facets(docs: DataFrame, names=("source_slug", "content_type", "domain", "language"), cap: int = 50) -> DataFrame:
    """(facet, value, n): the most frequent values of each facet; arrays count by element."""
    kinds = dict(docs.dtypes)

    def named(n: str) -> Column:
        values = F.col(n) if kinds[n].startswith("array") else F.array(n)
        return F.transform(values, lambda v: F.struct(F.lit(n).alias("facet"), v.alias("value")))

    parts = [named(n) for n in names]
    counts = docs.select(F.explode(F.concat(*parts)).alias("f")).select("f.*").where("value is not null").groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("facet").orderBy(F.desc("n"), "value")
    return counts.withColumn("r", F.row_number().over(w)).where(F.col("r") <= cap).drop("r")


def facet_first_seen(docs: DataFrame, name: str) -> DataFrame:
    """(value, n, place): counts in the order in which values first occur, by id. The window runs over values, not documents."""
    c = docs.groupBy(F.col(name).alias("value")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("at"))
    return c.select("value", "n", F.row_number().over(Window.orderBy("at")).cast("bigint").alias("place"))


def facet_options(listed: DataFrame, counts: DataFrame) -> DataFrame:
    """The listed values (slug, position) with their facet counts, 0 for none."""
    return listed.select("slug", "position").join(counts.select(F.col("value").alias("slug"), "n"), "slug", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def page_bounds(found: DataFrame, number: int, size: int) -> DataFrame:
    """(total, pages, page): exact total, pages of it, at least one, and the page asked for, kept within them."""
    t = found.agg(F.count(F.lit(1)).alias("total")).withColumn("pages", F.greatest(F.lit(1), F.ceil(F.col("total") / size)).cast("bigint"))
    return t.withColumn("page", F.greatest(F.lit(1), F.least(F.lit(number), F.col("pages"))).cast("bigint"))


def highlight(text: Column, terms: list[str]) -> Column:
    """Whole words that equal a term, in em tags; case is kept."""
    if not terms:
        return text
    words = "|".join(sorted(terms, key=len, reverse=True))
    return F.regexp_replace(text, rf"(?iu)(?<![\p{{L}}\p{{N}}])({words})(?![\p{{L}}\p{{N}}])", "<em>$1</em>")


def snippet(body: Column, terms: list[str], width: int = 35) -> Column:
    """`width` words around the first matching one, from the start without a match."""
    words = F.split(body, " ")
    if not terms:
        return F.array_join(F.slice(words, 1, width), " ")
    bare = F.transform(words, lambda w: F.regexp_replace(F.lower(w), r"[^\p{L}\p{N}]", ""))
    spots = [F.array_position(bare, t) for t in terms]
    spot = F.coalesce(F.array_min(F.filter(F.array(*spots), lambda p: p > 0)), F.lit(1))
    return F.array_join(F.slice(words, F.greatest(F.lit(1), spot - width // 2).cast("int"), F.lit(width)), " ")


def marked(docs: DataFrame, terms: list[str]) -> DataFrame:
    """docs with m_title, m_headings, m_section_path, m_meta_description and m_body: texts with matches in em tags, the body cropped around the first of them."""
    plain = {f"m_{c}": highlight(F.coalesce(c, F.lit("")), terms) for c in ("title", "section_path", "meta_description")}
    return docs.withColumns({**plain, "m_headings": F.transform("headings", lambda h: highlight(h, terms)), "m_body": highlight(snippet(F.coalesce("body", F.lit("")), terms), terms)})


def response(docs: DataFrame, q: str, where: Column | None = None, sort: str = "relevance", number: int = 1, size: int = 10) -> DataFrame:
    """One page as the service answers it: each hit with its rank, marked texts and why it matched, and the exact total beside it.

    Texts are marked on the page's rows only. The total is one row, so joining it costs nothing.
    """
    found, keys = ranked(docs, q, where, sort)
    top = marked(page(found, keys, number, size), query_terms(q))
    why = why_matched({"title": F.col("m_title"), "headings": F.array_join("m_headings", " "), "section": F.col("m_section_path"), "description": F.col("m_meta_description"), "body": F.col("m_body")})
    total = found.agg(F.count(F.lit(1)).alias("total"))
    return top.join(F.broadcast(total)).select(
        "rank",
        "id",
        F.coalesce("title", F.lit("Untitled")).alias("title"),
        "url",
        "source_name",
        F.col("m_body").alias("snippet"),
        F.filter(F.array("m_title", "m_meta_description"), lambda h: h != "").alias("highlights"),
        why.alias("why"),
        "total",
    )


def why_matched(marked: dict[str, Column]) -> Column:
    """Labels of the marked-up fields that hold a highlight, in the order given."""
    return F.array_compact(F.array(*[F.when(F.contains(c, F.lit("<em>")), F.lit(label)) for label, c in marked.items()]))


SUGGESTIONS = {
    "react": "useState|useEffect|Server Components|React hooks",
    "next": "App Router|Server Components|API routes|getServerSideProps",
    "typescript": "generics|utility types|type narrowing|decorators",
    "postgres": "SELECT|JOIN|indexes|EXPLAIN ANALYZE",
    "mdn": "fetch API|CSS grid|Array methods|Promise",
    "javascript": "closures|async await|destructuring|modules",
    "css": "flexbox|grid|custom properties|animations",
    "html": "semantic HTML|accessibility|forms|canvas",
}  # the first keyword that the query holds counts
DEFAULT_SUGGESTIONS = "useState|async/await|SQL joins|TypeScript generics"


def recovery_suggestions(q: Column, total: Column) -> Column:
    """What to try next when a query found nothing; [] when it found something or was empty."""
    out = F.lit(DEFAULT_SUGGESTIONS)
    for word, values in reversed(SUGGESTIONS.items()):
        out = F.when(F.contains(F.lower(q), F.lit(word)), F.lit(values)).otherwise(out)
    return F.when((total == 0) & (q != ""), F.split(out, "[|]")).otherwise(F.array().cast("array<string>"))


def demo_search(docs: DataFrame, q: str, where: Column | None = None, sort: str = "relevance") -> tuple[DataFrame, list[Column]]:
    """The offline mode: substring of all text fields; relevance is the boost score; dates don't filter."""
    low = F.lower(F.concat_ws(" ", "title", "meta_description", "body", F.array_join("tags", " ")))
    d = docs if where is None else docs.where(where)
    d = d.where(F.contains(low, F.lit(q.strip().lower()))) if q.strip() else d
    keys = {"newest": [F.desc_nulls_last("published_at")], "oldest": [F.asc_nulls_last("published_at")]}.get(sort, [F.desc_nulls_last("boost_score")])
    return d, [*keys, F.asc("id")]


def autocomplete_demo(docs: DataFrame, q: str, keep: int = 6) -> DataFrame:
    """(title, id): the first distinct titles that hold q; nothing for an empty query."""
    word = q.strip().lower()
    titles = docs.select("id", F.trim("title").alias("title")).where(F.contains(F.lower("title"), F.lit(word)) & F.lit(word != ""))
    return titles.groupBy("title").agg(F.min("id").alias("id")).orderBy("id").limit(keep)


def autocomplete(docs: DataFrame, q: str, hits: int = 8, keep: int = 6) -> DataFrame:
    """(title, rank): distinct titles of the best hits, the last word as a prefix; nothing for an empty query."""
    if not q.strip():
        return docs.limit(0).select("title", F.lit(0).cast("bigint").alias("rank"))
    found, keys = ranked(docs, q, prefix_last=True)
    top = page(found, keys, 1, hits).select(F.trim("title").alias("title"), "rank").where("title <> ''")
    return top.groupBy("title").agg(F.min("rank").alias("rank")).orderBy("rank").limit(keep)
