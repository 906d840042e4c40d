"""Column expressions: text, URLs, dates, scores, labels. All run in the JVM, none needs Python."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TRACKING = r"^(utm_|fbclid|gclid)"

# where to look, for what, and what it says about a page: the first match wins. In paths these are whole segments, in titles whole words
_SEP = "[-_]"
_KINDS = tuple(
    (where, (r"/(%s)/" if where == "path" else r"\b(%s)\b") % "|".join(words), kind)
    for where, kind, words in (
        ("path", "reference", ("api-docs", "openapi", "api[-_/]reference", r"api[-/]v\d")),
        ("path", "reference", ("reference", *(f"{x}[-/]" for x in ("class", "interface", "type", "namespace", "enum")))),
        ("path", "tutorial", ("tutorials?", "walkthroughs?", f"step{_SEP}by{_SEP}step")),
        ("path", "guide", ("guides?", f"how{_SEP}to", f"getting{_SEP}started", "quickstart", "cookbook")),
        ("path", "guide", ("learn", "introduction", "overview", "concepts?", "fundamentals?")),
        ("path", "blog", ("blog", "posts?", "news", "articles?", "changelog", f"release{_SEP}notes?")),
        ("title", "reference", (r"api\b.*\breference", r"reference\b.*\bapi")),
        ("title", "reference", ("class", "interface", "type", "namespace", "enum", "function", "method", "property")),
        ("title", "tutorial", ("tutorial", "walkthrough", "step.by.step")),
        ("title", "guide", ("guide", "overview", "introduction", "getting started")),
    )
)
FRESH_DAYS, OK_DAYS = 7, 30


def clean_text(x: Column) -> Column:
    """White space of any kind collapsed to single spaces, ends stripped; null becomes ''."""
    return F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)\s+", " "))


def word_count(clean: Column) -> Column:
    """Words of an already cleaned text; a cut may have left a space at its end."""
    t = F.trim(clean)
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, " "))).cast("bigint")


def content_hash(body: Column) -> Column:
    return F.sha2(body, 256)


def url_parts(url: Column) -> dict[str, Column]:
    """scheme, authority, path and query by the generic URI grammar; absent parts are ''."""
    u = F.trim(url)
    pattern = r"^(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
    return {name: F.regexp_extract(u, pattern, i) for i, name in enumerate(("scheme", "authority", "path", "query"), 1)}


def extract_domain(url: Column) -> Column:
    """Lower-cased authority, port and user included; '' for none."""
    return F.lower(url_parts(url)["authority"])


def url_path(url: Column) -> Column:
    path = url_parts(url)["path"]
    return F.when(path == "", F.lit("/")).otherwise(path)


def _recode(x: Column) -> Column:
    """Decoded and encoded again the form way: space as +, ~ plain."""
    return F.replace(F.replace(F.url_encode(F.coalesce(F.try_url_decode(x), x)), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def normalize_url(url: Column) -> Column:
    """Queue identity of a URL: case, slashes, tracking parameters and fragment don't count."""
    p = url_parts(url)
    scheme = F.when(p["scheme"] == "", F.lit("https")).otherwise(F.lower(p["scheme"]))
    path = F.regexp_replace(p["path"], r";[^/]*$", "")
    path = F.regexp_replace(F.when(path == "", F.lit("/")).otherwise(path), "/{2,}", "/")
    path = F.when(path == "/", path).otherwise(F.regexp_replace(path, "/$", ""))
    pairs = F.filter(F.split(p["query"], "&"), lambda x: (x != "") & ~F.lower(F.coalesce(F.try_url_decode(F.element_at(F.split(x, "=", 2), 1)), F.lit(""))).rlike(TRACKING))
    coded = F.transform(pairs, lambda x: F.concat(_recode(F.element_at(F.split(x, "=", 2), 1)), F.lit("="), _recode(F.coalesce(F.try_element_at(F.split(x, "=", 2), F.lit(2)), F.lit("")))))
    query = F.array_join(coded, "&")
    return F.concat(scheme, F.lit("://"), F.lower(p["authority"]), path, F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)))


def display_url(url: Column) -> Column:
    """Host and path without the trailing slash; what isn't a URL is shown as it is."""
    p = url_parts(url)
    host = F.regexp_replace(F.lower(p["authority"]), r"^[^@]*@|:\d*$", "")
    good = (p["scheme"] != "") & (host != "")
    return F.when(good, F.concat(host, F.regexp_replace(p["path"], "/$", ""))).otherwise(url)


def parse_datetime(x: Column) -> Column:
    """Lenient ISO date-time, a trailing Z accepted; null where it doesn't parse."""
    t = F.trim(x)
    return F.when(t.rlike(r"^\d{4}(-\d\d){2}"), F.try_to_timestamp(F.regexp_replace(t, "Z$", "+00:00"))).cast("timestamp_ntz")


def content_type(url: Column, title: Column, pre_count: Column) -> Column:
    """Kind of page by URL path, then title, then code density."""
    on = {"path": url_parts(url)["path"], "title": F.coalesce(title, F.lit(""))}
    out = F.when(pre_count >= 5, F.lit("reference")).otherwise(F.lit("guide"))
    for where, pattern, kind in reversed(_KINDS):
        out = F.when(on[where].rlike(f"(?i){pattern}"), F.lit(kind)).otherwise(out)
    return out


def url_section_path(url: Column) -> Column:
    """Breadcrumb from URL segments: extension off, words capitalised, dull ones skipped; '' below two."""
    segments = F.filter(F.split(url_path(url), "/"), lambda s: s != "")
    words = F.transform(segments, lambda s: F.initcap(F.regexp_replace(F.regexp_replace(s, r"\.(html?|md)$", ""), "[-_]", " ")))
    kept = F.filter(words, lambda s: ~F.lower(s).isin("latest current docs us en en-gb en-us".split()) & (F.length(s) > 1))
    return F.when(F.size(kept) >= 2, F.array_join(F.slice(kept, 1, 4), " > ")).otherwise(F.lit(""))


def parse_tags(keywords: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(keywords, F.lit("")), ","), clean_text), lambda t: t != "")


def boost_score(title: Column, description: Column, words: Column, code_blocks: Column, section: Column, depth: Column, authority: Column) -> Column:
    """Points for completeness, depth and authority; null and '' earn none."""

    def point(cond: Column, n: int) -> Column:
        return F.when(F.coalesce(cond, F.lit(False)), F.lit(n)).otherwise(F.lit(0))

    return (
        point(title != "", 2)
        + point(description != "", 1)
        + point((words >= 300) & (words <= 5000), 2)
        + point(depth <= 1, 1)
        + point(code_blocks > 0, 1)
        + point(section != "", 1)
        + F.least(F.lit(5), (F.coalesce(authority, F.lit(0)) / 2).cast("int"))
    ).cast("int")


def age_days(at: Column, as_of: str) -> Column:
    """Whole periods of 24 hours since `at`; calendar days don't matter."""
    return F.floor(F.timestamp_diff("SECOND", at, F.lit(as_of).cast("timestamp_ntz")) / 86400)


def freshness(at: Column, as_of: str) -> Column:
    days = age_days(at, as_of)
    return F.when(at.isNull(), F.lit("unknown")).when(days <= FRESH_DAYS, F.lit("fresh")).when(days <= OK_DAYS, F.lit("ok")).otherwise(F.lit("stale"))


def freshness_label(updated: Column, status: Column) -> Column:
    """What a result card says about its age; null where nothing is known."""
    by_status = F.when(status == "fresh", F.lit("Updated recently")).when(status == "stale", F.lit("Update may be stale"))
    return F.when(updated.isNotNull(), F.concat(F.lit("Updated "), F.date_format(updated, "MMM d, yyyy"))).otherwise(by_status)


def cadence_label(hours: Column) -> Column:
    """Hours between crawls in the largest unit they fill; the plural starts at two whole units."""
    out = F.concat(hours.cast("string"), F.lit(" hours"))
    for unit, name in ((24, "day"), (168, "week"), (720, "month")):
        text = F.concat(F.round(hours / unit).cast("bigint").cast("string"), F.lit(f" {name}"), F.when(hours >= 2 * unit, F.lit("s")).otherwise(F.lit("")))
        out = F.when(hours >= unit, text).otherwise(out)
    return out


def compact_number(n: Column, signs: str = "KMBT") -> Column:
    """A whole number for display: in thousands, millions and so on with one decimal from 10,000 on, a zero decimal left out; with commas below. What is larger stays in the unit of the last sign."""
    out = F.format_number(n, 0)
    for power, sign in zip((3, 6, 9, 12), signs):
        unit = 10**power
        tenths = F.call_function("div", n + F.lit(unit // 20), F.lit(unit // 10))
        text = F.concat(F.call_function("div", tenths, F.lit(10)).cast("string"), F.when(tenths % 10 > 0, F.concat(F.lit("."), (tenths % 10).cast("string"))).otherwise(F.lit("")), F.lit(sign))
        least = 10_000 if power == 3 else unit - unit // 20000  # what rounds up to a whole unit is one
        out = F.when(n >= least, text).otherwise(out)
    return out


def flag(value: Column, default: bool = False) -> Column:
    """A setting's text as a truth value; only null takes the default."""
    return F.coalesce(F.lower(F.trim(value)).isin("1", "true", "yes", "on"), F.lit(default))


def at_least(value: Column, default: int, least: int) -> Column:
    """A setting's text as a whole number, blank and null as the default, never below `least`."""
    return F.greatest(F.lit(least), F.coalesce(F.when(F.trim(value) != "", F.trim(value).cast("int")), F.lit(default)))


def status_label(status: Column, other: str = "Pending") -> Column:
    known = status.isin("healthy", "crawling", "failing")
    return F.when(known, F.initcap(status)).otherwise(F.lit(other))


def is_uuid(x: Column) -> Column:
    return F.coalesce(x.rlike(r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[1-8][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"), F.lit(False))


def decode_entities(x: Column) -> Column:
    """Tags other than em taken out, then entities decoded: ampersands first, so doubly escaped ones decode twice; numbered ones last."""
    out = F.regexp_replace(x, r"(?i)<(?!/?em\b)[^>]*>", "")
    for a, b in (("amp", "&"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'")):
        out = F.replace(out, F.lit(f"&{a};"), F.lit(b))
    codes = F.array_distinct(F.regexp_extract_all(out, F.lit(r"&#(\d{1,7});"), F.lit(1)))

    def put(text: Column, code: Column) -> Column:
        char = F.decode(F.unhex(F.lpad(F.hex(code.cast("bigint")), 8, "0")), "UTF-32")
        return F.replace(text, F.concat(F.lit("&#"), code, F.lit(";")), char)

    return F.aggregate(codes, out, put)


def parts(x: Column) -> Column:
    """Runs of letters and digits in lower case; an empty string stands for other signs at either end. Splitting costs a fourth of extracting."""
    return F.split(F.lower(F.coalesce(x, F.lit(""))), r"[^\p{L}\p{N}]+")


def tokens(x: Column) -> Column:
    return F.filter(parts(x), lambda w: w != "")


def retry_delay(retry_count: Column) -> Column:
    """Seconds: 5 doubled for each retry after the first, 300 at most."""
    return F.least(F.lit(300.0), 5 * F.pow(F.lit(2.0), F.least(F.greatest(retry_count - 1, F.lit(0)), F.lit(10)))).cast("bigint")


def should_retry(retry_count: Column, status_code: Column, most: int = 3) -> Column:
    return (retry_count < most) & (status_code.isNull() | status_code.isin(408, 425, 429) | (status_code >= 500))


def depth_cap(source_max: Column, global_max: Column) -> Column:
    return F.least(F.coalesce(source_max, global_max), global_max)
