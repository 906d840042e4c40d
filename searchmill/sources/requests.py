"""Search requests: strict validation for the service, lenient parsing for addresses, and service settings."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from urllib.parse import parse_qs, urlencode

CONTENT_TYPES = ("guide", "reference", "tutorial", "api", "blog")
SORTS = ("relevance", "newest", "oldest")
WINDOWS = ("7d", "30d", "90d")
LISTS = ("source", "content_type", "domain", "language", "tags")
PARAMETERS = {name: "contentType" if name == "content_type" else name for name in LISTS}
QUERY_CHARS, LIST_ITEMS, ITEM_CHARS, MAX_PAGE, MAX_LIMIT = 200, 20, 100, 10_000, 50
_DAY = re.compile(r"\d{4}(-\d\d){2}")
_UUID = re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[1-8][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}", re.I)


@dataclass(frozen=True)
class Request:
    """What a search asks for. `checked` raises ValueError where the service would refuse."""

    q: str = ""
    page: int = 1
    limit: int = 10
    source: tuple[str, ...] = ()
    content_type: tuple[str, ...] = ()
    domain: tuple[str, ...] = ()
    language: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()
    sort: str = "relevance"
    published_from: str | None = None
    published_to: str | None = None
    updated_within: str | None = None

    def checked(self) -> Request:
        out = replace(self, q=self.q.strip())
        if len(out.q) > QUERY_CHARS:
            raise ValueError(f"q has more than {QUERY_CHARS} characters")
        if not 1 <= out.page <= MAX_PAGE:
            raise ValueError(f"page isn't within 1 and {MAX_PAGE}")
        if not 1 <= out.limit <= MAX_LIMIT:
            raise ValueError(f"limit isn't within 1 and {MAX_LIMIT}")
        for name in LISTS:
            values = getattr(out, name)
            if len(values) > LIST_ITEMS or any(not 1 <= len(v) <= ITEM_CHARS for v in values):
                raise ValueError(f"{name}: at most {LIST_ITEMS} values of 1 to {ITEM_CHARS} characters")
        if set(out.content_type) - set(CONTENT_TYPES):
            raise ValueError("unknown content type")
        if out.sort not in SORTS:
            raise ValueError("unknown sort")
        if out.updated_within and out.updated_within not in WINDOWS:
            raise ValueError("unknown updated_within")
        for day in (out.published_from, out.published_to):
            if day and not _DAY.fullmatch(day):
                raise ValueError("dates are written YYYY-MM-DD")
        if out.published_from and out.published_to and out.published_from > out.published_to:
            raise ValueError("published_from is after published_to")
        return out

    def filters(self) -> dict:
        """Arguments of the filter builder."""
        return {
            "sources": self.source,
            "content_types": self.content_type,
            "domains": self.domain,
            "languages": self.language,
            "tags": self.tags,
            "published_from": self.published_from,
            "published_to": self.published_to,
            "updated_within": self.updated_within,
        }

    def active_filters(self) -> int:
        """How many filters are set; the date bounds don't count."""
        return sum(len(getattr(self, n)) for n in LISTS) + bool(self.updated_within)

    def worth_running(self) -> bool:
        return bool(self.q.strip()) or self.active_filters() > 0

    def toggled(self, name: str, value: str) -> Request:
        """With the value put in, or taken out if it is there; back on the first page."""
        have = getattr(self, name)
        return replace(self, page=1, **{name: tuple(v for v in have if v != value) if value in have else (*have, value)})

    def address(self) -> str:
        """URL parameters, defaults left out."""
        out: list[tuple[str, str]] = []
        if self.q:
            out.append(("q", self.q))
        for name in LISTS:
            out += [(PARAMETERS[name], v) for v in getattr(self, name)]
        for key, value, default in (("sort", self.sort, "relevance"), ("from", self.published_from, None), ("to", self.published_to, None), ("updatedWithin", self.updated_within, None), ("page", self.page, 1), ("limit", self.limit, 10)):
            if value != default:
                out.append((key, str(value)))
        return urlencode(out)


def parse_address(text: str) -> Request:
    """A request from URL parameters; whatever is invalid becomes its default."""
    given = parse_qs(text.lstrip("?"), keep_blank_values=True)

    def one(key: str) -> str | None:
        return given[key][0] if key in given else None

    def many(key: str, allowed=None) -> tuple[str, ...]:
        values = tuple(dict.fromkeys(v.strip() for v in given.get(key, []) if v.strip()))[:LIST_ITEMS]
        return tuple(v for v in values if allowed is None or v in allowed)

    def number(key: str, default: int, most: int) -> int:
        v = one(key) or ""
        return int(v) if re.fullmatch(r"\d{1,9}", v) and 1 <= int(v) <= most else default

    def choice(key: str, allowed, default=None):
        v = one(key)
        return v if v in allowed else default

    days = [v if v and _DAY.fullmatch(v) else None for v in (one("from"), one("to"))]
    lists = {n: many(p, CONTENT_TYPES if n == "content_type" else None) for n, p in PARAMETERS.items()}
    return Request(
        q=(one("q") or "").strip()[:QUERY_CHARS], page=number("page", 1, MAX_PAGE), limit=number("limit", 10, MAX_LIMIT), sort=choice("sort", SORTS, "relevance"), published_from=days[0], published_to=days[1], updated_within=choice("updatedWithin", WINDOWS), **lists
    )


@dataclass(frozen=True)
class Click:
    """A click on a result, as the service accepts it."""

    search_id: str
    document_id: str
    rank: int

    def checked(self) -> Click:
        if not _UUID.fullmatch(self.search_id) or not _UUID.fullmatch(self.document_id):
            raise ValueError("ids are UUIDs")
        if self.rank < 1:
            raise ValueError("ranks start at 1")
        return self


def mode(search_up: bool, database_up: bool, demo_allowed: bool) -> str:
    """live with both services, degraded with one, else demo if allowed, else unavailable."""
    if search_up and database_up:
        return "live"
    if search_up or database_up:
        return "degraded"
    return "demo" if demo_allowed else "unavailable"


@dataclass(frozen=True)
class CrawlSettings:
    """Runtime settings with their floors; blank values count as unset."""

    max_depth: int = 2
    concurrency: int = 5
    domain_delay_ms: int = 500
    max_retries: int = 3
    allowed_domains: tuple[str, ...] = field(default=())

    @classmethod
    def of(cls, values: dict[str, str | None], config: dict | None = None) -> CrawlSettings:
        defaults = (config or {}).get("defaults") or {}
        base = cls()

        def number(name: str, default: int, least: int) -> int:
            v = (values.get(name) or "").strip()
            return max(least, int(v if v else default))

        # the first that names any: the setting, the configuration's own list, the union over its sources
        own = [d.strip() for d in (values.get("ALLOWED_DOMAINS") or "").split(",")]
        listed = [d.strip() for d in (config or {}).get("allowed_domains") or []]
        union = [d.strip().lower() for s in (config or {}).get("sources") or [] for d in s.get("allowed_domains") or []]
        domains = next((x for x in (own, listed, union) if any(x)), [])
        return cls(
            number("MAX_DEPTH", defaults.get("max_depth", base.max_depth), 0),
            number("CONCURRENCY", base.concurrency, 1),
            number("DOMAIN_DELAY_MS", defaults.get("rate_limit_per_domain_ms", base.domain_delay_ms), 0),
            number("MAX_RETRIES", base.max_retries, 0),
            tuple(dict.fromkeys(d for d in domains if d)),
        )


def flag(value: str | None, default: bool = False) -> bool:
    """Only an unset value takes the default; a blank one is off."""
    return default if value is None else value.strip().lower() in ("1", "true", "yes", "on")
