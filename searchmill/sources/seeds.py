"""Seed configuration: sources with their domains, depth, authority and seed URLs."""

from __future__ import annotations

from pathlib import Path
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from searchmill.functions import columns as C

SCHEMA = "slug string, allowed_domains array<string>, authority_weight double, max_depth int, seeds array<string>"
DEFAULT_DEPTH, DEFAULT_PRIORITY, DEFAULT_AUTHORITY, DEFAULT_CADENCE = 2, 100, 5.0, 168


def load(path: str) -> dict:
    """A checked configuration from a YAML or JSON file; an empty file is an empty one."""
    text = Path(path).read_text("utf-8")
    if path.endswith(".json"):
        import json

        config = json.loads(text) if text.strip() else {}
    else:
        import yaml  # optional: only for YAML files

        config = yaml.safe_load(text) or {}
    return check(config)


def check(config: dict) -> dict:
    """The configuration itself, or a ValueError that names the first problem."""
    if not isinstance(config, dict) or not isinstance(config.get("sources") or [], list):
        raise ValueError("a seed configuration is a mapping whose sources are a list")
    seen: set[str] = set()
    fallback = (config.get("defaults") or {}).get("max_depth", DEFAULT_DEPTH)
    for s in config.get("sources") or []:
        problem = _problem(s, seen, fallback)
        if problem:
            raise ValueError(problem)
    return config


def _problem(s, seen: set[str], depth: int) -> str | None:
    slug = str(s.get("slug") or "").strip() if isinstance(s, dict) else ""
    if not slug or slug in seen:
        return f"slug missing or repeated: {slug!r}"
    seen.add(slug)
    hosts = {str(h).strip().lower() for h in s.get("allowed_domains") or []} - {""}
    if not hosts:
        return f"{slug}: no allowed_domains"
    if not 0 <= float(s.get("authority_weight", DEFAULT_AUTHORITY)) <= 10:
        return f"{slug}: authority_weight out of range"
    if int(s.get("max_depth", depth)) < 0:
        return f"{slug}: max_depth below 0"
    for seed in s.get("seeds") or []:
        u = urlparse(str(seed.get("url") or "").strip() if isinstance(seed, dict) else "")
        if u.scheme not in ("http", "https") or not u.hostname:
            return f"{slug}: not an http URL: {u.geturl()!r}"
        if u.hostname.lower() not in hosts:
            return f"{slug}: seed outside allowed_domains: {u.geturl()!r}"
    return None


def problems(sources: DataFrame) -> DataFrame:
    """(slug, problem): the same checks over a table of sources, 'ok' for none."""
    hosts = F.filter(F.transform("allowed_domains", lambda h: F.lower(F.trim(h))), lambda h: h != "")
    host = lambda u: F.regexp_extract(F.lower(u), r"^https?://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    repeated = F.row_number().over(Window.partitionBy("slug").orderBy("allowed_domains")) > 1
    problem = (
        F.when((F.trim("slug") == "") | F.col("slug").isNull() | repeated, "slug missing or repeated")
        .when(F.size(hosts) == 0, "no allowed_domains")
        .when((F.col("authority_weight") < 0) | (F.col("authority_weight") > 10), "authority_weight out of range")
        .when(F.col("max_depth") < 0, "max_depth below 0")
        .when(F.exists("seeds", lambda u: host(u) == ""), "not an http URL")
        .when(F.exists("seeds", lambda u: ~F.array_contains(hosts, host(u))), "seed outside allowed_domains")
        .otherwise("ok")
    )
    return sources.select("slug", problem.alias("problem"))


def allowed_domains(sources: DataFrame) -> DataFrame:
    """One row: the domains of all sources (slug, position, allowed_domains), first seen first. A list of hosts, hence small."""
    flat = sources.select("position", F.posexplode("allowed_domains").alias("i", "domain")).groupBy("domain").agg(F.min(F.struct("position", "i")).alias("at"))
    ordered = F.array_sort(F.collect_list(F.struct("at", "domain")))
    return flat.agg(F.transform(ordered, lambda s: s["domain"]).alias("domains"))


def registry_frame(spark: SparkSession, config: dict) -> DataFrame:
    """(position, slug, name, description, home_url, authority_weight, crawl_cadence_hours, max_depth, allowed_domains), defaults filled in."""
    depth = (config.get("defaults") or {}).get("max_depth", DEFAULT_DEPTH)
    rows = [
        (i, s["slug"], s.get("name", s["slug"]), s.get("description", ""), s.get("home_url"), float(s.get("authority_weight", DEFAULT_AUTHORITY)), int(s.get("crawl_cadence_hours", DEFAULT_CADENCE)), int(s.get("max_depth", depth)), [h.strip().lower() for h in s.get("allowed_domains") or []])
        for i, s in enumerate(config.get("sources") or [])
    ]
    return spark.createDataFrame(rows, "position int, slug string, name string, description string, home_url string, authority_weight double, crawl_cadence_hours int, max_depth int, allowed_domains array<string>")


def seed_batch(seeds: DataFrame, default_priority: int = DEFAULT_PRIORITY) -> DataFrame:
    """seeds (source_slug or null, url, priority or null, arrival) as a batch for the queue, at depth 0."""
    url: Column = F.col("url")
    return seeds.select(
        "url",
        C.normalize_url(url).alias("normalized_url"),
        C.extract_domain(url).alias("domain"),
        F.lit(0).alias("depth"),
        F.lit(None).cast("string").alias("source_url"),
        "source_slug",
        F.coalesce("priority", F.lit(default_priority)).alias("priority"),
        "arrival",
    )


def seeds_frame(spark: SparkSession, config: dict) -> DataFrame:
    """Seeds of each source, or of the flat list that a configuration without sources has."""
    own = [(s["slug"], x) for s in config.get("sources") or [] for x in s.get("seeds") or []]
    flat = own or [(None, x) for x in config.get("seeds") or []]
    default = (config.get("defaults") or {}).get("priority", DEFAULT_PRIORITY)
    rows = [(slug, x["url"], int(x.get("priority", default)), i) for i, (slug, x) in enumerate(flat)]
    return seed_batch(spark.createDataFrame(rows, "source_slug string, url string, priority int, arrival long"))
