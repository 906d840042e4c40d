"""Settings of the search index, and what has to change where an index has others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from searchmill.operators.search import ATTRIBUTES

KIND = "setting string, values array<string>"
DATES, COUNTS, SCORES = ("published_at", "last_updated_at"), ("word_count", "code_block_count"), ("authority_score", "boost_score")
SCALAR_FACETS = ("source_slug", "content_type", "domain", "language")
WANTED = {
    "searchable": ATTRIBUTES,  # by falling weight
    "filterable": (*SCALAR_FACETS, "tags", "freshness_status", "code_block_count", *DATES),
    "sortable": (*DATES, *COUNTS, *SCORES),
    "displayed": ("id", "url", "canonical_url", *SCALAR_FACETS, *(a for a in ATTRIBUTES if a != "tags"), "tags", "freshness_status", *DATES, *COUNTS, *SCORES),
    "ranking": ("words", "typo", "proximity", "attribute", "sort", "exactness", *(f"{s}:desc" for s in SCORES)),
    "values_per_facet": ("50",),
}
ORDERED = ("searchable", "ranking")  # of the others the order means nothing


def reconcile(current: DataFrame) -> DataFrame:
    """(setting, values): the settings of current (setting, values) that are missing or differ, as they should be."""
    wanted = current.sparkSession.createDataFrame([(k, list(v)) for k, v in WANTED.items()], KIND)
    have = current.select("setting", F.col("values").alias("have"))
    same = F.when(F.col("setting").isin(*ORDERED), F.col("values") == F.col("have")).otherwise(F.array_sort("values") == F.array_sort("have"))
    return wanted.join(have, "setting", "left").where(~F.coalesce(same, F.lit(False))).select("setting", "values")
