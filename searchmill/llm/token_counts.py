"""Token counts: an exact histogram of encoded lengths that answers for every context limit.

Each text is encoded whole; documents are counted by length. With suffix sums over
the lengths, one row for each length L that occurs tells what a context limit of
L would give. A limit between two lengths behaves as `at_limit` says.

Cases. A null text isn't a document here; an empty one has length 0. Repeated rows
count each, whatever the doc_id, which may be null. No documents give no rows.
Other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import TOKENIZERS
from .tokens import count_udf


def histogram(docs: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """(n_tokens, docs) for each encoded length that occurs."""
    counted = docs.select(count_udf(folder)(F.col("text")).alias("n_tokens")).where("n_tokens is not null")
    return counted.groupBy("n_tokens").agg(F.count("*").alias("docs"))


def context_table(docs: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """One row for each length L that occurs: n_tokens (L), docs, docs_longer, tokens, tokens_longer, truncated_total, lost_tokens, quantile.

    docs_longer and tokens_longer are of the documents above L (suffix sums);
    truncated_total is the tokens left if every document is cut to L, lost_tokens
    what the cut takes; quantile is the share of documents of at most L tokens.
    The window runs over lengths, of which there are at most as many as the
    longest document has tokens, and never over documents.
    """
    up = Window.orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    above = Window.orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, -1)
    rows = histogram(docs, folder).withColumns(
        {
            "docs_longer": F.coalesce(F.sum("docs").over(above), F.lit(0)),
            "tokens_longer": F.coalesce(F.sum(F.col("docs") * F.col("n_tokens")).over(above), F.lit(0)),
            "docs_upto": F.sum("docs").over(up),
            "tokens": F.sum(F.col("docs") * F.col("n_tokens")).over(up),
        }
    )
    return rows.select(
        "n_tokens",
        "docs",
        "docs_longer",
        "tokens",
        "tokens_longer",
        (F.col("tokens") + F.col("docs_longer") * F.col("n_tokens")).alias("truncated_total"),
        (F.col("tokens_longer") - F.col("docs_longer") * F.col("n_tokens")).alias("lost_tokens"),
        (F.col("docs_upto") / (F.col("docs_upto") + F.col("docs_longer"))).alias("quantile"),
    )


def at_limit(table: DataFrame, limit: int) -> DataFrame:
    """(docs_longer, truncated_total, lost_tokens) of any context limit, from the context table; one row."""
    longer = F.col("n_tokens") > limit
    return table.select(
        F.coalesce(F.sum(F.when(longer, F.col("docs"))), F.lit(0)).alias("docs_longer"),
        F.coalesce(F.sum(F.col("docs") * F.least("n_tokens", F.lit(limit))), F.lit(0)).alias("truncated_total"),
        F.coalesce(F.sum(F.when(longer, F.col("docs") * (F.col("n_tokens") - limit))), F.lit(0)).alias("lost_tokens"),
    )


def length_quantile(table: DataFrame, q: float) -> DataFrame:
    """(n_tokens): the least length that at least the share q of documents don't exceed."""
    return table.where(F.col("quantile") >= F.lit(q) - F.lit(1e-12)).agg(F.min("n_tokens").alias("n_tokens"))
