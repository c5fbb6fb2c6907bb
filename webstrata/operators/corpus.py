"""Corpus statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COUNTS = ["content_length", "headings_count", "paragraphs_count", "links_count", "tables_count"]


def corpus_rollup(summary: DataFrame, dims: list[str], counts: list[str] | None = None) -> DataFrame:
    """Pages, sums and means of the page counts per dimension prefix, with totals.

    ``level`` is the grouping id: 0 for the full key, all ones for the grand total.
    """
    counts = counts or COUNTS
    return summary.rollup(*dims).agg(
        F.grouping_id().cast("bigint").alias("level"),
        F.count(F.lit(1)).alias("pages"),
        *[F.sum(c).cast("bigint").alias(f"{c}_sum") for c in counts],
        *[F.round(F.avg(c), 6).alias(f"{c}_mean") for c in counts],
    )


def host(url):
    """Lower-case host of a URL column, NULL when there is none."""
    return F.lower(F.try_parse_url(url, F.lit("HOST")))
