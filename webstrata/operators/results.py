"""Merged result of a page, decision steps, summary, latest result per URL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webstrata.functions.memo import per_context
from webstrata.functions.text import or_default
from webstrata.operators.capture import RENDERED

# Titles and descriptions of the decision steps.
STEP_TYPE = "Website classified as %s"
STEP_MODE = "Engine selected '%s' strategy optimized for page architecture."
STEPS = {
    "rendered": ("Playwright selected", "Headless browser rendering forced for dynamic JS components."),
    "static": ("Requests selected", "Fast HTTP requests engine selected for static retrieval."),
    "text_on": ("Trafilatura enabled", "Main body article text extraction enabled."),
    "text_off": ("Trafilatura disabled", "Main text filtering bypassed to focus on structured elements."),
    "tables": ("Tables prioritized", "Preserving every detected data table."),
    "headings": ("Headings hierarchy prioritized", "Preserving complete H1-H6 heading tree."),
    "links": ("Hyperlinks prioritized", "Preserving all distinct navigation and reference links."),
}


def merge(chosen: DataFrame) -> DataFrame:
    """Add ``title``, ``clean_text`` and ``content_length`` to rows of ``pages.choose``.

    An extracted title wins even when it is only ``Untitled``.
    """
    return (
        chosen.withColumns(_merged())
        .withColumn("content_length", F.length("clean_text").cast("bigint"))
        .drop("extracted", "parsed_title")
    )


@per_context
def _merged() -> dict[str, Column]:
    text, title = F.col("extracted.text"), F.col("extracted.title")
    return {
        "clean_text": F.when(F.coalesce(text, F.lit("")) != "", text).otherwise(F.array_join("paragraphs", " ")),
        "title": F.when(F.coalesce(title, F.lit("")) != "", title).otherwise(F.coalesce("parsed_title", F.lit(""))),
    }


def decision_steps(strategy: Column, website_type: Column, method: Column) -> Column:
    """``array<struct<title,status,description>>`` of three or four steps; empty without strategy."""
    def step(title: Column, description: Column) -> Column:
        return F.struct(
            title.alias("title"), F.lit("success").alias("status"), description.alias("description")
        )

    def fixed(name: str) -> Column:
        return step(F.lit(STEPS[name][0]), F.lit(STEPS[name][1]))

    s = strategy
    steps = F.array_compact(
        F.array(
            step(
                F.format_string(STEP_TYPE, F.coalesce(website_type, F.lit("General"))),
                F.format_string(STEP_MODE, s["scraping_mode"]),
            ),
            F.when(method == RENDERED, fixed("rendered")).otherwise(fixed("static")),
            F.when(s["use_main_text"], fixed("text_on")).otherwise(fixed("text_off")),
            F.when(s["prioritize_tables"], fixed("tables"))
            .when(s["prioritize_headings"], fixed("headings"))
            .when(s["prioritize_links"], fixed("links")),
        )
    )
    none = F.array().cast("array<struct<title:string,status:string,description:string>>")
    return F.when(s.isNotNull(), steps).otherwise(none)


def page_summary(results: DataFrame, keep: list[str], mode: Column | None = None) -> DataFrame:
    """Counts of what each page yielded."""
    return results.select(
        *keep,
        or_default(F.col("title"), "N/A").alias("title"),
        F.col("content_length").cast("bigint").alias("content_length"),
        *[
            F.coalesce(F.size(name), F.lit(0)).cast("bigint").alias(f"{name}_count")
            for name in ("headings", "paragraphs", "links", "tables")
        ],
        *([mode.alias("mode")] if mode is not None else []),
    )


def latest_per_url(history: DataFrame, order: list[str], key: str = "url") -> DataFrame:
    """The newest row of every URL by ``order``, whose values must tell its rows apart.

    Hash aggregates with partial results find the winner on the order columns alone, one after the
    other, so a hot URL is one row per task and no payload is sorted; the row is then fetched by
    an equi join. Rows without URL, or with a null in an order column, never win.
    """
    light = history.select(key, *order).where(F.col(key).isNotNull())
    for column in order:
        best = light.groupBy(key).agg(F.max(column).alias("__newest"))
        light = light.join(best, key).where(F.col(column) == F.col("__newest")).drop("__newest")
    return history.join(light.distinct(), [key, *order], "left_semi")


def with_cached(requests: DataFrame, history: DataFrame, order: list[str], key: str = "url") -> DataFrame:
    """Every requested URL with its latest result, NULL where it still has to be captured."""
    return requests.join(latest_per_url(history, order, key), key, "left")


def not_captured(requests: DataFrame, history: DataFrame, key: str = "url") -> DataFrame:
    """Requested URLs without any result yet."""
    return requests.join(history.select(key), key, "left_anti")
