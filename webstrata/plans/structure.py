"""End-to-end plans: captured pages in, merged results out.

Structuring a page costs far more than moving it, so only bodies that can end up in a result are
structured; from there on all joins (analysis, strategy, choice) move compact rows. A page table
is structured where it is scanned, without any shuffle of HTML.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webstrata.functions.memo import per_context
from webstrata.operators import analysis as A
from webstrata.operators import capture as C
from webstrata.operators import pages as P
from webstrata.operators import results as R
from webstrata.operators import strategy as S
from webstrata.session import written
from webstrata.sources.addresses import address, fetch, stored

RESULT_COLUMNS = [
    "url", "title", "clean_text", "content_length", "headings", "paragraphs", "links", "tables",
    "scrape_method",
]


def _finish(rows: DataFrame, keep: list[str]) -> DataFrame:
    merged = R.merge(P.choose(rows, "strategy"))
    return merged.select(*keep, *RESULT_COLUMNS, *_decisions())


@per_context
def _decisions() -> list[Column]:
    steps = R.decision_steps(F.col("strategy"), F.col("website_type"), F.col("scrape_method"))
    analysis = F.when(F.col("has_analysis"), F.struct(*A.ANALYSIS_FIELDS))
    return [analysis.alias("analysis"), F.col("strategy"), steps.alias("steps")]


def _with_analysis(rows: DataFrame, responses: DataFrame | None) -> DataFrame:
    if responses is not None:
        # Parsed after the join: a page without any answer row ends in the fallback record too.
        answers = A.select_responses(responses).withColumnRenamed("content", "answer")
        return A.parse_responses(rows.join(answers, "url", "left"), "answer")
    schema = A.parse_responses(rows.select("url", F.lit(None).cast("string").alias("answer")), "answer").schema
    return rows.select(
        "*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in schema if f.name != "url"]
    )


def structure_pages(
    pages: DataFrame, responses: DataFrame | None = None, rules: Sequence[Column] = ()
) -> DataFrame:
    """Results for ``pages(page_id, url, html)`` that hold one static capture per URL."""
    rows = P.extract(pages, ["page_id", "url"])
    ready = S.assign_strategy(_with_analysis(rows, responses), rules)
    return _finish(ready.withColumn("scrape_method", F.lit(C.STATIC)), ["page_id"])


def structure_captures(
    captures: DataFrame | str,
    responses: DataFrame | None = None,
    rules: Sequence[S.Rule] = (),
    spark: SparkSession | None = None,
) -> DataFrame:
    """Results for a capture log, one row per URL with a usable attempt.

    ``captures`` is the path of a Parquet table (then with ``spark``), which is read where it is, or
    a frame, which is written once to the shared folder. Signals and analysis belong to the first
    usable attempt; where the strategy asks for rendering, text and structure come from the rendered
    attempt if there is one. Choices are made on light rows that carry addresses; the bodies of
    the at most two attempts per URL that can win are then read in place, so no body moves between
    tasks, whatever the number of URLs. What they yield is written once, too.
    """
    if isinstance(captures, str):
        path, seen = captures, C.classify(spark.read.parquet(captures))
        light = seen.select("url", "method", "attempt", "outcome", *address())
    else:
        spark = captures.sparkSession
        path = stored(C.classify(captures).drop("message", "api_status"), "captures")
        light = spark.read.parquet(path).select("url", "method", "attempt", "outcome", *address())
    outcomes = written(light, "outcomes")
    best = written(C.best_attempts(outcomes).where(F.col("first_choice") < 2**34), "best-attempts")
    wanted = best.select(F.col("first_file").alias("file"), F.col("first_row").alias("row")).unionByName(
        best.where("rendered_choice <> first_choice").select(F.col("rendered_file").alias("file"), F.col("rendered_row").alias("row"))
    )
    best = best.select("url", "first_choice", "rendered_choice")
    bodies = fetch(spark, path, outcomes, wanted).select("url", "method", "body", C.priority(F.lit(True)).alias("choice"))
    extracts = written(P.extract(bodies, ["url", "method", "choice"], "body"), "extracts")
    signals = extracts.select(
        "url", F.col("choice").alias("first_choice"), "number_of_tables", "framework_hints"
    )
    planned = S.assign_strategy(
        _with_analysis(best.join(signals, ["url", "first_choice"]), responses), rules
    )
    wanted = F.coalesce(F.col("strategy.requires_rendered"), F.lit(False))
    choice = F.when(wanted, F.coalesce("rendered_choice", "first_choice")).otherwise(F.col("first_choice"))
    chosen = planned.withColumn("choice", choice).drop(
        "first_choice", "rendered_choice", "number_of_tables", "framework_hints"
    )
    # Written, for the join below would test the choice for null ahead of it and parse every answer again for that.
    rows = extracts.drop("number_of_tables", "framework_hints").join(written(chosen, "choices"), ["url", "choice"])
    return _finish(rows.withColumn("scrape_method", F.col("method")), [])


def capture_failures(captures: DataFrame) -> DataFrame:
    """``(url, outcome, api_status, message)`` of URLs without any usable attempt."""
    light = C.classify(captures).select("url", "method", "attempt", "outcome", "api_status", "message")
    return C.first_failures(written(light, "outcomes")).select("url", "outcome", "api_status", "message")
