"""Extraction strategy per page, from analysis fields and structural signals."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webstrata.functions.memo import per_context
from webstrata.functions.text import contains_any, strip

# Mode, extraction order, main text on, tables / links / headings first.
DEFINITIONS = [
    ("article", ["main_text", "headings", "metadata"], True, False, False, True),
    ("product_catalog", ["links", "product_cards", "images", "prices"], False, False, True, False),
    ("documentation", ["headings", "code_blocks", "sidebar_links", "main_text"], True, False, True, True),
    ("forum", ["posts", "replies", "user_metadata", "links"], False, False, True, False),
    ("wiki", ["tables", "headings", "links", "main_text"], True, True, True, True),
    ("blog", ["main_text", "headings", "author_meta", "links"], True, False, False, True),
    ("news", ["headline", "main_text", "timestamp", "links"], True, False, False, True),
    ("ecommerce", ["price_and_specs", "tables", "images", "description"], False, True, False, False),
    ("table_heavy", ["tables", "structured_data", "headers"], False, True, False, False),
    ("generic", ["main_text", "tables", "links", "headings"], True, False, False, False),
]
DEFINITION_SCHEMA = (
    "scraping_mode string, extraction_priority array<string>, use_main_text boolean, "
    "prioritize_tables boolean, prioritize_links boolean, prioritize_headings boolean"
)
# Words that decide the mode, first row with a hit wins.
MODE_WORDS = [
    ("product_catalog", ["product catalog", "catalog", "product list"]),
    ("ecommerce", ["e-commerce", "ecommerce", "store", "shop"]),
    ("wiki", ["wiki", "wikipedia", "knowledgebase", "knowledge base"]),
    ("forum", ["forum", "discussion", "qa", "q&a", "community"]),
    ("documentation", ["documentation", "docs", "api reference"]),
    ("news", ["news", "press", "journal"]),
    ("blog", ["blog"]),
    ("article", ["article", "editorial", "paper"]),
    ("table_heavy", ["table", "financial"]),
]
SHOP_TYPES = dict(MODE_WORDS)["ecommerce"]
# Frameworks whose pages need rendering.
RENDERED_FRAMEWORKS = ["react", "next.js", "vue.js", "nuxt.js", "angular", "svelte"]
MODES = [row[0] for row in DEFINITIONS]


def definitions(spark: SparkSession) -> DataFrame:
    """The ten strategies: a fixed dimension table, safe to broadcast."""
    return spark.createDataFrame(DEFINITIONS, DEFINITION_SCHEMA).withColumn("use_parser", F.lit(True))


def needs_rendering(flag: Column, framework: Column, hints: Column) -> Column:
    """The analysis says so, or the framework or any hint is a client-side one."""
    known = F.array(*[F.lit(f) for f in RENDERED_FRAMEWORKS])
    return (
        F.coalesce(flag, F.lit(False))
        | F.coalesce(F.lower(framework).isin(RENDERED_FRAMEWORKS), F.lit(False))
        | F.coalesce(F.arrays_overlap(F.transform(hints, lambda h: F.lower(h)), known), F.lit(False))
    )


def table_heavy(kind: Column, wanted: Column, table_confidence: Column, tables: Column) -> Column:
    """Many tables or a high table confidence, no shop, and either asked for or very many."""
    return (
        ((tables >= 3) | (table_confidence >= 0.8))
        & ~kind.isin(SHOP_TYPES)
        & (F.contains(wanted, F.lit("table")) | (tables >= 4))
    )


def scraping_mode(
    website_type: Column,
    recommended: Column,
    table_confidence: Column,
    tables: Column,
    rules: Sequence[Column] = (),
) -> Column:
    """Mode of a page. ``rules`` are string columns tried first, in order; only known modes count."""
    kind = strip(F.lower(F.coalesce(website_type, F.lit(""))))
    wanted = strip(F.lower(F.coalesce(recommended, F.lit(""))))
    count = F.coalesce(tables, F.lit(0))
    combined = F.concat(kind, F.lit(" "), wanted)
    builtin = F.when(table_heavy(kind, wanted, F.coalesce(table_confidence, F.lit(0.0)), count), "table_heavy")
    for mode, words in MODE_WORDS:
        builtin = builtin.when(contains_any(combined, words), mode)
    return _first_known(rules, builtin.otherwise("generic"))


def _first_known(rules: Sequence[Column], builtin: Column) -> Column:
    return F.coalesce(*[F.when(r.isin(MODES), r) for r in rules], builtin) if rules else builtin


@per_context
def _builtin_mode() -> Column:
    return scraping_mode(
        F.col("website_type"), F.col("recommended_strategy"), F.col("table_confidence"), F.col("number_of_tables")
    )


@per_context
def _strategy_fields() -> Column:
    fields = F.struct(
        "scraping_mode", "extraction_priority", "use_main_text", "use_parser", "prioritize_tables",
        "prioritize_links", "prioritize_headings",
        needs_rendering(F.col("requires_javascript"), F.col("framework"), F.col("framework_hints")).alias(
            "requires_rendered"
        ),
    )
    return F.when(F.col("scraping_mode").isNotNull(), fields).alias("strategy")


#: A rule over rows, as a frame with the columns of the pages, that gives the mode of each row or none.
Rule = Column | Callable[[pd.DataFrame], pd.Series]


def tried(rule: Callable[[pd.DataFrame], pd.Series], rows: pd.DataFrame) -> tuple[list, list[bool]]:
    """A rule's mode per row, and which rows it fails on.

    The rule sees all rows at once. If it raises, halves are tried until the rows that it fails on
    stand alone, so a few bad rows cost a logarithm and leave the others their mode.
    """
    if not len(rows):
        return [], []
    try:
        modes = list(rule(rows))
        if len(modes) != len(rows):
            raise ValueError(f"{len(modes)} modes for {len(rows)} rows")
        return modes, [False] * len(rows)
    except Exception:  # whatever a rule raises concerns only the rows it raises for
        if len(rows) == 1:
            return [None], [True]
        half = len(rows) // 2
        (a, x), (b, y) = tried(rule, rows.iloc[:half]), tried(rule, rows.iloc[half:])
        return a + b, x + y


def rule_choice(pages: DataFrame, rules: Sequence[Rule], has: Column) -> Column:
    """``struct<mode,failures>``: the first known mode that a rule gives, and how many rules failed before it."""
    given = F.array(*[r if isinstance(r, Column) else F.lit(None).cast("string") for r in rules])
    functions = [None if isinstance(r, Column) else r for r in rules]
    known = set(MODES)

    def choose(rows: pd.DataFrame, given: pd.Series, wanted: pd.Series) -> pd.DataFrame:
        mode, failures = pd.Series([None] * len(rows), dtype=object), pd.Series([0] * len(rows))
        open_rows = np.flatnonzero(wanted.fillna(False).to_numpy(bool))
        for k, rule in enumerate(functions):
            if rule is None:
                found = [given.iloc[i][k] for i in open_rows]
            else:
                found, failed = tried(rule, rows.iloc[open_rows])
                failures.iloc[open_rows] += np.array(failed, int)
            hit = np.array([isinstance(m, str) and m in known for m in found], bool)
            mode.iloc[open_rows[hit]] = [m for m, h in zip(found, hit) if h]
            open_rows = open_rows[~hit]
        return pd.DataFrame({"mode": mode, "failures": failures})

    decide = F.pandas_udf(choose, "mode string, failures bigint")
    return decide(F.struct(*pages.columns), given, has)


def assign_strategy(pages: DataFrame, rules: Sequence[Rule] = (), has: str = "has_analysis") -> DataFrame:
    """Add the nullable struct ``strategy`` to rows with analysis fields and signals.

    Custom rules go first, in order. One given as a column is part of the plan, and an error in it
    ends the job. One given as a function may fail: it is skipped for the rows it fails on, and
    ``rule_failures`` is added, the number of rules that failed on a row before one decided.
    """
    registry = F.broadcast(definitions(pages.sparkSession))
    analysed = F.coalesce(F.col(has), F.lit(False))
    if all(isinstance(r, Column) for r in rules):
        mode, extra, ready = _first_known(rules, _builtin_mode()), [], pages
    else:
        ready = pages.withColumn("__by_rule", rule_choice(pages, rules, analysed))
        mode = F.coalesce(F.col("__by_rule.mode"), _builtin_mode())
        extra = [F.col("__by_rule.failures").alias("rule_failures")]
    joined = ready.withColumn("scraping_mode", F.when(analysed, mode)).join(registry, "scraping_mode", "left")
    return joined.select(*pages.columns, _strategy_fields(), *extra)
