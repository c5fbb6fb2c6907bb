"""Flat forms of extracted tables and links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webstrata.functions.text import explode_rows, strip


def table_rows(results: DataFrame, keep: list[str], tables: str = "tables") -> DataFrame:
    """``table_index, row_index, cells``, both 1-based; empty rows keep their number but go."""
    by_table = explode_rows(results, keep, tables, "table", "table_index")
    by_row = explode_rows(by_table, [*keep, "table_index"], "table", "cells", "row_index")
    return by_row.where(F.size("cells") > 0).select(
        *keep,
        (F.col("table_index") + 1).alias("table_index"),
        (F.col("row_index") + 1).alias("row_index"),
        F.transform("cells", lambda c: strip(F.coalesce(c, F.lit("")))).alias("cells"),
    )


def table_cells(rows: DataFrame, keep: list[str]) -> DataFrame:
    """Long form ``table_index, row_index, col_index, value``: its schema fits any width."""
    cells = explode_rows(rows, [*keep, "table_index", "row_index"], "cells", "value", "col_index")
    return cells.withColumn("col_index", F.col("col_index") + 1)


def wide_rows(rows: DataFrame, keep: list[str], width: int | None = None) -> DataFrame:
    """``col_1 .. col_n`` form. Without ``width`` one aggregate finds the widest row first; a
    given ``width`` that some row exceeds is an error, so no cell is lost."""
    if width is None:
        width = rows.agg(F.max(F.size("cells")).alias("w")).first()["w"] or 1
    else:
        too_wide = F.raise_error(F.lit(f"a row has more than {width} cells"))
        rows = rows.withColumn("cells", F.when(F.size("cells") > width, too_wide).otherwise(F.col("cells")))
    return rows.select(
        *keep, "table_index", "row_index",
        *[F.get("cells", F.lit(i)).alias(f"col_{i + 1}") for i in range(width)],
    )


def link_rows(results: DataFrame, keep: list[str], links: str = "links") -> DataFrame:
    """``pos, text, href`` of every link with an href; repeats stay."""
    flat = explode_rows(results, keep, links, "link")
    return (
        flat.select(
            *keep,
            "pos",
            strip(F.coalesce("link.text", F.lit(""))).alias("text"),
            strip(F.coalesce("link.href", F.lit(""))).alias("href"),
        )
        .where(F.col("href") != "")
    )
