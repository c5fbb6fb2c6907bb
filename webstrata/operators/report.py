"""Report tables. Everything per page is computed inside the row; only output rows multiply."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webstrata.functions.text import bind, escape_markup, explode_rows, or_default, strip

# How much a printed report shows. Nothing is cut unless a caller passes them.
PREVIEW_CHARS, UI_PREVIEW_CHARS = 1000, 300
SHOWN_HEADINGS, SHOWN_TABLES, SHOWN_COLUMNS, SHOWN_LINKS = 20, 5, 8, 100
SHOWN_CELL = 200
PAGE_WIDTH, MAX_WIDTH, MIN_WIDTH, CHAR_WIDTH = 504.0, 180.0, 35.0, 5.5
NO_CONTENT = "No content available"


def _label_rows(df: DataFrame, keep: list[str], rows: list[tuple[str, Column]], names: tuple[str, str], present: Column | None = None) -> DataFrame:
    pairs = F.array(
        *[F.struct(F.lit(label).alias(names[0]), value.alias(names[1])) for label, value in rows]
    )
    if present is not None:
        pairs = F.when(present, pairs)
    return explode_rows(df, keep, pairs, "row").select(*keep, "row.*")


# Fixed values below: the labels of report rows.


def statistics(results: DataFrame, keep: list[str]) -> DataFrame:
    """``(statistic, value)`` rows of the summary section."""
    full_tables = F.filter(F.coalesce("tables", F.array().cast("array<array<array<string>>>")), lambda t: F.size(t) > 0)
    headings = F.filter(F.coalesce("headings", F.array().cast("array<string>")), lambda h: h != "")
    rows = [
        ("Total Content Length (characters)", F.length(or_default(F.col("clean_text"), NO_CONTENT))),
        ("Number of Headings", F.size(headings)),
        ("Number of Paragraphs", F.coalesce(F.size("paragraphs"), F.lit(0))),
        ("Number of Links", F.coalesce(F.size("links"), F.lit(0))),
        ("Number of Tables", F.size(full_tables)),
    ]
    return _label_rows(results, keep, [(n, v.cast("bigint")) for n, v in rows], ("statistic", "value"))


def metadata(results: DataFrame, keep: list[str], generated_at: Column) -> DataFrame:
    """``(label, value)`` rows of the cover section; ``generated_at`` is a timestamp column."""
    rows = [
        ("Website Title:", escape_markup(or_default(F.col("title"), "No Title"))),
        ("Source URL:", escape_markup(F.coalesce("url", F.lit("")))),
        ("Generated Date:", F.date_format(generated_at, "yyyy-MM-dd")),
        ("Generated Time:", F.date_format(generated_at, "HH:mm:ss")),
        ("Scrape Method:", or_default(F.col("scrape_method"), "Unknown")),
    ]
    return _label_rows(results, keep, rows, ("label", "value"))


def analysis_rows(analysis: DataFrame, keep: list[str], has: str = "has_analysis") -> DataFrame:
    """``(label, value)`` rows of the analysis section; none for pages without analysis."""
    def share(name: str) -> Column:
        return F.concat(
            (F.coalesce(name, F.lit(0.0)) * 100).cast("bigint").cast("string"), F.lit("%")
        )

    lines = F.transform("warnings", lambda w: F.concat(F.lit("• "), escape_markup(w)))
    rows = [
        ("Website Type", escape_markup(or_default(F.col("website_type"), "Unknown"))),
        ("Detected Framework", escape_markup(or_default(F.col("framework"), "Unknown"))),
        ("Content Confidence", share("content_confidence")),
        ("Table Confidence", share("table_confidence")),
        ("Requires JavaScript", F.when(F.col("requires_javascript"), "Yes").otherwise("No")),
        ("Recommended Strategy", escape_markup(or_default(F.col("recommended_strategy"), "Standard HTML"))),
        (
            "Architectural Summary",
            escape_markup(or_default(F.col("summary"), "No architectural summary provided.")),
        ),
        (
            "AI Warnings & Hazards",
            F.when(F.size("warnings") > 0, F.array_join(lines, "<br/>")).otherwise("None detected."),
        ),
    ]
    return _label_rows(analysis, keep, rows, ("label", "value"), F.col(has))


def _shown(pos: Column, limit: int | None) -> Column:
    """Whether a row is among the first ``limit``; every row is without one."""
    return (F.lit(True) if limit is None else pos < limit).alias("shown")


def preview(text: Column, chars: int | None = None) -> Column:
    """The text, or its first ``chars`` characters with dots when cut."""
    t = or_default(text, NO_CONTENT)
    if chars is None:
        return t
    return F.concat(F.substring(t, 1, chars), F.when(F.length(t) > chars, "...").otherwise(""))


def ui_preview(text: Column, chars: int | None = None) -> Column:
    """The text, or its first ``chars`` characters, always with dots when there is any text."""
    head = text if chars is None else F.substring(text, 1, chars)
    return F.when(F.coalesce(text, F.lit("")) != "", F.concat(head, F.lit("..."))).otherwise("No preview available")


def headings(results: DataFrame, keep: list[str], limit: int | None = None) -> DataFrame:
    """All headings with their position; ``shown`` tells the first ``limit``."""
    rows = explode_rows(results, keep, F.filter("headings", lambda h: h != ""), "heading")
    return rows.select("*", _shown(F.col("pos"), limit))


def _layout(rows: Column, columns: int | None, chars: int | None) -> Column:
    """Padded, column-filtered cells of one table: at most ``columns``, cells of at most ``chars`` characters."""
    def clip(cell: Column) -> Column:
        c = strip(F.coalesce(cell, F.lit("")))
        if chars is not None:
            c = F.when(F.length(c) > chars, F.concat(F.substring(c, 1, chars - 3), F.lit("..."))).otherwise(c)
        return escape_markup(c)

    tagged = F.transform(
        rows,
        lambda r, i: F.struct(
            i.alias("index"),
            F.transform(r, clip).alias("cells"),
        ),
    )
    filled = F.filter(tagged, lambda r: F.exists(r["cells"], lambda c: c != ""))

    def at(cells: Column, i: Column) -> Column:
        return F.coalesce(F.get(cells, i), F.lit(""))

    def active(full: Column) -> Column:
        width = F.array_max(F.transform(full, lambda r: F.size(r["cells"])))
        every = F.sequence(F.lit(0), width - 1)
        used = F.filter(every, lambda i: F.exists(full, lambda r: at(r["cells"], i) != ""))
        return used if columns is None else F.slice(used, 1, columns)

    def lay(full: Column) -> Column:
        return bind(
            active(full),
            lambda cols: F.transform(
                full,
                lambda r: F.struct(
                    (r["index"] == 0).alias("is_header"),
                    F.transform(cols, lambda i: at(r["cells"], i)).alias("cells"),
                ),
            ),
        )

    none = F.array().cast("array<struct<is_header:boolean,cells:array<string>>>")
    return bind(filled, lambda full: F.when(F.size(full) > 0, lay(full)).otherwise(none))


def column_widths(rows: Column) -> Column:
    """Widths of laid-out rows: by longest text, capped, then scaled to the page (floor kept)."""
    def capped(r: Column) -> Column:
        columns = F.sequence(F.lit(0), F.size(r[0]["cells"]) - 1)
        return F.transform(
            columns,
            lambda i: F.least(
                F.lit(MAX_WIDTH),
                F.greatest(
                    F.lit(MIN_WIDTH),
                    F.array_max(F.transform(r, lambda x: F.length(F.get(x["cells"], i)) * CHAR_WIDTH)),
                ),
            ),
        )

    def scaled(w: Column) -> Column:
        total = F.aggregate(w, F.lit(0.0), lambda s, x: s + x)
        return bind(
            total,
            lambda t: F.when(
                t > PAGE_WIDTH, F.transform(w, lambda x: F.greatest(x * (F.lit(PAGE_WIDTH) / t), F.lit(MIN_WIDTH)))
            ).otherwise(w),
        )

    return bind(capped(rows), scaled)


def report_tables(
    results: DataFrame, keep: list[str], limit: int | None = None, columns: int | None = None, chars: int | None = None
) -> DataFrame:
    """``table_index, shown, rows, widths`` of all tables that have visible cells.

    ``table_index`` counts these from 1 and ``shown`` tells the first ``limit``. ``columns`` and
    ``chars`` cut the layout of a table to what a page can hold.
    """
    visible = F.filter(
        "tables", lambda t: F.exists(F.flatten(t), lambda c: strip(F.coalesce(c, F.lit(""))) != "")
    )
    tables = explode_rows(results, keep, visible, "table", "table_index")
    return (
        tables.select("*", _shown(F.col("table_index"), limit))
        .withColumn("table_index", F.col("table_index") + 1)
        .withColumn("rows", _layout(F.col("table"), columns, chars))
        .withColumn("widths", column_widths(F.col("rows")))
        .drop("table")
    )


def table_lines(laid_out: DataFrame, keep: list[str]) -> DataFrame:
    """One row per report line: position, header flag, spanning flag and cells."""
    exploded = explode_rows(laid_out, [*keep, "table_index", "shown"], "rows", "row")
    cells = F.col("row.cells")
    spans = (F.get(cells, F.lit(0)) != "") & (F.size(F.filter(cells, lambda c: c != "")) == 1)
    return exploded.select(
        *keep,
        "table_index",
        "shown",
        (F.col("pos") + 1).alias("row_index"),
        F.col("row.is_header").alias("is_header"),
        spans.alias("spans_row"),
        cells.alias("cells"),
    )


def table_widths(laid_out: DataFrame, keep: list[str]) -> DataFrame:
    """One row per report column with its width in points."""
    return explode_rows(laid_out, [*keep, "table_index", "shown"], "widths", "width").select(
        *keep, "table_index", "shown", (F.col("pos") + 1).alias("col_index"), "width"
    )


def display_links(results: DataFrame, keep: list[str], links: str = "links", limit: int | None = None) -> DataFrame:
    """All links per page by distinct href with the first text given for each.

    ``shown`` tells the first ``limit``, ``has_more`` whether the page has others.
    """
    def first_of_runs(items: Column) -> Column:
        """The least item of every href: items are sorted and those that begin a run are kept."""
        return bind(
            F.sort_array(items),
            lambda s: F.filter(s, lambda x, i: (i == 0) | (F.get(s, i - 1)["href"] != x["href"])),
        )

    def by_href(named: Column) -> Column:
        places = F.transform(named, lambda x, i: F.struct(x["href"].alias("href"), i.alias("at")))
        texts = F.transform(
            named,
            lambda x, i: F.struct(
                x["href"].alias("href"), (x["text"] == "").alias("blank"), i.alias("at"), x["text"].alias("text")
            ),
        )
        # both are in the order of href
        return F.zip_with(
            first_of_runs(places),
            first_of_runs(texts),
            lambda p, t: F.struct(p["at"].alias("at"), p["href"].alias("href"), t["text"].alias("text")),
        )

    trimmed = F.transform(
        links,
        lambda x: F.struct(
            strip(F.coalesce(x["text"], F.lit(""))).alias("text"),
            strip(F.coalesce(x["href"], F.lit(""))).alias("href"),
        ),
    )
    labelled = F.sort_array(bind(F.filter(trimmed, lambda x: x["href"] != ""), by_href))
    pages = results.select(*keep, labelled.alias("labelled"))
    more = F.lit(False) if limit is None else F.size("labelled") > limit
    shown = explode_rows(pages, [*keep, more.alias("has_more")], "labelled", "link")
    text, href = F.col("link.text"), F.col("link.href")
    return shown.select(
        *keep,
        "pos",
        href.alias("href"),
        F.when(text != "", text).otherwise(href).alias("label"),
        _shown(F.col("pos"), limit),
        "has_more",
    )
