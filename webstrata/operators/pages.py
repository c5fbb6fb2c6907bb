"""Page operators: one row in, one row out, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webstrata.functions import html as H
from webstrata.functions import tables as T
from webstrata.functions.memo import per_context


@per_context
def _markup(html: str) -> Column:
    return H.markup(F.col(html))


@per_context
def _shared() -> list[Column]:
    mk = F.col("markup")
    return [
        H.head_tags(mk).alias("head"),
        H.tag_marks(mk).alias("marks"),
        H.paragraph_pieces(mk).alias("p_pieces"),
        H.title(mk).alias("title_text"),
        T.table_pieces(mk).alias("pieces"),
    ]


@per_context
def _spans() -> Column:
    return T.spans(F.col("pieces"))


def with_markup(pages: DataFrame, html: str = "html") -> DataFrame:
    """Add the columns every extractor reads: ``markup``, ``head`` tags, ``marks``, ``p_pieces``,
    ``title_text`` and table ``pieces``. Those that nothing reads are pruned."""
    return pages.withColumn("markup", _markup(html)).select("*", *_shared())


@per_context
def _extracted() -> list[Column]:
    mk = F.col("markup")
    return [
        F.col("title_text").alias("parsed_title"),
        H.heading_items(mk).alias("heading_items"),
        H.paragraph_texts(F.col("p_pieces")).alias("paragraph_texts"),
        H.links(mk).alias("links"),
        F.coalesce(main_column(), basic_column()).alias("content"),
    ]


@per_context
def _paragraph_columns() -> tuple[Column, Column]:
    texts = F.col("paragraph_texts")
    return H.long_paragraphs(texts).alias("paragraphs"), H.first_paragraphs(texts).alias("first_paragraphs")


@per_context
def _judged_tables() -> Column:
    return T.tables(F.col("pieces"), F.col("spans")).alias("judged_tables")


def extract(pages: DataFrame, keep: list[str], html: str = "html") -> DataFrame:
    """Structure every page once, before any strategy is known.

    The result is compact and still open to both strategy choices (heading levels and the
    data-table verdicts are kept), so joins after this point move structured rows, never HTML.
    Basic content is read only where there is no main text. Tables come last: only compact
    columns and the pieces of pages with a table pass the one Python step.
    """
    wide = with_markup(pages, html).select(*keep, *_extracted(), *signal_columns(html), "pieces")
    ranged = wide.select("*", *_paragraph_columns(), _spans().alias("spans"))
    return ranged.select("*", _judged_tables()).drop("paragraph_texts", "pieces", "spans")


@per_context
def main_column() -> Column:
    return H.main_content(F.col("markup"), F.col("title_text"), F.col("head"))


@per_context
def basic_column() -> Column:
    return H.basic_content(F.col("markup"), F.col("p_pieces"))


@per_context
def signal_columns(html: str = "html") -> list[Column]:
    """Scalar structural signals of a page, over :func:`with_markup`."""
    mk, head, marks, raw = F.col("markup"), F.col("head"), F.col("marks"), F.col(html)
    counted = {"table": "tables", "form": "forms", "a": "links", "img": "images", "script": "scripts"}
    return [
        H.signal_title(F.col("title_text"), head).alias("page_title"),
        H.meta_description(head).alias("meta_description"),
        H.canonical_url(head).alias("canonical_url"),
        *[H.mark_count(marks, tag).alias(f"number_of_{name}") for tag, name in counted.items()],
        *[H.has_mark(marks, name).alias(f"has_{name}") for name in H.FLAGGED],
        H.framework_hints(mk, head, raw).alias("framework_hints"),
        F.coalesce(F.length(raw), F.lit(0)).cast("bigint").alias("total_html_size"),
        F.length(H.visible_text(mk)).cast("bigint").alias("visible_text_length"),
    ]


def signals(pages: DataFrame, keep: list[str], html: str = "html", paragraphs: int | None = None) -> DataFrame:
    """All structural signals of each page in one row, with all or the first ``paragraphs`` non-empty ones."""
    return with_markup(pages, html).select(
        *keep,
        *signal_columns(html),
        H.heading_items(F.col("markup")).alias("heading_hierarchy"),
        H.first_paragraphs(H.paragraph_texts(F.col("p_pieces")), paragraphs).alias("first_paragraphs"),
    )


def content(pages: DataFrame, keep: list[str], html: str = "html") -> DataFrame:
    """``main``, ``basic`` and ``content``: main text, else the long paragraphs, else NULL."""
    both = with_markup(pages, html).select(
        *keep, main_column().alias("main"), basic_column().alias("basic")
    )
    return both.select(*keep, "main", "basic", F.coalesce("main", "basic").alias("content"))


def choose(extracted: DataFrame, flags: str | None = None) -> DataFrame:
    """Apply strategy flags: heading levels, table filter, main text on or off.

    ``flags`` names a struct column with ``prioritize_headings``, ``prioritize_tables`` and
    ``use_main_text``; without one, or where it is NULL, the defaults apply.
    """
    return extracted.withColumns(_chosen(flags)).drop("heading_items", "judged_tables", "content")


@per_context
def _chosen(flags: str | None) -> dict[str, Column]:
    def flag(name: str, default: bool) -> Column:
        return F.lit(default) if flags is None else F.coalesce(F.col(f"{flags}.{name}"), F.lit(default))

    all_levels, all_tables = flag("prioritize_headings", False), flag("prioritize_tables", False)
    return {
        "headings": H.heading_texts(F.col("heading_items"), all_levels),
        "tables": T.chosen_tables(F.col("judged_tables"), all_tables),
        "extracted": F.when(flag("use_main_text", True), F.col("content")),
    }


def parse(pages: DataFrame, keep: list[str], html: str = "html", flags: str | None = None) -> DataFrame:
    """Title, headings, paragraphs, links and tables of each page."""
    keep_all = keep + ([flags] if flags else [])
    return choose(extract(pages, keep_all, html), flags).select(
        *keep, F.col("parsed_title").alias("title"), "headings", "paragraphs", "links", "tables"
    )
