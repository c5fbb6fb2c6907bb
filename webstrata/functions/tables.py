"""HTML tables of a page: nesting, data-table test, cell text.

Tokens, attributes, texts and all the tests are native expressions. The one sequential step,
matching open and close tags with implied ends, is a small Arrow helper that sees only the tag
names of pages that have a table. It keeps the work on the map side: the relational form of
the same test (``operators.nodes``) would have to bring every page back together by a shuffle.
"""

from __future__ import annotations

import sys
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from webstrata.functions.html import _ANCHOR, _BLOCKS, _REST, VOID, attribute, inner_text
from webstrata.functions.memo import per_context
from webstrata.functions.text import RECORD, UNIT, bind, contains_any, split_at, word_tokens

# Executors get the helper by value, so they need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Class marks that accept a table, words that reject it, layout roles.
DATA_CLASSES = ["infobox", "wikitable", "data", "table-all", "grid"]
IGNORED_WORDS = [
    "nav", "navigation", "navbox", "sidebar", "menu", "vertical-navbox", "navbox-inner",
    "metadata", "maintenance", "mbox", "ambox", "imbox", "tmbox", "fmbox", "ombox", "cmbox",
    "warning", "error", "alert", "caution", "info", "toc", "footer", "header", "banner", "ad",
    "ads", "social", "share", "login", "signup",
]
LAYOUT_ROLES = ["presentation", "none", "navigation"]
SHADOW_ROLES = ["navigation", "banner", "contentinfo"]
SHADOW_TAGS = ["nav", "header", "footer", "aside"]

MIN_TABLE_TEXT = 15
MAX_EMPTY_SHARE = 0.6
MAX_LINK_SHARE = 0.8

# Elements are numbered as they open. What opens inside an element follows it without a gap, so
# "all rows of a table, nested ones included" is one range of row numbers, and so for cells.
_TABLE = (
    T.StructType()
    .add("start", "integer")
    .add("shadowed", "boolean")
    .add("shaped", "boolean")
    .add("row_from", "integer")
    .add("row_to", "integer")
    .add("cell_from", "integer")
    .add("cell_to", "integer")
)
_ROW = T.StructType().add("cell_from", "integer").add("cell_to", "integer")
_CELL = T.StructType().add("start", "integer").add("stop", "integer").add("direct", "boolean")
SPANS = (
    T.StructType().add("tables", T.ArrayType(_TABLE)).add("rows", T.ArrayType(_ROW)).add("cells", T.ArrayType(_CELL))
)
_VOID = set(VOID)
_BLOCK = set(_BLOCKS) - {"caption", "head"}
_RANK = {"td": 1, "th": 1, "caption": 1, "tr": 2, "thead": 3, "tbody": 3, "tfoot": 3, "table": 4}
_SECTIONS = ("thead", "tbody", "tfoot")


def table_spans(codes: list[str]) -> dict:
    """Tables, rows and cells of one page from its tag names (``name``, ``/name``, ``name!`` when ill-famed).

    Every element is emitted once, in the order of opening, with the range of what opened inside it:
    rows and cells of a table, cells of a row, tags of a cell. A cell is direct when its parent is a
    row. A table also tells whether an ancestor marks it as page furniture, and whether it is shaped
    like data: two rows or more, and not all of them with a single direct cell.
    """
    stack: list[tuple[str, bool, dict | None]] = []
    opened: Counter = Counter()  # how many elements of a name are on the stack
    tables: list[dict] = []
    rows: list[dict] = []
    cells: list[dict] = []
    walls: list[tuple[str, int]] = []  # open main, article and body elements with their place on the stack
    marks: list[int] = []  # places on the stack of open elements that mark page furniture

    def end(at: int, item: dict | None) -> None:
        if item is None:
            return
        if "stop" in item:
            item["stop"] = at
            return
        item["cell_to"] = len(cells)
        if "row_to" in item:
            item["row_to"] = len(rows)

    def close(names, at: int, barrier) -> None:
        if not any(opened[n] for n in names):
            return
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in names:
                for tag, _, item in stack[k:]:
                    opened[tag] -= 1
                    end(at, item)
                del stack[k:]
                while walls and walls[-1][1] >= k:
                    walls.pop()
                while marks and marks[-1] >= k:
                    marks.pop()
                return
            if barrier(stack[k][0]):
                return

    for at, code in enumerate(codes):
        name = code.rstrip("!")
        if not name or name in _VOID:
            continue
        if name[0] == "/":
            rank = _RANK.get(name[1:], 0)
            close((name[1:],), at, lambda n: _RANK.get(n, 0) > rank)
            continue
        if name in _BLOCK:
            close(("p",), at, lambda n: n in _BLOCK)
        item: dict | None = None
        if name in ("td", "th"):
            close(("td", "th"), at, lambda n: _RANK.get(n, 0) > 1)
            parent = stack[-1][2] if stack and stack[-1][0] == "tr" else None
            item = {"start": at, "stop": len(codes), "direct": parent is not None}
            cells.append(item)
            if parent is not None:
                parent["own"] += 1
        elif name == "tr":
            close(("tr",), at, lambda n: _RANK.get(n, 0) > 2)
            item = {"cell_from": len(cells), "cell_to": -1, "own": 0}
            rows.append(item)
        elif name in _SECTIONS:
            close(_SECTIONS, at, lambda n: n == "table")
        elif name == "li":
            close(("li",), at, lambda n: n in ("ul", "ol", "menu", "dir") or n in _RANK)
        elif name == "table":
            # looking outwards, main and article end the search before, body after they are looked at
            tag, wall = walls[-1] if walls else ("", -1)
            shadowed = bool(marks) and (marks[-1] >= wall if tag == "body" else marks[-1] > wall)
            item = {"start": at, "shadowed": shadowed, "row_from": len(rows), "row_to": -1, "cell_from": len(cells), "cell_to": -1}
            tables.append(item)
        bad = code.endswith("!")
        if bad:
            marks.append(len(stack))
        if name in ("main", "article", "body"):
            walls.append((name, len(stack)))
        stack.append((name, bad, item))
        opened[name] += 1
    for _, _, item in stack:
        end(len(codes), item)
    filled = [0, *accumulate(r["own"] > 0 for r in rows)]
    single = [0, *accumulate(r["own"] == 1 for r in rows)]
    for t in tables:
        some, ones = (x[t["row_to"]] - x[t["row_from"]] for x in (filled, single))
        t["shaped"] = t["row_to"] - t["row_from"] >= 2 and 0 < some and ones < some
    return {"tables": tables, "rows": rows, "cells": cells}


def _span_arrays(codes: pa.Array) -> pa.Array:
    out = [None if c is None else table_spans(c.split(" ")) for c in codes.to_pylist()]
    return pa.array(out, type=to_arrow_type(SPANS))


@per_context
def _spans_function():
    # Spark 4.1 fails to lift a deterministic Python function out of an expression when its
    # argument holds nested lambdas, and would copy it into filters pushed below. Both end here.
    return F.arrow_udf(_span_arrays, SPANS).asNondeterministic()


def _words(tag: Column) -> Column:
    empty = F.lit("")
    return word_tokens(
        F.concat_ws(" ", F.coalesce(attribute(tag, "id"), empty), F.coalesce(attribute(tag, "class"), empty))
    )


def ignored_words(tag: Column) -> Column:
    """True where id or class words of a tag are on the ignore list."""
    return F.arrays_overlap(_words(tag), F.array(*[F.lit(w) for w in IGNORED_WORDS]))


def shadows(tag: Column, name: Column) -> Column:
    """True where an element marks everything below it as page furniture."""
    return name.isin(SHADOW_TAGS) | (
        tag.rlike(r"(?i)[\s/\"'](?:id|class|role)[\s=]")
        & (F.coalesce(F.lower(attribute(tag, "role")).isin(SHADOW_ROLES), F.lit(False)) | ignored_words(tag))
    )


def tag_pieces(mk: Column) -> Column:
    """The page cut before every tag: each piece but the first starts with one tag."""
    return split_at(mk, rf"<(/?[a-zA-Z]{_REST}>)", after="<$1")


def tag_name(piece: Column) -> Column:
    """``name`` or ``/name`` in lower case, ``''`` for a piece without a tag."""
    return F.lower(F.regexp_extract(piece, r"^<(/?[a-zA-Z][^\s/>]*)", 1))


def has_table(mk: Column) -> Column:
    return mk.rlike(r"(?i)<table[\s/>]")


def table_pieces(mk: Column) -> Column:
    """:func:`tag_pieces` of pages with a table, NULL otherwise."""
    return F.when(has_table(mk), tag_pieces(mk))


def spans(pieces: Column) -> Column:
    """Table, row and cell ranges over :func:`table_pieces`, NULL without a table."""
    def code(piece: Column) -> Column:
        name = tag_name(piece)
        opens = ~name.startswith("/") & (name != "")
        return F.when(opens & shadows(piece, name), F.concat(name, F.lit("!"))).otherwise(name)

    return _spans_function()(F.array_join(F.transform(pieces, code), " "))


def _measured(pieces: Column, cells: Column) -> Column:
    """Text, linked length and parentage of every cell, each read once."""
    def cell(c: Column) -> Column:
        fragment = F.array_join(F.slice(pieces, c["start"] + 1, c["stop"] - c["start"]), "")

        def measure(html: Column) -> Column:
            anchors = F.regexp_extract_all(html, F.lit(_ANCHOR), F.lit(0))
            linked = F.aggregate(
                F.filter(anchors, lambda a: attribute(a, "href").isNotNull()),
                F.lit(0),
                lambda n, a: n + F.length(inner_text(a)),
            )
            return F.struct(
                inner_text(html).alias("text"),
                F.when(F.contains(html, F.lit("<a")) | F.contains(html, F.lit("<A")), linked)
                .otherwise(F.lit(0))
                .alias("linked"),
                c["direct"].alias("direct"),
            )

        return bind(fragment, measure)

    return F.transform(cells, cell)


def _range(items: Column, start: Column, stop: Column) -> Column:
    return F.slice(items, start + 1, stop - start)


def _is_data(tag: Column, table: Column, cells: Column) -> Column:
    zero = F.lit(0)
    start = F.struct(zero.alias("n"), zero.alias("empty"), zero.alias("total"), zero.alias("linked"))

    def add(s: Column, c: Column) -> Column:
        return F.struct(
            (s["n"] + 1).alias("n"),
            (s["empty"] + F.when(c["text"] == "", 1).otherwise(0)).alias("empty"),
            (s["total"] + F.length(c["text"])).alias("total"),
            (s["linked"] + c["linked"]).alias("linked"),
        )

    def filled(s: Column) -> Column:
        return (
            (s["total"] >= MIN_TABLE_TEXT)
            & (s["empty"] / s["n"] <= MAX_EMPTY_SHARE)
            & (s["linked"] <= MAX_LINK_SHARE * s["total"])
        )

    own = F.filter(_range(cells, table["cell_from"], table["cell_to"]), lambda c: c["direct"])
    accepted = contains_any(F.lower(F.coalesce(attribute(tag, "class"), F.lit(""))), DATA_CLASSES)
    layout = F.coalesce(F.lower(attribute(tag, "role")).isin(LAYOUT_ROLES), F.lit(False))
    judged = ~layout & ~ignored_words(tag) & ~table["shadowed"] & bind(F.aggregate(own, start, add), filled)
    return table["shaped"] & (accepted | judged)


def tables(pieces: Column, ranges: Column) -> Column:
    """``struct<texts,rows,tables>``: cell texts once, rows as ranges of cells, tables as ranges of rows with their verdict.

    Linear in the page, however deep tables nest; :func:`chosen_tables` writes the rows out.
    """
    def judged(cells: Column) -> Column:
        return F.struct(
            F.transform(cells, lambda c: c["text"]).alias("texts"),
            ranges["rows"].alias("rows"),
            F.transform(
                ranges["tables"],
                lambda t: F.struct(
                    _is_data(F.get(pieces, t["start"]), t, cells).alias("is_data"),
                    t["row_from"].alias("row_from"),
                    t["row_to"].alias("row_to"),
                ),
            ).alias("tables"),
        )

    return F.when(ranges.isNotNull(), bind(_measured(pieces, ranges["cells"]), judged))


def chosen_tables(judged: Column, keep_all: Column) -> Column:
    """Distinct non-empty tables by content, in order: all where ``keep_all``, else data tables only.

    Rows and cells of nested tables show in every outer one too. Empty cells and rows are dropped.
    """
    def packed(t: Column) -> Column:
        rows = F.transform(
            _range(judged["rows"], t["row_from"], t["row_to"]),
            lambda r: F.array_join(F.filter(_range(judged["texts"], r["cell_from"], r["cell_to"]), lambda x: x != ""), UNIT),
        )
        return F.array_join(F.filter(rows, lambda x: x != ""), RECORD)

    kept = F.filter(judged["tables"], lambda t: keep_all | t["is_data"])
    found = F.array_distinct(F.filter(F.transform(kept, packed), lambda t: t != ""))
    return unpack(F.coalesce(found, F.array().cast("array<string>")))


def unpack(packed: Column) -> Column:
    """``array<string>`` of packed tables to ``array<array<array<string>>>``."""
    return F.transform(packed, lambda t: F.transform(F.split(t, RECORD), lambda r: F.split(r, UNIT)))
