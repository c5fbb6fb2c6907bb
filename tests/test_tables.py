import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from webstrata.functions import tables as B
from webstrata.operators import nodes as N
from webstrata.operators import pages as P
from webstrata.operators import tables as T

BODY = "<tr><th>Header 1</th><th>Header 2</th></tr><tr><td>Cell 1a</td><td>Cell 1b</td></tr><tr><td>Cell 2a</td><td>Cell 2b</td></tr>"
ROWS = [["Header 1", "Header 2"], ["Cell 1a", "Cell 1b"], ["Cell 2a", "Cell 2b"]]
NARROW = "<tr><td>only one column here</td></tr>" * 3


def accepted(pages_of, html):
    return P.parse(pages_of(html), ["page_id"]).first().tables


@pytest.mark.parametrize(
    ("html", "count"),
    [
        (f'<table class="wikitable"><thead>{BODY}</table>', 1),
        (f"<table>{BODY}</table>", 1),
        ("<table><tr><td>one row with text</td><td>two</td></tr></table>", 0),
        (f"<table class=wikitable>{NARROW}</table>", 0),
        ("<table><tr></tr><tr></tr></table>", 0),
        (f"<table class=metadata role=presentation>{BODY}</table>", 1),
        (f"<table role=None>{BODY}</table>", 0),
        (f"<table id='top_MENU-x'>{BODY}</table>", 0),
        (f"<table class='vertical navbox-inner'>{BODY}</table>", 0),
        (f"<table class='menus'>{BODY}</table>", 1),
        (f"<aside><div>{BODY and ''}<table>{BODY}</table></div></aside>", 0),
        (f"<nav></nav><table>{BODY}</table>", 1),
        (f"<nav><b></nav><table>{BODY}</table>", 1),
        (f"<div role=Banner><table>{BODY}</table></div>", 0),
        (f"<div class='my ad'><article><table>{BODY}</table></article></div>", 1),
        (f"<article class=ad><table>{BODY}</table></article>", 1),
        (f"<html class=error><body><table>{BODY}</table></body></html>", 1),
        (f"<body class=error><table>{BODY}</table></body>", 0),
        (f"<p class=info>x<table>{BODY}</table>", 1),
        ("<table><tr><td>a<td>b<tr><td>c<td>d</table>", 0),
        ("<table><tr><td>long enough text here<td><td><tr><td><td><td></table>", 0),
        ("<table><tr><td><a href=x>long enough link</a><td>x<tr><td><a href=y>another long link</a><td>y</table>", 0),
        ("<table><tr><td><a>long enough link</a><td>x<tr><td><a>another long link</a><td>y</table>", 1),
        (f"<table>{BODY}</table><table>{BODY}</table>", 1),
    ],
)
def test_data_table_rules(pages_of, html, count):
    assert len(accepted(pages_of, html)) == count


def test_rows_drop_empty_cells_and_rows(pages_of):
    html = "<table class=grid><tr><td> <td>a b<td>c</tr><tr><td></tr><tr><th>d <i>e</i><td>&nbsp;<td>f</table>"
    assert accepted(pages_of, html) == [[["a b", "c"], ["d e", "f"]]]


def test_nested_tables_show_in_both(pages_of):
    inner = "<table class=data><tr><td>in1<td>in2<tr><td>in3<td>in4</table>"
    html = f"<table class=data><tr><td>outer {inner} tail<td>second<tr><td>r2a<td>r2b</table>"
    small = [["in1", "in2"], ["in3", "in4"]]
    outer = [["outer in1in2in3in4 tail", "in1", "in2", "in3", "in4", "second"], *small, ["r2a", "r2b"]]
    assert accepted(pages_of, html) == [outer, small]


def test_prioritised_tables_skip_the_rules(pages_of):
    flags = F.struct(
        F.lit(True).alias("prioritize_tables"), F.lit(True).alias("prioritize_headings"), F.lit(True).alias("use_main_text")
    )
    pages = pages_of("<nav><table><tr><td>x</table><h4>deep</h4></nav>").withColumn("flags", flags)
    row = P.parse(pages, ["page_id"], flags="flags").first()
    assert (row.tables, row.headings) == ([[["x"]]], ["deep"])


def random_page(rng):
    parts, stack = [], []
    for _ in range(rng.randint(5, 40)):
        move = rng.random()
        if move < 0.45:
            tag = rng.choice(["div", "nav", "main", "article", "aside", "section"])
            attrs = rng.choice(["", "", " class='x menu'", " id=ok", " role=banner", " class=\"a>b\""])
            parts.append(f"<{tag}{attrs}>")
            stack.append(tag)
        elif move < 0.7 and stack:
            parts.append(f"</{stack.pop()}>")
        elif move < 0.8:
            parts.append(rng.choice(["<b>", "text", "<br>", "<!-- <nav> -->"]))
        else:
            parts.append(f"<table>{BODY}</table>")
    return "<body>" + "".join(parts) + "".join(f"</{t}>" for t in reversed(stack)) + "</body>"


def test_ancestor_verdicts_agree_with_the_relational_form(pages_of):
    rng = random.Random(7)
    pages = pages_of(*[random_page(rng) for _ in range(120)])
    helper = (
        P.with_markup(pages)
        .withColumn("spans", B.spans(F.col("pieces")))
        .select("page_id", F.inline("spans.tables"))
        .select("page_id", F.col("start").cast("bigint").alias("pre"), "shadowed")
    )
    relational = N.shadowed_tables(N.page_nodes(pages)).select("page_id", "pre", "shadowed")
    a, b = (sorted(map(tuple, df.collect())) for df in (helper, relational))
    assert len(a) > 100 and a == b
    assert {x[2] for x in a} == {True, False}


def test_containment(pages_of):
    nodes = N.page_nodes(pages_of("<div><p>a<p>b</div><p>c", "<article><ul><li>x<li>y</ul></article><li>z"))
    assert N.contained(nodes, "p", "div").count() == 2
    assert N.contained(nodes, "li", "article").count() == 2


def test_containment_takes_no_pairs(pages_of):
    """20 000 tables inside 20 000 marked elements: pairs would be 2 * 10^8."""
    n = 20_000
    html = "<body>" + "<div class=ad>" * n + "<table><tr><td>x</table>" * n + "</div>" * n + "<table></table></body>"
    nodes = N.page_nodes(pages_of(html)).cache()
    found = N.shadowed_tables(nodes)
    assert found.where("shadowed").count() == n and found.count() == n + 1
    assert N.contained(nodes, "table", "div").count() == n
    plan = found._jdf.queryExecution().toString() + N.contained(nodes, "table", "div")._jdf.queryExecution().toString()
    assert "Join" not in plan


def result_row(spark, tables):
    return spark.createDataFrame([(1, tables)], "page_id bigint, tables array<array<array<string>>>")


def test_flat_rows_and_cells(spark):
    df = result_row(spark, [[["a", " b "], [], ["c"]], [], [[None, "d", "e"]]])
    rows = T.table_rows(df, ["page_id"])
    assert [tuple(r) for r in rows.orderBy("table_index", "row_index").collect()] == [
        (1, 1, 1, ["a", "b"]), (1, 1, 3, ["c"]), (1, 3, 1, ["", "d", "e"]),
    ]
    assert T.table_cells(rows, ["page_id"]).count() == 6
    wide = T.wide_rows(rows, ["page_id"]).orderBy("table_index", "row_index")
    assert wide.columns == ["page_id", "table_index", "row_index", "col_1", "col_2", "col_3"]
    assert tuple(wide.first())[3:] == ("a", "b", None)
    with pytest.raises(PySparkException):
        T.wide_rows(rows, ["page_id"], 2).collect()


def test_ancestor_marks_behind_a_quoted_bracket(pages_of):
    table = "<table><tr><th>Name</th><th>Value</th></tr><tr><td>alpha beta</td><td>gamma delta</td></tr></table>"
    html = f'<html><body><div title="a > b" class="sidebar">{table}</div></body></html>'
    assert P.parse(pages_of(html), ["page_id"]).first().tables == []
    assert len(P.parse(pages_of(html.replace("sidebar", "plain")), ["page_id"]).first().tables) == 1


def test_many_unclosed_tags_take_linear_time():
    import time

    start = time.process_time()
    codes = ["p"] + ["b"] * 20000 + ["div", "/span"] * 20000 + ["table", "tr", "td", "/table"]
    assert [t["row_to"] - t["row_from"] for t in B.table_spans(codes)["tables"]] == [1]
    assert time.process_time() - start < 5


def nested(depth, before=""):
    return before + "<table><tr><td>left<td>right cell" * depth + "</table>" * depth


def test_deeply_nested_tables_are_judged_in_linear_space(pages_of):
    import time

    pages = pages_of(nested(800), nested(2))
    start = time.process_time()
    judged = P.extract(pages, ["page_id"]).orderBy("page_id").select("judged_tables").collect()
    assert time.process_time() - start < 5
    deep, flat = (r.judged_tables for r in judged)
    assert (len(deep.tables), len(deep.rows), len(deep.texts)) == (800, 800, 1600)
    assert [(t.row_from, t.row_to, t.is_data) for t in flat.tables] == [(0, 2, True), (1, 2, False)]
    assert [t.is_data for t in deep.tables] == [True] * 799 + [False]
    assert len(accepted(pages_of, nested(40))) == 39


def test_tags_are_dealt_anew(spark, pages_of):
    """A partition of pages has many times its bytes in tags: they are not sorted where the pages were grouped."""
    from webstrata.session import spread

    whole = pages_of("<div><p>a</div>", "<nav><table><tr><td>x</table></nav>").groupBy("page_id").agg(F.first("html").alias("html"))
    nodes = N.page_nodes(whole)
    assert nodes.rdd.getNumPartitions() == spread(spark) >= 4
    assert [r.shadowed for r in N.shadowed_tables(nodes).collect()] == [True]
