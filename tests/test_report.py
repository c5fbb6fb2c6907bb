import datetime

from pyspark.sql import functions as F

from webstrata.operators import corpus, report, results

SCHEMA = (
    "page_id bigint, url string, title string, clean_text string, headings array<string>, paragraphs array<string>, "
    "links array<struct<text:string,href:string>>, tables array<array<array<string>>>, scrape_method string"
)


def page(spark, **fields):
    row = {
        "page_id": 1, "url": "https://e.org/?a=1&b=2", "title": "", "clean_text": "", "headings": [], "paragraphs": [],
        "links": [], "tables": [], "scrape_method": None,
    } | fields
    return spark.createDataFrame([tuple(row.values())], SCHEMA)


def pairs(df):
    return {r[1]: r[2] for r in df.collect()}


def test_merge_prefers_extracted_text(spark):
    schema = "parsed_title string, paragraphs array<string>, extracted struct<title:string,text:string>"
    rows = [("Real", ["a", "b"], ("Untitled", "main")), ("Real", ["a", "b"], None), (None, [], ("", ""))]
    merged = results.merge(spark.createDataFrame(rows, schema)).collect()
    assert [(r.title, r.clean_text, r.content_length) for r in merged] == [("Untitled", "main", 4), ("Real", "a b", 3), ("", "", 0)]


def test_decision_steps(spark):
    schema = (
        "s struct<scraping_mode:string,use_main_text:boolean,prioritize_tables:boolean,prioritize_headings:boolean,"
        "prioritize_links:boolean>, t string, m string"
    )
    rows = [(("wiki", True, True, True, True), "Wiki", "Playwright"), (("generic", True, False, False, False), None, "Unknown"), (None, "x", "Requests")]
    df = spark.createDataFrame(rows, schema)
    steps = [r[0] for r in df.select(results.decision_steps(F.col("s"), F.col("t"), F.col("m"))).collect()]
    assert [s.title for s in steps[0]] == ["Website classified as Wiki", "Playwright selected", "Trafilatura enabled", "Tables prioritized"]
    assert [s.title for s in steps[1]] == ["Website classified as General", "Requests selected", "Trafilatura enabled"]
    assert steps[2] == []


def test_summary(spark):
    df = page(spark, clean_text="abc", headings=["h"]).withColumn("content_length", F.length("clean_text"))
    row = results.page_summary(df, ["page_id"]).first()
    assert (row.title, row.content_length, row.headings_count, row.tables_count) == ("N/A", 3, 1, 0)


def test_statistics_and_metadata(spark):
    stats = pairs(report.statistics(page(spark, headings=["a", ""], tables=[[["x"]], []], paragraphs=["p"]), ["page_id"]))
    assert stats == {
        "Total Content Length (characters)": 20, "Number of Headings": 1, "Number of Paragraphs": 1, "Number of Links": 0, "Number of Tables": 1,
    }
    at = F.lit(datetime.datetime(2024, 5, 6, 7, 8, 9))
    meta = pairs(report.metadata(page(spark, title="A & <b>"), ["page_id"], at))
    assert meta["Website Title:"] == "A &amp; &lt;b&gt;" and meta["Source URL:"].endswith("a=1&amp;b=2")
    assert (meta["Generated Date:"], meta["Scrape Method:"]) == ("2024-05-06", "Unknown")


def test_analysis_rows(spark):
    schema = (
        "page_id bigint, has_analysis boolean, website_type string, framework string, content_confidence double, table_confidence double, "
        "requires_javascript boolean, recommended_strategy string, summary string, warnings array<string>"
    )
    rows = [(1, True, "", "R&D", 0.29, 0.999, True, "s", "", ["a<b", "c"]), (2, False, None, None, None, None, None, None, None, None)]
    got = report.analysis_rows(spark.createDataFrame(rows, schema), ["page_id"])
    assert {r.page_id for r in got.collect()} == {1}
    values = pairs(got)
    assert values["Content Confidence"] == "28%" and values["Table Confidence"] == "99%"
    assert values["Website Type"] == "Unknown" and values["AI Warnings & Hazards"] == "• a&lt;b<br/>• c"


def test_previews(spark):
    df = spark.createDataFrame([("x" * 1001,), ("short",), ("",)], "t string")
    rows = df.select(report.preview(F.col("t"), 1000).alias("a"), report.ui_preview(F.col("t"), 300).alias("b"), report.preview(F.col("t")).alias("c")).collect()
    assert rows[0].a == "x" * 1000 + "..." and rows[0].b == "x" * 300 + "..."
    assert rows[0].c == "x" * 1001
    assert (rows[1].a, rows[1].b) == ("short", "short...")
    assert (rows[2].a, rows[2].b) == ("No content available", "No preview available")


def test_headings_tell_which_are_shown(spark):
    many = page(spark, headings=[str(i) for i in range(25)])
    assert [r.shown for r in report.headings(many, ["page_id"], limit=20).orderBy("pos").collect()] == [True] * 20 + [False] * 5
    assert all(r.shown for r in report.headings(many, ["page_id"]).collect())


def test_report_table_layout(spark):
    table = [["a", "", "x" * 250], [" ", None], ["b", ""], ["c"]]
    many = [[[str(i)]] for i in range(7)]
    laid = report.report_tables(page(spark, tables=[table, [[""]], *many]), ["page_id"], limit=5, chars=200)
    lines = report.table_lines(laid, ["page_id"]).where("table_index = 1").orderBy("row_index").collect()
    assert [len(r.cells) for r in lines] == [2, 2, 2]
    assert lines[0].cells[1] == "x" * 197 + "..."
    assert [(r.is_header, r.spans_row) for r in lines] == [(True, False), (False, True), (False, True)]
    assert {r.table_index: r.shown for r in laid.collect()} == {k: k <= 5 for k in range(1, 9)}
    wide = [[str(i) * 40 for i in range(10)]]
    widths = [r.width for r in report.table_widths(report.report_tables(page(spark, tables=[wide]), ["page_id"], columns=8), ["page_id"]).collect()]
    assert report.report_tables(page(spark, tables=[wide]), ["page_id"]).selectExpr("size(widths)").first()[0] == 10
    assert len(widths) == 8 and all(abs(w - 63.0) < 1e-9 for w in widths)
    mixed = [["&" * 10, "a"]]
    widths = report.table_widths(report.report_tables(page(spark, tables=[mixed]), ["page_id"]), ["page_id"]).orderBy("col_index").collect()
    assert [r.width for r in widths] == [180.0, 35.0]


def test_display_links(spark):
    links = [("", "/a"), ("A", " /a "), ("Z", "/a"), ("b", "/b"), ("x", " ")] + [("n", f"/{i}") for i in range(120)]
    rows = report.display_links(page(spark, links=links), ["page_id"], limit=100).orderBy("pos").collect()
    assert len(rows) == 122 and all(r.has_more for r in rows) and [r.shown for r in rows] == [True] * 100 + [False] * 22
    assert [(r.href, r.label) for r in rows[:2]] == [("/a", "A"), ("/b", "b")]
    alone = report.display_links(page(spark, links=[("", "/only")]), ["page_id"]).first()
    assert (alone.label, alone.has_more) == ("/only", False)


def test_many_links_take_little_time(spark):
    import time

    links = [(f"text {k}" if k % 3 else "", f"/{k % 40_000}") for k in range(50_000)]
    df = page(spark, links=links).cache()
    df.count()
    start = time.process_time()
    rows = report.display_links(df, ["page_id"]).collect()
    assert time.process_time() - start < 5
    first = {}
    for text, href in links:
        first[href] = first.get(href) or text
    assert [(r.href, r.label) for r in sorted(rows, key=lambda r: r.pos)] == [(h, t or h) for h, t in first.items()]


def test_latest_cached_and_missing(spark):
    history = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), ("b", 1, "x")], "url string, at int, body string")
    assert {r.url: r.body for r in results.latest_per_url(history, ["at"]).collect()} == {"a": "new", "b": "x"}
    plan = results.latest_per_url(history, ["at"])._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan
    asked = spark.createDataFrame([("a",), ("c",)], "url string")
    assert {r.url: r.body for r in results.with_cached(asked, history, ["at"]).collect()} == {"a": "new", "c": None}
    assert [r.url for r in results.not_captured(asked, history).collect()] == ["c"]


def test_rollup(spark):
    rows = [("h", "m", 10), ("h", "n", 20), ("g", "m", 30)]
    df = spark.createDataFrame(rows, "host string, mode string, content_length bigint")
    got = {(r.host, r.mode, r.level): (r.pages, r.content_length_sum) for r in corpus.corpus_rollup(df, ["host", "mode"], ["content_length"]).collect()}
    assert got[(None, None, 3)] == (3, 60) and got[("h", None, 1)] == (2, 30) and len(got) == 6
