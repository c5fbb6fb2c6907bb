import json

import pytest
from pyspark.sql import functions as F

from webstrata.operators import analysis as A
from webstrata.operators import strategy as S

FULL = {
    "website_type": "Wiki", "framework": "Unknown", "content_confidence": 0.9, "table_confidence": 0.5,
    "requires_javascript": False, "recommended_strategy": "wiki", "warnings": [], "overall_score": 90,
    "compatibility_grade": "A", "strengths": ["s"], "limitations": ["l"], "recommendation": "r", "summary": "sum",
}


@pytest.fixture
def read(spark):
    def parse(content):
        text = content if isinstance(content, str) or content is None else json.dumps(content)
        return A.parse_responses(spark.createDataFrame([("u", text)], "url string, content string")).first()

    return parse


def test_complete_answer(read):
    row = read(FULL)
    assert row.has_analysis and row.website_type == "Wiki" and row.overall_score == 90
    assert row.warnings == [] and row.main_content_selector == "body" and row.rendering_type == "Mostly Static"


@pytest.mark.parametrize("wrap", ["```json\n%s\n```", " ```%s``` ", "%s"])
def test_fences(read, wrap):
    assert read(wrap % json.dumps(FULL)).website_type == "Wiki"


@pytest.mark.parametrize("text", ["{", "no json", json.dumps(FULL) + "]", json.dumps(FULL) + " trailing", None, ""])
def test_unreadable_answers_fall_back(read, text):
    row = read(text)
    assert row.has_analysis and row.overall_score == 50 and row.compatibility_grade == "C"
    assert row.warnings[0].startswith("AI Analysis notice: ")
    assert row.recommended_strategy == "Standard HTML extraction (Fallback)"


def test_bad_number_falls_back(read):
    assert "could not convert string to float: 'high'" in read(FULL | {"content_confidence": "high"}).summary


@pytest.mark.parametrize(
    "content",
    [[FULL], "3", "null", FULL | {"warnings": None}, FULL | {"strengths": None}, FULL | {"limitations": 4},
     FULL | {"table_confidence": None}, FULL | {"warnings": [1], "framework": "React"}],
)
def test_unusable_shapes_leave_no_analysis(read, content):
    row = read(content)
    assert row.has_analysis is False and row.website_type is None


def test_numbers_as_text_and_truthy_text(read):
    row = read(FULL | {"content_confidence": "0.9", "requires_javascript": "false", "rendering_type": ""})
    assert row.content_confidence == 0.9 and row.requires_javascript is True
    assert row.rendering_type == "Dynamic SPA" and row.javascript_complexity == "High"


@pytest.mark.parametrize(
    ("given", "expected"),
    [(None, 84), (0, 84), (-5, 84), ("77", 77), ("90.5", 84), (90.9, 90), (250, 250), (True, 1), ([1], 84)],
)
def test_score(read, given, expected):
    assert read(FULL | {"overall_score": given}).overall_score == expected


def test_score_is_clamped(read):
    low = read({"content_confidence": 0.0, "table_confidence": 0.0})
    assert (low.overall_score, low.compatibility_grade) == (35, "D")
    assert read({"content_confidence": 1.0, "table_confidence": 1.0}).overall_score == 98


@pytest.mark.parametrize(("grade", "expected"), [(" b ", "B"), ("E", "A"), (None, "A")])
def test_grade(read, grade, expected):
    assert read(FULL | {"compatibility_grade": grade}).compatibility_grade == expected


def test_warnings_in_order(read):
    row = read({"framework": "WordPress", "content_confidence": 0.1})
    assert row.warnings == [
        "This site appears to use WordPress.", "Content extraction confidence is low.", "No semantic HTML tables detected.",
    ]
    known = ["wordpress plugin", "Low CONFIDENCE", "table layout"]
    assert read({"framework": "WordPress", "content_confidence": 0.1, "warnings": known}).warnings == known


def test_defaults_and_null_texts(read):
    row = read({"framework": None, "website_type": None, "content_confidence": 0.8, "table_confidence": 0.6, "strengths": ["", None, 3]})
    assert (row.framework, row.website_type, row.summary) == ("None", "None", "")
    assert row.warnings[0] == "This site appears to use None." and row.strengths == ["3"]
    assert row.recommended_strategy == "Standard HTML parsing"
    assert row.recommendation == "Execute 'Standard HTML parsing' extraction for optimal performance."
    assert row.limitations == ["No critical scraping limitations identified."]
    assert read({"scrape_strategy": "alias"}).recommended_strategy == "alias"


def test_response_choice(spark):
    rows = [
        ("a", 1, 500, "x"), ("a", 2, 200, "second"), ("a", 3, 200, "third"),
        ("b", 1, 200, ""), ("b", 3, 200, "late"), ("c", 1, 200, "first"), ("c", 2, 200, "other"),
    ]
    df = spark.createDataFrame(rows, "url string, attempt int, status_code int, content string")
    assert {r.url: r.content for r in A.select_responses(df).collect()} == {"a": "second", "b": "late", "c": "first"}
    two = {r.url: r.content for r in A.select_responses(df, attempts=2).collect()}
    assert two == {"a": "second", "b": None, "c": "first"}


def test_prompt(pages_of):
    prompt = A.prompts(pages_of("<TITLE>\n My page </TITLE>" + "z" * 9000)).first().prompt
    assert prompt.startswith("Target URL: https://example.org/0\nPage Title: My page\n\nHTML Snapshot:\n<TITLE>")
    assert prompt.count("z") >= 9000 and prompt.endswith("}")
    cut = A.prompts(pages_of("z" * 9000), chars=8000).first()
    assert cut.is_cut and cut.prompt.count("z") < 8000 + 10
    assert "Page Title: N/A" in A.prompts(pages_of("<p>")).first().prompt


def test_severity_and_bands(spark):
    df = spark.createDataFrame([(1, ["Angular app error", "LOGIN needed", "slow"]), (2, [])], "id int, warnings array<string>")
    rows = A.warning_severity(df, ["id"]).orderBy("id", "pos").collect()
    assert [r.severity for r in rows] == ["info", "danger", "warning", "success"]
    bands = spark.createDataFrame([(0.895,), (0.894,), (0.7,), (0.1,), (None,)], "c double")
    assert [r[0] for r in bands.select(A.band(A.percent(F.col("c")))).collect()] == ["green", "yellow", "yellow", "red", "red"]


def strategy(spark, rules=(), **fields):
    row = {
        "has_analysis": True, "website_type": "", "framework": "Unknown", "table_confidence": 0.1, "requires_javascript": False,
        "recommended_strategy": "", "number_of_tables": 0, "framework_hints": [],
    } | fields
    schema = (
        "has_analysis boolean, website_type string, framework string, table_confidence double, requires_javascript boolean, "
        "recommended_strategy string, number_of_tables bigint, framework_hints array<string>"
    )
    return S.assign_strategy(spark.createDataFrame([tuple(row.values())], schema), rules).first().strategy


def test_wiki_and_shop(spark):
    wiki = strategy(spark, website_type="Wiki", framework="MediaWiki", recommended_strategy="wiki")
    assert (wiki.scraping_mode, wiki.requires_rendered, wiki.use_main_text) == ("wiki", False, True)
    shop = strategy(
        spark, website_type="E-commerce", framework="React", table_confidence=0.9, requires_javascript=True, recommended_strategy="ecommerce"
    )
    assert (shop.scraping_mode, shop.requires_rendered, shop.prioritize_tables) == ("ecommerce", True, True)


@pytest.mark.parametrize(
    ("fields", "mode"),
    [
        ({"website_type": "Workshop"}, "ecommerce"),
        ({"website_type": "Newspaper"}, "news"),
        ({"website_type": "Stable"}, "table_heavy"),
        ({"website_type": "x", "recommended_strategy": "Q&A"}, "forum"),
        ({"website_type": "Docs blog"}, "documentation"),
        ({"website_type": "x", "number_of_tables": 4}, "table_heavy"),
        ({"website_type": "x", "number_of_tables": 3}, "generic"),
        ({"website_type": "x", "number_of_tables": 3, "recommended_strategy": "tables"}, "table_heavy"),
        ({"website_type": " Store ", "number_of_tables": 9}, "ecommerce"),
        ({"website_type": "catalog store"}, "product_catalog"),
    ],
)
def test_modes(spark, fields, mode):
    assert strategy(spark, **fields).scraping_mode == mode


def test_hints_rules_and_missing_analysis(spark):
    assert strategy(spark, framework_hints=["jQuery", "Vue.js"]).requires_rendered is True
    rules = [F.lit("nonsense"), F.when(F.col("website_type") == "x", "forum")]
    assert strategy(spark, rules, website_type="x").scraping_mode == "forum"
    assert strategy(spark, rules, website_type="blog").scraping_mode == "blog"
    assert strategy(spark, has_analysis=False) is None


def test_failing_rules_are_skipped_and_counted(spark):
    def never(rows):
        raise RuntimeError("broken rule")

    def short(rows):
        return rows["website_type"].iloc[:0]

    grades = {"x": "forum", "y": "nonsense"}
    rules = [never, F.lit(None).cast("string"), lambda rows: rows["website_type"].map(grades.__getitem__), short, F.when(F.col("website_type") == "z", "news")]
    base = {"framework": None, "framework_hints": [], "requires_javascript": False, "recommended_strategy": "", "table_confidence": 0.0, "number_of_tables": 0}
    schema = "website_type string, has_analysis boolean, framework string, framework_hints array<string>, requires_javascript boolean, recommended_strategy string, table_confidence double, number_of_tables bigint"
    kinds = ["x", "y", "z", "blog"] * 25 + [None]
    rows = [(k, k is not None, *base.values()) for k in kinds]
    found = S.assign_strategy(spark.createDataFrame(rows, schema).repartition(3), rules).collect()
    got = {(r.website_type, r.strategy.scraping_mode if r.strategy else None, r.rule_failures) for r in found}
    assert len(found) == 101
    assert got == {("x", "forum", 1), ("y", "generic", 2), ("z", "news", 3), ("blog", "blog", 3), (None, None, 0)}


def test_a_filter_on_the_analysis_reads_no_answer_twice(spark):
    answers = spark.createDataFrame([(1, '{"warnings": []}'), (2, "[1]")], "id int, content string").repartition(2)
    rows = A.parse_responses(answers).where("has_analysis")
    assert [r.id for r in rows.collect()] == [1]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(A.NO_RESPONSE) == 1


def test_customers_are_dealt_to_all_tasks(spark, tmp_path):
    from workloads import inputs as D

    made = spark.createDataFrame([(k, f"c{k}") for k in range(40)], "c_custkey bigint, c_name string")
    made.coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    assert D.customer_responses(spark, str(tmp_path)).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
