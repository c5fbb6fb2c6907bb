"""Page analysis: prompts out, model responses in.

A response row is ``(url, attempt, status_code, content)``. Responses are read as ``VARIANT``,
so wrongly typed fields keep their loose meaning instead of turning into NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webstrata.functions.memo import per_context
from webstrata.functions.text import bind, contains_any, or_default, strip

PROMPT_RULES = """\
Task: describe how this page is built and how well it can be extracted.
- Rely on the snapshot, the title and the URL only; leave out what they do not show.
- Use "Unknown" as framework unless tags, script sources or markup prove one.
- Both confidences are numbers from 0.0 to 1.0; requires_javascript is true or false.
- overall_score is an integer from 0 to 100; compatibility_grade is A, B, C or D.
- Answer with one JSON object of the form below and nothing else, without code fences.
"""
# The keys that the response reader expects, with the kind of value each holds.
ANSWER_KEYS = {
    "website_type": "text", "framework": "text", "content_confidence": "0.0 to 1.0",
    "table_confidence": "0.0 to 1.0", "requires_javascript": "true or false",
    "recommended_strategy": "text", "warnings": "list of texts", "summary": "text",
    "overall_score": "0 to 100", "compatibility_grade": "A to D", "rendering_type": "text",
    "javascript_complexity": "text", "strengths": "list of texts", "limitations": "list of texts",
    "recommendation": "text",
}
ANSWER_FORMAT = "{" + ", ".join(f'"{key}": <{kind}>' for key, kind in ANSWER_KEYS.items()) + "}"

ANALYSIS_FIELDS = [
    "website_type", "framework", "content_confidence", "table_confidence", "requires_javascript",
    "recommended_strategy", "warnings", "summary", "main_content_selector", "overall_score",
    "compatibility_grade", "rendering_type", "javascript_complexity", "strengths", "limitations",
    "recommendation",
]

# Texts that stand in for missing answers.
DEFAULT_STRATEGY = "Standard HTML parsing"
USES_FRAMEWORK = "This site appears to use %s."
LOW_CONTENT = "Content extraction confidence is low."
NO_TABLES = "No semantic HTML tables detected."
STRENGTH_TEXTS = {
    "content": "Clean semantic HTML structure with high text readability.",
    "static": "Static page rendering accessible via high-speed HTTP requests.",
    "tables": "Structured data tables detected for extraction.",
    "none": "Standard web page structure.",
}
LIMITATION_TEXTS = {
    "script": "Requires headless browser execution for client-side JS rendering.",
    "content": "Mixed text and navigation layout may reduce extraction precision.",
    "none": "No critical scraping limitations identified.",
}
RECOMMENDATION = "Execute '%s' extraction for optimal performance."
BAD_JSON = "Failed to parse AI response as valid JSON"
BAD_NUMBER = "could not convert string to float: '%s'"
NO_RESPONSE = "No usable response after retry"
FALLBACK = {
    "website_type": "Unknown",
    "framework": "Unknown",
    "content_confidence": 0.0,
    "table_confidence": 0.0,
    "requires_javascript": False,
    "recommended_strategy": "Standard HTML extraction (Fallback)",
    "warnings": "AI Analysis notice: %s",
    "summary": "Fallback analysis generated due to AI processing failure: %s",
    "main_content_selector": "body",
    "overall_score": 50,
    "compatibility_grade": "C",
    "rendering_type": "Unknown / Fallback",
    "javascript_complexity": "Medium",
    "strengths": "Basic HTML fallback parser available.",
    "limitations": "AI architectural analysis was unavailable.",
    "recommendation": "Proceed with standard HTML extraction.",
}
# Words that grade a warning, and the text without any.
INFO_WORDS = ["appears to use", "react", "vue", "angular", "framework"]
DANGER_WORDS = ["login", "paywall", "captcha", "error", "failed"]
NO_WARNING = "No scraping obstacles or anti-scraping protections detected."


def prompts(
    pages: DataFrame, title: str | None = None, rules: str = PROMPT_RULES, chars: int | None = None
) -> DataFrame:
    """``(url, prompt, is_cut)`` for offline batch inference.

    The snapshot is the whole page, or its first ``chars`` characters for models with a small
    window; ``is_cut`` then tells the pages that are longer.
    """
    html = F.coalesce("html", F.lit(""))
    snapshot = html if chars is None else F.substring(html, 1, chars)
    found = strip(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1))
    given = F.col(title) if title else F.lit("")
    name = or_default(F.when(F.coalesce(given, F.lit("")) != "", given).otherwise(found), "N/A")
    text = F.concat(
        F.lit("Target URL: "), F.col("url"),
        F.lit("\nPage Title: "), name,
        F.lit("\n\nHTML Snapshot:\n"), snapshot,
        F.lit("\n\nInstructions:\n" + rules + "\nRequired Schema:\n" + ANSWER_FORMAT),
    )
    cut = F.lit(False) if chars is None else F.length(html) > chars
    return pages.select("url", text.alias("prompt"), cut.alias("is_cut"))


def select_responses(responses: DataFrame, attempts: int | None = None) -> DataFrame:
    """``(url, content)``: the first usable answer, NULL if none; ``attempts`` keeps later ones out.

    One hash aggregate with partial results finds the attempt of every URL on light rows; its
    content then comes by an equi join, so no answer is sorted or carried through the aggregate. Of
    answers with one attempt number the smallest by a hash of the content counts.
    """
    usable = (F.col("status_code") == 200) & (F.coalesce("content", F.lit("")) != "")
    if attempts is not None:
        usable = usable & (F.col("attempt") <= attempts)
    # attempt and hash as one number
    place = F.col("attempt").cast("decimal(38,0)") * F.lit(str(2**64)).cast("decimal(20,0)") + F.xxhash64("content").cast("decimal(20,0)")
    rows = responses.where(F.col("url").isNotNull()).select("url", "content", F.when(usable, place.cast("decimal(38,0)")).alias("place"))
    first = rows.groupBy("url").agg(F.min("place").alias("place"))
    chosen = rows.where(F.col("place").isNotNull()).join(first, ["url", "place"]).select("url", "content").dropDuplicates(["url"])
    return first.select("url").join(chosen, "url", "left")


def _unfenced(text: Column) -> Column:
    t = strip(text)
    t = F.regexp_replace(t, r"\A```json", "")
    t = F.regexp_replace(t, r"\A```", "")
    return strip(F.regexp_replace(t, r"```\z", ""))


_KEYS = [
    "recommended_strategy", "scrape_strategy", "warnings", "framework", "content_confidence",
    "table_confidence", "overall_score", "requires_javascript", "compatibility_grade",
    "rendering_type", "javascript_complexity", "strengths", "limitations", "recommendation",
    "website_type", "summary", "main_content_selector",
]


def parse_responses(responses: DataFrame, content: str = "content") -> DataFrame:
    """Replace ``content`` by the 16 analysis fields and ``has_analysis``.

    ``has_analysis`` is false where the answer is JSON of an unusable shape: the page then goes
    on without analysis and strategy. A missing answer, broken JSON or a confidence that is no
    number gives the fallback record instead.

    The steps are chained with ``bind``, so each intermediate is evaluated once per answer and
    the optimizer cannot multiply them into one another. The fields leave as a generated row: a
    later filter on one of them would else be moved below and read every answer a second time.
    """
    rest = [c for c in responses.columns if c != content]
    return responses.select(*rest, F.inline_outer(F.array(_analysis(content))))


@per_context
def _analysis(content: str) -> Column:
    read = bind(F.struct(F.col(content).alias("answer")), _read_json)
    for step in (_read_fields, _add_framework_warning, _add_confidence_warnings, _score, _conclude):
        read = bind(read, step)
    return read


def _with(row: Column, **fields: Column) -> Column:
    for name, value in fields.items():
        row = row.withField(name, value)
    return row


def _read_json(row: Column) -> Column:
    """The answer as variant, and the JSON text of every key (NULL when the key is missing)."""
    def texts(v: Column) -> Column:
        return F.struct(
            row["answer"].alias("answer"),
            v.alias("v"),
            *[F.to_json(F.try_variant_get(v, f"$.{k}", "variant")).alias(k) for k in _KEYS],
        )

    # The parser stops after the first value. Read as the first of two array elements, an answer
    # followed by anything else fails to reproduce the second.
    guard = "\u241e"
    pair = F.try_parse_json(F.concat(F.lit("["), _unfenced(row["answer"]), F.lit(f',"{guard}"]')))

    def first(p: Column) -> Column:
        whole = (F.try_variant_get(p, "$[1]", "string") == guard) & F.try_variant_get(
            p, "$[2]", "variant"
        ).isNull()
        return F.when(whole, F.try_variant_get(p, "$[0]", "variant"))

    return bind(bind(pair, first), texts)


def _said(value: Column, j: Column) -> Column:
    """Text form of any JSON value (null reads ``None``, booleans ``True``/``False``)."""
    return (
        F.when(j.startswith('"'), value)
        .when(j == "null", F.lit("None"))
        .when(j == "true", F.lit("True"))
        .when(j == "false", F.lit("False"))
        .otherwise(j)
    )


def _element_text(x: Column) -> Column:
    return F.try_variant_get(F.try_parse_json(x), "$", "string")


def _read_fields(row: Column) -> Column:
    """Typed fields with the loose reading of missing, empty and mistyped values."""
    def text(key: str) -> Column:
        return F.try_variant_get(row["v"], f"$.{key}", "string")

    def truthy(key: str) -> Column:
        j = row[key]
        blank = j.isNull() | j.isin("null", "false", '""', "[]", "{}")
        is_number = F.substring(j, 1, 1).between("-", "9")  # casting other texts costs an exception each
        return ~blank & F.coalesce(F.when(is_number, j.try_cast("double") != 0), F.lit(True))

    def string(key: str, default: str) -> Column:
        return F.when(row[key].isNull(), F.lit(default)).otherwise(_said(text(key), row[key]))

    def string_or(key: str, default: Column) -> Column:
        return F.when(truthy(key), _said(text(key), row[key])).otherwise(default)

    def number(key: str) -> Column:
        return (
            F.when(row[key].isNull(), F.lit(0.0))
            .when(row[key] == "true", F.lit(1.0))
            .when(row[key] == "false", F.lit(0.0))
            .otherwise(F.try_variant_get(row["v"], f"$.{key}", "double"))
        )

    def items(key: str) -> Column:
        """Elements of a list as JSON text; characters of a text; NULL where not iterable."""
        j = row[key]
        quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
        return (
            F.when(j.isNull(), F.array().cast("array<string>"))
            .when(
                j.startswith("["),
                F.transform(
                    F.try_variant_get(row["v"], f"$.{key}", "array<variant>"), lambda x: F.to_json(x)
                ),
            )
            .when(
                j.startswith('"'),
                F.transform(F.filter(F.split(text(key), ""), lambda c: c != ""), quoted),
            )
            .when(j.startswith("{"), F.transform(F.json_object_keys(j), quoted))
        )

    def kept(key: str) -> Column:
        full = F.filter(items(key), lambda x: ~x.isin("null", "false", '""', "[]", "{}", "0", "0.0"))
        return F.transform(full, lambda x: _said(_element_text(x), x))

    def not_number(key: str) -> Column:
        return row[key].startswith('"') & number(key).isNull()

    con = "content_confidence"
    failure = (
        F.when(F.coalesce(row["answer"], F.lit("")) == "", F.lit(NO_RESPONSE))
        .when(row["v"].isNull(), F.lit(BAD_JSON))
        .when(not_number(con), F.format_string(BAD_NUMBER, text(con)))
        .when(
            not_number("table_confidence") & number(con).isNotNull(),
            F.format_string(BAD_NUMBER, text("table_confidence")),
        )
    )
    script = truthy("requires_javascript")
    strategy = string_or("recommended_strategy", string_or("scrape_strategy", F.lit(DEFAULT_STRATEGY)))
    return F.struct(
        failure.alias("failure"),
        F.to_json(row["v"]).startswith("{").alias("is_object"),
        items("warnings").alias("warning_items"),
        string("website_type", "Unknown").alias("website_type"),
        string("framework", "Unknown").alias("framework"),
        number(con).alias("content_confidence"),
        number("table_confidence").alias("table_confidence"),
        script.alias("requires_javascript"),
        strategy.alias("recommended_strategy"),
        string("summary", "").alias("summary"),
        string("main_content_selector", "body").alias("main_content_selector"),
        F.coalesce(F.try_variant_get(row["v"], "$.overall_score", "bigint"), F.lit(0))
        .cast("bigint")
        .alias("overall_score"),
        strip(F.upper(string("compatibility_grade", ""))).alias("compatibility_grade"),
        string_or("rendering_type", F.when(script, "Dynamic SPA").otherwise("Mostly Static")).alias(
            "rendering_type"
        ),
        string_or("javascript_complexity", F.when(script, "High").otherwise("Low")).alias(
            "javascript_complexity"
        ),
        kept("strengths").alias("strengths"),
        kept("limitations").alias("limitations"),
        string_or("recommendation", F.lit("")).alias("recommendation"),
    )


def _named_framework(row: Column) -> Column:
    return ~row["framework"].isin("Unknown", "Standard HTML/CSS")


def _add_framework_warning(row: Column) -> Column:
    plain = F.transform(row["warning_items"], lambda w: F.coalesce(_element_text(w), w))

    def extend(warnings: Column) -> Column:
        known = F.exists(
            warnings,
            lambda w: F.contains(F.lower(w), F.lower(row["framework"]))
            | F.contains(F.lower(w), F.lit("appears to use")),
        )
        more = F.array_append(warnings, F.format_string(USES_FRAMEWORK, row["framework"]))
        return F.when(_named_framework(row) & ~known, more).otherwise(warnings)

    return _with(row, warnings=bind(plain, extend))


def _add_confidence_warnings(row: Column) -> Column:
    def append(limit: Column, words: list[str], line: str):
        def step(warnings: Column) -> Column:
            known = F.exists(warnings, lambda w: contains_any(F.lower(w), words))
            return F.when(limit & ~known, F.array_append(warnings, F.lit(line))).otherwise(warnings)

        return step

    low_text = append(row["content_confidence"] < 0.4, ["content extraction", "confidence"], LOW_CONTENT)
    low_table = append(row["table_confidence"] < 0.2, ["table"], NO_TABLES)
    return _with(row, warnings=bind(bind(row["warnings"], low_text), low_table))


def _score(row: Column) -> Column:
    """Score, grade and the texts that stand in for empty lists."""
    con, tab, script = row["content_confidence"], row["table_confidence"], row["requires_javascript"]
    derived = (con * 60 + tab * 20).cast("bigint") + F.when(script, 10).otherwise(20)
    score = F.when(row["overall_score"] > 0, row["overall_score"]).otherwise(
        F.greatest(F.lit(35), F.least(F.lit(98), derived))
    )

    def grade(value: Column) -> Column:
        given = row["compatibility_grade"]
        return (
            F.when(given.isin("A", "B", "C", "D"), given)
            .when(value >= 85, "A")
            .when(value >= 70, "B")
            .when(value >= 50, "C")
            .otherwise("D")
        )

    def stand_in(given: Column, choices: list[tuple[Column, str]], none: str) -> Column:
        picked = F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in choices]))
        return (
            F.when(F.size(given) > 0, given)
            .when(F.size(picked) > 0, picked)
            .when(given.isNotNull(), F.array(F.lit(none)))
        )

    strengths = [
        (con > 0.7, STRENGTH_TEXTS["content"]),
        (~script, STRENGTH_TEXTS["static"]),
        (tab > 0.5, STRENGTH_TEXTS["tables"]),
    ]
    limits = [(script, LIMITATION_TEXTS["script"]), (con < 0.5, LIMITATION_TEXTS["content"])]
    advice = F.format_string(RECOMMENDATION, row["recommended_strategy"])
    return _with(
        row,
        iterable=row["strengths"].isNotNull() & row["limitations"].isNotNull(),
        overall_score=score.cast("bigint"),
        compatibility_grade=bind(score, grade),
        strengths=stand_in(row["strengths"], strengths, STRENGTH_TEXTS["none"]),
        limitations=stand_in(row["limitations"], limits, LIMITATION_TEXTS["none"]),
        recommendation=or_else(row["recommendation"], advice),
    )


def or_else(text: Column, other: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")) == "", other).otherwise(text)


def _conclude(row: Column) -> Column:
    """The record, the fallback record, or no analysis at all."""
    con, tab = row["content_confidence"], row["table_confidence"]
    texts_only = F.forall(row["warning_items"], lambda w: w.startswith('"'))
    tested = _named_framework(row) | (con < 0.4) | (tab < 0.2)
    usable = (
        row["is_object"] & row["warning_items"].isNotNull() & row["iterable"]
        & con.isNotNull() & tab.isNotNull() & (texts_only | ~tested)
    )
    readable = row["is_object"] & row["warning_items"].isNotNull()
    failed = row["failure"].isNotNull() & (row["is_object"].isNull() | readable)

    def fallback(name: str) -> Column:
        value = FALLBACK[name]
        if name in ("warnings", "summary"):
            line = F.format_string(value, row["failure"])
            return F.array(line) if name == "warnings" else line
        if name in ("strengths", "limitations"):
            return F.array(F.lit(value))
        return F.lit(value).cast("bigint") if name == "overall_score" else F.lit(value)

    def record(state: Column) -> Column:
        return F.struct(
            (state != "none").alias("has_analysis"),
            *[
                F.when(state == "failed", fallback(n)).when(state == "usable", row[n]).alias(n)
                for n in ANALYSIS_FIELDS
            ],
        )

    state = F.when(failed, "failed").when(F.coalesce(usable, F.lit(False)), "usable").otherwise("none")
    return bind(state, record)


def warning_severity(analysis: DataFrame, keep: list[str], warnings: str = "warnings") -> DataFrame:
    """One row per warning with its severity; one success row where there is none."""
    exploded = analysis.select(*keep, F.posexplode_outer(warnings).alias("pos", "warning"))
    lower = F.lower("warning")
    level = (
        F.when(F.col("warning").isNull(), "success")
        .when(contains_any(lower, INFO_WORDS), "info")
        .when(contains_any(lower, DANGER_WORDS), "danger")
        .otherwise("warning")
    )
    return exploded.select(
        *keep,
        F.coalesce("pos", F.lit(0)).cast("bigint").alias("pos"),
        level.alias("severity"),
        F.coalesce("warning", F.lit(NO_WARNING)).alias("warning"),
    )


def percent(confidence: Column) -> Column:
    """Whole percent, halves rounded up."""
    return F.floor(F.coalesce(confidence, F.lit(0.0)) * 100 + 0.5).cast("bigint")


def band(value: Column) -> Column:
    """Colour band of a percentage or score."""
    return F.when(value >= 90, "green").when(value >= 70, "yellow").otherwise("red")
