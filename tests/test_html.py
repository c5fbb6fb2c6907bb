import pytest
from pyspark.sql import functions as F
from tokenizer import Reader, clean, ordered

from webstrata.functions import html as H
from webstrata.functions import text as T
from webstrata.operators import pages as P

LONG_A = "This is the first long paragraph with well over fifty characters in it."
LONG_B = "A second long paragraph, again with more than fifty characters inside."
SIMPLE = f"""<html><head><title>A Page  Title</title></head><body><h1>Main Heading</h1><h2>Sub Heading</h2>
<p>{LONG_A}</p><p>{LONG_B}</p><p>short</p><a href="https://example.com/first">First Link</a>
<a href="/relative-path">Relative Link</a></body></html>"""


def one(df, column="x"):
    return df.first()[column]


def test_parse_simple_page(pages_of):
    row = P.parse(pages_of(SIMPLE), ["page_id"]).first()
    assert row.title == "A Page Title"
    assert row.headings == ["Main Heading", "Sub Heading"]
    assert row.paragraphs == [LONG_A, LONG_B]
    assert [tuple(x) for x in row.links] == [
        ("First Link", "https://example.com/first"), ("Relative Link", "/relative-path"),
    ]
    assert row.tables == []


def test_empty_and_null_pages_give_empty_results(pages_of):
    for row in P.parse(pages_of(None, "", "just text"), ["page_id"]).collect():
        assert (row.title, row.headings, row.paragraphs, row.links, row.tables) == ("", [], [], [], [])


def test_heading_levels_follow_the_flag(pages_of):
    html = "<h3>c</h3><h1>a</h1><h5>e</h5><h2> </h2><h1>a</h1><h6>f"
    items = P.with_markup(pages_of(html)).select(H.heading_items(F.col("markup")).alias("i"))
    row = items.select(
        H.heading_texts(F.col("i"), F.lit(False)).alias("few"), H.heading_texts(F.col("i"), F.lit(True)).alias("all"), "i"
    ).first()
    assert row.few == ["c", "a"]
    assert row.all == ["c", "a", "e", "f"]
    assert [h.level for h in row.i] == ["h3", "h1", "h5", "h1", "h6"]


def test_signals_page(pages_of):
    html = "<html><head><title>T</title></head><body><h1>H</h1><p> </p><p>Important intro text</p><p>b</p><p>c</p><p>d</p></body></html>"
    row = P.signals(pages_of(html), ["page_id"], paragraphs=3).first()
    assert row.page_title == "T"
    assert row.first_paragraphs == ["Important intro text", "b", "c"]
    assert P.signals(pages_of(html), ["page_id"]).first().first_paragraphs == ["Important intro text", "b", "c", "d"]
    assert [tuple(h) for h in row.heading_hierarchy] == [("h1", "H")]
    assert row.total_html_size == len(html)
    assert row.visible_text_length == len("TH Important intro textbcd")


def test_counts_ignore_comments_and_scripts(pages_of):
    html = (
        "<table><tr><td>a<td>b</table><!-- <table> <form> --><script>'<table>'</script><SCRIPT src=x></SCRIPT>"
        "<form><img/><a name=q>x</a><main></main>"
    )
    row = P.signals(pages_of(html), ["page_id"]).first()
    counts = (row.number_of_tables, row.number_of_forms, row.number_of_links, row.number_of_images, row.number_of_scripts)
    assert counts == (1, 1, 1, 1, 2)
    assert (row.has_main, row.has_article, row.has_nav) == (True, False, False)


@pytest.mark.parametrize(
    ("source", "expected"),
    [
        ("a&nbsp;&nbsp;b　c  d", "a b c d"),
        ("&#233;&#xE9;&#x1F600;", "éé😀"),
        ("&amp;quot; &amp;nbsp; &amp;amp;", "&quot; &nbsp; &amp;"),
        ("&lt;b&gt; &#60;i&#62;", "<b> <i>"),
        ("&bogus; &copy &lbrace;", "&bogus; © {"),
        ("&#0; &#55296; &#99999999;", "� � �"),
        ("x<b title='a > b'>y</b>z", "xyz"),
        ("x<br/>y < z", "xy < z"),
        ("\x1cA\x1dB\x1fC", "A B C"),
    ],
)
def test_inner_text(pages_of, source, expected):
    assert one(pages_of(source).select(H.inner_text(H.markup(F.col("html"))).alias("x"))) == expected


def test_ten_thousand_attributes(pages_of):
    tag = "<p " + " ".join(f'a{i}="v > {i}"' for i in range(10_000)) + f">{LONG_A}</p>"
    assert P.parse(pages_of(tag), ["page_id"]).first().paragraphs == [LONG_A]


@pytest.mark.parametrize(
    ("tag", "expected"),
    [
        ("<a HREF=/x>", "/x"),
        ("<a title='href=/no' href='/y'>", "/y"),
        ('<a href="/1" href="/2">', "/1"),
        ("<a href>", ""),
        ("<a data-href=/no>", None),
        ('<a/href="a&amp;b&#39;c">', "a&b'c"),
        ("<a href = /spaced >", "/spaced"),
    ],
)
def test_attribute(pages_of, tag, expected):
    assert one(pages_of(tag).select(H.attribute(F.col("html"), "href").alias("x"))) == expected


def test_links_keep_order_and_distinct_pairs(pages_of):
    html = "<a href=/1>x</a><a href=/1>x</a><a href=/1></a><a>n</a><a href=' '>b</a><A HREF=' /2 '>y <b>z</b></A>"
    assert [tuple(x) for x in P.parse(pages_of(html), ["page_id"]).first().links] == [("x", "/1"), ("", "/1"), ("y z", "/2")]


def test_visible_text_drops_nested_elements(pages_of):
    html = "<body>a<nav>x<nav>y</nav>z</nav>b<header>h</header></header>c<svg/>d<iframe>e</iframe><footer>unclosed"
    assert one(P.with_markup(pages_of(html)).select(H.visible_text(F.col("markup")).alias("x"))) == "abcd"


def test_meta_signals(pages_of):
    html = (
        "<meta NAME=Description content='  '><meta property='OG:description' content='from og'>"
        "<link rel='Canonical' href=/no><link rel='next canonical' href=' /yes '><meta property=og:title content='Og'><title> </title>"
    )
    row = P.signals(pages_of(html), ["page_id"]).first()
    assert (row.meta_description, row.canonical_url, row.page_title) == ("from og", "/yes", "Og")


@pytest.mark.parametrize(
    ("html", "expected"),
    [
        ("<meta name=generator content='Drupal 9, Joomla'>", ["Drupal", "Joomla"]),
        ("<div id=__NEXT_DATA__ data-reactroot>", ["Next.js"]),
        ("<div data-reactid=1>", ["React"]),
        ("<p v-if=x>", ["Vue.js"]),
        ("<p v-iffy=x>", []),
        ("<p data-ng-app>", ["Angular"]),
        ("<p>data-ng-app v-if id=__NUXT__</p>", []),
        ("<script src=/_next/react.js></script>", ["Next.js", "React"]),
        ("<script src='https://cdn.shopify.com/x'></script><link href=bootstrap.css>", ["Bootstrap", "Shopify"]),
        ("<!-- tailwindcss -->", ["Tailwind CSS"]),
        ("shopify.theme", []),
        (None, []),
    ],
)
def test_framework_hints(pages_of, html, expected):
    assert P.signals(pages_of(html), ["page_id"]).first().framework_hints == expected


def test_basic_content(pages_of):
    paragraph = "Hello <b>big</b> day " + "x" * 60
    html = f"<title> The Title </title>{f'<p>{paragraph}</p>' * 3}<p>Short</p>"
    row = P.content(pages_of(html, "<p>Short</p>", f"<p>{'y' * 250}</p>"), ["page_id"]).orderBy("page_id").collect()
    assert row[0].basic.title == "The Title"
    assert row[0].basic.text == " ".join(["Hellobigday " + "x" * 60] * 3)
    assert row[1].content is None
    assert row[2].basic.title == "Untitled"


def test_main_content(pages_of):
    body = "word " * 60
    html = (
        f"<title>Site</title><nav>menu</nav><p>outside</p><article><h1>Head</h1><aside>no</aside><p>{body}[12]</p>"
        "<div><a href=/1>link</a> <a href=/2>farm</a></div><form>f</form></article><footer>foot</footer>"
    )
    row = P.content(pages_of(html, f"<div>{body}</div><nav>n</nav>", "<main>tiny</main>"), ["page_id"]).orderBy("page_id").collect()
    assert row[0].main.text == "Head " + body.strip()
    assert row[0].content.title == "Site"
    assert (row[1].main.title, row[1].main.text) == ("Untitled", body.strip())
    assert row[2].content is None


def test_pages_agree_with_a_tokenizer(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = P.with_markup(pages).select(
        "html",
        H.paragraph_texts(F.col("p_pieces")).alias("p"),
        H.links(F.col("markup")).alias("a"),
        H.heading_items(F.col("markup")).alias("h"),
        H.visible_text(F.col("markup")).alias("v"),
    ).collect()
    assert rows
    for row in rows:
        read = Reader(row.html)
        assert row.p == read.paragraphs
        assert [tuple(x) for x in row.a] == ordered(x for x in read.links if clean(x[1]))
        assert [tuple(x) for x in row.h] == [x for x in read.headings if x[1]]
        assert row.v == clean("".join(read.visible))


def test_escape_markup(spark):
    df = spark.createDataFrame([("<a href='x'>\"&amp;\"</a>",)], "s string")
    row = df.select(T.escape_markup(F.col("s")).alias("a"), T.escape_markup(F.col("s"), True).alias("b")).first()
    assert row.a == "&lt;a href='x'&gt;\"&amp;amp;\"&lt;/a&gt;"
    assert row.b == "&lt;a href=&#039;x&#039;&gt;&quot;&amp;amp;&quot;&lt;/a&gt;"


QUOTED = (
    '<html><head><title>T</title></head><body><div data-t="<nav><a href=1>x</a>" title="a > b" '
    "srcdoc='<script>1</script><p>no</p><table>'>"
    + "<p>" + "long enough words " * 20 + '</p><a href="/one" title="<b>">One</a></div>'
    + "<script>var s = \"<p title='<a>'>\";</script></body></html>"
)


def test_markup_in_attribute_values_is_no_markup(pages_of):
    row = P.signals(pages_of(QUOTED), ["page_id"]).first()
    assert not row.has_nav and row.number_of_links == 1 and row.number_of_tables == 0 and row.number_of_scripts == 1
    assert row.visible_text_length == len("T" + "long enough words " * 20 + "One")
    done = P.parse(pages_of(QUOTED), ["page_id"]).first()
    assert [tuple(x) for x in done.links] == [("One", "/one")] and len(done.paragraphs) == 1 and done.tables == []
    content = P.content(pages_of(QUOTED), ["page_id"]).first()
    assert content.main.text.startswith("long enough words")


def test_entities_without_bounds_and_semicolons(spark):
    cases = {
        "&#0000000065;": "A", "&copy 2": "\u00a9 2", "&amp x": "& x", "&#146;&#150;": "\u2019\u2013", "&#x0000041;": "A",
        "&#99999999999;": "\ufffd", "&copyright;": "&copyright;", "?a&copy=1": "?a&copy=1", "&lt b": "< b", "&#129;": "\x81",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r.t: r.d for r in df.select("t", H.inner_text(H.markup(F.col("t"))).alias("d")).collect()}
    assert got == cases


def test_many_dropped_elements_take_little_time(pages_of):
    import time

    html = "<body>" + "<svg><g/><svg>in</svg></svg>text here " * 20_000 + "<script>x</script></body>"
    df = P.with_markup(pages_of(html)).cache()
    df.count()
    start = time.time()
    assert df.select(F.length(H.visible_text(F.col("markup")))).first()[0] == len("text here " * 20_000) - 1
    assert time.time() - start < 10
