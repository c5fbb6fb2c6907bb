"""HTML extraction as native ``Column -> Column`` functions.

Every function takes the column made by :func:`markup` unless it says otherwise. Nothing here
shuffles and nothing leaves the JVM. Patterns keep alternations under possessive quantifiers
only, so tags with thousands of attributes do not exhaust the regex stack.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webstrata.functions.text import (
    RECORD,
    SEPARATORS,
    UNIT,
    bind,
    collapse,
    contains_any,
    decode_early,
    decode_late,
    non_empty,
    ordered_distinct,
    split_at,
    strip,
)

_REST = r"""(?:[^"'>=]++|=\s*+(?:"[^"]*+"|'[^']*+')|[="'])*+"""
_VALUE = r"""(?:"[^"]*+"|'[^']*+'|[^\s>]++)"""
_ATTR = rf"[^\s=/>]++(?:\s*+=\s*+{_VALUE})?+"
_END = r"(?=[\s/>])"
# Every pattern starts with one literal character, so a scan rejects other positions at once.
_ANY_TAG = rf"<(?:[a-zA-Z/!?]{_REST}>|!\z)"
_RAW_TEXT = (
    rf"(?is)<(?:(!)--.*?(?:--(>)|\z)|((script|style){_END}{_REST}>).*?(?=</\4[\s/>]|\z))"
)
# Comments, script and style elements, tags and text, cut at every place where one of them begins.
_TOKEN = (
    rf"(?is)<(?:!--.*?(?:-->|\z)|(script|style){_END}{_REST}>.*?(?=</\1[\s/>]|\z)|[a-z/!?]{_REST}>)|[^<]++|<"
)
_QUOTED_MARKUP = r"""=\s*+(?:"[^"<]*+<|'[^'<]*+<)"""
_BLOCKS = (
    "address article aside blockquote body caption center dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main "
    "menu nav ol p pre section summary table tbody td tfoot th thead tr ul"
).split()
#: Elements without content.
VOID = "area base br col embed hr img input link meta param source track wbr".split()
_BLOCK_TAG = rf"(?is)</?(?:{'|'.join(_BLOCKS)}){_END}{_REST}>"
_ANCHOR = rf"(?is)<a{_END}{_REST}>.*?(?=</?a[\s/>]|\z)"
_HIDDEN = ["noscript", "header", "footer", "nav", "svg", "template", "iframe"]
_BOILERPLATE = ["nav", "header", "footer", "aside", "form", "noscript", "svg", "template", "iframe"]

COUNTED = ["table", "form", "a", "img", "script"]
FLAGGED = ["article", "main", "nav", "aside", "footer"]
MIN_PARAGRAPH = 50
MIN_CONTENT = 200


def open_tag(names: str) -> str:
    """Pattern of an opening tag whose name is one of the ``|``-separated ``names``."""
    return rf"(?is)<(?:{names}){_END}{_REST}>"


def markup(html: Column) -> Column:
    """Normalised markup of a raw document.

    Comments shrink to a marker, script and style bodies go in the same leftmost pass (a
    ``</p>`` inside a script is harmless), non-syntax entities are resolved and separator
    characters become spaces.
    """
    plain = F.regexp_replace(F.coalesce(html, F.lit("")), SEPARATORS, " ")
    return decode_early(F.regexp_replace(bind(plain, _quiet_values), _RAW_TEXT, "<$1$2$3"))


def _quiet_values(doc: Column) -> Column:
    """Escape ``<`` inside quoted attribute values, so that no later pattern takes it for a tag.

    One leftmost pass over whole tokens, and only for documents with such a value.
    """
    def quiet(token: Column) -> Column:
        is_tag = token.rlike(r"^<[a-zA-Z]")
        first = F.regexp_extract(token, rf"(?s)^<[a-zA-Z/!?]{_REST}>", 0)
        rest = F.substring(token, F.length(first) + 1, F.length(token))
        inside = F.replace(F.substring(first, F.lit(2), F.length(first)), F.lit("<"), F.lit("&lt;"))
        return F.when(is_tag & (first != ""), F.concat(F.lit("<"), inside, rest)).otherwise(token)

    tokens = F.regexp_extract_all(doc, F.lit(_TOKEN), F.lit(0))
    return F.when(doc.rlike(_QUOTED_MARKUP), F.array_join(F.transform(tokens, quiet), "")).otherwise(doc)


def inner_text(fragment: Column) -> Column:
    """Text of a fragment: tags removed without a separator, decoded, white space collapsed."""
    return collapse(decode_late(F.regexp_replace(fragment, _ANY_TAG, "")))


def attribute(tag: Column, name: str) -> Column:
    """Decoded value of the first ``name`` attribute of a tag, NULL when absent."""
    head = rf"(?is)^<[a-z][^\s/>]*+(?:[\s/]*+(?!{name}[\s=/>]){_ATTR})*+[\s/]*+{name}"
    raw = F.regexp_extract(tag, rf"{head}\s*+=\s*+({_VALUE})", 1)
    value = F.when(
        raw.rlike(r"""(?s)^(?:".*"|'.*')$"""), F.substring(raw, F.lit(2), F.length(raw) - 2)
    ).otherwise(raw)
    return F.when(raw != "", decode_late(value)).when(tag.rlike(head + r"(?=[\s=/>])"), F.lit(""))


def has_attribute(tag: Column, name_pattern: str) -> Column:
    """True where a tag carries an attribute whose whole name matches ``name_pattern``."""
    stop = rf"(?:{name_pattern})(?=[\s=/>])"
    return tag.rlike(rf"(?is)^<[a-z][^\s/>]*+(?:[\s/]*+(?!{stop}){_ATTR})*+[\s/]*+{stop}")


def tags(mk: Column, names: str) -> Column:
    """All opening tags with one of the given names, in document order."""
    return F.regexp_extract_all(mk, F.lit(open_tag(names)), F.lit(0))


#: Pieces that one fold of :func:`drop_subtrees` collects.
_RUN = 256


def drop_subtrees(mk: Column, names: list[str]) -> Column:
    """Remove whole elements, nested ones of the same name included.

    A scan over the pieces between such tags carries the name and depth of the element being
    dropped; an element that never closes runs to the end of the page. What is kept is collected
    run by run: a fold copies what it has collected at every step, so its length is bounded.
    """
    pieces = split_at(mk, rf"(?i)<(/?)({'|'.join(names)})(?=[\s/>])", after="<$1$2")
    none = F.array().cast("array<string>")

    def state(name: Column, depth: Column, kept: Column) -> Column:
        return F.struct(name.alias("name"), depth.alias("depth"), kept.alias("kept"))

    def step(acc: Column, piece: Column) -> Column:
        def named(name: Column) -> Column:
            closes = piece.startswith("</")
            opens = name.isin(names) & ~closes & ~piece.rlike(rf"^<{_REST}(?<=/)>")
            inside = F.when(
                name == acc["name"],
                acc["depth"] + F.when(closes, -1).when(opens, 1).otherwise(0),
            ).otherwise(acc["depth"])
            depth = F.when(acc["depth"] > 0, inside).otherwise(F.when(opens, 1).otherwise(0))
            return bind(
                depth,
                lambda d: state(
                    F.when(acc["depth"] > 0, acc["name"]).otherwise(name),
                    d,
                    F.when(d == 0, F.array_append(acc["kept"], piece)).otherwise(acc["kept"]),
                ),
            )

        return bind(F.lower(F.regexp_extract(piece, r"^</?([a-zA-Z0-9]+)", 1)), named)

    def fold(cut: Column) -> Column:
        def run(acc: Column, number: Column) -> Column:
            scanned = F.aggregate(F.slice(cut, number * _RUN + 1, _RUN), state(acc["name"], acc["depth"], none), step)
            return bind(scanned, lambda r: state(r["name"], r["depth"], F.array_append(acc["kept"], F.array_join(r["kept"], ""))))

        numbers = F.sequence(F.lit(0), ((F.size(cut) - 1) / _RUN).cast("int"))
        joined = F.aggregate(numbers, state(F.lit(""), F.lit(0), none), run, lambda acc: F.array_join(acc["kept"], ""))
        return F.when(F.size(cut) > 1, joined).otherwise(cut[0])

    return bind(pieces, fold)


def _first_element(mk: Column, name: str) -> Column:
    return F.regexp_extract(mk, rf"(?is)<{name}{_END}{_REST}>(.*?)(?:</{name}[\s/>]|\z)", 1)


def has_element(mk: Column, name: str) -> Column:
    return mk.rlike(rf"(?i)<{name}[\s/>]")


def tag_marks(mk: Column) -> Column:
    """Names of the counted and flagged elements, in document order, from one pass."""
    found = F.regexp_extract_all(mk, F.lit(rf"(?i)<({'|'.join(COUNTED + FLAGGED)})[\s/>]"), F.lit(1))
    return F.transform(found, lambda t: F.lower(t))


def mark_count(marks: Column, name: str) -> Column:
    return F.size(F.filter(marks, lambda t: t == name)).cast("bigint")


def has_mark(marks: Column, name: str) -> Column:
    return F.array_contains(marks, name)


def title(mk: Column) -> Column:
    """Cleaned ``<title>`` text, ``''`` when missing."""
    return inner_text(_first_element(mk, "title"))


def heading_items(mk: Column) -> Column:
    """``array<struct<level,text>>`` of H1-H6 in document order, blanks dropped."""
    found = F.regexp_extract_all(
        mk, F.lit(rf"(?is)<h[1-6]{_END}{_REST}>.*?(?=</?h[1-6][\s/>]|\z)"), F.lit(0)
    )
    items = F.transform(
        found,
        lambda x: F.struct(F.lower(F.substring(x, 2, 2)).alias("level"), inner_text(x).alias("text")),
    )
    return F.filter(items, lambda h: h["text"] != "")


def heading_texts(items: Column, all_levels: Column) -> Column:
    """Distinct heading texts: H1-H6 where ``all_levels``, else H1-H3."""
    kept = F.filter(items, lambda h: all_levels | h["level"].isin("h1", "h2", "h3"))
    return ordered_distinct(F.transform(kept, lambda h: h["text"]))


def paragraph_pieces(mk: Column) -> Column:
    """Inner markup of every ``<p>``; a new ``<p>`` or block tag ends an open one."""
    pattern = rf"(?is)<(?:(p){_END}{_REST}>|/?(?:{'|'.join(_BLOCKS)}){_END}{_REST}>)"
    pieces = F.filter(
        split_at(mk, pattern, after=f"$1{RECORD}"),
        lambda x: F.substring(x, 1, 2).isin("p" + RECORD, "P" + RECORD),
    )
    return F.transform(pieces, lambda x: F.substring(x, F.lit(3), F.length(x)))


def paragraph_texts(pieces: Column) -> Column:
    """Cleaned text of every paragraph piece."""
    return F.transform(pieces, inner_text)


def long_paragraphs(texts: Column) -> Column:
    """Distinct paragraphs of more than 50 characters."""
    return F.array_distinct(F.filter(texts, lambda x: F.length(x) > MIN_PARAGRAPH))


def first_paragraphs(texts: Column, limit: int | None = None) -> Column:
    """The non-empty paragraphs, or the first ``limit`` of them, without length gate or de-duplication."""
    full = F.filter(texts, lambda x: x != "")
    return full if limit is None else F.slice(full, 1, limit)


def links(mk: Column) -> Column:
    """``array<struct<text,href>>`` of anchors with an href, distinct on the pair, in order.

    The pair is packed into one string for the de-duplication, which keeps it hash based.
    """
    anchors = F.regexp_extract_all(mk, F.lit(_ANCHOR), F.lit(0))
    packed = F.transform(
        anchors, lambda x: F.concat(inner_text(x), F.lit(UNIT), collapse(attribute(x, "href")))
    )
    kept = F.array_distinct(F.filter(packed, lambda x: x.isNotNull() & ~x.endswith(UNIT)))
    return F.transform(
        kept,
        lambda x: F.struct(
            F.substring_index(x, UNIT, 1).alias("text"), F.substring_index(x, UNIT, -1).alias("href")
        ),
    )


def visible_text(mk: Column) -> Column:
    """Text outside navigation, header, footer and non-rendered elements (title included)."""
    return inner_text(drop_subtrees(mk, _HIDDEN))


def head_tags(mk: Column) -> Column:
    """All meta, link and script tags, read in one pass for the functions below."""
    return tags(mk, "meta|link|script")


def _named(head: Column, name: str) -> Column:
    return F.filter(head, lambda t: F.lower(F.substring(t, 2, len(name))) == name)


def _meta(head: Column, key: str, value: str) -> Column:
    hit = F.filter(_named(head, "meta"), lambda m: F.lower(attribute(m, key)) == value)
    return bind(F.get(hit, F.lit(0)), lambda m: F.when(m.isNotNull(), F.coalesce(attribute(m, "content"), F.lit(""))))


def open_graph(head: Column, name: str) -> Column:
    """Content of the first ``og:<name>`` meta tag, NULL when absent."""
    return _meta(head, "property", f"og:{name}")


def signal_title(title_text: Column, head: Column) -> Column:
    return F.coalesce(
        F.when(title_text != "", title_text), collapse(open_graph(head, "title")), F.lit("")
    )


def meta_description(head: Column) -> Column:
    return F.coalesce(
        non_empty(collapse(_meta(head, "name", "description"))),
        collapse(open_graph(head, "description")),
        F.lit(""),
    )


def canonical_url(head: Column) -> Column:
    hit = F.filter(
        _named(head, "link"),
        lambda t: F.concat(F.lit(" "), collapse(attribute(t, "rel")), F.lit(" ")).contains(" canonical "),
    )
    return F.coalesce(
        strip(non_empty(attribute(F.get(hit, F.lit(0)), "href"))), strip(open_graph(head, "url")), F.lit("")
    )


# Technology marks. Each row is (texts to look for, names to report).
_GENERATOR_MARKS = [
    (["wordpress"], ["WordPress"]),
    (["gatsby"], ["Gatsby"]),
    (["next.js", "nextjs"], ["Next.js"]),
    (["nuxt"], ["Nuxt.js"]),
    (["shopify"], ["Shopify"]),
    (["drupal"], ["Drupal"]),
    (["joomla"], ["Joomla"]),
]
_SCRIPT_MARKS = [
    (["angular"], ["Angular"]),
    (["jquery"], ["jQuery"]),
    (["bootstrap"], ["Bootstrap"]),
    (["wp-content", "wp-includes"], ["WordPress"]),
    (["shopify"], ["Shopify"]),
]
_LINK_MARKS = [
    (["bootstrap"], ["Bootstrap"]),
    (["tailwind"], ["Tailwind CSS"]),
    (["wp-content", "wp-includes"], ["WordPress"]),
]
# Without one of these no attribute mark can be present.
_ID_MARKS = ["__NEXT_DATA__", "__NUXT__", "___gatsby"]
_NAME_TRACE = r"(?i)[\s/\"'](?:v-(?:bind|model|if|for)|ng-|data-(?:v-|ng-|react))"


def framework_hints(mk: Column, head: Column, html: Column) -> Column:
    """Sorted distinct technology names found in attributes, sources and raw text."""

    def names(condition: Column, values: list[str]) -> Column:
        return F.when(condition, F.array(*[F.lit(v) for v in values]))

    def sources(name: str, key: str) -> Column:
        return F.transform(
            F.filter(_named(head, name), lambda t: has_attribute(t, key)),
            lambda t: F.lower(attribute(t, key)),
        )

    def from_attributes(all_tags: Column) -> Column:
        def any_id(value: str) -> Column:
            return F.exists(all_tags, lambda t: F.contains(t, F.lit(value)) & (attribute(t, "id") == value))

        def any_name(pattern: str) -> Column:
            return F.exists(all_tags, lambda t: has_attribute(t, pattern))

        return F.array(
            F.when(any_id("__NEXT_DATA__"), F.array(F.lit("Next.js"))).when(
                any_name("data-reactroot|data-reactid"), F.array(F.lit("React"))
            ),
            names(any_id("__NUXT__"), ["Nuxt.js", "Vue.js"]),
            names(any_id("___gatsby"), ["Gatsby", "React"]),
            names(any_name(r"data-v-[^\s=/>]*+|v-bind|v-model|v-if|v-for"), ["Vue.js"]),
            names(any_name(r"(?:data-)?ng-[^\s=/>]*+"), ["Angular"]),
        )

    def seen(items: Column, words: list[str]) -> Column:
        return F.exists(items, lambda s: contains_any(s, words))

    def from_scripts(srcs: Column) -> Column:
        return F.array(
            names(seen(srcs, ["_next/"]), ["Next.js", "React"]),
            names(F.exists(srcs, lambda s: F.contains(s, F.lit("react")) & ~F.contains(s, F.lit("_next/"))), ["React"]),
            names(seen(srcs, ["_nuxt/"]), ["Nuxt.js", "Vue.js"]),
            names(F.exists(srcs, lambda s: F.contains(s, F.lit("vue")) & ~F.contains(s, F.lit("_nuxt/"))), ["Vue.js"]),
            *[names(seen(srcs, words), values) for words, values in _SCRIPT_MARKS],
        )

    generator = F.lower(_meta(head, "name", "generator"))
    none = F.array().cast("array<array<string>>")
    groups = F.concat(
        bind(
            generator,
            lambda g: F.array(*[names(contains_any(g, words), values) for words, values in _GENERATOR_MARKS]),
        ),
        F.when(
            contains_any(mk, _ID_MARKS) | mk.rlike(_NAME_TRACE),
            bind(tags(mk, r"[a-z][a-z0-9:-]*"), from_attributes),
        ).otherwise(none),
        bind(sources("script", "src"), from_scripts),
        bind(
            sources("link", "href"),
            lambda hrefs: F.array(*[names(seen(hrefs, words), values) for words, values in _LINK_MARKS]),
        ),
        F.array(
            names(
                bind(F.lower(html), lambda h: contains_any(h, ["tailwindcss", 'class="tw-'])), ["Tailwind CSS"]
            ),
            names(F.contains(html, F.lit("Shopify.theme")), ["Shopify"]),
        ),
    )
    return F.sort_array(F.array_distinct(F.flatten(F.array_compact(groups))))


def basic_content(mk: Column, pieces: Column) -> Column:
    """``struct<title,text>`` from long paragraphs, NULL below 200 characters.

    Text nodes are stripped one by one and joined without a separator.
    """
    def squeeze(piece: Column) -> Column:
        return F.array_join(
            F.transform(split_at(piece, _ANY_TAG), lambda n: strip(decode_late(n))), ""
        )

    blocks = F.filter(F.transform(pieces, squeeze), lambda x: F.length(x) > MIN_PARAGRAPH)
    own = strip(decode_late(F.regexp_replace(_first_element(mk, "title"), _ANY_TAG, "")))
    name = F.when(has_element(mk, "title"), own).otherwise(F.lit("Untitled"))
    return bind(
        F.array_join(blocks, " "),
        lambda text: F.when(
            F.length(text) >= MIN_CONTENT, F.struct(name.alias("title"), text.alias("text"))
        ),
    )


def main_content(mk: Column, title_text: Column, head: Column) -> Column:
    """``struct<title,text>`` of the page without boilerplate, NULL below 200 characters.

    The container runs from the first article or main element to the last end tag of that
    name, else the whole page is taken. Navigation, header, footer, aside and form subtrees
    go; so do blocks whose text is more than 80 % links, and ``[n]`` citation marks.
    """
    container = F.regexp_extract(
        mk, rf"(?is)<(article|main){_END}{_REST}>(.*)</\1[\s/>]", 2
    )
    untitled = F.regexp_replace(mk, rf"(?is)<title{_END}{_REST}>.*?(?:</title[\s/>]|\z)", "")
    body = bind(container, lambda c: F.when(c != "", c).otherwise(untitled))

    def block_text(block: Column) -> Column:
        linked = F.aggregate(
            F.regexp_extract_all(block, F.lit(_ANCHOR), F.lit(0)),
            F.lit(0),
            lambda n, a: n + F.length(inner_text(a)),
        )
        return bind(
            inner_text(block),
            lambda text: F.when(
                ~contains_any(block, ["<a", "<A"]) | (linked <= 0.8 * F.length(text)), text
            ).otherwise(F.lit("")),
        )

    blocks = F.transform(split_at(drop_subtrees(body, _BOILERPLATE), _BLOCK_TAG), block_text)
    joined = F.array_join(F.filter(blocks, lambda x: x != ""), " ")
    text = F.trim(F.regexp_replace(F.regexp_replace(joined, r"\[\d+\]", ""), " {2,}", " "))
    name = F.coalesce(
        non_empty(collapse(open_graph(head, "title"))),
        F.when(title_text != "", title_text),
        F.lit("Untitled"),
    )
    return bind(
        text,
        lambda t: F.when(F.length(t) >= MIN_CONTENT, F.struct(name.alias("title"), t.alias("text"))),
    )
