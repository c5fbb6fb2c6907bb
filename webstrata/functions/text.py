"""Text primitives as ``Column -> Column`` functions (all JVM side)."""

from __future__ import annotations

import json
from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Separators used inside packed strings. They are white space to ``collapse``, so cleaned
# text never contains them and markup input is freed of them by ``functions.html.markup``.
CUT, RECORD, UNIT = "\x1c", "\x1e", "\x1f"
SEPARATORS = "[\x1c-\x1f]"

# Unicode white space; Java's ``\\s`` covers ASCII only. Latin-1 members are listed one by one
# and the rest sits behind one range test, which keeps the class cheap for ordinary letters.
_WS_LATIN = r" \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0"
_WS_WIDE = r"[\u1680-\u3000&&[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]"
WS = f"[{_WS_LATIN}{_WS_WIDE}]"
_NOT_ONE_SPACE = f"{WS}(?:{WS}+|(?<! ))"
_WS_CHARS = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(
    map(chr, range(0x2000, 0x200B))
)

# Entities that stay escaped until markup has been split into pieces.
_LATE = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
_ENTITY = r"&(?:#[0-9]++|#[xX][0-9a-fA-F]++|[A-Za-z][A-Za-z0-9]*+);"
_RARE = r"&(?!(?:amp|lt|gt|quot|#39);)(?:#[0-9]++|#[xX][0-9a-fA-F]++|[A-Za-z][A-Za-z0-9]*+);"
# Names that need no semicolon; without one they count only before other than letters, digits and "=".
_BARE = "&(" + "|".join(sorted((k for k in html5 if not k.endswith(";")), key=len, reverse=True)) + ")(?![;A-Za-z0-9=])"
# Numbers from 128 to 159 mean the characters of the Windows code page.
_C1 = {k: ord(c) for k in range(128, 160) if (c := bytes([k]).decode("cp1252", "replace")) != "\ufffd"}
# Frequent names, resolved by plain replacement before the general path is tried.
_FREQUENT = ("nbsp", "copy", "middot", "mdash", "ndash", "hellip", "rsquo", "laquo", "raquo")


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``use``, also inside a lambda."""
    return F.transform(F.array(value), use)[0]


def collapse(c: Column) -> Column:
    """White space runs become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(c, _NOT_ONE_SPACE, " "))


def strip(c: Column) -> Column:
    """Trim Unicode white space at both ends, leaving the inside alone."""
    return F.trim(c, F.lit(_WS_CHARS))


def split_at(c: Column, pattern: str, before: str = "", after: str = "") -> Column:
    """Split at a pattern, by way of a separator: a regex inside ``split`` is compiled per row.

    ``before`` and ``after`` stay as parts of the pieces next to the cut (``$n`` for groups).
    """
    return F.split(F.regexp_replace(c, pattern, before + CUT + after), CUT)


def or_default(c: Column, default: str) -> Column:
    """``default`` where the text is NULL or empty."""
    return bind(
        F.coalesce(c, F.lit("")), lambda x: F.when(x == "", F.lit(default)).otherwise(x)
    )


def non_empty(c: Column) -> Column:
    """NULL where the text is empty."""
    return bind(c, lambda x: F.when(x != "", x))


def explode_rows(df: DataFrame, keep: list, items: Column | str, name: str, pos: str = "pos") -> DataFrame:
    """One row per array element with its 0-based position.

    The outer form plus a filter on its output: a plain explode would let the optimizer infer
    a filter on the array, push it down and so compute the array twice.
    """
    return df.select(*keep, F.posexplode_outer(items).alias(pos, name)).where(
        F.col(pos).isNotNull()
    ).withColumn(pos, F.col(pos).cast("bigint"))


def ordered_distinct(items: Column) -> Column:
    """Non-empty items, first occurrence kept."""
    return F.array_distinct(F.filter(items, lambda x: x != ""))


def _entity_names() -> Column:
    names = {k[:-1]: v for k, v in html5.items() if k.endswith(";")}
    return F.from_json(F.lit(json.dumps(names)), "map<string,string>")


def _resolve(entity: Column) -> Column:
    def char(body: Column) -> Column:
        digits = F.regexp_replace(body, "^#[xX]?0*", "")
        number = F.when(body.rlike("^#[xX]"), F.conv(digits, 16, 10)).otherwise(digits).try_cast("int")
        code = F.when(F.length(digits) <= 8, number)
        valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        windows = F.try_element_at(F.create_map(*[F.lit(x) for pair in _C1.items() for x in pair]), code)
        point = F.when(valid, F.coalesce(windows, code)).otherwise(F.lit(0xFFFD))
        numeric = F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")
        return F.when(body.startswith("#"), numeric).otherwise(
            F.try_element_at(_entity_names(), body)
        )

    def keep_syntax(ch: Column) -> Column:
        out = F.coalesce(ch, entity)
        for name, plain in _LATE:
            out = F.when(ch == plain, F.lit(name)).otherwise(out)
        return out

    return bind(char(F.substring(entity, F.lit(2), F.length(entity) - 2)), keep_syntax)


def decode_early(c: Column) -> Column:
    """Resolve every entity of a document except the five that carry syntax.

    One left-to-right pass, so ``&amp;nbsp;`` stays the text ``&nbsp;``. Documents without
    rare entities never enter the general branch.
    """
    def frequent(doc: Column) -> Column:
        for name in _FREQUENT:
            doc = F.replace(doc, F.lit(f"&{name};"), F.lit(html5[name + ";"]))
        return doc

    def general(doc: Column) -> Column:
        pieces = split_at(doc, _ENTITY)
        found = F.regexp_extract_all(doc, F.lit(_ENTITY), F.lit(0))
        return F.array_join(
            F.zip_with(
                pieces, F.transform(found, _resolve), lambda p, e: F.concat(p, F.coalesce(e, F.lit("")))
            ),
            "",
        )

    def choose(doc: Column) -> Column:
        return F.when(doc.rlike(_RARE), general(doc)).otherwise(doc)

    def closed(doc: Column) -> Column:
        return F.regexp_replace(doc, _BARE, "&$1;")

    return bind(
        c, lambda doc: F.when(F.contains(doc, F.lit("&")), bind(frequent(closed(doc)), choose)).otherwise(doc)
    )


def decode_late(c: Column) -> Column:
    """Resolve the five syntax entities, ``&amp;`` last."""
    for name, plain in _LATE:
        c = F.replace(c, F.lit(name), F.lit(plain))
    return c


def escape_markup(c: Column, quotes: bool = False) -> Column:
    """Escape ``& < >`` (and both quotes) for markup output."""
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")]
    if quotes:
        pairs += [('"', "&quot;"), ("'", "&#039;")]
    for plain, name in pairs:
        c = F.replace(c, F.lit(plain), F.lit(name))
    return c


def contains_any(c: Column, words: list[str]) -> Column:
    """True where the text contains at least one of ``words``."""
    out = F.contains(c, F.lit(words[0]))
    for word in words[1:]:
        out = out | F.contains(c, F.lit(word))
    return out


def word_tokens(c: Column) -> Column:
    """Lower-case alphanumeric tokens."""
    return split_at(F.lower(c), "[^a-z0-9]+")
