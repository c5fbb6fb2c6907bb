"""Relational element table with interval encoding (open position, close position).

Used for structural questions over a corpus. An element contains another of the same page
exactly when its interval does. Windows are per page and tag, so a task never holds more
than one page's tags of one name.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webstrata.functions import html as H
from webstrata.functions import tables as T
from webstrata.functions.text import explode_rows
from webstrata.session import spread

OPTIONAL_END = ["p", "li", "tr", "td", "th", "dt", "dd", "option"]


def page_nodes(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """``(key, tag, pre, post, shadows)``: one row per element; ``post`` is exclusive.

    Elements close at the next end tag of their name at their depth, so unclosed inline tags do
    no harm. Names with optional ends that are not balanced in a page end at their next sibling.
    """
    pieces = explode_rows(pages, [key], T.tag_pieces(H.markup(F.col(html))), "piece")
    name = T.tag_name(F.col("piece"))
    tokens = (
        pieces.withColumn("name", name)
        .where((F.col("name") != "") & ~F.col("name").isin(H.VOID))
        .select(
            key,
            "pos",
            F.ltrim(F.col("name"), F.lit("/")).alias("tag"),
            F.when(F.col("name").startswith("/"), -1).otherwise(1).alias("step"),
            T.shadows(F.col("piece"), F.col("name")).alias("shadows"),
        )
    )
    # Dealt anew, for a partition of pages holds many times its bytes in tags, and all are sorted.
    tokens = tokens.repartition(spread(pages.sparkSession), key, "tag")
    by_tag = Window.partitionBy(key, "tag").orderBy("pos")
    whole = Window.partitionBy(key, "tag")
    depth = F.sum("step").over(by_tag) + F.when(F.col("step") < 0, 1).otherwise(0)
    numbered = (
        tokens.withColumn("depth", depth)
        .withColumn("loose", F.col("tag").isin(OPTIONAL_END) & (F.sum("step").over(whole) != 0))
        .withColumn("next_same", F.lead("pos").over(by_tag))
        .withColumn("next_level", F.lead("pos").over(Window.partitionBy(key, "tag", "depth").orderBy("pos")))
    )
    post = F.when(F.col("loose"), F.col("next_same")).otherwise(F.col("next_level"))
    return numbered.where("step = 1").select(
        key,
        "tag",
        F.col("pos").alias("pre"),
        F.coalesce(post, F.lit(2**31 - 1)).cast("bigint").alias("post"),
        "shadows",
    )


def contained(nodes: DataFrame, inner: str, outer: str, key: str = "page_id") -> DataFrame:
    """Elements named ``inner`` inside some ``outer``: those that open before the last ``outer`` that opened earlier ends.

    A running maximum per page over the elements of the two names; no pair of elements is formed.
    """
    before = Window.partitionBy(key).orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)
    ends = F.max(F.when(F.col("tag") == outer, F.col("post"))).over(before)
    both = nodes.where(F.col("tag").isin(inner, outer)).withColumn("__ends", ends)
    return both.where((F.col("tag") == inner) & (F.col("__ends") > F.col("pre"))).drop("__ends")


def shadowed_tables(nodes: DataFrame, key: str = "page_id") -> DataFrame:
    """Tables with an ancestor that marks page furniture, looking outwards up to main/article.

    Only tables and ancestors that can decide (furniture, main, article, body) are sorted, per page
    by where they open, and swept once. Of each kind of ancestor the open ones are a stack: what has
    ended by the present place is taken off its top, and what is then on top opened last.
    """
    walls = ("main", "article")
    deciding = F.col("shadows") | F.col("tag").isin(*walls, "body", "table")
    rows = nodes.where(deciding).select(key, "pre", "post", "tag", "shadows")
    rows = rows.repartition(key).sortWithinPartitions(key, "pre")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, begun, open_ = None, False, {}

        def last(kind: str, at: int) -> int:
            stack = open_[kind]
            while stack and stack[-1][1] <= at:
                stack.pop()
            return stack[-1][0] if stack else -1

        for batch in batches:
            keep, verdicts = [], []
            for k, (own, pre, post, tag, shadows) in enumerate(zip(*(c.to_pylist() for c in batch.columns))):
                if not begun or own != page:
                    page, begun, open_ = own, True, {"wall": [], "body": [], "shadow": []}
                if tag == "table":
                    shadow = last("shadow", pre)
                    keep.append(k)
                    verdicts.append(shadow > last("wall", pre) and shadow >= last("body", pre))
                if tag in walls:
                    open_["wall"].append((pre, post))
                    continue
                if tag == "body":
                    open_["body"].append((pre, post))
                if shadows:
                    open_["shadow"].append((pre, post))
            found = batch.select([0, 1]).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*found.columns, pa.array(verdicts, pa.bool_())], [key, "pre", "shadowed"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(sweep, f"`{key}` {kinds[key]}, pre {kinds['pre']}, shadowed boolean")
