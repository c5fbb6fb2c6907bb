"""The trie of conversation prefixes by truncation peeling.

Work goes from the deepest turn up. At a depth, the conversations that end there are merged with what
survives from below, equal prefixes become one node, its last turn is stripped and the rest is grouped
again one turn higher; members, children, leaves and savings are summed on the way, so that nodes are
found and aggregated in the same pass.

A prefix is known by 124 bits: the sum, over its turns, of a hash of turn and place. Sums need no order,
so places and prefixes of a conversation of any length come from ranges of its turns and one row per
range; no conversation has to meet in one task. Equal whole conversations are one class with a count
before peeling starts. Subtrees of bounded size are peeled within a task, in one sweep over rows sorted
by falling depth that keeps two neighbouring depths only. The depths above them, where some node holds
too much for a task, are peeled one Spark aggregation each, with partial aggregation per task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webstrata.session import written

#: Conversations of so many ids in a row begin like the first of them.
GROUP = 20
#: At most so many turns, less one, are taken from that first conversation.
TAKEN = 4
#: Rows of a subtree that one task peels: a 256th of all, within these bounds.
LEAST, MOST = 1_000, 1_000_000
#: Ids that are joined before they are sent to the task that digests them.
IDS = 512

_MASK = (1 << 62) - 1
_NO_ENDS = hashlib.sha256(b"").hexdigest()

RESULT = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"


def running(rows: DataFrame, key: str, order: list[str], lanes: list[str]) -> DataFrame:
    """``rows`` with the running sum (modulo 2^62) of every lane within its key, the row itself included.

    Rows are sorted in ranges of (key, order), and a row per range hands on the sums of the key that
    goes on in the next one. Columns are whole numbers, key and lanes not null.
    """
    sums = [f"{lane}_sum" for lane in lanes]
    ordered = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, last, before = TaskContext.get().partitionId(), 0, None, np.zeros(len(lanes), np.int64)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = batch.column(batch.schema.get_field_index(key)).to_numpy()
            starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            runs = np.diff(np.append(starts, n))
            found = []
            for k, lane in enumerate(lanes):
                total = np.cumsum(batch.column(batch.schema.get_field_index(lane)).to_numpy())  # wraps, as wanted
                base = np.append(0, total[starts[1:] - 1])
                if keys[0] == last:
                    base[0] -= before[k]
                found.append((total - np.repeat(base, runs)) & _MASK)
            last, before = keys[-1], np.array([f[-1] for f in found])
            more = [pa.array(np.full(n, part)), pa.array(at + np.arange(n)), *[pa.array(f) for f in found]]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "__part", "__at", *sums])
            at += n

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields]
    kinds += [f"{c} bigint" for c in ("__part", "__at", *sums)]
    found = written(ordered.mapInArrow(walk, ", ".join(kinds)), "running")
    ends = found.groupBy("__part").agg(F.min(key).alias("first"), F.max(key).alias("last"), *[F.max_by(s, "__at").alias(s) for s in sums])
    carried, last, total = [], None, [0] * len(lanes)
    for r in sorted(ends.collect(), key=lambda r: r["__part"]):  # a row per range
        before = total if r["first"] == last else [0] * len(lanes)
        if any(before):
            carried.append((r["__part"], r["first"], *before))
        goes_on = before if r["first"] == r["last"] else [0] * len(lanes)
        last, total = r["last"], [(r[s] + b) & _MASK for s, b in zip(sums, goes_on)]
    carry = found.sparkSession.createDataFrame(carried, ", ".join(["__part bigint", "__first bigint", *[f"__{s} bigint" for s in sums]]))
    joined = found.join(F.broadcast(carry), "__part", "left")
    add = lambda s: (F.col(s) + F.when(F.col("__first") == F.col(key), F.col(f"__{s}")).otherwise(0)).bitwiseAND(F.lit(_MASK))
    return joined.select(*[F.col(f"`{c}`") for c in rows.columns], *[add(s).alias(s) for s in sums])


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1), two halves of a hash of role and text, and words, for every turn that has a conv_id."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    half = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("bigint")
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").alias("turn"),
        role.alias("role"),
        half(1).alias("x"),
        half(16).alias("y"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("words"),
        F.lit(1).cast("bigint").alias("one"),
        F.monotonically_increasing_id().alias("row"),
    )
    # the row number is fixed by writing; it lets rows that are equal in all else go to different ranges
    rows = running(written(rows, "turns"), "conv_id", ["turn", "role", "x", "y", "row"], ["one"])
    return written(rows.select("conv_id", F.col("one_sum").alias("place"), "x", "y", "words"), "placed-turns")


def rebuild(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, total) and their turns (conv_id, place, total, words, a, b) after rebuilding.

    A conversation takes its first turns, as many as the hash of its id says, from the first
    conversation of its group of ids and goes on with its own turns after as many.
    """
    c = F.col("conv_id")
    taken = F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(TAKEN))
    heads = placed.where((c % GROUP == 0) & (F.col("place") < TAKEN)).groupBy(c.alias("first")).agg(
        F.sort_array(F.collect_list(F.struct("place", "x", "y", "words"))).alias("head")  # fewer than TAKEN entries
    )
    lengths = placed.groupBy("conv_id").agg(F.max("place").alias("length")).select("conv_id", "length", (c - c % GROUP).alias("first"), taken.alias("taken"))
    begun = lengths.join(heads, "first", "left").withColumn("head", F.slice(F.coalesce("head", F.array().cast(heads.schema["head"].dataType)), F.lit(1), F.col("taken").cast("int")))
    begun = begun.withColumn("begins", F.size("head").cast("bigint"))
    convs = written(begun.withColumn("total", F.col("begins") + F.greatest(F.col("length") - F.col("taken"), F.lit(0))).drop("length", "first"), "rebuilt")
    own = placed.join(convs.drop("head"), "conv_id").where(F.col("place") > F.col("taken"))
    own = own.select("conv_id", (F.col("place") - F.col("taken") + F.col("begins")).alias("place"), "total", "words", "x", "y")
    inherited = convs.where("begins > 0").select("conv_id", "total", F.explode("head").alias("h")).select("conv_id", "h.place", "total", "h.words", "h.x", "h.y")
    lane = lambda seed: F.xxhash64("x", "y", "place", F.lit(seed)).bitwiseAND(F.lit(_MASK))
    rows = own.unionByName(inherited).select("conv_id", "place", "total", "words", lane(1).alias("a"), lane(2).alias("b"))
    return convs.select("conv_id", "total"), rows


def prefixes(rows: DataFrame) -> DataFrame:
    """conv_id, place, total, words, (a, b) of the prefix that ends at the turn and (up_a, up_b) of the one before."""
    found = running(rows, "conv_id", ["place"], ["a", "b"])
    before = lambda k: (F.col(f"{k}_sum") - F.col(k)).bitwiseAND(F.lit(_MASK))
    return written(
        found.select("conv_id", "place", "total", "words", before("a").alias("up_a"), before("b").alias("up_b"), F.col("a_sum").alias("a"), F.col("b_sum").alias("b")),
        "prefixes",
    )


def classes(ended: DataFrame) -> DataFrame:
    """Equal whole conversations (a, b, conv_id) as one row: a, b, conv_id (least), n, ends (hash of their ids in order).

    A digest can only be taken in order. Ids are sorted and joined range by range, so a very large
    class is sent as a few long strings, which its task digests one after the other.
    """
    ordered = ended.select("a", "b", "conv_id").repartitionByRange("a", "b", "conv_id").sortWithinPartitions("a", "b", "conv_id")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(k).to_pylist() for k in range(3)))
            out = []
            for key, run in groupby(rows, lambda r: r[:2]):
                ids = [r[2] for r in run]
                out += [(*key, ids[k], len(ids[k : k + IDS]), ",".join(map(str, ids[k : k + IDS]))) for k in range(0, len(ids), IDS)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)] if out else [pa.array([], t) for t in kinds], names)

    names, kinds = ["a", "b", "conv_id", "n", "ids"], [*[pa.int64()] * 4, pa.string()]
    joined = ordered.mapInArrow(join, "a bigint, b bigint, conv_id bigint, n bigint, ids string")
    joined = joined.repartition("a", "b").sortWithinPartitions("a", "b", "conv_id")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, least, n, state = None, None, 0, None
        for batch in batches:
            out = []
            for a, b, conv, k, ids in zip(*(batch.column(c).to_pylist() for c in range(5))):
                if (a, b) != key:
                    if key:
                        out.append((*key, least, n, state.hexdigest()))
                    key, least, n, state = (a, b), conv, 0, hashlib.sha256()
                state.update((("," if n else "") + ids).encode())
                n += k
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["a", "b", "conv_id", "n", "ends"])
        if key:
            yield pa.RecordBatch.from_pydict({"a": [key[0]], "b": [key[1]], "conv_id": [least], "n": [n], "ends": [state.hexdigest()]})

    return written(joined.mapInArrow(digest, "a bigint, b bigint, conv_id bigint, n bigint, ends string"), "classes")


NODE = "a bigint, b bigint, up_a bigint, up_b bigint, depth bigint, conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string, parent_conv_id bigint"


def peel(rows: DataFrame, top: int) -> DataFrame:
    """Nodes of the subtrees below depth ``top`` - 1, whose rows meet by (top_a, top_b); those at ``top`` have no parent yet.

    A sweep over rows of falling depth: at a change of depth what has been stripped becomes what
    survives. A node is handed to its parent and leaves the task once the parent's least member is known.
    """
    names = [c.split()[0] for c in NODE.split(", ")]
    kinds = [pa.string() if c.endswith("string") else pa.int64() for c in NODE.split(", ")]
    columns = ["top_a", "top_b", "place", "a", "b", "up_a", "up_b", "words", "conv_id", "n", "ends"]
    ordered = rows.select(*columns).repartition("top_a", "top_b").sortWithinPartitions("top_a", "top_b", F.desc("place"), "a", "b")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        here, below, above, node = None, {}, {}, None

        def close() -> None:
            """The node is complete: what survives from below joins it, and it goes up without its last turn."""
            a, b, up, depth, words, n, least, ends = node
            k, m, children, leaves, saved, pending = below.pop((a, b), (0, None, 0, 0, 0, ()))
            n += k
            least = m if least is None else least if m is None else min(least, m)
            saved += (n - 1) * words
            out.extend((*child, least) for child in pending)
            row = (a, b, *up, depth, least, n, children, leaves or 1, saved, ends or _NO_ENDS)
            if depth == top:
                out.append((*row, None))
                return
            s = above.get(up)
            if s is None:
                above[up] = [n, least, 1, leaves or 1, saved, [row]]
            else:
                s[0] += n
                s[1] = min(s[1], least)
                s[2] += 1
                s[3] += leaves or 1
                s[4] += saved
                s[5].append(row)

        for batch in batches:
            for top_a, top_b, depth, a, b, up_a, up_b, words, conv, n, ends in zip(*(c.to_pylist() for c in batch.columns)):
                if node is not None and (here != (top_a, top_b, depth) or node[:2] != [a, b]):
                    close()
                    node = None
                if here != (top_a, top_b, depth):
                    below, above = above, {}
                    here = (top_a, top_b, depth)
                if node is None:
                    node = [a, b, (up_a, up_b), depth, words, 0, None, None]
                if n:  # a class of conversations that end here
                    node[5:] = [n, conv, ends]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
                out.clear()
        if node is not None:
            close()
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return written(ordered.mapInArrow(sweep, NODE), "peeled")


def peel_level(paths: DataFrame, survivors: DataFrame, depth: int) -> DataFrame:
    """Nodes at a depth, from the conversations that end there and the survivors stripped to it: one aggregation."""
    zero, no = F.lit(0).cast("bigint"), lambda kind: F.lit(None).cast(kind)
    here = paths.where(F.col("place") == depth).select(
        "a", "b", "up_a", "up_b", "words", "n", F.when(F.col("n") > 0, F.col("conv_id")).alias("least"), zero.alias("child"), zero.alias("leaves"), zero.alias("saved"), "ends"
    )
    stripped = survivors.select(
        F.col("up_a").alias("a"), F.col("up_b").alias("b"), no("bigint").alias("up_a"), no("bigint").alias("up_b"), no("bigint").alias("words"),
        F.col("n_convs").alias("n"), F.col("conv_id").alias("least"), F.lit(1).cast("bigint").alias("child"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"), no("string").alias("ends"),
    )
    found = here.unionByName(stripped).groupBy("a", "b").agg(
        F.max("up_a").alias("up_a"), F.max("up_b").alias("up_b"), F.max("words").alias("words"), F.sum("n").alias("n_convs"), F.min("least").alias("conv_id"),
        F.sum("child").alias("n_children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.max("ends").alias("ends"),
    )
    return written(
        found.select(
            "a", "b", "up_a", "up_b", F.lit(depth).cast("bigint").alias("depth"), "conv_id", "n_convs", "n_children", F.greatest("leaves", F.lit(1)).alias("n_leaves"),
            (F.col("saved") + (F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"), F.coalesce("ends", F.lit(_NO_ENDS)).alias("ends_sha256"),
        ),
        "level",
    )


def prefix_trie(conversations: DataFrame, limit: int | None = None) -> DataFrame:
    """One row per node of the trie of rebuilt conversations: the columns of ``RESULT``.

    ``conversations`` has conv_id, turn, role and text; other columns are ignored. A null role or text
    counts as empty, a null turn comes first; turns of one number are ordered by role and then by a
    hash of the text, so repeated rows are turns of their own. Rows without conv_id belong to no
    conversation. For ids below zero the first id of the group is found by truncation (-5 belongs to
    0). A conversation left without turns is a member of the root alone. Texts of any length count
    whole. An empty table gives no rows, not even a root. ``limit`` bounds the rows of a subtree
    that one task peels; the result does not depend on it.
    """
    spark = conversations.sparkSession
    convs, rows = rebuild(turns(conversations))
    paths = prefixes(rows)
    zero = F.lit(0).cast("bigint")
    last = F.col("place") == F.col("total")
    ended = paths.where(last).select("a", "b", "conv_id").unionByName(convs.where("total = 0").select(zero.alias("a"), zero.alias("b"), "conv_id"))
    found = classes(ended)
    ends = found.join(convs.where("total > 0"), "conv_id", "left_semi").select("conv_id", "n", "ends")
    paths = written(
        paths.join(ends, "conv_id").select("conv_id", "place", "total", "words", "up_a", "up_b", "a", "b", F.when(last, F.col("n")).otherwise(0).alias("n"), F.when(last, F.col("ends")).alias("ends")),
        "class-paths",
    )
    if limit is None:
        limit = min(MOST, max(LEAST, paths.count() // 256))
    weights = paths.groupBy("place", "a", "b").agg(F.sum(F.col("total") - F.col("place") + 1).alias("weight"))
    deepest = weights.where(F.col("weight") > limit).agg(F.max("place")).first()[0] or 0
    top = deepest + 1
    tops = paths.where(F.col("place") == top).select("conv_id", F.col("a").alias("top_a"), F.col("b").alias("top_b"))
    peeled = peel(paths.where(F.col("place") >= top).join(tops, "conv_id"), top)
    columns = [c.split()[0] for c in RESULT.split(", ")]
    done, survivors = [peeled.where(F.col("depth") > top)], peeled.where(F.col("depth") == top).drop("parent_conv_id")
    for depth in range(deepest, 0, -1):
        level = peel_level(paths, survivors, depth)
        done.append(survivors.join(level.select(F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv_id").alias("parent_conv_id")), ["up_a", "up_b"]))
        survivors = level
    total = lambda c: F.coalesce(F.sum(c), zero)
    below = survivors.agg(F.min("conv_id").alias("least"), total("n_convs").alias("n"), F.count(F.lit(1)).alias("children"), total("n_leaves").alias("leaves"), total("saved_tokens").alias("saved")).first()
    turnless = found.join(convs.where("total = 0"), "conv_id", "left_semi").first()  # one class at most
    if turnless is None and below["n"] == 0:
        return spark.createDataFrame([], RESULT)
    least = min(k for k in (below["least"], turnless and turnless["conv_id"]) if k is not None)
    n = below["n"] + (turnless["n"] if turnless else 0)
    root = (least, 0, None, n, below["children"], below["leaves"] or 1, below["saved"], turnless["ends"] if turnless else _NO_ENDS)
    done.append(survivors.withColumn("parent_conv_id", F.lit(least).cast("bigint")))
    result = spark.createDataFrame([root], RESULT)
    for nodes in done:
        result = result.unionByName(nodes.select(*columns))
    return result
