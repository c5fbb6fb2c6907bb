"""Fuzzy line de-duplication by MinHash.

Lines are compared as sets of character shingles of their normal form. Every different line gets a
one-permutation MinHash signature, cut into bands; lines sharing a band are candidates. As in any
bucketed join, each bucket first links its members to one hub, and only pairs of different
components are compared after that, so a large bucket costs its size. Candidates are verified by the
exact Jaccard similarity of their shingle sets. Distributed union-find joins the links, and the first
line of a component (smallest document id, then position) is the one that stays.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webstrata.llm.common import in_slices
from webstrata.llm.components import components
from webstrata.llm.shingles import mix
from webstrata.session import written

#: Characters of a shingle.
WIDTH = 6
#: Bands and hashes per band: a pair at similarity 0.8 shares a band with probability 0.996.
BANDS, ROWS = 14, 5
PERCENT = 80
#: 64-bit words of the bits that bound the difference of two lines.
WORDS = 16
#: Characters whose shingles are hashed together.
BLOCK = 1 << 17
#: Band hashes that meet in one group, and those that a task holds before it puts them out.
GROUP, HELD = 1 << 19, 1 << 21
#: Pairs of lines compared together.
PAIRS = 32
#: Up to so many ids are sent to all tasks; beyond it they are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Up to so many bytes of positions are sent to all tasks; beyond it they are joined by a shuffle.
BROADCAST_BYTES = 64 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_EMPTY = np.iinfo(np.uint64).max
_BLANKS = re.compile(r"[\x20\x09\x0B-\x0D]+")


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def normal_lines(lower: str) -> list[str]:
    """Lines of a text already in lower case, with single spaces and none at the ends; only what needs it is changed."""
    if "  " in lower or any(c in lower for c in "\t\x0b\x0c\r"):
        lower = _BLANKS.sub(" ", lower)
    lines = lower.split("\n")
    if lower[:1] == " " or lower[-1:] == " " or " \n" in lower or "\n " in lower:
        lines = [x.strip(" ") for x in lines]
    return lines


def line_keys(lines: list[str]) -> np.ndarray:
    """A 64-bit key per line."""
    return np.frombuffer(b"".join([blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8).digest() for x in lines]), "<i8")


def signatures(lines: list[str], keys: np.ndarray, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """Band hashes, a row per line. Each shingle falls into one of ``bands * rows`` bins and the least hash of a bin counts;
    an empty bin takes the value of the next full one. A line shorter than a shingle is one shingle, its key."""
    bins = bands * rows
    least = np.full(len(lines) * bins, _EMPTY, np.uint64)
    h, owner = shingle_hashes(lines, width)
    if len(h):
        slot = ((h >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).view(np.int64)
        np.minimum.at(least, slot + owner * bins, mix(h))
    short = np.flatnonzero(np.fromiter(map(len, lines), np.int64, len(lines)) < width)
    least[short * bins] = mix(keys[short].view(np.uint64))
    empty = least == _EMPTY
    gaps, full = np.flatnonzero(empty), np.flatnonzero(~empty)
    table = least.reshape(-1, bins)
    table += np.arange(bins, dtype=np.uint64)
    row = gaps // bins
    own = bins - np.bincount(row, minlength=len(lines))
    ends = own.cumsum()
    source = gaps - np.arange(len(gaps))  # the next full bin, of all lines
    least[gaps] = least[full[np.where(source < ends[row], source, ends[row] - own[row])]]
    out = table[:, ::rows].copy()
    for k in range(1, rows):
        out *= _BASE
        out += table[:, k::rows]
    return mix(out + np.arange(bands, dtype=np.uint64)).view(np.int64)


def shingle_hashes(lines: list[str], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles and the line each belongs to; a line shorter than a shingle has none."""
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    chars = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    if len(chars) < width:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h, have = chars, 1
    for bit in f"{width:b}"[1:]:  # hashes of twice the characters from two neighbours, and one more where the width is odd
        h, have = h[:-have] * np.uint64(pow(int(_BASE), have, 1 << 64)) + h[have:], 2 * have
        if bit == "1":
            h, have = h[:-1] * _BASE + chars[have:], have + 1
    inside = np.ones(len(h), bool)
    ends = sizes.cumsum()
    for k in range(1, width):
        last = ends - k
        inside[last[(last >= 0) & (last < len(h))]] = False
    return mix(h[inside]), np.repeat(np.arange(len(lines)), np.maximum(sizes - width + 1, 0))


def parities(lines: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per line the number of different shingles, and bits that flip once per different shingle."""
    h, owner = shingle_hashes(lines)
    short = np.flatnonzero(np.fromiter(map(len, lines), np.int64, len(lines)) < WIDTH)
    h, owner = np.append(h, mix(keys[short].view(np.uint64))), np.append(owner, short)
    # A shingle is known by its line and the highest bits of its hash that fit beside it.
    left = np.uint64(64 - len(lines).bit_length())
    h = np.sort(owner.view(np.uint64) << left | h >> (np.uint64(64) - left))
    h = h[np.append(True, h[1:] != h[:-1])]
    bits = 64 * WORDS
    place = h >> (left - np.uint64(bits.bit_length() - 1))
    word = (place >> np.uint64(6)).view(np.int64)
    starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
    table = np.zeros(len(lines) * WORDS, np.uint64)
    table[word[starts]] = np.bitwise_xor.reduceat(np.uint64(1) << (place & np.uint64(63)), starts)
    return np.bincount((h >> left).view(np.int64), minlength=len(lines)), table.view(np.int64).reshape(-1, WORDS)


def _blocks(lines: list[str]) -> Iterator[tuple[int, int]]:
    at = total = 0
    for k, line in enumerate(lines):
        total += len(line)
        if total > BLOCK:
            yield at, k + 1
            at, total = k + 1, 0
    if at < len(lines):
        yield at, len(lines)


def _lines(texts: list[str], seen: set[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """All lines of some texts: number per text, keys, which are blank; and the places and texts of the new ones."""
    cut = [normal_lines(t) for t in texts]
    lines = [x for c in cut for x in c]
    keys = line_keys(lines)
    blank = np.fromiter((not x for x in lines), bool, len(lines))
    fresh = []
    for k, (key, line) in enumerate(zip(keys.tolist(), lines)):
        if line and key not in seen:
            seen.add(key)
            fresh.append(k)
    return np.fromiter(map(len, cut), np.int64, len(cut)), keys, blank, np.array(fresh, np.int64), [lines[k] for k in fresh]


def signed_lines(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text_key, lower) with the text replaced by the keys of its lines, null for a blank one.

    The first row of a slice also holds the keys that are new in their task (``fresh``) and their band
    hashes, ``BANDS`` for each, as bytes.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("keys", pa.list_(pa.int64())), ("fresh", pa.binary()), ("bands", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in in_slices(batches, 200):
            counts, keys, blank, fresh, lines = _lines(batch.column(2).to_pylist(), seen)
            new = keys[fresh]
            bands = b"".join([signatures(lines[a:b], new[a:b]).tobytes() for a, b in _blocks(lines)])
            ends = pa.array(np.append(0, counts.cumsum()).astype(np.int32))
            others = [None] * (batch.num_rows - 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.ListArray.from_arrays(ends, pa.array(keys, mask=blank)), pa.array([new.tobytes(), *others], pa.binary()), pa.array([bands, *others], pa.binary())],
                schema=schema,
            )

    return docs.mapInArrow(run, "doc_id bigint, text_key bigint, keys array<bigint>, fresh binary, bands binary")


def band_rows(signed: DataFrame) -> DataFrame:
    """``part, bands, keys``: the bands of every different line of a task, as bytes, dealt by their highest bits.

    There are as many parts as keep some ``GROUP`` bands in each, and a task for every few of them, however
    large the table is.
    """
    rows = signed.select("fresh", "bands").where("bands is not null")
    total = rows.agg(F.sum(F.length("bands").cast("bigint"))).first()[0] or 0
    high = max(5, (total // (8 * GROUP)).bit_length())
    schema = pa.schema([("part", pa.int64()), ("bands", pa.binary()), ("keys", pa.binary())])

    def dealt(bands: list[np.ndarray], keys: list[np.ndarray]) -> pa.RecordBatch:
        band, key = np.concatenate(bands), np.repeat(np.concatenate(keys), BANDS)
        part = (band.view(np.uint64) >> np.uint64(64 - high)).astype(np.uint16 if high <= 16 else np.uint32)
        order = np.argsort(part, kind="stable")
        band, key, part = band[order], key[order], part[order]
        starts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        ends = np.append(starts[1:], len(part))
        cut = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(part[starts].astype(np.int64)), cut(band), cut(key)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, keys, held = [], [], 0
        for batch in in_slices(batches, 1):
            keys.append(np.frombuffer(batch.column(0)[0].as_py(), np.int64))
            bands.append(np.frombuffer(batch.column(1)[0].as_py(), np.int64))
            held += len(bands[-1])
            if held > HELD:
                yield dealt(bands, keys)
                bands, keys, held = [], [], 0
        if held:
            yield dealt(bands, keys)

    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, (1 << high) // 4)
    return rows.mapInArrow(run, "part bigint, bands binary, keys binary").repartition(tasks, "part")


def bucket_rows(rows: DataFrame) -> DataFrame:
    """``band, key, is_hub`` of the bands with two different keys or more, from ``part, bands, keys``.

    All rows of a part meet and are sorted by band: nearly all bands have one key and end here. The
    hub of a bucket is the line that most tasks have (of near copies, the original), then the one of
    the least hash.
    """
    schema = pa.schema([("band", pa.int64()), ("key", pa.int64()), ("is_hub", pa.bool_())])

    def runs(*columns: np.ndarray) -> np.ndarray:
        """Where another value begins."""
        if not len(columns[0]):
            return np.empty(0, np.int64)
        changed = np.zeros(len(columns[0]) - 1, bool)
        for c in columns:
            changed |= c[1:] != c[:-1]
        return np.flatnonzero(np.append(True, changed))

    def many(starts: np.ndarray, total: int) -> np.ndarray:
        """Which rows are in a run of two or more."""
        size = np.diff(np.append(starts, total))
        return np.repeat(size > 1, size)

    def buckets(table: pa.Table) -> pa.Table:
        band, key = (np.frombuffer(b"".join(table.column(c).to_pylist()), np.int64) for c in ("bands", "keys"))
        order = np.argsort(band)
        order = order[many(runs(band[order]), len(band))]
        band, key = band[order], key[order]
        order = np.lexsort((key, band))
        band, key = band[order], key[order]
        starts = runs(band, key)
        seen = np.diff(np.append(starts, len(band)))
        band, key = band[starts], key[starts]
        keep = many(runs(band), len(band))
        band, key, seen = band[keep], key[keep], seen[keep]
        order = np.lexsort((key, mix(key.view(np.uint64)), -seen, band))
        hub = np.zeros(len(band), bool)
        hub[order[runs(band[order])]] = True
        return pa.Table.from_arrays([pa.array(band), pa.array(key), pa.array(hub)], schema=schema)

    return rows.groupBy("part").applyInArrow(buckets, "band bigint, key bigint, is_hub boolean")


@lru_cache(maxsize=2000)
def _shingles(line: str, width: int) -> frozenset[str]:
    return frozenset([line[k : k + width] for k in range(max(1, len(line) - width + 1))])


def similarity(x: str, y: str, width: int = WIDTH) -> tuple[int, int]:
    """Sizes of the intersection and the union of two lines' shingle sets; those of short lines are remembered."""
    a, b = ((_shingles if len(s) <= 1000 else _shingles.__wrapped__)(s, width) for s in (x, y))
    both = len(a & b)
    return both, len(a) + len(b) - both


def overlaps(xs: list[str], ys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``similarity`` of many pairs, by as many bits of the shingles' hashes as fit beside the number of a line.

    A line shorter than a shingle counts as an empty set.
    """
    n = len(xs)
    h, owner = shingle_hashes(xs + ys)
    left = np.uint64(64 - (2 * n).bit_length())
    h = np.sort(owner.view(np.uint64) << left | h >> (np.uint64(64) - left))
    h = h[np.append(True, h[1:] != h[:-1])] if len(h) else h
    owner = (h >> left).view(np.int64)
    sizes = np.bincount(owner, minlength=2 * n)
    h = np.sort(h - ((owner // n * n).view(np.uint64) << left))  # the second of a pair goes beside the first
    both = np.bincount((h[1:][h[1:] == h[:-1]] >> left).view(np.int64), minlength=n)
    return both, sizes[:n] + sizes[n:] - both


def line_texts(keys: DataFrame, docs: DataFrame) -> DataFrame:
    """``key, norm, n, p0 ..`` of the wanted lines: text, number of shingles, and bits that flip once per shingle.

    Two shingle sets differ in at least as many shingles as their bits differ. Up to ``BROADCAST_IDS``
    wanted keys are sent to all tasks, which then put out no other line; more are joined.
    """
    keys = written(keys.distinct(), "wanted-lines")
    few = keys.count() <= BROADCAST_IDS
    sent = docs.sparkSession.sparkContext.broadcast(np.sort(keys.toArrow().column(0).to_numpy())) if few else None

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in in_slices(batches, 200):
            _, keys, _, fresh, lines = _lines(batch.column(0).to_pylist(), seen)
            found = keys[fresh]
            if sent is not None:
                at = np.searchsorted(sent.value, found)
                wanted = np.flatnonzero(np.take(sent.value, at, mode="clip") == found) if len(sent.value) else at[:0]
                found, lines = found[wanted], [lines[k] for k in wanted]
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(lines, pa.string())], ["key", "norm"])

    there = docs.select("lower").mapInArrow(lines, "key bigint, norm string")
    picked = (there if few else there.join(keys, "key")).groupBy("key", "norm").agg(F.lit(1)).select("key", "norm")
    schema = pa.schema([("key", pa.int64()), ("norm", pa.string()), ("n", pa.int64())] + [(f"p{k}", pa.int64()) for k in range(WORDS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, 1000):
            keys, lines = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            found = [parities(lines[a:b], keys[a:b]) for a, b in _blocks(lines)]
            sizes, table = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64), np.empty((0, WORDS), np.int64))
            columns = [batch.column(0), batch.column(1), pa.array(sizes), *(pa.array(np.ascontiguousarray(table[:, k])) for k in range(WORDS))]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    kinds = "key bigint, norm string, n bigint, " + ", ".join(f"p{k} bigint" for k in range(WORDS))
    return written(picked.mapInArrow(run, kinds), "line-texts")


def _near(percent: int) -> Column:
    """Whether the bits of rows x and y allow the similarity: a bound without false dismissals."""
    total = F.col("x.n") + F.col("y.n")
    least = F.floor((total * percent + percent + 99) / (100 + percent))
    apart = sum((F.bit_count(F.col(f"x.p{k}").bitwiseXOR(F.col(f"y.p{k}"))) for k in range(1, WORDS)), F.bit_count(F.col("x.p0").bitwiseXOR(F.col("y.p0"))))
    return apart <= total - 2 * least


def verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs of keys (a, b) whose lines reach ``percent``, by the bound on their bits and then by their whole sets.

    The sets are compared by hashes first; within two shingles of the limit the texts themselves decide.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, PAIRS):
            xs, ys = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            both, union = overlaps(xs, ys)
            above = 100 * both - percent * union
            keep = above >= 0
            for k in np.flatnonzero(np.abs(above) <= 400):
                a, b = similarity(xs[k], ys[k])
                keep[k] = 100 * a >= percent * b
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))

    full = pairs.join(texts.alias("x"), F.col("a") == F.col("x.key")).join(texts.alias("y"), (F.col("b") == F.col("y.key")) & _near(percent))
    return written(full.select("a", "b", F.col("x.norm").alias("x"), F.col("y.norm").alias("y")).mapInArrow(compare, "a bigint, b bigint"), "line-links")


def line_groups(signed: DataFrame, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``node, component`` of the keys of lines that are like another, different line; docs has (lower)."""
    buckets = written(bucket_rows(band_rows(signed)), "buckets")
    hubs = buckets.where("is_hub").select("band", F.col("key").alias("a"))
    stars = buckets.select("band", F.col("key").alias("b")).join(hubs, "band").where("a <> b")
    stars = written(stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "line-stars")
    texts = line_texts(stars.select(F.col("a").alias("key")).unionAll(stars.select("b")), docs)
    groups = written(components(verified(stars, texts, percent)), "line-groups")
    grouped = buckets.join(groups.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    grouped = written(grouped.select("band", "key", "component"), "grouped-buckets")
    mixed = grouped.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    grouped = grouped.join(written(mixed.select("band"), "mixed-bands"), "band", "left_semi")
    # Every line of a bucket is in some star, so its text is there already.
    grouped = written(grouped.join(texts.drop("norm"), "key"), "mixed-buckets")
    apart = (F.col("x.band") == F.col("y.band")) & (F.col("x.key") < F.col("y.key")) & (F.col("x.component") != F.col("y.component"))
    rest = grouped.alias("x").join(grouped.alias("y"), apart & _near(percent))
    rest = rest.select(F.col("x.key").alias("a"), F.col("y.key").alias("b")).distinct().join(stars, ["a", "b"], "left_anti")
    rest = written(rest, "line-rest")
    if rest.count() <= BROADCAST_IDS // 2:  # few lines are left: the others need not be sorted
        texts = texts.join(F.broadcast(rest.select(F.explode(F.array("a", "b")).alias("key")).distinct()), "key", "left_semi")
    more = verified(rest, texts, percent)
    return components(groups.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(more))


def dedup_lines(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, text (the lines that stay), n_lines, n_kept.

    Lines end at line feeds; they are alike when the Jaccard similarity of their shingle sets reaches
    ``percent``, after lower-casing and reducing white space. Of lines joined by a chain of likenesses,
    over all documents, the first stays: the smallest id, then the position. Blank lines stay. A null
    text is one blank line. Lines of rows without id go if a row with an id has a like one; among
    themselves they all stay. Rows repeating an id and text get the same answer. An empty table gives no
    rows; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    lower = rows.select("doc_id", F.xxhash64("text").alias("text_key"), F.lower("text").alias("lower"))
    signed = written(signed_lines(lower), "signed-lines")
    groups = line_groups(signed, lower, percent)
    placed = signed.select("doc_id", "text_key", F.posexplode("keys").alias("pos", "key")).where("key is not null")
    placed = placed.join(groups.withColumnRenamed("node", "key"), "key", "left").select("doc_id", "text_key", "pos", F.coalesce("component", "key").alias("component"))
    placed = written(placed, "line-places")
    firsts = placed.groupBy("component").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1 and first_id is not null")
    firsts = written(firsts, "line-firsts")
    sent = F.broadcast if firsts.count() <= BROADCAST_IDS else lambda rows: rows
    there = written(placed.join(sent(firsts), "component"), "lines-again")
    first_pos = there.where("doc_id = first_id").groupBy("component").agg(F.min("pos").alias("first_pos"))
    gone = there.join(sent(first_pos), "component").where("not (doc_id <=> first_id and pos = first_pos)")
    gone = written(gone.groupBy("doc_id", "text_key").agg(F.collect_set("pos").alias("gone")), "lines-gone")
    gone = gone.select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key"), "gone")
    same = F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.xxhash64("text") == F.col("gone_key"))
    n, positions = gone.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("gone")), F.lit(0))).first()
    joined = rows.join(F.broadcast(gone) if 64 * n + 8 * positions <= BROADCAST_BYTES else gone, same, "left")
    lines = lines_of(F.col("text"))
    stay = F.array_join(F.filter(lines, lambda _, k: ~F.array_contains("gone", k)), "\n")
    whole, n_lines = F.col("gone").isNull(), F.size(lines).cast("bigint")
    n_kept = F.when(whole, n_lines).otherwise(n_lines - F.size("gone"))
    return joined.select("doc_id", F.when(whole, F.col("text")).otherwise(stay).alias("text"), n_lines.alias("n_lines"), n_kept.alias("n_kept"))
