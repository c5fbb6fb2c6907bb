"""Jaccard self-join on word shingles: subsets for small sets, inverted lists for large ones.

Documents with one set of shingles are one node, named by a fingerprint of the set, so exact copies
never meet as pairs. Nodes link when ``100 * intersection >= percent * union``, which for sizes a
and b asks for an overlap of ``need(a, b)``.

*Light* nodes, with at most ``boundary`` shingles, list all their subsets of the sizes an overlap
may need. Of the nodes under one subset of size c the smallest links to every node b with
``need(smallest, b) <= c``, and no other two link that do not both link to it, so one star per
subset finds every component among light nodes.

*Heavy* nodes scan inverted lists over the rarest shingles of each set (prefix filter, ordered by a
count sketch over the whole corpus), with bounds from sizes and positions. The boundary is the
largest size up to which subsets are cheaper than the measured length of the lists.

Lists are worked off in two rounds. First every list links its members to one hub, the member with
the fewest rarer shingles. Then only pairs of different components remain, so a large group of near
copies costs its size, not its square. A pair goes through a bound on the symmetric difference (bit
parities), then through an exact comparison of the whole sets.

Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webstrata.llm.common import id_text, in_slices, one_of_each, without
from webstrata.llm.components import components
from webstrata.llm.shingles import mix, shingle_set
from webstrata.session import written

#: Log2 of the cells of the count sketch: a fixed 8 MB in every task.
SKETCH_BITS = 21
_CHUNK = 4096
#: Bits of a set's parity sketch.
PARITY = 1024
#: Largest size that may be handled by subsets.
LIGHT_MOST = 20
#: Documents handled together.
SLICE = 300
#: Up to so many document ids are sent to all tasks to pick texts; beyond it they are joined by a shuffle.
BROADCAST_IDS = 500_000


def need(a: int, b: int, percent: int) -> int:
    """Smallest overlap with which sets of sizes a and b link."""
    return -(-percent * (a + b) // (100 + percent))


def _need(a: Column, b: Column, percent: int) -> Column:
    return F.floor(((a + b) * F.lit(percent) + F.lit(percent + 99)) / F.lit(100 + percent))


def sketch(docs: DataFrame, width: int, bits: int = SKETCH_BITS) -> np.ndarray:
    """How many documents hold a shingle of each cell (low bits of the hash), over all documents."""
    cells, names = 1 << bits, ["chunk", "counts"]
    schema = pa.schema([("chunk", pa.int32()), ("counts", pa.binary())])

    def rows(counts: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for some in itertools.batched(sorted(counts), 64):
            columns = [pa.array(some, pa.int32()), pa.array([counts[k].tobytes() for k in some], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, np.int64)
        for batch in in_slices(batches, SLICE):
            found = [shingle_set(t, width) for t in batch.column(1).to_pylist()]
            if found:
                np.add.at(total, (np.concatenate(found) & np.uint64(cells - 1)).astype(np.int64), 1)
        table = total.reshape(-1, min(_CHUNK, cells))
        yield from rows({int(k): table[k] for k in np.flatnonzero(table.any(1))})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = np.frombuffer(data, np.int64)
                sums[chunk] = sums[chunk] + part if chunk in sums else part
        yield from rows(sums)

    kinds = "chunk int, counts binary"
    merged = docs.mapInArrow(count, kinds).repartition("chunk").mapInArrow(add, kinds).toArrow()
    out = np.zeros((-(-cells // _CHUNK), min(_CHUNK, cells)), np.int32)
    for chunk, data in zip(merged.column(names[0]).to_pylist(), merged.column(names[1]).to_pylist()):
        out[chunk] = np.minimum(np.frombuffer(data, np.int64), np.iinfo(np.int32).max)
    return out.ravel()


def fingerprint(shingles: np.ndarray) -> int:
    """Signed 64-bit name of a set; 0 is kept for the empty set."""
    if not len(shingles):
        return 0
    h = int(mix(np.array([mix(shingles ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(len(shingles))]))[0])
    return (h or 1) - (1 << 64 if h >> 63 else 0)


def parity(shingles: np.ndarray) -> bytes:
    """Bits that flip once per shingle: two sets differ in at least as many shingles as their bits differ."""
    hit = np.bincount((mix(shingles + np.uint64(7)) % np.uint64(PARITY)).astype(np.int64), minlength=PARITY)
    return np.packbits((hit & 1).astype(bool)).tobytes()


def describe(docs: DataFrame, width: int, percent: int, counts: np.ndarray) -> DataFrame:
    """Per document: doc_id, text_key, node, size; once per node and task also parity, prefix and, if small, the set."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)  # a fixed number of cells
    schema = pa.schema(
        [("doc_id", pa.int64()), ("text_key", pa.int64()), ("node", pa.int64()), ("size", pa.int64()), ("parity", pa.binary()), ("prefix", pa.list_(pa.int64())), ("small", pa.list_(pa.int64()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, seen = shared.value, set()
        for batch in in_slices(batches, SLICE):
            rows = []
            for text in batch.column(1).to_pylist():
                s = shingle_set(text, width)
                node, n = fingerprint(s), len(s)
                if not n or node in seen:
                    rows.append((node, n, None, None, None))
                    continue
                seen.add(node)
                rare = cells[(s & np.uint64(len(cells) - 1)).astype(np.int64)]
                first = n - -(-percent * n // 100) + 1
                order = np.lexsort((s, rare))[:first]
                rows.append((node, n, parity(s), s[order].view(np.int64), s.view(np.int64) if n <= LIGHT_MOST else None))
            columns = [batch.column(0), batch.column(2)] + [pa.array([r[k] for r in rows], schema.field(k + 2).type) for k in range(5)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    return keyed.mapInArrow(run, "doc_id bigint, text_key bigint, node bigint, size bigint, parity binary, prefix array<bigint>, small array<bigint>")


def subset_sizes(size: int, percent: int) -> list[int]:
    """Overlaps that a set of this size may need with a set of any size it can link to."""
    low, high = -(-percent * size // 100), size * 100 // percent
    return sorted({need(size, other, percent) for other in range(low, high + 1)})


def subset_cost(size: int, percent: int) -> int:
    return sum(math.comb(size, c) for c in subset_sizes(size, percent))


def light_edges(nodes: DataFrame, boundary: int, percent: int) -> DataFrame:
    """Edges a, b among nodes (node, size, small) of at most ``boundary`` shingles: a star per subset."""
    schema = pa.schema([("c", pa.int32()), ("subset", pa.int64()), ("node", pa.int64()), ("size", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, 100):
            rows = []
            for node, size, small in zip(*(batch.column(k).to_pylist() for k in range(3))):
                hashes = mix(np.array(small, np.int64).view(np.uint64))
                total = hashes.sum(dtype=np.uint64)
                for c in subset_sizes(size, percent):
                    left_out = np.array(list(itertools.combinations(range(size), size - c)), int).reshape(math.comb(size, c), size - c)
                    for h in (total - hashes[left_out].sum(1, dtype=np.uint64)).view(np.int64).tolist():
                        rows.append((c, h, node, size))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    light = nodes.where(F.col("size") <= boundary).select("node", "size", "small")
    subsets = light.mapInArrow(run, "c int, subset bigint, node bigint, size bigint")
    hubs = subsets.groupBy("c", "subset").agg(F.min(F.struct("size", "node")).alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return (
        subsets.join(hubs, ["c", "subset"])
        .where((F.col("node") != F.col("hub.node")) & (_need(F.col("size"), F.col("hub.size"), percent) <= F.col("c")))
        .select(F.col("hub.node").alias("a"), F.col("node").alias("b"))
        .distinct()
    )


def _fits(x: str, y: str, percent: int) -> Column:
    """Whether two list rows can link: by their sizes, and by what follows their first common shingle."""
    least = _need(F.col(f"{x}.size"), F.col(f"{y}.size"), percent)
    return (F.col(f"{x}.size") - F.col(f"{x}.pos") >= least) & (F.col(f"{y}.size") - F.col(f"{y}.pos") >= least)


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def first_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``node, text`` of the documents named by ``wanted`` (node, doc_id, text_key); the key keeps apart the texts of one id or of none."""
    same = docs["doc_id"].eqNullSafe(wanted["doc_id"]) & (F.xxhash64(docs["text"]) == wanted["text_key"])
    return docs.join(wanted, same).select("node", "text")


def linked(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes that do link, by the parity bound and then by whole sets."""
    spark = pairs.sparkSession
    about = nodes.select("node", "size", "parity", "first_id", "first_key")
    side = lambda x: about.select(*[F.col(c).alias(f"{x}{'' if c == 'node' else '_' + c}") for c in about.columns])

    names = ["a", "b", "a_first_id", "b_first_id", "a_first_key", "b_first_key"]

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = lambda n: batch.column(batch.schema.get_field_index(n))
            if not batch.num_rows:
                continue
            bits = [np.frombuffer(b"".join(col(f"{x}_parity").to_pylist()), np.uint64).reshape(-1, PARITY // 64) for x in "ab"]
            apart = np.bitwise_count(bits[0] ^ bits[1]).sum(1, dtype=np.int64)
            total = col("a_size").to_numpy() + col("b_size").to_numpy()
            least = -(-percent * total // (100 + percent))
            keep = pa.array(total - 2 * least >= apart)
            yield pa.RecordBatch.from_arrays([col(n) for n in names], names).filter(keep)

    rest = pairs.join(side("a"), "a").join(side("b"), "b")
    rest = written(rest.mapInArrow(bound, ", ".join(f"{n} bigint" for n in names)), "pairs")
    wanted = rest.select(F.col("a").alias("node"), F.col("a_first_id").alias("doc_id"), F.col("a_first_key").alias("text_key"))
    wanted = wanted.unionAll(rest.select("b", "b_first_id", "b_first_key")).distinct()
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, SLICE):
            sets = [shingle_set(t, width) for t in batch.column(1).to_pylist()]
            mine = [fingerprint(s) == n for s, n in zip(sets, batch.column(0).to_pylist())]  # two texts may share id and key
            rows = pa.array([s.tobytes() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), rows], ["node", "shingles"]).filter(pa.array(mine, pa.bool_()))

    sets = written(first_texts(docs, wanted).mapInArrow(load, "node bigint, shingles binary").dropDuplicates(["node"]), "sets")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, 200):
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    full = rest.select("a", "b").join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    full = full.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b").select("a", "b", "x", "y")
    return written(full.mapInArrow(compare, "a bigint, b bigint"), "links")


def choose_boundary(lists: DataFrame, percent: int) -> int:
    """The largest size up to which listing subsets costs no more rows than the sets' inverted lists."""
    cost = lists.where(F.col("size") <= LIGHT_MOST).groupBy("size").agg((F.sum("n") / F.countDistinct("node")).alias("scan"))
    scans = {r["size"]: r["scan"] for r in cost.collect()}  # at most LIGHT_MOST rows
    boundary = 0
    for size in range(1, LIGHT_MOST + 1):
        prefix = size - -(-percent * size // 100) + 1
        if subset_cost(size, percent) > prefix + scans.get(size, 0):
            break
        boundary = size
    return boundary


def jaccard_components(
    docs: DataFrame, width: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    A set holds the different shingles of ``width`` words, lower-cased in A-Z and split at ASCII
    white space; with fewer words the whole sequence is one shingle. A null text or one without
    words has an empty set, links with nothing and is its own component. Rows without id take part, but
    never name a component that has an id. Rows that repeat an id count like any other. An empty
    table gives no rows, and other columns are ignored.
    """
    return _components(id_text(docs, id_col, text_col), width, percent).drop("text_key")


def drop_near_copies(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that stand for their component: one id of each stays."""
    found = _components(id_text(docs, id_col, text_col), width, percent)
    gone = found.where("not (doc_id <=> component_id)").select("doc_id", "text_key")
    return without(docs, gone, F.col(id_col).cast("bigint"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))


def drop_all_near_copies(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Exactly one row of ``docs``, with all its columns, per component; every row whose text has no word stays.

    It is the first by id, rows without id last, then by a hash of the text; of rows with that id and text
    one stays (``one_of_each``).
    """
    found = _named(id_text(docs, id_col, text_col), width, percent).where("size > 0")
    found = written(found.select("doc_id", "text_key", (F.col("doc_id").eqNullSafe(F.col("stay.doc_id")) & (F.col("text_key") == F.col("stay.text_key"))).alias("stays")), "stays")
    key = F.col(id_col).cast("bigint"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    again = found.where("stays").groupBy("doc_id", "text_key").count().where("count > 1")
    return one_of_each(without(docs, found.where(~F.col("stays")), *key), again, *key)


def _components(docs: DataFrame, width: int, percent: int) -> DataFrame:
    named = F.when(F.col("size") > 0, F.col("stay.doc_id")).otherwise(F.col("doc_id"))
    return _named(docs, width, percent).select("doc_id", "text_key", F.col("size").alias("n_shingles"), named.alias("component_id"))


def _named(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Per document doc_id, text_key, size and ``stay``, the first (no_id, doc_id, text_key) of its component; null without words."""
    described = written(describe(docs, width, percent, sketch(docs, width)), "described")
    first = described.where("size > 0").groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("first"))
    once = described.where(F.col("prefix").isNotNull()).dropDuplicates(["node"])  # a row per task and node before
    nodes = written(once.drop("doc_id", "text_key").join(first.select("node", F.col("first.doc_id").alias("first_id"), F.col("first.text_key").alias("first_key")), "node"), "nodes")

    rows = nodes.select("node", "size", F.posexplode("prefix").alias("pos", "shingle"))
    rows = rows.repartition("shingle").withColumn("rank", F.shiftleft(F.col("pos").cast("bigint"), 40) + F.pmod(F.xxhash64("node"), F.lit(1 << 40)))
    lists = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("hub_rank")).where("n > 1")
    lists = written(rows.join(lists, "shingle"), "lists")
    boundary = choose_boundary(lists, percent)
    lists = lists.where(F.col("size") >= -(-percent * (boundary + 1) // 100))
    heavy = (F.col("x.size") > boundary) | (F.col("y.size") > boundary)

    hubs = lists.where("rank = hub_rank")
    stars = lists.alias("x").join(hubs.alias("y"), (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.node") != F.col("y.node")) & heavy & _fits("x", "y", percent))
    stars = written(_ordered(stars.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))), "stars")
    edges = linked(stars, nodes, docs, width, percent).unionAll(light_edges(nodes, boundary, percent))
    groups = written(components(edges), "groups")

    grouped = lists.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = grouped.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    grouped = written(grouped.join(mixed.select("shingle"), "shingle", "left_semi").select("shingle", "node", "size", "pos", "component"), "mixed")
    apart = (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.component") != F.col("y.component"))
    rest = grouped.alias("x").join(grouped.alias("y"), apart & heavy & _fits("x", "y", percent))
    rest = _ordered(rest.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))).join(stars, ["a", "b"], "left_anti")
    more = linked(rest, nodes, docs, width, percent)
    joined = groups.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(more)
    groups = components(joined)

    names = groups.join(first, "node").groupBy("component").agg(F.min("first").alias("stay"))
    of_node = groups.join(names, "component").select("node", "stay")
    of_node = first.join(of_node, "node", "left").select("node", F.coalesce("stay", "first").alias("stay"))
    return described.join(of_node, "node", "left").select("doc_id", "text_key", "size", "stay")
