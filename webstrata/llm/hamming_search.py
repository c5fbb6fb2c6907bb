"""Nearest neighbours by multi-index hashing of learned rotated binary codes.

Rotations learned on a bounded sample (iterative quantisation: the rotation that brings the vectors
nearest to their signs) turn every vector into a binary code. A code is split into 16-bit
substrings and each is indexed. By the pigeonhole principle a code within Hamming radius r has a
substring within r / tables of the query's, so probing the buckets that near to the query retrieves
every code within r; these are compared in full and reranked by the cosine of the original vectors.
A query with too few codes in its radius widens it.

All rows are indexed, in blocks of bounded size on shared files. Every block answers all queries, in
groups of bounded size, with its own nearest few; the best of these are the answer, so neither a very
common vector nor the number of rows meets in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webstrata.session import written

#: Bits of a code; a multiple of 64.
BITS = 128
#: Radius that is always retrieved in full.
RADIUS = 60
#: Codes that a block looks at, at least, for each neighbour asked for.
ENOUGH = 40
#: Rows, in expectation, that the rotations are learned on, and rounds of learning.
SAMPLE, ROUNDS = 8000, 20
#: Rows of an index block and of a query group.
BLOCK, GROUP = 8192, 2048

_ONES = np.bitwise_count(np.arange(1 << 16, dtype=np.uint16)).astype(np.uint8)


def usable(vector: Column) -> Column:
    """Neither null nor zero, and every component a finite number."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def learn(vectors: np.ndarray, bits: int = BITS, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Mean and rotations (dimension x bits), each block of columns an orthogonal matrix of its own."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    mean = unit.mean(0)
    x = unit - mean
    d = x.shape[1]
    random, turns = np.random.default_rng(7), []
    for _ in range(-(-bits // d)):
        turn = np.linalg.qr(random.standard_normal((d, d)))[0]
        for _ in range(rounds):
            u, _, v = np.linalg.svd(x.T @ np.where(x @ turn > 0, 1.0, -1.0))
            turn = u @ v
        turns.append(turn)
    return mean, np.concatenate(turns, 1)[:, :bits]


def codes(vectors: np.ndarray, mean: np.ndarray, turns: np.ndarray) -> np.ndarray:
    """Substrings of the codes: 16-bit numbers, a row per vector."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.packbits((unit - mean) @ turns > 0, axis=1).view(np.uint16)


class Block:
    """The index of some rows: for every substring, its different values and the rows that have each."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, parts: np.ndarray):
        self.ids, self.vectors, self.parts = ids, vectors, parts
        self.norms = np.sqrt((vectors * vectors).sum(1))
        self.tables = []
        for column in parts.T:
            order = np.argsort(column, kind="stable")
            values, counts = np.unique(column[order], return_counts=True)
            self.tables.append((order, values, counts))

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Every row whose code differs from ``code`` in at most ``radius`` bits."""
        near = radius // len(self.tables)
        hit = np.zeros(len(self.ids), bool)
        for part, (order, values, counts) in zip(code, self.tables):
            probed = _ONES[values ^ part] <= near
            hit[order[np.repeat(probed, counts)]] = True
        rows = np.flatnonzero(hit)
        return rows[_ONES[self.parts[rows] ^ code].sum(1, dtype=np.int64) <= radius]

    def nearest(self, own: int, vector: np.ndarray, code: np.ndarray, k: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and cosines of the best rows; the radius grows until there are enough rows to choose from, or all."""
        bits = 16 * len(self.tables)
        while True:
            rows = self.within(code, radius)
            rows = rows[self.ids[rows] != own]
            if len(rows) >= k * ENOUGH or radius >= bits:
                break
            radius = min(bits, radius + 2 * len(self.tables))
        score = (self.vectors[rows] * vector).sum(1) / (self.norms[rows] * np.sqrt((vector * vector).sum()))
        best = np.lexsort((self.ids[rows], -score))[:k]
        return self.ids[rows[best]], score[best]


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def nearest(
    vectors: DataFrame, queries: Column, k: int = 5, radius: int = RADIUS, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """For each row chosen by ``queries`` its k nearest other rows: query_id, rank, vec_id, score.

    ``queries`` is a condition on the column ``vec_id``. Nearness is the cosine in double precision;
    ties go to the smaller id. Vectors that are null, zero, of another length than most, or hold a
    component that is null or not finite take no part, nor do rows without id. Rows that share the
    query's id are no candidates of it; a repeated id can be found several times, and a repeated
    query row answers once. Empty tables give no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    result = "query_id bigint, rank int, vec_id bigint, score double"
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], result)
    rows = rows.where(F.size("v") == sizes["d"])
    share = min(1.0, SAMPLE / sizes["count"])
    sample = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < share * (1 << 30)).select("v").toArrow()
    known = _matrix(sample.column(0)) if sample.num_rows else np.eye(sizes["d"])
    mean, turns = learn(known)
    names = ["block", "vec_id", "v", "code"]

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            if batch.num_rows:
                block = (part << 32) + (at + np.arange(batch.num_rows)) // BLOCK
                at += batch.num_rows
                found = codes(_matrix(batch.column(1)), mean, turns)
                yield pa.RecordBatch.from_arrays([pa.array(block), batch.column(0), batch.column(1), pa.array([c.tobytes() for c in found], pa.binary())], names)

    indexed = written(rows.mapInArrow(index, "block bigint, vec_id bigint, v array<double>, code binary"), "codes")
    asked = indexed.where(queries).dropDuplicates(["vec_id"]).select(F.col("vec_id").alias("query_id"), F.col("v").alias("qv"), F.col("code").alias("qcode"))
    groups = max(1, -(-indexed.where(queries).count() // GROUP))
    asked = written(asked.withColumn("in_part", F.pmod(F.xxhash64("query_id"), F.lit(groups))), "queries")
    blocks = indexed.select(F.col("block").alias("in_block")).distinct()
    left = indexed.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("part", F.col("part").cast("bigint"))
    right = asked.crossJoin(blocks)  # a stated query set against every block of the index

    def search(key, own: pa.Table, asked: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if own.num_rows and asked.num_rows:
            parts = lambda c: np.frombuffer(b"".join(c.to_pylist()), np.uint16).reshape(len(c), -1)
            block = Block(own["vec_id"].to_numpy(), _matrix(own["v"]), parts(own["code"]))
            wanted, code = _matrix(asked["qv"]), parts(asked["qcode"])
            for k_, q in enumerate(asked["query_id"].to_pylist()):
                ids, scores = block.nearest(q, wanted[k_], code[k_], k, radius)
                out[0].extend([q] * len(ids))
                out[1].extend(ids.tolist())
                out[2].extend(scores.tolist())
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["query_id", "vec_id", "score"])

    found = left.groupBy("block", "part").cogroup(right.groupBy("in_block", "in_part")).applyInArrow(search, "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
