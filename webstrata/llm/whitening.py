"""Whitening of embeddings by incremental eigendecomposition.

Every task keeps the spectrum of the scatter matrix of the rows it has seen and adds each centred row
as a rank-one update: the row is turned into the current eigenvectors, entries that change nothing
and equal eigenvalues are deflated, the new eigenvalues are the roots of the secular equation and
the new eigenvectors follow from them. Spectra of tasks are combined in a tree; one spectrum is added to
another as successive rank-one updates with its scaled eigenvectors. The combined eigenvectors are the basis of
a last Rayleigh-Ritz step over all rows: the covariance is measured in that basis, task by task,
and its small eigenproblem turns the basis, which brings the result to double precision whatever the
updates have lost.

Between tasks and the driver go a row of sums and a few square matrices of the vectors' dimension per
task, never vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webstrata.session import written

#: Vectors are fitted as whole numbers, floor(SCALE * entry) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: Components that are returned.
COMPONENTS = 8
#: Spectra that one task combines in a round of the tree.
FAN_IN = 16
#: Entries beyond it have no whole number that a double tells from the next.
LARGEST = float(1 << 42)

_EPS = np.finfo(float).eps
_LONGEST = (1 << 63) - 1

RESULT = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def secular(poles: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Eigenvalues of diag(poles) + z z' less each pole, a row per eigenvalue, for ascending poles and z without zeros.

    Root k lies between pole k and the next; it is sought as a distance from the nearer of the two, so
    that the differences keep their digits. Steps follow the rational function through the value
    and the slopes of both sides; a step out of its bracket halves the bracket.
    """
    m, squares = len(poles), z * z
    top = poles[-1] + squares.sum()
    right = np.append(poles[1:], top)
    gap = right - poles
    away = poles[None, :] - poles[:, None]  # of pole j from pole k
    middle = 1 + (squares / (away - gap[:, None] / 2)).sum(1)
    near_left = (middle >= 0) | (np.arange(m) == m - 1)
    origin = np.where(near_left, np.arange(m), np.minimum(np.arange(m) + 1, m - 1))
    away = poles[None, :] - poles[origin][:, None]
    low = np.where(near_left, 0.0, -gap / 2)
    high = np.where(near_left, gap / 2, 0.0)
    if middle[-1] < 0:
        low[-1], high[-1] = gap[-1] / 2, gap[-1]
    t = (low + high) / 2
    own = away[np.arange(m), np.arange(m)]
    following = np.append(away[np.arange(m - 1), np.arange(1, m)], 0.0)
    lower = np.tri(m, dtype=bool)
    for _ in range(80):
        apart = away - t[:, None]
        terms = squares / apart
        slopes = terms / apart
        value = 1 + terms.sum(1)
        done = (np.abs(value) <= 4 * m * _EPS * (1 + np.abs(terms).sum(1))) | (high - low <= 2 * _EPS * np.maximum(np.abs(low), np.abs(high)))
        if done.all():
            break
        low, high = np.where(value < 0, t, low), np.where(value >= 0, t, high)
        left_slope = np.where(lower, slopes, 0.0).sum(1)
        right_slope = slopes.sum(1) - left_slope
        p, q = own - t, following - t
        a, b = left_slope * p * p, right_slope * q * q
        with np.errstate(all="ignore"):
            c = value - a / p - np.where(b > 0, b / q, 0.0)
            # c + a / (p - s) + b / (q - s) = 0
            linear = c * (p + q) + a + b
            constant = c * p * q + a * q + b * p
            root = np.sqrt(np.maximum(linear * linear - 4 * c * constant, 0.0))
            step = np.where(linear > 0, 2 * constant / (linear + root), (linear - root) / (2 * c))
            step[-1] = p[-1] + a[-1] / c[-1]
            new = t + step
        t = np.where(done, t, np.where((new > low) & (new < high), new, (low + high) / 2))
    return t[:, None] - away


@dataclass
class Spectrum:
    """Ascending eigenvalues and eigenvectors (columns) of a scatter matrix."""

    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def empty(cls, d: int) -> Spectrum:
        return cls(np.zeros(d), np.eye(d))

    def add(self, row: np.ndarray) -> None:
        """Add the rank-one matrix row row'."""
        values, vectors = self.values, self.vectors
        z = row @ vectors
        size = float(np.sqrt(z @ z))
        if not size:
            return
        limit = 8 * _EPS * max(float(values[-1]), size * size)
        kept = np.abs(z) * size > limit
        at = np.flatnonzero(kept)
        for i, j in zip(at, at[1:]):  # equal eigenvalues: turn the pair so that only the later one changes
            difference = values[j] - values[i]
            if difference <= limit:
                r = np.hypot(z[i], z[j])
                cos, sin = z[j] / r, z[i] / r
                if abs(difference * cos * sin) <= limit:
                    z[i], z[j] = 0.0, r
                    vectors[:, [i, j]] = vectors[:, [i, j]] @ np.array([[cos, sin], [-sin, cos]])
                    kept[i] = False
        at = np.flatnonzero(kept)
        poles = values[at]
        beyond = secular(poles, z[at])  # eigenvalue k less pole j
        apart = poles[:, None] - poles[None, :]
        np.fill_diagonal(apart, 1.0)
        exact = np.sqrt(np.abs(np.prod(beyond / apart, axis=0)))  # the z whose eigenvalues these are exactly
        turn = np.copysign(exact, z[at])[:, None] / -beyond.T
        turn /= np.sqrt((turn * turn).sum(0))
        new = values.copy()
        new[at] = poles + np.diagonal(beyond)
        vectors = vectors.copy()
        vectors[:, at] = vectors[:, at] @ turn
        order = np.argsort(new, kind="stable")
        self.values, self.vectors = new[order], vectors[:, order]

    def merge(self, other: Spectrum) -> None:
        """Add another spectrum, eigenvector by eigenvector."""
        for value, vector in zip(other.values, other.vectors.T):
            if value > 0:
                self.add(np.sqrt(value) * vector)


def _matrix(column: pa.Array, kind) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(flat), -1)


def fit_list(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and x, the whole numbers of every usable vector of the most common length (of ties, the shorter)."""
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    fits = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST))
    rows = rows.where(F.col("v").isNotNull() & F.coalesce(fits, F.lit(False)))
    x = F.transform("v", lambda c: F.floor(c * SCALE) + SHIFT).cast("array<bigint>")
    rows = written(rows.select("vec_id", x.alias("x")), "whole-vectors")
    size = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("x") == (size["d"] if size else 0))


def sums(rows: DataFrame) -> tuple[int, list[int]]:
    """Number of rows and the exact sum of each entry of ``x``; a row per task reaches the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, 0, 0
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0), np.int64)
                n, high, low = n + len(x), high + (x >> 24).sum(0), low + (x & 0xFFFFFF).sum(0)
        if n:
            yield pa.RecordBatch.from_pydict({"n": [n], "high": [high], "low": [low]})

    parts = rows.select("x").mapInArrow(add, "n bigint, high array<bigint>, low array<bigint>").collect()
    total = [sum((h << 24) + lo for h, lo in pairs) for pairs in zip(*(zip(r["high"], r["low"]) for r in parts))]
    return sum(r["n"] for r in parts), total


@dataclass(frozen=True)
class Centre:
    """The exact mean total / n as a whole number and a rest."""

    n: int
    total: list[int]

    def __post_init__(self):
        whole = [s // self.n for s in self.total]
        object.__setattr__(self, "whole", np.array(whole, np.int64))
        object.__setattr__(self, "rest", np.array([(s - self.n * w) / self.n for s, w in zip(self.total, whole)]))

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.rest

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of (n x - total)^2, exact; none where it is no long."""
        near = x - self.whole
        most = (float(np.abs(near).max(initial=0)) + 1) * self.n
        off = np.array([s - self.n * int(w) for s, w in zip(self.total, self.whole)], object)
        if most * most * x.shape[1] < float(1 << 62):
            return ((self.n * near - off.astype(np.int64)) ** 2).sum(1).tolist()
        exact = ((self.n * near.astype(object) - off) ** 2).sum(1)
        return [int(e) if e <= _LONGEST else None for e in exact]


def spectrum(rows: DataFrame, centre: Centre) -> Spectrum:
    """The spectrum of the scatter matrix of all rows: rank-one updates in every task, a tree of merges."""
    d = len(centre.total)

    def packed(part: int, found: Spectrum) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([part]), pa.array([found.values.tobytes()], pa.binary()), pa.array([found.vectors.tobytes()], pa.binary())],
            ["part", "eigenvalues", "eigenvectors"],
        )

    def unpacked(values: bytes, vectors: bytes) -> Spectrum:
        return Spectrum(np.frombuffer(values).copy(), np.frombuffer(vectors).reshape(d, d).copy())

    def update(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, seen = Spectrum.empty(d), False
        for batch in batches:
            if batch.num_rows:
                seen = True
                different, times = np.unique(_matrix(batch.column(0), np.int64), axis=0, return_counts=True)
                for row, k in zip(centre.centred(different), times):
                    found.add(np.sqrt(float(k)) * row)
        if seen:
            yield packed(TaskContext.get().partitionId(), found)

    def combine(key, table):
        found = Spectrum.empty(d)
        for values, vectors in zip(table["eigenvalues"].to_pylist(), table["eigenvectors"].to_pylist()):
            found.merge(unpacked(values, vectors))
        return pa.Table.from_batches([packed(key[0].as_py(), found)])

    kinds = "part bigint, eigenvalues binary, eigenvectors binary"
    parts = written(rows.select("x").mapInArrow(update, kinds), "spectra")
    most = parts.agg(F.max("part")).first()[0]
    while most > 0:
        most //= FAN_IN
        parts = written(parts.withColumn("part", F.floor(F.col("part") / FAN_IN)).groupBy("part").applyInArrow(combine, kinds), "spectra")
    row = parts.first()
    return unpacked(row["eigenvalues"], row["eigenvectors"])


def summed(rows: DataFrame, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of the square matrices that ``of`` makes of blocks of ``x``: per task, then per group of tasks, then on the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for batch in batches:
            if batch.num_rows:
                total = total + of(_matrix(batch.column(0), np.int64))
        if np.ndim(total):
            yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId() // 256], "m": pa.array([total.tobytes()], pa.binary())})

    def combine(key, table):
        total = np.sum([np.frombuffer(m) for m in table["m"].to_pylist()], axis=0)
        return pa.table({"m": pa.array([total.tobytes()], pa.binary())})

    found = rows.select("x").mapInArrow(add, "part bigint, m binary").groupBy("part").applyInArrow(combine, "m binary").collect()
    total = np.sum([np.frombuffer(r["m"]) for r in found], axis=0)
    side = int(round(len(total) ** 0.5))
    return total.reshape(side, side)


@dataclass(frozen=True)
class Whitening:
    """Components (columns, unit length) with their eigenvalues, and the trace of the covariance."""

    centre: Centre
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    def apply(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows; not a number for components without variance."""
        with np.errstate(all="ignore"):
            return self.centre.centred(x) @ self.components / np.sqrt(np.where(self.eigenvalues > 0, self.eigenvalues, np.nan))


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening:
    """The leading components of the covariance of all rows ``x``; there must be one."""
    centre = Centre(*sums(rows))
    basis = np.linalg.qr(spectrum(rows, centre).vectors)[0]

    def ritz(x: np.ndarray) -> np.ndarray:
        turned = centre.centred(x) @ basis
        return turned.T @ turned

    small = summed(rows, ritz) / centre.n
    values, turn = np.linalg.eigh((small + small.T) / 2)
    values = np.where(values > len(values) * _EPS * max(values[-1], 0.0), values, 0.0)[::-1][:components]
    found = (basis @ turn)[:, ::-1][:, :components]
    return Whitening(centre, found * np.sign(found[np.abs(found).argmax(0), np.arange(found.shape[1])]), values, float(np.trace(small)))


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per usable vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Vectors that are null, hold an entry that is null, not finite or of 2^42 and more, or have another
    length than most take no part; those of length zero have no components. Ids may be null or
    repeat: every vector counts and gets its rows. ``deviation`` is null where it exceeds a long.
    A component without variance (equal vectors, fewer vectors than entries) has null ``whitened``,
    ``explained`` of zero, null if there is no variance at all, and does not enter ``identity_error``,
    which is null if no component does. An empty table gives no rows; other columns are ignored.
    """
    spark: SparkSession = vectors.sparkSession
    rows = fit_list(vectors, id_col, vector_col)
    if rows.where(F.size("x") > 0).isEmpty():
        return spark.createDataFrame([], RESULT)
    found = fit(rows, components)
    real = found.eigenvalues > 0
    if real.any():

        def outer(x: np.ndarray) -> np.ndarray:
            own = np.c_[np.ones(len(x)), found.apply(x)[:, real]]
            return own.T @ own

        moments = summed(rows, outer) / found.centre.n
        error = float(np.abs(moments[1:, 1:] - np.outer(moments[0, 1:], moments[0, 1:]) - np.eye(int(real.sum()))).max())
    else:
        error = None
    share = (found.eigenvalues / found.trace).tolist() if found.trace > 0 else [None] * len(found.eigenvalues)
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = len(share)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1), np.int64)
            values = found.apply(x)
            each = np.repeat(np.arange(len(x)), m)
            columns = [
                batch.column(0).take(pa.array(each)),
                pa.array(np.tile(np.arange(1, m + 1), len(x)), kinds[1]),
                pa.array([found.centre.n] * (m * len(x)), kinds[2]),
                pa.array(found.centre.deviations(x), kinds[3]).take(pa.array(each)),
                pa.array(values.ravel(), kinds[4], mask=np.isnan(values.ravel())),
                pa.array(share * len(x), kinds[5]),
                pa.array([error] * (m * len(x)), kinds[6]),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(emit, RESULT)
