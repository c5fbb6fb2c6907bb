import numpy as np
import pytest

from webstrata.llm import whitening as W
from webstrata.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def check(rows, vectors, components=8):
    """Rows (as dicts) against numpy on all vectors; a repeated id must hold equal vectors."""
    x = np.floor(1024 * np.array([v for _, v in vectors], float)).astype(np.int64) + 100_000
    n, d = x.shape
    total = x.sum(0)
    centred = x - total / n
    cov = centred.T @ centred / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    m = min(components, d)
    assert len(rows) == n * m and {r["n"] for r in rows} == {n}
    deviation = {}
    for (k, _), row in zip(vectors, x.tolist()):
        deviation.setdefault(k, set()).add(sum((n * a - int(s)) ** 2 for a, s in zip(row, total)))
    assert all(r["deviation"] in deviation[r["vec_id"]] for r in rows)
    for c in range(m):
        own = [r for r in rows if r["component"] == c + 1]
        assert len(own) == n
        assert own[0]["explained"] == pytest.approx(values[c] / np.trace(cov), rel=1e-9, abs=1e-12)
        if values[c] <= d * 1e-15 * values[0]:
            assert all(r["whitened"] is None for r in own)
            continue
        got = {r["vec_id"]: r["whitened"] for r in own}
        want = {k: v for (k, _), v in zip(vectors, centred @ axes[:, c] / np.sqrt(values[c]))}
        sign = np.sign(sum(got[k] * want[k] for k in got))
        assert max(abs(sign * got[k] - want[k]) for k in got) < 1e-8
    assert {r["identity_error"] for r in rows if r["identity_error"] is None or r["identity_error"] > 1e-9} <= {None}


@pytest.mark.parametrize("kind", ["plain", "repeats", "low rank", "steps"])
def test_updates_give_the_spectrum(kind):
    rng = np.random.default_rng(3)
    rows = rng.standard_normal((90, 12)) * np.linspace(1, 50, 12)
    if kind == "repeats":
        rows = np.repeat(rows[:7], 20, 0)
    elif kind == "low rank":
        rows = rows[:, :3] @ rng.standard_normal((3, 12))
    elif kind == "steps":
        rows = np.round(rows / 40) * 1.0
    one, two = W.Spectrum.empty(12), W.Spectrum.empty(12)
    for k, row in enumerate(rows):
        (one if k % 3 else two).add(row)
    one.merge(two)
    want = rows.T @ rows
    assert np.abs(one.vectors * one.values @ one.vectors.T - want).max() < 1e-9 * np.abs(want).max()
    assert np.abs(one.vectors.T @ one.vectors - np.eye(12)).max() < 1e-9
    assert np.all(np.diff(one.values) >= 0)


def test_secular_roots_are_eigenvalues():
    rng = np.random.default_rng(1)
    for _ in range(50):
        poles = np.sort(rng.random(9)) * 10.0 ** rng.integers(-3, 6)
        z = rng.standard_normal(9) * 10.0 ** rng.integers(-3, 3)
        got = poles + np.diagonal(W.secular(poles, z))
        want = np.linalg.eigvalsh(np.diag(poles) + np.outer(z, z))
        assert np.allclose(got, want, rtol=1e-12, atol=1e-13 * np.abs(want).max())


def frame_of(spark, vectors):
    rows = [(k, v, 1, "a", 2) for k, v in vectors]
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, x int, part string, n int").repartition(5)


def test_whiten(spark):
    rng = np.random.default_rng(2)
    base = (rng.standard_normal((150, 10)) @ rng.standard_normal((10, 10))).astype(np.float32)
    good = [(k, v.tolist()) for k, v in enumerate(base)] + [(7, base[7].tolist())] * 80 + [(None, base[0].tolist())]
    bad = [(900, None), (901, [None] * 10), (902, [float("nan")] * 10), (903, [float("inf")] + [0.0] * 9), (904, [1.0]), (905, []), (906, [1e30] * 10)]
    check([r.asDict() for r in W.whiten(frame_of(spark, good + bad)).collect()], good)


@pytest.mark.parametrize("n", [1, 2, 3])
def test_few_or_equal_vectors(spark, n):
    vectors = [(k, [0.5 * k, 1.0, -2.0]) for k in range(n)]
    rows = [r.asDict() for r in W.whiten(frame_of(spark, vectors)).collect()]
    assert len(rows) == 3 * n
    assert {r["component"] for r in rows if r["whitened"] is not None} == (set() if n == 1 else {1})
    assert {r["identity_error"] is None for r in rows} == {n == 1}
    assert {r["explained"] for r in rows} == ({None} if n == 1 else {1.0, 0.0})


def test_nothing_to_whiten(spark):
    for vectors in ([], [(1, None), (2, [float("nan")])], [(1, []), (2, [])]):
        found = W.whiten(frame_of(spark, vectors) if vectors else frame_of(spark, [(1, None)]).where("vec_id > 5"))
        assert found.collect() == [] and found.columns[:2] == ["vec_id", "component"]


def test_long_deviations_are_null(spark):
    vectors = [(k, [1e9 * k, 1.0]) for k in range(4)]
    rows = W.whiten(frame_of(spark, vectors)).collect()
    assert any(r["deviation"] is None for r in rows) and len(rows) == 8


def test_query(spark):
    vectors = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check([r.asDict() for r in QUERIES["op13_whitening"](spark, SF).collect()], vectors)
