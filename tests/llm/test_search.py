import numpy as np
from pyspark.sql import functions as F

from webstrata.llm.hamming_search import Block, codes, learn, nearest


def brute(ids, x, own, k):
    scores = (x * x[own]).sum(1) / np.sqrt((x * x).sum(1) * (x[own] * x[own]).sum())
    scores[ids == ids[own]] = -9
    order = np.lexsort((ids, -scores))[:k]
    return ids[order].tolist(), scores[order]


def test_recall_and_scores(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((1500, 24)).astype(np.float32)
    x[700:720] = x[3]  # ties
    ids = np.arange(1500) * 3
    df = spark.createDataFrame([(int(i), v.tolist(), 0) for i, v in zip(ids, x)], "vec_id bigint, embedding array<float>, code int").repartition(3)
    got = {}
    for r in nearest(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r["query_id"], []).append(r)
    x = x.astype(float)
    queries = [k for k, i in enumerate(ids) if i % 50 == 0]
    assert sorted(got) == [int(ids[k]) for k in queries]
    hits = 0
    for k in queries:
        rows = sorted(got[int(ids[k])], key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == [1, 2, 3, 4, 5]
        want, _ = brute(ids, x, k, 5)
        hits += len({r["vec_id"] for r in rows} & set(want))
        for r in rows:
            v = x[r["vec_id"] // 3]
            assert abs(r["score"] - v @ x[k] / np.linalg.norm(v) / np.linalg.norm(x[k])) < 1e-12
        assert rows == sorted(rows, key=lambda r: (-r["score"], r["vec_id"]))
    assert hits >= 0.9 * 5 * len(queries)


def test_every_code_within_the_radius_is_found():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((600, 16))
    mean, turns = learn(x, 64)
    parts = codes(x, mean, turns)
    block = Block(np.arange(600), x, parts)
    apart = np.bitwise_count(parts[:, None] ^ parts[None, :40]).sum(2)
    for q in range(40):
        for radius in (0, 7, 19, 30):
            assert block.within(parts[q], radius).tolist() == np.flatnonzero(apart[:, q] <= radius).tolist()
    assert np.allclose(turns[:, :16].T @ turns[:, :16], np.eye(16))


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]),
            (7, [1.0, 1.0, 1.0]), (8, [-1.0, 0.5]), (None, [1.0, 1.0]), (50, [0.0, 3.0]), (50, [0.0, 3.0]), (100, []), (9, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in nearest(df, F.col("vec_id") % 50 == 0, k=3).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 9), (0, 3, 50), (50, 1, 8), (50, 2, 0), (50, 3, 1)]
    assert nearest(df.where("false"), F.col("vec_id") % 50 == 0).collect() == []
    alone = nearest(df.where("vec_id = 0"), F.col("vec_id") % 50 == 0).collect()
    assert alone == []
