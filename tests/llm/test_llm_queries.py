import duckdb
import pytest

import corpus_pipeline
from webstrata.llm.oracles import ORACLES
from webstrata.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def values(table):
    return sorted((tuple(r[c] for c in sorted(table.column_names)) for r in table.to_pylist()), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    mine, theirs = QUERIES[name](spark, SF).toArrow(), con.sql(ORACLES[name]).to_arrow_table()
    assert {f.name: str(f.type) for f in mine.schema} == {f.name: str(f.type) for f in theirs.schema}
    assert values(mine) == values(theirs)


@pytest.mark.parametrize("n", range(1, 14))
def test_one_query_for_each_operator(n):
    assert len([q for q in QUERIES if q.startswith(f"op{n}_")]) == 1


def test_pipeline_equals_brute_force(spark, frame, prose, edge_rows, tmp_path):
    """Stages on a small table: what goes at each, and that the rest is packed whole."""
    from test_exact_dedup import brute as copies
    from test_near import brute as near

    rows = [(d, t, "en") for d, t, _ in prose] + [(500 + k, t, "en") for k, (_, t, _) in enumerate(edge_rows)]
    frame(rows).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = rows
    for (name, stage), keep in zip(
        corpus_pipeline.STAGES,
        [
            lambda r: [x for x in r if any(c.isalpha() for c in x[1] or "")],
            lambda r: [x for x in r if x[0] in {d for d, _, _, kept, _ in copies(r) if kept}],
            lambda r: [x for x in r if x[0] in {d for d, _, c in near(r, 5, 80) if d == c}],
        ],
    ):
        left, columns = keep(left), docs.columns
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns, name
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert sorted(r["doc_id"] for r in docs.collect()) == sorted(d for d, _, _ in left), name
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == {d for d, _, _ in left}
    whole = {}
    for r in packed:
        whole[r["doc_id"]] = whole.get(r["doc_id"], 0) + r["length"]
        assert r["offset"] + r["length"] <= 2048
    assert all(whole[r["doc_id"]] == r["doc_tokens"] for r in packed)


def test_pipeline_packs_repeated_rows_once(spark, frame, tmp_path):
    long = " ".join(f"word{k}" for k in range(40))
    rows = [(1, "one two three", "en")] * 6 + [(None, "four five six", "en")] * 6 + [(2, long, "en"), (2, long + " more", "en"), (None, long + " again", "en")]
    frame(rows).write.parquet(f"{tmp_path}/documents.parquet")
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted([r["doc_id"] for r in packed], key=str) == [1, 2, None]


def test_pipeline_on_an_empty_table(spark, empty, tmp_path):
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
