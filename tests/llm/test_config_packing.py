import itertools
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from webstrata.llm import config_packing as C
from webstrata.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def pieces_of(n, window):
    """Lengths of the pieces of a document of n ids."""
    return [n] if n <= window else [k for k in (n % window,) if k] + [window] * (n // window)


def check(rows, ids_of, window):
    """Every document whole, every sequence gapless and within the window; the number of sequences."""
    sequences, documents = {}, {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        documents.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for spans in sequences.values():
        spans.sort()
        assert [a for a, _ in spans] == [0, *np.cumsum([n for _, n in spans])[:-1]]
        assert sum(n for _, n in spans) <= window
    want = {}
    for doc_id, ids in ids_of:
        lengths = pieces_of(len(ids), window)
        starts = [0, *np.cumsum(lengths)[:-1].tolist()]
        crc = [zlib.crc32(np.array(ids[a : a + n], "<u4").tobytes()) for a, n in zip(starts, lengths)]
        want.setdefault(doc_id, []).extend(zip(range(len(lengths)), starts, lengths, crc))
    assert {d: sorted(p) for d, p in documents.items()} == {d: sorted(p) for d, p in want.items()}
    return len(sequences)


def test_pack_few(edge, edge_rows, empty, vocabulary):
    path = vocabulary("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    ids = [(d, [*library.encode(t or "", add_special_tokens=False).ids, 2]) for d, t, _ in edge_rows]
    got = C.pack_few(edge, path, end_id=2, window=64, with_ids=True).collect()
    n = check(got, ids, 64)
    assert n <= -(-sum(len(i) for _, i in ids) // 64) + 1
    assert all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in got)
    assert C.pack_few(empty, path, end_id=2).collect() == []


def test_query(spark, vocabulary):
    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    ids = [(r["doc_id"], [*library.encode(r["text"] or "", add_special_tokens=False).ids, 2]) for r in docs]
    rows = QUERIES["op12_config_packing"](spark, SF)
    assert dict(rows.dtypes)["piece"] == "int"
    assert check(rows.collect(), ids, 1024) <= 1.02 * sum(len(i) for _, i in ids) / 1024 + 1


def test_price_finds_the_best_filling():
    values = np.zeros(21)
    values[[3, 5, 7, 11]] = [3.1, 5.0, 7.7, 10.0]
    best, last = C.price(values, 20)
    for c in range(21):
        sums = [sum(values[list(p)]) for k in range(7) for p in itertools.combinations_with_replacement([3, 5, 7, 11], k) if sum(p) <= c]
        assert best[c] == pytest.approx(max(sums))
    for c, row in enumerate(C.fillings(last, np.arange(21))):
        assert row.sum() <= c and values[row].sum() == pytest.approx(best[c])


@pytest.mark.parametrize("seed", range(4))
def test_solution_covers_and_bounds(seed):
    rng = random.Random(seed)
    window = 60
    counts = np.zeros(window + 1, np.int64)
    for k in rng.sample(range(5, 50), 12):
        counts[k] = rng.randint(1, 400)
    found = C.solve(counts, window)
    served = np.zeros(window + 1)
    for lengths, x in found.repeats.items():
        assert sum(lengths) <= window
        np.add.at(served, list(lengths), x)
    assert (served >= counts - 1e-6).all()
    packed = C.plan({k: int(n) for k, n in enumerate(counts) if n}, window).sequences
    assert found.bound - 1e-6 <= packed <= 1.12 * found.bound + 2


def test_pairs_that_fill_a_window_meet():
    """Each of these has one full configuration, which the program repeats."""
    assert C.plan({600: 1000, 424: 1000}, 1024).sequences == 1000
    assert C.plan({342: 300, 341: 600}, 1024).sequences == 300
    assert C.plan({}, 1024).sequences == 0
