import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from webstrata.llm import pieces as P
from webstrata.llm.packing import combinations, pack, plan
from webstrata.llm.token_counts import counter, token_counts
from webstrata.llm.token_files import read_token_files, token_files
from webstrata.llm.words import encoder
from webstrata.session import shared_folder

ODD = [" ", "  ", "\n", "\t", "a", "the", " hello", "'s", "<|endoftext|>", "<|", "12", "é", "世界", "!", "...", "\xa0", "\x1c",
       "é", "\r\n", "x" * 70, "\U0001f600", "É", "ß", "İ", "\x85", "½", "▁", "<s>", "<0x0A>", "aaaa", " " * 17, "=="]


def odd_texts(n):
    rng = random.Random(3)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 8))) for _ in range(n)]


def latin_texts(n):
    """Texts that are merged whole: Latin-1 letters, contractions, numbers and marks."""
    rng = random.Random(4)
    parts = ["the", " THE", "'s", "'LL", "12", "½", "é", "ÀÉ", "ª", "²", "ß", "...", "&&&", "x" * 120, "\n", "\r\n", "  ", " " * 120, "|"]
    parts += [chr(c) for c in range(0x20, 0x150)]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(n)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_library(vocabulary, name):
    library, own = Tokenizer.from_file(vocabulary(name)), encoder(vocabulary(name))
    for text in odd_texts(3000) + latin_texts(6000):
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == np.array(ids, f"<u{own.width}").tobytes(), text


def test_counts_equal_library(vocabulary):
    library, own = Tokenizer.from_file(vocabulary("byte_bpe_50k.json")), counter(vocabulary("byte_bpe_50k.json"))
    for text in odd_texts(3000):
        assert own.reduce(text, sum) == len(library.encode(text, add_special_tokens=False).ids), text


def test_token_counts(edge, edge_rows, empty, vocabulary):
    path = vocabulary("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    n = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    want = sorted([(d, len((t or "").encode()), n(t), n(t) > 1024) for d, t, _ in edge_rows], key=str)
    assert sorted([tuple(r) for r in token_counts(edge, path).collect()], key=str) == want
    assert token_counts(empty, path).collect() == []


def test_token_files(spark, edge, edge_rows, empty, vocabulary):
    path, folder = vocabulary("byte_bpe_50k.json"), shared_folder(spark, "t")
    library = Tokenizer.from_file(path)
    token_files(edge, folder, path, end_id=2)
    got = read_token_files(spark, folder, with_ids=True).orderBy("start").collect()
    ids = lambda t: library.encode(t or "", add_special_tokens=False).ids + [2]
    assert sorted([(r["doc_id"], tuple(r["ids"])) for r in got], key=str) == sorted([(d, tuple(ids(t))) for d, t, _ in edge_rows], key=str)
    at = 0
    for r in got:
        assert (r["start"], r["n_tokens"]) == (at, len(r["ids"]))
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        at += len(r["ids"])
    named = [r["doc_id"] for r in got if r["doc_id"] is not None]
    assert named == sorted(named)
    assert token_files(empty, shared_folder(spark, "t"), path, end_id=2).collect() == []


def test_pack(edge, edge_rows, empty, vocabulary):
    path = vocabulary("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    want = sorted([(d, tuple(library.encode(t or "", add_special_tokens=False).ids + [1])) for d, t, _ in edge_rows], key=str)
    got = pack(edge, path, end_id=1, window=64, with_ids=True).collect()
    documents, sequences = {}, {}
    for r in got:
        assert r["length"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        documents.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], r["ids"]))
    assert sorted(sequences) == list(range(len(sequences)))
    for spans in sequences.values():
        spans.sort()
        assert [a for a, _ in spans] == [0, *np.cumsum([n for _, n in spans])[:-1]]
        assert sum(n for _, n in spans) <= 64
    assert sum(r["length"] for r in got) == sum(len(i) for _, i in want)
    for d, ids in want:
        found = sorted(documents[d, len(ids)])
        starts = sorted({s for s, _ in found})
        assert starts == list(range(0, len(ids), 64))
        assert all(any(p == list(ids[s : s + 64]) for s, p in found if s == at) for at in starts)
    assert pack(empty, path, end_id=1).collect() == []


def test_plan_fills_windows():
    rng = random.Random(9)
    histogram = {k: rng.randint(1, 60) for k in range(1, 257)}
    places = plan(histogram, 256)
    assert places.sequences * 256 <= 1.04 * sum(k * n for k, n in histogram.items()) + 256
    used = {}
    for length, n in histogram.items():
        for s, o in zip(*(x.tolist() for x in places.place(np.full(n, length), np.arange(n)))):
            used.setdefault(s, []).append((o, length))
    for spans in used.values():
        spans.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and spans[0][0] == 0
        assert sum(n for _, n in spans) <= 256


def test_combinations_are_complete():
    lengths = np.array([1, 2, 3, 5, 8, 10])
    got = {tuple(r) for r in combinations(lengths, 10).tolist()}
    want = {(a, b, c) for a in lengths for b in [0, *lengths] for c in [0, *lengths] if a >= b >= c and a + b + c == 10}
    assert got == {tuple(map(int, w)) for w in want}


def test_pieces_equal_library(vocabulary):
    path = vocabulary("piece_bpe_32k.model")
    library, own = sentencepiece.SentencePieceProcessor(model_file=path), P.Pieces(path)
    texts = odd_texts(2000)
    for text, data in zip(texts, own.encode(texts)):
        ids = np.frombuffer(data, "<i4")
        assert ids.tolist() == library.encode(text), text
        assert own.decode(ids) == library.decode(ids.tolist())


def test_unigram_search_finds_the_best_sum(vocabulary):
    own = P.Pieces(vocabulary("piece_bpe_32k.model"), unigram=True)
    words = ["the", "river", "banks", "believe", "a", "things"]
    for word, data in zip(words, own.encode(words)):
        ids, marked = np.frombuffer(data, "<i4").tolist(), P.MARK + word
        assert "".join(own.text[k] for k in ids) == marked
        best = -np.inf
        for cuts in itertools.product([0, 1], repeat=len(marked) - 1):
            edges = [0, *[k + 1 for k, c in enumerate(cuts) if c], len(marked)]
            parts = [marked[a:b] for a, b in zip(edges, edges[1:])]
            if all(x in own.id_of for x in parts):
                best = max(best, sum(own.score[own.id_of[x]] for x in parts))
        assert sum(own.score[k] for k in ids) == best


def test_pieces_round_trip(spark, edge, edge_rows, empty, vocabulary):
    path = vocabulary("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    encoded = P.encode(edge, path)
    got = sorted([(r["doc_id"], r["n_pieces"], tuple(r["ids"])) for r in encoded.collect()], key=str)
    ids = [(d, tuple(library.encode(t or ""))) for d, t, _ in edge_rows]
    assert got == sorted([(d, len(i), i) for d, i in ids], key=str)
    back = sorted([tuple(r) for r in P.decode(encoded, path).collect()], key=str)
    assert back == sorted([(d, library.decode(list(i))) for d, i in ids], key=str)
    assert P.encode(empty, path).collect() == [] and P.round_trip(empty, path).collect() == []
    same = {r["doc_id"]: r["same"] for r in P.round_trip(edge, path).collect()}
    assert same[1] and same[12] and not same[10]  # a mark in a text comes back as a space
    assert isinstance(encoded.toArrow(), pa.Table)
