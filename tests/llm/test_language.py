import itertools
import random
import zlib

import numpy as np
import pytest

from webstrata.llm import language_id as G


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    parts = {"aa": ["ka", "lo", "mi", "to"], "bb": ["sch", "ein", "ung", "er"], "cc": ["tion", "que", "eau", "ment"]}
    rows = []
    for k in range(240):
        lang = rng.choice(sorted(parts))
        words = ["".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 40))]
        rows.append((k, " ".join(words).capitalize() + ".", lang))
    return rows


def test_held_out_accuracy(frame, corpus, edge_rows, vocabulary):
    odd = [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 34 !", "bb"), (1003, "²½", "bb"), (1004, "kalo", None), (None, "kalo", "aa")]
    got = {r["doc_id"]: r for r in G.identify(frame(corpus + odd), vocabulary("piece_bpe_32k.model")).collect()}
    assert len(got) == len(corpus) + len(odd)
    out = [(d, lang) for d, _, lang in corpus if zlib.crc32(str(d).encode()) % 4 == 2]
    assert all(got[d]["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2) for d, _, _ in corpus)
    assert sum(got[d]["lang_pred"] == lang for d, lang in out) >= 0.97 * len(out)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert [got[k]["lang_pred"] for k in (1000, 1001, 1002, 1003)] == [G.NONE] * 4
    assert got[1004]["lang_pred"] == "aa" and not got[None]["held_out"]


def test_letters_beside_other_signs(frame, corpus, vocabulary):
    texts = ["m²", "H₂O CO₂", "x²+y²", "½kalo", "²ª"]
    assert all(G.words_of(t) for t in texts) and not any(map(G.words_of, ["²½", "Ⅳ ₂", "", "3 _ 4"]))
    df = frame(corpus + [(1000 + k, t, None) for k, t in enumerate(texts)])
    got = [r for r in G.identify(df, vocabulary("piece_bpe_32k.model")).collect() if r["doc_id"] >= 1000]
    assert len(got) == len(texts) and all(r["lang_pred"] != G.NONE and r["score"] > 0 for r in got)
    left = {r["doc_id"] for r in G.keep_identified(df, vocabulary("piece_bpe_32k.model"), least=0.0).collect()}
    assert left >= {1000 + k for k in range(len(texts))}


def test_nothing_to_learn(frame, empty, vocabulary):
    path = vocabulary("piece_bpe_32k.model")
    rows = G.identify(frame([(1, "kalo", None), (2, None, "aa")]), path).collect()
    assert {(r["lang_pred"], r["score"]) for r in rows} == {(G.NONE, 0.0)}
    assert G.identify(empty, path).collect() == []
    assert [r["doc_id"] for r in G.keep_identified(frame([(1, "kalo", None), (2, "12", None), (3, None, None)]), path).collect()] == [1]


def test_forward_sums_all_segmentations(vocabulary):
    path = vocabulary("piece_bpe_32k.model")
    table = G.piece_table(path)
    rng = np.random.default_rng(0)
    p = rng.random((table.size + 1, 2)) * 1e-3
    model = G.Model(path, ["aa", "bb"], p)
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [sp.id_to_piece(k) for k in range(sp.vocab_size()) if not (sp.is_control(k) or sp.is_unknown(k) or sp.is_byte(k))]
    number = {x: k for k, x in enumerate(pieces)}
    words = ["then", "ing", "a", "ꙮx"]
    for word, scores in zip(words, G.word_scores(model, words)):
        marked = "▁" + word
        total = np.zeros(2)
        for cuts in itertools.product([0, 1], repeat=len(marked) - 1):
            edges = [0, *[k + 1 for k, c in enumerate(cuts) if c], len(marked)]
            parts = [marked[a:b] for a, b in zip(edges, edges[1:])]
            if all(x in number or len(x) == 1 for x in parts):
                total += np.prod([p[number.get(x, table.size)] for x in parts], axis=0)
        assert np.allclose(np.exp(scores), total, rtol=1e-9)


def summed(word, p, number, unknown):
    """Log of the sum over all segmentations, by logarithms throughout."""
    longest, sums = max(map(len, number)), [np.zeros(p.shape[1])]
    for j in range(1, len(word) + 1):
        parts = [(sums[j - k], word[j - k : j]) for k in range(1, min(j, longest) + 1)]
        terms = [a + np.log(p[number.get(x, unknown)]) for a, x in parts if x in number or len(x) == 1]
        sums.append(np.logaddexp.reduce(terms, axis=0))
    return sums[-1]


def numbered(path):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [sp.id_to_piece(k) for k in range(sp.vocab_size()) if not (sp.is_control(k) or sp.is_unknown(k) or sp.is_byte(k))]
    return {x: k for k, x in enumerate(pieces)}


def test_long_words_are_summed_whole(vocabulary, monkeypatch):
    path = vocabulary("piece_bpe_32k.model")
    number, table = numbered(path), G.piece_table(path)
    p = np.random.default_rng(1).random((table.size + 1, 3)) ** 4 * 1e-3 + 1e-12
    model = G.Model(path, ["aa", "bb", "cc"], p)
    rng = random.Random(2)
    words = ["donaudampfschifffahrtsgesellschaft", "rindfleischetikettierung", "ꙮ" * 60, "ein" * 6] + [
        "".join(rng.choice(["ung", "en", "th", "x", "ꙮ", "tion", "q"]) for _ in range(n)) for n in (9, 16, 17, 40, 300)
    ]
    want = np.array([summed("▁" + w, p, number, table.size) for w in words])
    assert np.allclose(G.word_scores(model, words), want, rtol=1e-11)
    for window in (20, 64):
        monkeypatch.setattr(G, "WINDOW", window)
        assert np.allclose(G.word_scores(model, words), want, rtol=1e-11)


def test_fit_counts_pieces_of_long_words(vocabulary):
    """One round of expectation maximisation against posteriors taken from the sums before and behind each piece."""
    path = vocabulary("piece_bpe_32k.model")
    number, table = numbered(path), G.piece_table(path)
    words, counts = ["kalo", "donaudampfschifffahrtsgesellschaft", "x" * 40], np.array([[2.0, 0], [1, 3], [0, 1]])
    p = np.full((table.size + 1, 2), 1.0 / table.size)
    p[-1] = G.UNKNOWN
    longest = max(map(len, number))
    expected = np.zeros((table.size, 2))
    for word, weight in zip(words, counts):
        word = "▁" + word
        whole = summed(word, p, number, table.size)
        for i in range(len(word)):
            for k in range(1, min(longest, len(word) - i) + 1):
                x = word[i : i + k]
                if x in number:
                    share = summed(word[:i], p, number, table.size) + np.log(p[number[x]]) + summed(word[i + k :], p, number, table.size) - whole
                    expected[number[x]] += weight * np.exp(share)
    want = expected + G.SMOOTHING
    want *= (1 - G.UNKNOWN) / want.sum(0)
    assert np.allclose(G.fit(path, ["aa", "bb"], words, counts, rounds=1).p[:-1], want, rtol=1e-9)


def test_predictions_equal_brute_force(frame, corpus, edge_rows, vocabulary):
    """Every row, edge rows included, scored word by word from the fitted probabilities."""
    path = vocabulary("piece_bpe_32k.model")
    rows = corpus[:60] + [(d if d is None else d + 2000, t, lang if lang is None else "aa") for d, t, lang in edge_rows]
    df = frame(rows)
    model = G.train(df.select("doc_id", "text", "lang").where(~G.held_out()), path)
    number, unknown = numbered(path), len(model.p) - 1
    known = {}
    want = []
    for d, text, _ in rows:
        words = G.words_of(text or "")
        if not words:
            want.append((d, G.NONE, 0.0))
            continue
        for w in set(words) - set(known):
            known[w] = summed("▁" + w, model.p, number, unknown)
        total = np.sum([known[w] for w in words], axis=0)
        best = int(total.argmax())
        want.append((d, model.languages[best], round(float(1 / np.exp(total - total[best]).sum()), 6)))
    got = [(r["doc_id"], r["lang_pred"], round(r["score"], 6)) for r in G.identify(df, path).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_long_words_and_full_memory(vocabulary):
    path = vocabulary("piece_bpe_32k.model")
    model = G.fit(path, ["aa"], ["kalo", "x" * 300], np.ones((2, 1)))
    scorer = G.Scorer(model, entries=3)
    for words in (["a", "b"], ["c", "d"], ["a", "b", "c", "d", "e"], ["x" * 5000]):
        scorer.learn([words])
        assert np.isfinite(scorer.total(words)).all()
        assert np.allclose(scorer.total(words), G.word_scores(model, words).sum(0))


def test_keep_identified(frame, corpus, vocabulary):
    odd = [(1000, None, "aa"), (1001, "12 34", "bb")]
    df = frame(corpus + odd)
    left = G.keep_identified(df, vocabulary("piece_bpe_32k.model"))
    assert left.columns == df.columns
    assert {r["doc_id"] for r in left.collect()} == {d for d, _, _ in corpus}
