import re
from collections import Counter

import pytest

from webstrata.llm import jaccard_join as J
from webstrata.llm import line_dedup as L
from webstrata.llm.components import components
from webstrata.llm.shingles import shingle_set


class Sets:
    """Plain union-find."""

    def __init__(self, n):
        self.up = list(range(n))

    def root(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({k: k + 32 for k in range(65, 91)}))
    return {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()


def brute(rows, width, percent):
    sets, found = [shingles(t, width) for _, t, _ in rows], Sets(len(rows))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                found.join(a, b)
    out = []
    for k, (doc_id, _, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if found.root(j) == found.root(k) and rows[j][0] is not None]
        out.append((doc_id, len(sets[k]), (min(ids) if ids else None) if sets[k] else doc_id))
    return sorted(out, key=str)


def got(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


@pytest.mark.parametrize("width, percent", [(4, 85), (2, 60)])
def test_jaccard_equals_brute_force(frame, prose, width, percent):
    assert got(J.jaccard_components(frame(prose), width, percent)) == brute(prose, width, percent)


def test_jaccard_edge_cases(edge, edge_rows, empty):
    assert got(J.jaccard_components(edge)) == brute(edge_rows, 4, 85)
    assert J.jaccard_components(empty).collect() == []


@pytest.mark.parametrize("boundary", [0, 5, 9])
def test_any_boundary_gives_the_same(frame, prose, monkeypatch, boundary):
    monkeypatch.setattr(J, "choose_boundary", lambda lists, percent: boundary)
    monkeypatch.setattr(J, "BROADCAST_IDS", 0)
    short = [(d, " ".join(t.split()[:12]), x) for d, t, x in prose]
    assert got(J.jaccard_components(frame(short), 1, 70)) == brute(short, 1, 70)


def test_drop_near_copies(edge, edge_rows):
    left = J.drop_near_copies(edge, 4, 85)
    assert left.columns == edge.columns
    stay = sorted([d for d, _, c in brute(edge_rows, 4, 85) if d == c], key=str)
    assert sorted([r["doc_id"] for r in left.collect()], key=str) == stay


def test_one_row_of_each_component_stays(frame, empty):
    long = " ".join(f"w{k}" for k in range(60))
    alone = " ".join(f"v{k}" for k in range(60))
    rows = [(3, long, "en")] * 4 + [(3, long + " x", "en"), (4, long + " y", "en"), (None, long, "en"), (5, "a b", "en")]
    rows += [(None, alone, "en")] * 3 + [(None, alone + " x", "de"), (None, "  ", "en"), (None, "  ", "en"), (6, "", "en")]
    for some in (rows, rows[::-1]):
        left = J.drop_all_near_copies(frame(some), 4, 85)
        assert left.columns == frame(some).columns
        got = [(r["doc_id"], r["text"].split()[:1]) for r in left.collect()]
        assert sorted(got, key=str) == sorted([(3, ["w0"]), (5, ["a"]), (None, ["v0"]), (None, []), (None, []), (6, [])], key=str)
    assert J.drop_all_near_copies(empty).collect() == []


def test_texts_without_ids_meet_only_their_own_node(spark):
    rows = [(d, f"text {k}") for d in (None, 0, 7) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    wanted = docs.selectExpr("monotonically_increasing_id() AS node", "doc_id", "xxhash64(text) AS text_key")
    assert J.first_texts(docs, wanted).count() == len(rows)


def test_jaccard_without_ids(frame, prose, monkeypatch):
    monkeypatch.setattr(J, "BROADCAST_IDS", 0)
    some = [(None if d % 3 == 0 else 0 if d % 3 == 1 else d, t, x) for d, t, x in prose]
    assert got(J.jaccard_components(frame(some), 2, 60)) == brute(some, 2, 60)


def test_need_is_the_least_overlap():
    for a in range(1, 40):
        for b in range(1, 40):
            least = next(n for n in range(1, a + b + 1) if 100 * n >= 85 * (a + b - n))
            assert J.need(a, b, 85) == least


def test_long_words_and_blocks(monkeypatch):
    text = "a" * 3000 + " b c d " + "e" * 10 + " f g"
    whole = shingle_set(text, 4).tolist()
    monkeypatch.setattr("webstrata.llm.shingles.BLOCK", 16)
    assert shingle_set(text, 4).tolist() == whole and len(whole) == 4


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 9), (5, 5), (4, None), (3, 10), (10, 11), (11, 12), (12, 13), (13, 14)]
    edges += [(100 + k, 101 + k) for k in range(60)]
    df = spark.createDataFrame(edges, "a bigint, b bigint").repartition(5)
    want = {k: 1 for k in (1, 2, 3, 10, 11, 12, 13, 14)} | {k: 7 for k in (7, 8, 9)} | {100 + k: 100 for k in range(61)}
    rows = components(df).collect()
    assert {r["node"]: r["component"] for r in rows} == want and len(rows) == len(want)
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def brute_lines(rows, percent):
    norm = lambda x: re.sub(r"[\x20\x09-\x0D]+", " ", x.lower()).strip(" ")
    places = [(r, k, norm(x)) for r, (_, t, _) in enumerate(rows) for k, x in enumerate((t or "").split("\n"))]
    texts = sorted({x for _, _, x in places if x})
    found = Sets(len(texts))
    for a, x in enumerate(texts):
        for b in range(a):
            both, union = L.similarity(x, texts[b])
            if 100 * both >= percent * union:
                found.join(a, b)
    group = {x: found.root(k) for k, x in enumerate(texts)}
    first = {}
    for r, k, x in places:
        d = rows[r][0]
        if x and d is not None:
            first[group[x]] = min(first.get(group[x], (d, k)), (d, k))
    out = []
    for r, (d, t, _) in enumerate(rows):
        lines = (t or "").split("\n")
        keep = [line for k, line in enumerate(lines) if not norm(line) or group[norm(line)] not in first or first[group[norm(line)]] == (d, k)]
        out.append((d, "\n".join(keep), len(lines), len(keep)))
    return sorted(out, key=str)


def test_lines_equal_brute_force(frame, prose):
    texts = [t for _, t, _ in prose]
    rows = [(k, "\n".join(texts[k : k + 5]) + ("\n\n" if k % 3 else ""), "en") for k in range(0, len(texts), 4)]
    assert got(L.dedup_lines(frame(rows))) == brute_lines(rows, 80)


def test_lines_edge_cases(edge, edge_rows, empty, monkeypatch):
    monkeypatch.setattr(L, "BROADCAST_IDS", 0)
    assert got(L.dedup_lines(edge)) == brute_lines(edge_rows, 80)
    assert L.dedup_lines(empty).collect() == []


def test_bands_find_similar_lines():
    import random

    import numpy as np

    rng = random.Random(2)
    hits = total = 0
    for _ in range(400):
        a = "".join(rng.choice("abcdefgh ") for _ in range(200))
        at = rng.randrange(150)
        b = a[:at] + "#" * rng.randint(1, 14) + a[at + 14 :]
        both, union = L.similarity(a, b)
        if 100 * both >= 80 * union:
            x, y = L.signatures([a, b], np.array([1, 2]))
            total += 1
            hits += bool((x == y).any())
    assert total > 100 and hits / total > 0.98
    assert Counter(L.signatures(["abc", "abc"], np.array([5, 5]))[0].tolist()) == Counter(L.signatures(["abc"], np.array([5]))[0].tolist())


def test_line_bands_travel_in_parts(frame, prose):
    """Bands are dealt as bytes, a row per part and task and not one per band, and meet as single rows would."""
    import numpy as np
    from pyspark.sql import functions as F

    texts = [t.replace("\n", " ") for _, t, _ in prose]
    rows = [(k, "\n".join(texts[k : k + 5] + [texts[k] + " and more"]), "en") for k in range(0, len(texts), 3)]
    docs = frame(rows).select("doc_id", F.xxhash64("text").alias("text_key"), F.lower("text").alias("lower"))
    packed = L.band_rows(L.signed_lines(docs))
    lines = sorted({x for _, t, _ in rows for x in L.normal_lines(t.lower()) if x})
    keys = L.line_keys(lines)
    want = {}
    for key, bands in zip(keys.tolist(), L.signatures(lines, keys).tolist()):
        for band in bands:
            want.setdefault(band, set()).add(key)
    want = {band: found for band, found in want.items() if len(found) > 1}
    sent = packed.collect()
    assert len(sent) <= 3 * 32 < L.BANDS * len(lines) <= sum(len(r["bands"]) // 8 for r in sent)
    assert all((np.frombuffer(r["bands"], np.uint64) >> np.uint64(59) == r["part"]).all() for r in sent)
    got = {}
    for r in L.bucket_rows(packed).collect():
        got.setdefault(r["band"], []).append((r["key"], r["is_hub"]))
    assert want and {band: {key for key, _ in found} for band, found in got.items()} == want
    assert all(len(found) == len(want[band]) and sum(hub for _, hub in found) == 1 for band, found in got.items())


def test_line_overlaps_equal_whole_sets():
    import random

    import numpy as np

    rng = random.Random(5)
    lines = ["".join(rng.choice("ab é世\U0001f600") for _ in range(rng.randrange(6, 90))) for _ in range(40)] + ["x" * 300, "abcdef"]
    pairs = [(a, b) for a in lines for b in rng.sample(lines, 6) + [a + "b", a[:-1] + "cccc"]]
    both, union = L.overlaps([a for a, _ in pairs], [b for _, b in pairs])
    assert list(zip(both.tolist(), union.tolist())) == [L.similarity(a, b) for a, b in pairs]
    assert L.overlaps(["abc"], ["abcd"])[0].tolist() == [0]
    sizes, bits = L.parities(lines, L.line_keys(lines))
    for i, a in enumerate(lines):
        for j, b in enumerate(lines):
            both, union = L.similarity(a, b)
            assert sizes[i] + sizes[j] == both + union
            assert np.bitwise_count((bits[i] ^ bits[j]).view(np.uint64)).sum() <= union - both


def test_normal_lines():
    texts = ["", " ", "\n", "a  b", " a\t\r\nb \n \n c", "a\x0b\x0c b\n\n", "\t\ta\n", "a \nb", "a\n b", "x\x1cy\u2003z\u00a0"]
    for t in texts:
        assert L.normal_lines(t) == [re.sub(r"[\x20\x09\x0B-\x0D]+", " ", x).strip(" ") for x in t.split("\n")]
