import hashlib
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from webstrata.llm.exact_dedup import FINEST, drop_all_copies, drop_copies, exact_dedup, grow_directory


def brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t, _ in rows]
    groups = defaultdict(list)
    for (doc_id, _, _), text in zip(rows, norm):
        groups[text].append(doc_id)
    out = []
    for (doc_id, _, _), text in zip(rows, norm):
        ids = [x for x in groups[text] if x is not None]
        keep = min(ids) if ids else None
        kept = keep is None or doc_id == keep
        out.append((doc_id, keep, len(groups[text]), kept, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted([tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()], key=str)


def test_edge_cases(edge, edge_rows):
    assert rows_of(exact_dedup(edge)) == brute(edge_rows)


def test_colliding_keys_are_told_apart_by_their_bytes(edge, edge_rows):
    weak = lambda text: F.pmod(F.length(text), F.lit(3)).cast("bigint")
    assert rows_of(exact_dedup(edge, capacity=2, key=weak)) == brute(edge_rows)


def test_small_capacity(frame, prose):
    assert rows_of(exact_dedup(frame(prose), capacity=5)) == brute(prose)


def test_empty(empty):
    assert exact_dedup(empty).collect() == []


def test_drop_copies_keeps_columns(edge, edge_rows):
    left = drop_copies(edge)
    assert left.columns == edge.columns
    stay = sorted([r[0] for r in brute(edge_rows) if r[3]], key=str)
    assert sorted([r["doc_id"] for r in left.collect()], key=str) == stay


def test_directory_splits_only_overfull_buckets():
    rng = random.Random(1)
    keys = [rng.getrandbits(FINEST) for _ in range(5000)] + [77] * 900
    cells = defaultdict(int)
    for k in keys:
        cells[k] += 1
    directory = grow_directory(dict(cells), 100)
    assert len(directory.slots) == 2**directory.depth
    held, where = defaultdict(int), defaultdict(set)
    for k, n in cells.items():
        bucket = directory.slots[k >> (FINEST - directory.depth)]
        held[bucket] += n
        where[bucket].add(k >> (FINEST - directory.local[bucket]))
    assert all(len(p) == 1 for p in where.values())  # a bucket is one prefix
    assert all(n <= 100 or directory.local[b] == FINEST for b, n in held.items())
    assert max(directory.local) == directory.depth


def test_directory_without_entries():
    assert grow_directory({}, 10).slots == [0]


REPEATS = [(1, "one two three", "en")] * 5 + [(1, "one  two three", "en"), (1, "one two three", "de"), (2, "one two three", "en"), (None, "one two three", "en")]
REPEATS += [(None, "four five", "en")] * 4 + [(None, "four\tfive", "de"), (1, "other", "en"), (None, None, "en"), (None, "", "en")]


def test_one_row_of_each_group_stays(frame):
    left = drop_all_copies(frame(REPEATS))
    assert left.columns == frame(REPEATS).columns
    rows = [(r["doc_id"], " ".join((r["text"] or "").split())) for r in left.collect()]
    assert sorted(rows, key=str) == sorted([(1, "one two three"), (None, "four five"), (1, "other"), (None, "")], key=str)
    again = drop_all_copies(frame(REPEATS[::-1])).collect()
    assert sorted(map(tuple, left.collect()), key=str) == sorted(map(tuple, again), key=str)  # whatever the order of rows


def test_one_row_of_each_group_stays_by_a_shuffle(frame, edge, edge_rows, monkeypatch):
    monkeypatch.setattr("webstrata.llm.common.BROADCAST_ROWS", 0)
    assert len(drop_all_copies(frame(REPEATS)).collect()) == 4
    groups = {re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t, _ in edge_rows}
    assert sorted(re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "") for r in drop_all_copies(edge).collect()) == sorted(groups)
