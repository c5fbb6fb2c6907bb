import hashlib
import random
import re
import zlib

import pytest

from webstrata.llm.prefix_trie import prefix_trie, running
from webstrata.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id bigint, turn bigint, role string, text string, a bigint, place int, n string"


def brute(rows):
    """Nodes by walking every prefix of every rebuilt conversation."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    for c in own:
        own[c] = [r[2:] for r in sorted(own[c])]
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        first = c - (c % 20 if c >= 0 else -(-c % 20))
        whole[c] = tuple(own.get(first, [])[:h] + own[c][h:])
    members = {}
    for c, path in whole.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    children = {}
    for path in members:
        if path:
            children.setdefault(path[:-1], []).append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        below = children.get(path, [])
        leaves[path] = sum(leaves[p] for p in below) or 1
        saved[path] = sum(saved[p] for p in below) + (len(members[path]) - 1) * words
    out = []
    for path, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if len(whole[c]) == len(path))
        parent = min(members[path[:-1]]) if path else None
        out.append((min(convs), len(path), parent, len(convs), len(children.get(path, [])), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def frame_of(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA).repartition(5)


def made(seed, n=160, kinds=4, longest=7):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(n * 2), n):
        for turn in range(rng.randint(1, longest)):
            rows.append((c, turn, rng.choice(["user", "assistant"]), "word " * rng.randint(0, kinds)))
    return rows


@pytest.mark.parametrize("limit", [1, 20, None])
def test_equals_brute_force(spark, limit):
    rows = made(1)
    assert sorted([tuple(r) for r in prefix_trie(frame_of(spark, rows), limit).collect()], key=str) == brute(rows)


def test_odd_rows(spark):
    rows = [(None, 1, "user", "x"), (3, None, None, None), (3, 2, "user", "a b"), (3, 1, None, "a\tb\nc"), (0, 0, "", ""), (0, 1, "user", "a b")]
    rows += [(40, k, "user", "same") for k in range(3)] + [(41, k, "user", "same") for k in range(3)]  # copies
    rows += [(60, 1, "u", "t")] * 3  # repeated rows
    rows += [(85, k, "u", "alone") for k in range(2)] + [(-5, 0, "u", "neg"), (-20, 0, "u", "neg")]
    rows += [(100, 0, "role", "x" * 100_000), (100, 1, "rol", "ex"), (100, 2, "ro", "lex")]
    rows += [(c, 0, "user", "short") for c in range(120, 140)]  # many end up without turns
    got = prefix_trie(frame_of(spark, rows)).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute(rows)


def test_long_and_common_conversations(spark):
    rows = [(c, k, "user", f"t {k}") for c in (0, 1, 2) for k in range(300)]
    rows += [(c, k, "user", "hi") for c in range(1000, 1400) for k in range(3)]
    got = prefix_trie(frame_of(spark, rows)).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute(rows)


def test_only_turnless_and_empty(spark):
    alone = next(c for c in range(1, 100) if c % 20 and zlib.crc32(str(c).encode()) % 4)
    assert [tuple(r) for r in prefix_trie(frame_of(spark, [(alone, 0, "u", "t")])).collect()] == brute([(alone, 0, "u", "t")])
    assert prefix_trie(frame_of(spark, [(None, 1, "u", "t")])).collect() == []
    assert prefix_trie(frame_of(spark, [(1, 1, "u", "t")]).where("conv_id > 5")).collect() == []


def test_running_sums(spark):
    rows = [(k % 3, n, (k * 7919 + n) * (1 << 44) % (1 << 62)) for k in range(3) for n in range(400)]
    df = spark.createDataFrame(rows, "k bigint, n bigint, v bigint").repartition(7)
    want, total = {}, {}
    for k, n, v in sorted(rows):
        total[k] = (total.get(k, 0) + v) % (1 << 62)
        want[k, n] = total[k]
    assert {(r["k"], r["n"]): r["v_sum"] for r in running(df, "k", ["n"], ["v"]).collect()} == want


def test_query(spark):
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    got = QUERIES["op11_prefix_trie"](spark, SF)
    assert [t for _, t in got.dtypes] == ["bigint"] * 7 + ["string"]
    assert sorted([tuple(r) for r in got.collect()], key=str) == brute(rows)
