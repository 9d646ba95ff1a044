import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from marketlens.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def by_hand(rows):
    """The nodes as tuples, from (conv_id, turn, role, text) rows, with plain dictionaries."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            convs[c].append(((turn is not None, turn or 0), digest, (role, text)))
    own = {c: [t for *_, t in sorted(ts)] for c, ts in convs.items()}
    rebuilt = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + ts[h:]
    members = defaultdict(list)
    for c, ts in rebuilt.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    children = defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(m) - 1) * words
    out = []
    for node, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if len(rebuilt[c]) == len(node)))
        out.append((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), children[node], leaves[node], saved[node],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return out


def key(row):
    return tuple((x is None, x) for x in row)


def same(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    got = [tuple(r) for r in prefix_trie.trie(df, **kw).collect()]
    assert sorted(got, key=key) == sorted(by_hand(rows), key=key)


AWKWARD = [
    (0, 0, "user", "one two"), (0, 1, "assistant", "three"), (0, 2, None, None), (0, 3, "user", ""),
    (1, None, "user", "one two"), (1, 5, "user", "late"), (1, 5, "user", "late"), (1, 5, "b", "tie"), (1, None, None, "null turn"),
    (21, 0, "user", "base is absent"), (22, 0, "user", "base is absent"), (23, 0, "u", "x"), (24, 0, "u", "x"), (25, 0, "u", "x"),
    (-3, 0, "user", "negative"), (-20, 0, "user", "minus"), (-25, 4, "user", "minus"), (None, 0, "user", "no conversation"), (None, None, None, None),
    (40, 0, "user", "word " * 5000), (41, 0, "user", "word " * 5000), (42, 7, "ab", "c"), (43, 7, "a", "bc"), (9_000_000_000, 0, "u", "x"),
]


@pytest.mark.parametrize("kw", [{}, {"segment": 1, "block": 2}, {"segment": 2, "block": 3, "rows_per_range": 5}])
def test_awkward_rows(spark, kw):
    same(spark, AWKWARD, **kw)


def test_empty_and_clashing_columns(spark):
    assert prefix_trie.trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert prefix_trie.trie(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA)).count() == 0
    df = spark.createDataFrame([(*r, r[0], "x", 1) for r in AWKWARD], SCHEMA + ", _conv long, depth string, __nth int")
    got = [tuple(r) for r in prefix_trie.trie(df).collect()]
    assert sorted(got, key=key) == sorted(by_hand(AWKWARD), key=key)


@pytest.mark.parametrize("segment, block, ranges", [(256, 4096, 262_144), (3, 4, 50), (1, 1, 20), (2, 7, 10)])
def test_random_conversations_in_segments_and_blocks(spark, segment, block, ranges):
    rng = random.Random(segment * 100 + block)
    rows = []
    for c in rng.sample(range(200), 90):
        for turn in range(rng.choice([0, 1, 2, 3, 4, 5, 9, 14])):
            rows.append((c, turn, "user" if turn % 2 else "bot", " ".join(["w"] * rng.choice([0, 1, 2, 3])) if turn < 6 or c % 3 else "same"))
    same(spark, rows, segment=segment, block=block, rows_per_range=ranges)


def test_one_conversation_that_very_many_share_and_one_very_long(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(0, 1200) for t in range(3)]
    rows += [(5000, t, "user", f"turn {t}") for t in range(1500)] + [(5001, t, "user", f"turn {t % 7}") for t in range(700)]
    same(spark, rows, segment=64, block=100, rows_per_range=500)


def test_sparse_table():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 7, 64, 100):
        values = rng.integers(0, 4, n)
        values[0] = -1
        table = prefix_trie.Sparse(values)
        at, depth = np.repeat(np.arange(n), 4), np.tile(np.arange(4), n)
        for i, d, left, right in zip(at, depth, table.left_end(at, depth), table.right_end(at, depth)):
            a, z = i, i
            while values[a] >= d:
                a -= 1
            while z + 1 < n and values[z + 1] >= d:
                z += 1
            assert (left, right) == (a, z)
        pairs = np.array([(a, z) for a in range(n) for z in range(a, n)])
        assert (table.least(pairs[:, 0], pairs[:, 1]) == [values[a:z + 1].min() for a, z in pairs]).all()
