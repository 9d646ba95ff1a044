from itertools import combinations

import numpy as np
import xxhash
from cases import ROWS, frame

from marketlens.llm import simhash


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids, prints):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations(range(len(ids)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 4:
            parent[find(i)] = find(j)
    groups = {}
    for i, doc in enumerate(ids):
        groups.setdefault(find(i), []).append(doc)
    lowest = {g: min((x for x in docs if x is not None), default=None) for g, docs in groups.items()}
    return [lowest[find(i)] for i in range(len(ids))]


def check(df):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    prints = [plain_fingerprint(t) for _, t in rows]
    want = sorted((str(i), f"{p:016x}", str(c)) for (i, _), p, c in zip(rows, prints, components([i for i, _ in rows], prints)))
    got = simhash.near_duplicates(df).collect()
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want


def test_matches_brute_force_on_documents(spark):
    check(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))


def test_awkward_rows(spark):
    check(frame(spark))
    assert simhash.near_duplicates(frame(spark, [])).count() == 0
    kept = simhash.thin(frame(spark))
    assert kept.columns == frame(spark).columns
    rows = simhash.near_duplicates(frame(spark)).collect()
    assert kept.count() == len({r.component_id if r.component_id is not None else r.fingerprint for r in rows})
    assert len(ROWS) == len(rows)


def test_position_sets_meet_every_four_positions():
    for size, n in ((3, 20), (4, 70)):
        sets = simhash.position_sets(size)
        assert len(sets) == n
        assert all(any(set(s) <= set(four) for s in sets) for four in combinations(range(8), 4))


def test_links_are_complete_in_dense_and_sparse_neighbourhoods(spark):
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    prints = set()
    for s in seeds:
        for _ in range(12):
            p = int(s)
            for b in rng.choice(64, rng.integers(0, 5), replace=False):
                p ^= 1 << int(b)
            prints.add(p)
    prints = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    df = spark.createDataFrame([(p,) for p in prints], "_fp long")
    want = {(a, b) for a, b in combinations(prints, 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= 4}
    for posting in (3, 4):
        got = [(r.a, r.b) for r in simhash.links(df, posting).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_chains_are_one_component(spark):
    from marketlens.llm.common import connected
    edges = [(i, i + 1) for i in range(200)] + [(300, 301), (301, 300), (7, 7)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, 300: 300, 301: 300}
