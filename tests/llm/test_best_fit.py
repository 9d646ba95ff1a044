import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from cases import ROWS, frame

from marketlens.llm import best_fit
from marketlens.llm.queries import QUERIES
from marketlens.llm.tokens import tokenizer_path

SMALL = "/root/testdata/sf0.001"


def round_trip(pieces, docs, length):
    """Every id of every document lies in one piece, cuts are as told, sequences are gapless; returns the fills."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    want = []
    for doc_id, text in docs:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(doc_id is None, doc_id, k, at, len(p), zlib.crc32(p.tobytes())) for k, at in enumerate(range(0, len(ids), length)) for p in [ids[at:at + length]]]
    got = [(p.doc_id is None, p.doc_id, p.piece, p.start, p.length, p.ids_crc32) for p in pieces]
    none_last = lambda r: (r[0], r[1] or 0, *r[2:])
    assert sorted(got, key=none_last) == sorted(want, key=none_last)
    bins = defaultdict(list)
    for p in pieces:
        bins[p.sequence_id].append((p.offset, p.length))
    fills = []
    for parts in bins.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at and n > 0
            at += n
        assert at <= length
        fills.append(at)
    return fills


def test_awkward_rows(spark):
    for length, group in ((256, 4), (4096, 2048), (16, 3)):
        fills = round_trip(best_fit.pack(frame(spark), length=length, group=group, keep_open=2).collect(), [r[:2] for r in ROWS], length)
        assert len(fills) <= -(-sum(fills) // length) + 2
    assert best_fit.pack(frame(spark, [])).count() == 0


def test_query_round_trip(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    pieces = QUERIES["op11_best_fit"](spark, SMALL)
    assert dict(pieces.dtypes) == {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint",
                                   "sequence_id": "bigint", "offset": "bigint"}
    fills = round_trip(pieces.collect(), [(r.doc_id, r.text) for r in docs.collect()], 4096)
    assert len(fills) <= -(-sum(fills) // 4096) + 1


def test_levels_join_what_groups_leave(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    fills = round_trip(best_fit.pack(docs, length=4096, group=4, keep_open=8).collect(), [(r.doc_id, r.text) for r in docs.collect()], 4096)
    assert len(fills) <= -(-sum(fills) // 4096) + 2


def test_the_same_input_packs_alike(spark):
    runs = [sorted(map(tuple, QUERIES["op11_best_fit"](spark, SMALL).collect())) for _ in range(2)]
    assert runs[0] == runs[1]


def check(sizes, bins, capacity):
    fill = np.bincount(bins, weights=sizes)
    assert fill.max() <= capacity
    return int((fill > 0).sum())


@pytest.mark.parametrize("capacity, low, high", [(100, 1, 60), (100, 20, 50), (1000, 150, 500), (64, 1, 64), (10, 1, 3)])
def test_search_raises_squares_and_empties_bins(capacity, low, high):
    rng = random.Random(capacity + low)
    fewer = 0
    for _ in range(30):
        sizes = np.array([rng.randint(low, high) for _ in range(rng.randint(1, 80))], np.int64)
        # a poor start, by next fit, gives the search something to do
        bins, at, b = np.empty(len(sizes), np.int64), 0, 0
        for i, s in enumerate(sizes):
            if at + s > capacity:
                at, b = 0, b + 1
            bins[i], at = b, at + s
        before = check(sizes, bins, capacity)
        search = best_fit.Search(sizes, bins, capacity)
        squares = search.squares()
        for _ in range(5):
            lowest = min(np.flatnonzero(search.fill > 0), key=lambda x: search.fill[x])
            if not search.exchange(int(lowest)):
                break
            assert search.squares() > squares
            squares = search.squares()
        search.run(10 ** 6)
        after = check(sizes, search.bins, capacity)
        assert best_fit.fewest(sizes, capacity) <= after <= before
        assert (np.bincount(search.bins, weights=sizes, minlength=len(search.fill)) == search.fill).all()
        fewer += after < before
    assert fewer >= 10


def test_each_kind_of_exchange():
    def run(bins, capacity):
        sizes = np.array([s for b in bins for s in b], np.int64)
        at = np.array([i for i, b in enumerate(bins) for _ in b], np.int64)
        search = best_fit.Search(sizes, at, capacity)
        search.run(100)
        return sorted(sorted(sizes[search.bins == b].tolist()) for b in set(search.bins.tolist()))

    assert run([[6, 1], [3]], 10) == [[1, 3, 6]]  # a move
    assert run([[6, 2], [5, 3], [4]], 10) == [[2, 3, 5], [4, 6]]  # one for one, then moves
    assert run([[7, 2], [6, 3], [1, 1]], 10) == [[1, 2, 7], [1, 3, 6]]
    assert run([[5, 4], [4, 3, 2], [1, 1]], 10) == [[1, 2, 3, 4], [1, 4, 5]]


def test_one_for_two_and_two_for_one():
    two = best_fit.Search(np.array([5, 4, 3, 2], np.int64), np.array([0, 0, 1, 1], np.int64), 10)
    two.fill  # bin 1 gives 3 and 2 for 4: 5 + 5 = 10
    assert two.exchange(1) and sorted(two.sizes[two.bins == 0].tolist()) == [2, 3, 5]
    one = best_fit.Search(np.array([4, 4, 1, 6, 3], np.int64), np.array([0, 0, 0, 1, 1], np.int64), 10)
    assert one.exchange(1) or one.exchange(0)


def test_best_fit_takes_the_fullest_bin_with_room():
    sizes = np.array([6, 7, 3, 2, 2], np.int64)
    bins = best_fit.best_fit(sizes, 10)
    assert bins[2] == bins[1] and bins[3] == bins[0] == bins[4]
