import zlib
from collections import Counter, defaultdict

import numpy as np
from cases import ROWS, frame

from marketlens.llm import packing
from marketlens.llm.tokens import tokenizer_path


def round_trip(df, docs, length=2048, **kw):
    """Check every piece against the tokenizer; returns tokens by (sequence, doc_id)."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for doc_id, text in docs:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want[(doc_id, len(ids), ids.tobytes())] += 1
    pieces = packing.pack(df, length=length, **kw).collect()
    by_sequence = defaultdict(list)
    for p in pieces:
        by_sequence[p.sequence_id].append((p.offset, p.length, p.doc_id))
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for s, placed in by_sequence.items():
        at = 0
        for offset, n, _ in sorted(placed):
            assert offset == at and n > 0
            at += n
        assert at == length or s == len(by_sequence) - 1 and at <= length
    # the pieces of a document (and of its copies) cover its ids
    seen = defaultdict(list)
    for p in pieces:
        seen[(p.doc_id, p.doc_tokens)].append((p.start, p.length, p.ids_crc32))
    for (doc_id, n), parts in seen.items():
        texts = [(ids, c) for (d, k, ids), c in want.items() if (d, k) == (doc_id, n)]
        assert sum(k for _, k, _ in parts) == n * sum(c for _, c in texts)
        for start, k, crc in parts:
            assert any(zlib.crc32(ids[4 * start:4 * (start + k)]) == crc for ids, _ in texts)
        cover = Counter(x for start, k, _ in parts for x in range(start, start + k))
        assert set(cover) == set(range(n)) and set(cover.values()) == {sum(c for _, c in texts)}
    assert {(d, k) for d, k, _ in want} == set(seen)
    return by_sequence


def test_awkward_rows(spark):
    round_trip(frame(spark), [(r[0], r[1]) for r in ROWS], length=256)
    assert packing.pack(frame(spark, [])).count() == 0


def test_windows_hold_the_target_proportions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("source in ('src1', 'src2', 'src3', 'src4') and n_chars < 20000")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    placed = round_trip(docs, [r[:2] for r in rows], length=512)
    source = {r[0]: r[2] for r in rows}
    total = Counter()
    for parts in placed.values():
        for _, n, doc in parts:
            total[source[doc]] += n
    everything = sum(total.values())
    last = max(placed)
    for s, parts in placed.items():
        if s < last - 1:
            here = Counter()
            for _, n, doc in parts:
                here[source[doc]] += n
            for k, n in total.items():
                assert abs(here[k] - 512 * n / everything) <= 2 * packing.UNIT


def test_small_sources_are_served_in_units(spark):
    big = [(i, "alpha beta gamma delta " * 50, "big") for i in range(200)]
    tiny = [(1000 + i, "epsilon " * 40, f"tiny{i}") for i in range(5)]
    df = spark.createDataFrame(big + tiny, "doc_id long, text string, source string")
    placed = round_trip(df, [r[:2] for r in big + tiny], length=1024)
    pieces = Counter(doc for parts in placed.values() for _, _, doc in parts if doc >= 1000)
    assert all(n <= 41 // packing.UNIT + 3 for n in pieces.values())


def test_buckets_do_not_change_the_packing(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_ROWS", 3)
    monkeypatch.setattr(packing, "BUCKET_ROUNDS", 2)
    round_trip(frame(spark), [(r[0], r[1]) for r in ROWS], length=128)
