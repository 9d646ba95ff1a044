import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from cases import ROWS, frame
from pyspark.sql import functions as F

from marketlens.llm import collocations as co

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counts(rows):
    """f of every phrase by (lang, words), and n by lang."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, tuple(words[i:i + k])) for k in range(1, 5) for i in range(len(words) - k + 1))
    return f, n


def by_hand(rows, least, top):
    f, n = counts(rows)
    found = {}
    for (lang, p), a in f.items():
        if len(p) > 1 and a >= least:
            found[lang, p] = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
    inside = Counter()
    for lang, p in found:
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                inside[lang, p[i:i + m]] = max(inside[lang, p[i:i + m]], f[lang, p])
    out = []
    for lang in n:
        left = [(-s, -f[lang, p], " ".join(p).encode(), l, r) for (x, p), (s, _, l, r) in found.items() if x == lang and 100 * inside[lang, p] < 80 * f[lang, p]]
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(left)[:top], 1)]
    return out


def random_rows(seed, n):
    rng = random.Random(seed)
    words = ["the", "The", "of", "red", "apple", "é", "ÉT", "漢字", "a b", "x\x1cy", "new", "york", "city", "in", "don't", "--"]
    weights = [1 / (i + 1) for i in range(len(words))]
    rows = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, 40)):
            parts.append(rng.choices(words, weights)[0] if rng.random() < 0.8 else "new york city hall")
            parts.append(rng.choices([" ", "\t", "  ", ". ", ",", "\n", "\r\n", "\x0b"], [20, 2, 1, 2, 1, 1, 1, 1])[0])
        rows.append(("".join(parts), rng.choice(["en", "en", "en", "fr", None])))
    return rows + [(None, "en"), ("", None), (" .,;", "de"), ("new york city hall " * 50, "und")]


@pytest.mark.parametrize("shards, bits, chunk, least, top", [(1, 16, 1000, 3, 2000), (3, 16, 30, 3, 50), (4, 10, 100, 2, 7), (7, 16, 20, 5, 2000)])
def test_brute_force(spark, shards, bits, chunk, least, top):
    rows = random_rows(shards, 120)
    df = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    got = [tuple(r) for r in co.collocations(df, shards=shards, bits=bits, parts=64, chunk=chunk, least=least, top=top).collect()]
    assert sorted(got) == sorted(by_hand(rows, least, top)) and got


def test_awkward_rows(spark):
    df = frame(spark, ROWS * 5)
    got = [tuple(r) for r in co.collocations(df, bits=16, parts=64, least=5).collect()]
    assert sorted(got) == sorted(by_hand([(r[1], r[2]) for r in ROWS * 5], 5, 2000)) and got
    assert co.collocations(frame(spark, []), bits=12, parts=16).count() == 0
    assert co.collocations(frame(spark, [ROWS[2]]), bits=12, parts=16).count() == 0
    with pytest.raises(ValueError):
        co.collocations(df, shards=64)


def test_top_is_found_in_groups(spark, monkeypatch):
    rows = random_rows(11, 150)
    monkeypatch.setattr(co, "RANKED", 5)
    got = [tuple(r) for r in co.collocations(spark.createDataFrame(rows, "text string, lang string"), bits=16, parts=64, least=2, top=9).collect()]
    assert sorted(got) == sorted(by_hand(rows, 2, 9))


@pytest.mark.parametrize("held", [4, 1 << 19])
def test_last_scan_adds_up_arrays_of_a_task(spark, monkeypatch, held):
    """A task with many arrays hands on a row per part; sums are right if they are handed on early."""
    from types import SimpleNamespace

    import pyarrow as pa
    import zstandard
    monkeypatch.setattr(co, "HELD", held)
    tokens = np.array([5, 6, 7, 0, 5, 6, 0], "<i8").tobytes()
    batch = pa.RecordBatch.from_pydict({"lang": ["en", "fr"] * 20, "tokens": pa.array([tokens] * 40, pa.binary())})
    reached = SimpleNamespace(value=zstandard.ZstdCompressor().compress(np.zeros(1 << 8, np.uint8).tobytes()))
    sent = list(co.exact_counts(reached, 8, 1)(iter([batch])))
    if held > 40:
        assert sum(b.num_rows for b in sent) == 1 and sum(b.num_rows for b in co.summed(iter(sent))) == 12
    got = Counter()
    for b in co.summed(iter(sent)):
        for r in b.to_pylist():
            got[r["lang"], tuple(r[f"w{i}"] for i in range(4) if r[f"w{i}"])] += r["f"]
    once = {(5,): 2, (6,): 2, (7,): 1, (5, 6): 2, (6, 7): 1, (5, 6, 7): 1}
    assert got == {(lang, p): 20 * n for lang in ("en", "fr") for p, n in once.items()}


def test_words_with_the_same_hash_start_anew(spark, monkeypatch):
    seen, plain = [], co.spelled

    def clash_once(rows, dictionary, salt):
        seen.append(salt)
        return (rows, True) if salt == 0 else plain(rows, dictionary, salt)

    monkeypatch.setattr(co, "spelled", clash_once)
    rows = random_rows(5, 60)
    got = [tuple(r) for r in co.collocations(spark.createDataFrame(rows, "text string, lang string"), bits=14, parts=16, least=3).collect()]
    assert seen == [0, 1] and sorted(got) == sorted(by_hand(rows, 3, 2000))


def test_hashes_are_sparks(spark):
    words = ["", "a", "漢字", "x" * 100]
    for salt in (0, 1, 7):
        df = spark.createDataFrame([(w,) for w in words], "w string").select(F.xxhash64(F.lit(salt).cast("long"), F.col("w")))
        assert [r[0] % 2 ** 64 for r in df.collect()] == [xxhash.xxh64_intdigest(w, co.seed_of(salt)) for w in words]


def test_every_phrase_has_one_full_cycle():
    """In a plain simulation of the steps, each phrase is counted in as many steps as there are shards, once in each shard."""
    shards, bits, least = 4, 20, 4
    rng = np.random.default_rng(2)
    arrays = [rng.integers(0, 9, 400) * 7919 for _ in range(shards)]
    reached, table = np.full(1 << bits, co.NEVER, np.uint8), np.zeros(1 << bits, int)
    seen, began = Counter(), {}
    for step in range(co.LONGEST * shards):
        a = arrays[step % shards].astype("<i8")
        for k, at, _, slots, begins in co.phrases("en", a, reached, bits):
            active = (begins <= step) & (begins.astype(int) + shards > step)
            for i, b in zip(at[active], begins[active]):
                p = tuple(a[i:i + k])
                seen[p] += 1
                assert began.setdefault(p, b) == b
            np.add.at(table, slots[active], 1)
        reached[(table >= least) & (reached == co.NEVER)] = step + 1
    f = Counter(tuple(a[i:i + k]) for a in arrays for k in range(1, 5) for i in range(len(a) - k + 1) if 0 not in a[i:i + k])
    assert all(seen[p] == n for p, n in f.items() if p in seen)
    assert all(p in seen for p, n in f.items() if n >= least) and len({b for b in began.values()}) > 3


def test_figures_beyond_64_bits(spark):
    big = 9_000_000_000_000
    rows = [("en", [1], big), ("en", [2], big + 1), ("en", [3], 40), ("en", [1, 2], big - 1), ("en", [2, 3], 35), ("en", [1, 2, 3], 33)]
    got = co.scored(spark.createDataFrame(rows, "lang string, p array<long>, f long"), 2_000_000).collect()
    want = {(1, 2): (big - 1, big, big + 1, 2_000_000 * (big - 1) // (2 * big + 1)), (2, 3): (35, big + 1, 40, 0), (1, 2, 3): (33, big, 35, 0)}
    assert {tuple(r.p): (r.a, r.l, r.r, r.score) for r in got} == want
    kept = co.uncovered(co.scored(spark.createDataFrame(rows, "lang string, p array<long>, f long"), 2_000_000), 80)
    assert sorted(tuple(r.p) for r in kept.collect()) == [(1, 2), (1, 2, 3)]
