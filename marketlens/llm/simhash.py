"""SimHash near-duplicates through an inverted index over positional bytes.

A fingerprint is 64 bits, eight positional bytes.  If two fingerprints differ in at most
four bits, at most four bytes differ, so at least ``MIN_SHARED`` = 4 of the eight agree.

A posting list for every single (position, byte) would hold 1/256 of all fingerprints and
make the tally quadratic, so a posting holds the bytes of ``POSTING`` positions.  The sets
of positions are chosen so that any four positions contain one of them: whichever four
bytes a pair shares, it meets in some posting list.  Where a pair meets, its shared bytes
are tallied over all eight positions, pairs below the guaranteed minimum are left out,
and the rest is verified by the number of differing bits.  A pair that meets in several
lists is only taken from the first of them, so links need no deduplication.

Only distinct fingerprints enter the index: documents that share a fingerprint are one
entry, however many there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.llm.common import connected, join_spread, keep_rows, materialise, slices, text_of

SHINGLE = 4
SEED = 42
MAX_BITS = 4
BYTES = 8
MIN_SHARED = BYTES - MAX_BITS
#: Fingerprints of a posting list that is not cut.
LONG_LIST = 2048
#: Shingles that are turned into bits at a time, which bounds the memory of a long text.
CHUNK = 1 << 14


def fingerprint(text: bytes) -> int:
    """The signed 64-bit fingerprint of a UTF-8 text; 0 if it has no words."""
    words = (text or b"").lower().split()  # of bytes: lowers A-Z, splits at the six ASCII white-space characters
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    last = min(SHINGLE, len(words)) - 1
    n = len(words) - last
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        to = min(at + CHUNK, n)
        hashes = np.fromiter([digest(joined[a:b], SEED) for a, b in zip(starts[at:to].tolist(), ends[at + last:to + last].tolist())], "<u8", to - at)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


@F.arrow_udf(T.LongType())
def fingerprints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        yield pa.array([fingerprint(t) for part in slices(texts) for t in part], pa.int64())


def position_sets(size: int) -> list[tuple[int, ...]]:
    """Sets of ``size`` positions such that any ``MIN_SHARED`` positions contain one of them.

    For 4, all sets of four.  For 3, the positions form three groups in a ring, and a set
    lies in one group or has two positions in a group and one in the next: 20 sets.
    """
    if size == MIN_SHARED:
        return list(combinations(range(BYTES), size))
    if size != 3:
        raise ValueError("a posting holds three or four bytes")
    group = lambda p: p * 3 // BYTES
    chosen = []
    for s in combinations(range(BYTES), 3):
        g = sorted(map(group, s))
        if len(set(g)) == 1 or len(set(g)) == 2 and ((g[1] + 1) % 3 == g[2] if g[0] == g[1] else (g[1] + 1) % 3 == g[0]):
            chosen.append(s)
    return chosen


def mask_of(positions: tuple[int, ...]) -> int:
    mask = sum(0xFF << 8 * p for p in positions)
    return mask - (1 << 64) if mask >> 63 else mask


def shared_bytes(x: Column) -> Column:
    """Bit p is set if byte p of ``x``, the exclusive-or of two fingerprints, is zero."""
    bits = [F.when(x.bitwiseAND(F.lit(mask_of((p,)))) == 0, 1 << p).otherwise(0) for p in range(BYTES)]
    return sum(bits[1:], bits[0])


def posting_for(n: int) -> int:
    """Positions of a posting for ``n`` distinct fingerprints; both sizes give the same links.

    Three hold a list for each of 2^24 keys and set of positions; when those grow beyond a
    few entries, four make them shorter by 256.
    """
    return 3 if n <= 1 << 26 else 4


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task's links those that join two of its components: the same components from fewer links than nodes."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    for batch in batches:
        kept = []
        for i, (a, b) in enumerate(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist())):
            ra, rb = root(a), root(b)
            if ra != rb:
                parent[rb] = ra
                kept.append(i)
        if kept:
            yield batch.take(pa.array(kept))


def links(prints: DataFrame, posting: int = 3, max_bits: int = MAX_BITS, long_list: int = LONG_LIST) -> DataFrame:
    """(a, b), a < b: all pairs of distinct fingerprints (column ``_fp``) within ``max_bits`` bits.

    A posting list of more than ``long_list`` fingerprints is cut into chunks by a hash, and
    each pair of chunks is a join key of its own, so a dense family is spread over many tasks.
    """
    if max_bits > MAX_BITS:
        raise ValueError("the index is complete for up to four differing bits")
    sets = position_sets(posting)
    entries = F.array(*[F.struct(F.lit(k).cast("short").alias("k"), F.col("_fp").bitwiseAND(F.lit(mask_of(s))).alias("key")) for k, s in enumerate(sets)])
    postings = prints.select("_fp", F.explode(entries).alias("e")).select("_fp", "e.k", "e.key")
    long = postings.groupBy("k", "key").agg(F.count("*").alias("n")).where(F.col("n") > long_list)
    cut = postings.join(long.select("k", "key", F.ceil(F.col("n") / long_list).cast("int").alias("m")), ["k", "key"], "left")
    m = F.coalesce("m", F.lit(1))
    cut = cut.select("_fp", "k", "key", m.alias("m"), F.pmod(F.xxhash64("_fp"), m).cast("int").alias("c"))
    # which list is the first where a pair meets, by the set of bytes it shares
    first = F.array(*[F.lit(next((k for k, s in enumerate(sets) if all(m >> p & 1 for p in s)), -1)) for m in range(1 << BYTES)])
    a = cut.select("_fp", "k", "key", F.col("c").alias("lo"), F.explode(F.sequence("c", F.col("m") - 1)).alias("hi")).alias("a")
    b = cut.select("_fp", "k", "key", F.explode(F.sequence(F.lit(0), "c")).alias("lo"), F.col("c").alias("hi")).alias("b")
    xor = F.col("a._fp").bitwiseXOR(F.col("b._fp"))
    shared = shared_bytes(xor)
    here = F.get(first, shared) == F.col("a.k")
    tally = F.bit_count(shared) >= MIN_SHARED
    near = F.bit_count(xor) <= max_bits
    met = (F.col("a.k") == F.col("b.k")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.lo") == F.col("b.lo")) & (F.col("a.hi") == F.col("b.hi"))
    once = (F.col("a.lo") < F.col("a.hi")) | (F.col("a._fp") < F.col("b._fp"))
    return a.join(b, met & once & tally & near & here).select(F.least("a._fp", "b._fp").alias("a"), F.greatest("a._fp", "b._fp").alias("b"))


def grouped(docs: DataFrame, id_col: str, text_col: str, posting: int | None, max_bits: int) -> tuple[DataFrame, DataFrame]:
    """(_id, _fp, _key) of every row, and (_fp, _best) with the smallest document of the group."""
    text = text_of(text_col)
    rows = materialise(docs.select(F.col(id_col).alias("_id"), fingerprints(text.cast("binary")).alias("_fp"), F.xxhash64(text).alias("_key")))
    entry = F.struct(F.col("_id").isNull().alias("unnamed"), F.col("_id").alias("id"), F.col("_key").alias("key"))
    prints = materialise(rows.groupBy("_fp").agg(F.min(entry).alias("_first")))
    # the links of a dense family are many more than its fingerprints, so tasks hand on what connects them
    pairs = links(prints.select("_fp"), posting or posting_for(prints.count()), max_bits).mapInArrow(forest, "a long, b long")
    members = materialise(connected(materialise(pairs)))
    best = members.join(prints, F.col("node") == F.col("_fp")).groupBy("root").agg(F.min("_first").alias("_best"))
    joined = join_spread(members, best, "root", F.xxhash64("node")).select("node", "_best")
    groups = prints.join(joined, F.col("_fp") == F.col("node"), "left").select("_fp", F.coalesce("_best", "_first").alias("_best"))
    return rows, groups


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", posting: int | None = None, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id.

    A null or empty text has fingerprint zero and is linked like any other.  component_id is
    the smallest id that can be reached over links; null ids count last, so it is null only
    if every id of the group is.  Repeated rows share their group.  A text of any length has
    the fingerprint of all its shingles.  An empty table gives an empty result; only the id
    and the text are read.
    """
    rows, groups = grouped(docs, id_col, text_col, posting, max_bits)
    # a fingerprint can be that of very many documents
    return join_spread(rows, groups, "_fp", F.xxhash64("_id", "_key")).select(F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"),
                                           F.col("_best.id").alias("component_id"))


def thin(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", posting: int | None = None, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs``, all columns, with one row of each group: the one with the smallest id.

    The cases of ``near_duplicates`` hold here too; of rows with that id and the same text,
    the one with the smallest hash over its columns stays.
    """
    _, groups = grouped(docs, id_col, text_col, posting, max_bits)
    stay = groups.select(F.col("_best.id").alias("_stay_id"), F.col("_best.key").alias("_stay_key")).distinct()
    return keep_rows(docs, stay, id_col, F.xxhash64(text_of(text_col)))
