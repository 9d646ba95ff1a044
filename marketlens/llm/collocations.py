"""Collocations by dynamic itemset counting over cyclic scans of shards.

Texts become arrays of word hashes, dealt to ``SHARDS`` shards and written once.  A step
scans one shard, and steps go round the shards.  All lengths are counted in the same scan:
words from the first step on, and a longer phrase from the step after both its
subphrases (all but its last word, all but its first) have reached the threshold.  Each
phrase is counted for one full cycle from there, so over every shard exactly once.

Counting in the cycles takes a table of ``2 ** BITS`` slots, however large the corpus is.  A
slot holds the sum of the phrases that hash to it, so it is never less than the count of
any of them, and no phrase that reaches the threshold is missed.  What a step knows is the
step at which each slot reached the threshold; from that, a task tells for every place of a
text which phrases are active.  Tasks send the slots that they counted, compressed, and
these are added up in parts of the table; the driver holds the table alone.

When all cycles are complete, one more scan counts the phrases whose slots reached the
threshold by their words, so the figures are exact and those that only share a slot with
others fall out.  If the table is too small for a corpus, more phrases are counted in that
scan and the result is the same.

A hot word or phrase is one number of a task's table.  In the last scan a task adds up its
arrays before it hands on phrases, packed in parts by hash; a part is added up again where
its pieces meet, so what reaches the final sum grows with the distinct phrases.
"""

from __future__ import annotations

import struct
import uuid
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketlens.llm.common import LOWER, UPPER, join_spread, materialise, slices, text_of
from marketlens.session import ensure_checkpoint_dir
from marketlens.sources import files

LONGEST = 4
LEAST = 30
SCALE = 2_000_000
#: A phrase goes if a longer candidate around it has this percentage of its count.
COVERED = 80
TOP = 2000
SHARDS = 4
#: Slots of the table, as a power of two, and parts that it is added up in.
BITS = 26
PARTS = 1024
#: Tokens of an array.
CHUNK = 1 << 20
#: Texts that are split together.
TEXTS = 64
#: Phrases with their counts that a task holds in the last scan before it hands them on.
HELD = 1 << 19
#: Words whose hashes a task remembers.
CACHE = 1_000_000
#: Rows that meet in one window while the top is looked for, about, and groups that meet next.
RANKED = 50_000
FAN = 8

#: All ends of pieces become a full stop, which is in no word; a tab separates like a space.
ENDS = ".,;:!?\n\x0b\x0c\r"
TABLE = bytes.maketrans((UPPER + "\t" + ENDS).encode(), (LOWER + " " + "." * len(ENDS)).encode())
NEVER = 255

ARRAYS = "lang string, n_words long, tokens binary, words array<string>"


def seed_of(salt: int) -> int:
    """The seed with which XXH64 of a word equals Spark's xxhash64(salt, word)."""
    return xxhash.xxh64_intdigest(struct.pack("<q", salt), 42)


class Hashes(dict):
    """Signed 64-bit hashes of words, 0 for the end of a piece; ``fresh`` are the words that are new."""

    def __init__(self, salt: int):
        super().__init__({b".": 0})
        self.seed, self.fresh = seed_of(salt), []

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word, self.seed)
        h = h - (1 << 64) if h >> 63 else h or 1
        self[word] = h
        self.fresh.append(word)
        return h


def tokenise(salt: int, shards: int, chunk: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Arrays of word hashes by language, and the words that they stand for."""
        hashes, waiting, turn = Hashes(salt), {}, TaskContext.get().partitionId()
        lengths: Counter = Counter()

        def rows(lang: str | None, arrays: list[np.ndarray] | None, words: list[bytes], shard: int) -> pa.RecordBatch:
            tokens = np.concatenate(arrays) if arrays else None
            return pa.RecordBatch.from_arrays([
                pa.array([lang], pa.string()), pa.array([0 if tokens is None else int(np.count_nonzero(tokens))], pa.int64()),
                pa.array([None if tokens is None else tokens.tobytes()], pa.binary()),
                pa.array([[w.decode("utf-8") for w in words]], pa.list_(pa.string())), pa.array([shard], pa.int32())],
                ["lang", "n_words", "tokens", "words", "shard"])

        for batch in batches:
            for langs, texts in zip(slices(batch.column("lang"), TEXTS), slices(batch.column("text"), TEXTS)):
                for lang in dict.fromkeys(langs):
                    joined = b".".join(t for k, t in zip(langs, texts) if k == lang)
                    found = joined.translate(TABLE).replace(b".", b" . ").split()
                    array = np.fromiter(map(hashes.__getitem__, found), "<i8", len(found))
                    waiting.setdefault(lang, []).extend([array, np.zeros(1, "<i8")])
                    lengths[lang] += len(array) + 1
                # many languages are few arrays each, and no more than some in all
                full = waiting if lengths.total() >= 4 * chunk else [k for k in waiting if lengths[k] >= chunk]
                for lang in list(full):
                    yield rows(lang, waiting.pop(lang), [], turn % shards)
                    del lengths[lang]
                    turn += 1
                if len(hashes.fresh) > chunk // 8:
                    yield rows(None, None, hashes.fresh, -1)
                    hashes.fresh = []
                    if len(hashes) > CACHE:
                        hashes = Hashes(salt)
        for lang, kept in waiting.items():
            yield rows(lang, kept, [], turn % shards)
            turn += 1
        if hashes.fresh:
            yield rows(None, None, hashes.fresh, -1)

    return run


def slots_of(hashed: np.ndarray, bits: int) -> np.ndarray:
    return ((hashed ^ (hashed >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.uint32)


def phrases(lang: str, tokens: np.ndarray, reached: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each length k: k, the places, hashes and slots of phrases that begin a cycle at some step, and that step.

    ``reached`` holds for each slot the step from which its phrases activate longer ones.
    """
    words = tokens.view(np.uint64)
    at = np.flatnonzero(tokens)
    hashed = (words[at] ^ np.uint64(xxhash.xxh64_intdigest(lang))) * np.uint64(0xC2B2AE3D27D4EB4F)
    begins = np.zeros(len(at), np.uint8)
    for k in range(1, LONGEST + 1):
        slots = slots_of(hashed, bits)
        yield k, at, hashed, slots, begins
        if k == LONGEST or not len(at):
            return
        # a phrase that is not active activates nothing
        ready = np.full(len(tokens) + 1, NEVER, np.uint8)
        ready[at] = np.maximum(reached[slots], begins)
        longer = np.maximum(ready[at], ready[at + 1])
        go = longer < NEVER
        at, begins = at[go], longer[go]
        hashed = hashed[go] * np.uint64(0xFF51AFD7ED558CCD) ^ (words[at + k] + np.uint64(k)) * np.uint64(0xC4CEB9FE1A85EC53)


def unpack(blob: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)


def counted_slots(reached, step: int, shards: int, bits: int, parts: int, least: int, kind: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Parts of the table with the counts of the task's active phrases, no count above ``least``."""
        known = unpack(reached.value)
        table = np.zeros(1 << bits, kind)
        for batch in batches:
            for lang, tokens in zip(batch.column("lang").to_pylist(), batch.column("tokens").to_pylist()):
                for _, _, _, slots, begins in phrases(lang, np.frombuffer(tokens, "<i8"), known, bits):
                    active = np.sort(slots[(begins <= step) & (begins.astype(np.int32) + shards > step)])
                    if len(active):
                        first = np.flatnonzero(np.concatenate(([True], active[1:] != active[:-1])))
                        here, n = active[first], np.diff(np.append(first, len(active)))
                        table[here] = np.minimum(table[here] + n, least)
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for number, part in enumerate(table.reshape(parts, -1)):
            if part.any():
                yield pa.RecordBatch.from_pydict({"part": pa.array([number], pa.int32()), "counts": pa.array([squeeze(part.tobytes())], pa.binary())})

    return run


def added(least: int, kind: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of the counts of each part, no sum above ``least``; a part at a time comes in."""
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for number, blob in zip(batch.column("part").to_pylist(), batch.column("counts")):
                counts = unpack(blob.as_py()).view(kind)
                old = sums.get(number)
                sums[number] = counts if old is None else np.minimum(old.astype(np.uint64) + counts, least).astype(kind)
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for number, counts in sums.items():
            yield pa.RecordBatch.from_pydict({"part": pa.array([number], pa.int32()), "counts": pa.array([squeeze(counts.tobytes())], pa.binary())})

    return run


def together(blocks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Columns (language, words, count) with the counts of equal phrases added up, and their hashes, which they are sorted by.

    Phrases with equal hashes are told apart; such ones may stay in several columns.
    """
    rows = np.concatenate(blocks, axis=1)
    h = np.zeros(rows.shape[1], np.uint64)
    for values in rows[:-1]:
        h = (h ^ values.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    order = np.argsort(h)
    rows, h = rows[:, order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (rows[:-1, 1:] != rows[:-1, :-1]).any(axis=0)
    first = np.flatnonzero(new)
    sums = np.add.reduceat(rows[-1], first) if len(first) else rows[-1]
    rows = rows[:, first]
    rows[-1] = sums
    return rows, h[first]


def packed(rows: np.ndarray, h: np.ndarray, langs: list[str], parts: int) -> Iterator[pa.RecordBatch]:
    """A row for each part of the hashes: its number, its languages, and its phrases and counts, compressed."""
    squeeze = zstandard.ZstdCompressor(level=1).compress
    numbers = ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    bounds = np.searchsorted(numbers, np.arange(parts + 1))
    for number in np.flatnonzero(bounds[1:] > bounds[:-1]).tolist():
        part = rows[:, bounds[number]:bounds[number + 1]].copy()
        used, part[0] = np.unique(part[0], return_inverse=True)
        yield pa.RecordBatch.from_pydict({"part": pa.array([number], pa.int32()), "langs": pa.array([[langs[i] for i in used]], pa.list_(pa.string())),
                                          "counts": pa.array([squeeze(part.tobytes())], pa.binary())})


def exact_counts(reached, bits: int, parts: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of the phrases whose slots reached the threshold, by their words; absent words are 0.

        The arrays of a task are added up before they are handed on, in parts.
        """
        known = unpack(reached.value)
        langs: dict[str, int] = {}
        held: list[np.ndarray] = []
        n_held = 0
        for batch in batches:
            for lang, tokens in zip(batch.column("lang").to_pylist(), batch.column("tokens").to_pylist()):
                array = np.frombuffer(tokens, "<i8")
                number = langs.setdefault(lang, len(langs))
                for k, at, hashed, slots, _ in phrases(lang, array, known, bits):
                    keep = known[slots] < NEVER
                    at, hashed = at[keep], hashed[keep]
                    order = np.argsort(hashed)
                    at, hashed = at[order], hashed[order]
                    new = np.concatenate(([True], hashed[1:] != hashed[:-1]))[:len(at)]
                    columns = [array[at + i] for i in range(k)]
                    for c in columns:  # phrases with equal hashes are told apart
                        new[1:] |= c[1:] != c[:-1]
                    first = np.flatnonzero(new)
                    found = np.zeros((LONGEST + 2, len(first)), "<i8")
                    found[0], found[-1] = number, np.diff(np.append(first, len(at)))
                    for i, c in enumerate(columns, 1):
                        found[i] = c[first]
                    held.append(found)
                    n_held += len(first)
                if n_held > HELD:
                    rows, h = together(held)
                    held, n_held = [rows], rows.shape[1]
                    if n_held > HELD // 2:
                        yield from packed(rows, h, list(langs), parts)
                        langs, held, n_held = {}, [], 0
        if n_held:
            yield from packed(*together(held), list(langs), parts)

    return run


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Phrases and their counts, added up over the parts that come in; a phrase comes again if too many are held."""
    names = [f"w{i}" for i in range(LONGEST)]
    langs: dict[str, int] = {}
    held: list[np.ndarray] = []
    n_held = 0

    def out(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        texts = pa.array(list(langs), pa.string())
        for a in range(0, rows.shape[1], 1 << 16):
            part = rows[:, a:a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([texts.take(pa.array(part[0])), *map(pa.array, part[1:])], ["lang", *names, "f"])

    for batch in batches:
        for known, blob in zip(batch.column("langs").to_pylist(), batch.column("counts")):
            rows = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob.as_py()), "<i8").reshape(LONGEST + 2, -1).copy()
            rows[0] = np.array([langs.setdefault(x, len(langs)) for x in known])[rows[0]]
            held.append(rows)
            n_held += rows.shape[1]
            if n_held > HELD:
                rows, _ = together(held)
                held, n_held = [rows], rows.shape[1]
                if n_held > HELD // 2:
                    yield from out(rows)
                    langs, held, n_held = {}, [], 0
    if n_held:
        yield from out(together(held)[0])


def cycles(spark: SparkSession, arrays: DataFrame, shards: int, bits: int, parts: int, least: int) -> np.ndarray:
    """For each slot the step from which it was known to reach ``least``; NEVER where it did not."""
    kind = "u1" if least <= 0xFF else "<u2" if least <= 0xFFFF else "<u4"
    counts = np.zeros(1 << bits, kind)
    reached = np.full(1 << bits, NEVER, np.uint8)
    width = (1 << bits) // parts
    step, latest = 0, 0
    # the last phrases to begin their cycle did so when the latest slot was reached
    while step < latest + shards and step < LONGEST * shards:
        known = spark.sparkContext.broadcast(zstandard.ZstdCompressor(level=1).compress(reached.tobytes()))
        scan = arrays.where(F.col("shard") == step % shards).select("lang", "tokens")
        sent = scan.mapInArrow(counted_slots(known, step, shards, bits, parts, least, kind), "part int, counts binary")
        for row in sent.repartition("part").mapInArrow(added(least, kind), "part int, counts binary").collect():
            here = slice(row["part"] * width, (row["part"] + 1) * width)
            total = np.minimum(counts[here].astype(np.uint64) + unpack(bytes(row["counts"])).view(kind), least).astype(kind)
            counts[here] = total
            new = (total >= least) & (reached[here] == NEVER)
            if new.any():
                reached[here][new] = step + 1
                latest = step + 1
        known.destroy()
        step += 1
    return reached


def key(k: int) -> list[str]:
    return [f"w{i}" for i in range(k)]


def scored(frequent: DataFrame, scale: int) -> DataFrame:
    """(lang, p, a, l, r, score) of all phrases of two words or more; p is the array of word hashes."""
    long = frequent.where("size(p) > 1")
    cut = long.withColumn("k", F.explode(F.expr("sequence(1, size(p) - 1)")))
    sides = cut.select("lang", "p", "f", "k", F.posexplode(F.array(F.expr("slice(p, 1, k)"), F.expr("slice(p, k + 1, size(p) - k)"))).alias("side", "part"))
    table = frequent.select("lang", F.col("p").alias("part"), F.col("f").alias("n"))
    side = lambda i: F.max(F.when(F.col("side") == i, F.col("n")))
    cuts = sides.join(table, ["lang", "part"]).groupBy("lang", "p", "f", "k").agg(side(0).alias("l"), side(1).alias("r"))
    exact = "cast({} as decimal(38,0))"
    score = F.expr(f"cast({exact.format(scale)} * cast(f as decimal(19,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0))) as bigint)")
    best = cuts.withColumn("score", score).groupBy("lang", "p", "f").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    return best.select("lang", "p", F.col("f").alias("a"), "b.l", "b.r", "b.score")


def uncovered(candidates: DataFrame, covered: int) -> DataFrame:
    """Candidates without a longer one around them that has ``covered`` percent of their count."""
    begin = F.explode(F.expr("flatten(transform(sequence(2, size(p) - 1), n -> transform(sequence(1, size(p) - n + 1), i -> slice(p, i, n))))"))
    inside = candidates.where("size(p) > 2").select("lang", begin.alias("p"), F.col("a").cast("decimal(38,0)").alias("longer"))
    longest = inside.groupBy("lang", "p").agg(F.max("longer").alias("longer"))
    left = candidates.join(longest, ["lang", "p"], "left")
    return left.where(f"longer is null or 100 * longer < {covered} * cast(a as decimal(38,0))").drop("longer")


def leading(candidates: DataFrame, top: int) -> DataFrame:
    """Each language's first ``top`` by score and count, and those equal to the last of them; found in groups that meet in rounds."""
    groups = candidates.count() // RANKED + 1
    rows = candidates.withColumn("_g", F.pmod(F.xxhash64("p"), F.lit(groups)))
    while True:
        place = F.rank().over(Window.partitionBy("lang", "_g").orderBy(F.desc("score"), F.desc("a")))
        rows = rows.withColumn("_place", place).where(F.col("_place") <= top).drop("_place")
        if groups == 1:
            return materialise(rows.drop("_g"))
        groups = -(-groups // FAN)
        rows = materialise(rows.withColumn("_g", F.pmod(F.col("_g"), F.lit(groups))))


def spelled(rows: DataFrame, dictionary: DataFrame, salt: int) -> tuple[DataFrame, bool]:
    """``rows`` with their words as ``phrase``; and whether two words that matter have the same hash."""
    words = materialise(rows.select("lang", "p", F.posexplode("p").alias("i", "h")))
    hashed = F.xxhash64(F.lit(salt).cast("long"), F.col("word"))
    texts = dictionary.select(F.explode("words").alias("word")).withColumn("h", F.when(hashed == 0, 1).otherwise(hashed))
    texts = texts.join(words.select("h").distinct(), "h", "left_semi").groupBy("h").agg(F.min("word").alias("word"), F.max("word").alias("other"))
    texts = materialise(texts)
    if not texts.where("word <> other").isEmpty():
        return rows, True
    found = join_spread(words, texts.select("h", "word"), "h", F.xxhash64("lang", "p"))
    named = found.groupBy("lang", "p").agg(F.array_sort(F.collect_list(F.struct("i", "word"))).alias("_all"))
    named = named.select("lang", "p", F.array_join(F.col("_all.word"), " ").alias("phrase"))
    return rows.join(named, ["lang", "p"]), False


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, scale: int = SCALE, covered: int = COVERED,
                 top: int = TOP, shards: int = SHARDS, bits: int = BITS, parts: int = PARTS, chunk: int = CHUNK, salt: int = 0) -> DataFrame:
    """One row per phrase: lang, rank, phrase, a, l, r, n, score; each language's first ``top``.

    A null text is empty and a null language is ``und``.  A text of any length is read whole.
    Repeated rows count each time they occur.  Phrases with the same score and count stand in
    the order of their text, so reruns agree.  An empty table, or one without a phrase that
    occurs ``least`` times, gives an empty result.  Only the text and the language are read.
    If two words that matter have the same 64-bit hash, all is done again with other hashes.
    """
    if not 1 <= shards <= (NEVER - 1) // LONGEST:
        raise ValueError(f"the number of shards is between 1 and {(NEVER - 1) // LONGEST}")
    spark = docs.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/collocations-{uuid.uuid4().hex}"
    try:
        texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), text_of(text_col).cast("binary").alias("text"))
        written = texts.mapInArrow(tokenise(salt, shards, chunk), ARRAYS + ", shard int")
        written.write.partitionBy("shard").option("compression", "zstd").parquet(folder)
        stored = spark.read.schema(ARRAYS + ", shard int").parquet(folder)
        arrays = stored.where("shard >= 0")
        reached = cycles(spark, arrays, shards, bits, parts, least)
        known = spark.sparkContext.broadcast(zstandard.ZstdCompressor(level=1).compress(reached.tobytes()))
        places = key(LONGEST)
        counted = arrays.select("lang", "tokens").mapInArrow(exact_counts(known, bits, parts), "part int, langs array<string>, counts binary")
        counted = counted.repartition("part").sortWithinPartitions("part").mapInArrow(summed, "lang string, " + ", ".join(f"{w} long" for w in places) + ", f long")
        sums = counted.groupBy("lang", *places).agg(F.sum("f").alias("f")).where(F.col("f") >= least)
        frequent = materialise(sums.select("lang", F.filter(F.array(*places), lambda w: w != 0).alias("p"), "f"))
        known.destroy()
        first = leading(materialise(uncovered(materialise(scored(frequent, scale)), covered)), top)
        named, clash = spelled(first, stored.where("shard < 0"), salt)
        if clash:
            return collocations(docs, text_col, lang_col, least, scale, covered, top, shards, bits, parts, chunk, salt + 1)
        n = arrays.groupBy("lang").agg(F.sum("n_words").alias("n"))
        # a language has its first rows here, and those equal to the last of them
        place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
        out = named.withColumn("rank", place.cast("long")).where(F.col("rank") <= top).join(n, "lang")
        return materialise(out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
    finally:
        files.remove(spark, folder)
