"""Mixture-controlled packing by deficit round-robin over source queues.

Each source is a queue of its documents' tokens.  In every round a source's deficit grows
by its share of the window, and the source is served as many tokens as its deficit covers;
the rest is carried to the next round.  Sources whose share of a window is small are served
in units of ``UNIT`` tokens, once their deficit covers one.  The rounds, one after the
other, form one stream that is cut into sequences, so windows are full and each has the
target proportions up to a unit.

What a source has been served before round r is floor(r * window * share), so its deficit
follows from the round alone.  No state passes from window to window or from partition to
partition: each document computes the rounds it is served in from its place in its queue.
Places in queues and in the stream are prefix sums over buckets of bounded size.

The ids are computed once and written to the checkpoint folder.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.llm.common import materialise, prefix_sums, slices, text_of
from marketlens.llm.tokens import TEXTS, tokenizer, tokenizer_path

LENGTH = 2048
END_ID = 1
#: Least number of tokens that a source with a small share is served at a time.
UNIT = 32
#: Documents in a bucket of a queue, and rounds in a bucket of the stream.
BUCKET_ROWS = 1_000
BUCKET_ROUNDS = 512


def token_ids(path: str, end_id: int):
    """An Arrow UDF from text bytes to (number of ids, ids), with ``end_id`` last; ids are compressed."""
    schema = T.StructType([T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType())])

    @F.arrow_udf(schema)
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = tokenizer(path)
        end = np.array([end_id], words.dtype).tobytes()
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for texts in batches:
            out = []
            for part in slices(texts, TEXTS):
                packed = [ids + end for ids in words.encode(part)]
                out += [(len(p) // words.dtype.itemsize, squeeze(p)) for p in packed]
            yield pa.StructArray.from_arrays([pa.array([n for n, _ in out], pa.int64()), pa.array([b for _, b in out], pa.binary())], ["n", "ids"])

    return encode


@F.arrow_udf(T.ArrayType(T.LongType()))
def checksums(ids: pa.Array, n: pa.Array, starts: pa.Array, lengths: pa.Array) -> pa.Array:
    """CRC32 of each piece's ids as little-endian unsigned 32-bit integers."""
    def one(packed: bytes, count: int, at: list[int], size: list[int]) -> list[int]:
        raw = expand(packed)
        wide = memoryview(np.frombuffer(raw, f"<u{len(raw) // count}").astype("<u4").tobytes())
        return [zlib.crc32(wide[4 * a:4 * (a + k)]) for a, k in zip(at, size)]

    expand = zstandard.ZstdDecompressor().decompress
    parts = zip(*map(slices, (ids, n, starts, lengths)))
    return pa.array([one(*x) for part in parts for x in zip(*part)], pa.list_(pa.int64()))


def served(queues: DataFrame, total: int, length: int, unit: int) -> DataFrame:
    """Pieces of documents in the order of service: _round, _start, _len (tokens of the source's queue).

    ``queues`` has _at, the document's first place in its source's queue of _total tokens.
    """
    t, window, whole = "cast(_total as decimal(19,0))", f"cast({length} as decimal(10,0))", f"cast({total} as decimal(19,0))"
    dec = lambda x: f"cast({x} as decimal(19,0))"
    # a source is served every round if its share of a window is a unit or more
    often = f"_total * {length}D / {total}D >= {unit}"
    up = lambda a, b: f"(({a} + {b} - 1) div ({b}))"
    round_of = lambda tokens: f"({up(f'{dec(tokens)} * {whole}', f'{window} * {t}')} - 1)"  # noqa: E731  when so many tokens are covered
    before = lambda r: f"(({dec(r)} * {window} * {t}) div {whole})"  # noqa: E731  tokens served before round r
    steps = queues.withColumn("_often", F.expr(often)).withColumn("_step", F.explode(F.expr(
        f"sequence(if(_often, {round_of('_at + 1')}, _at div {unit}), if(_often, {round_of('_at + _n')}, (_at + _n - 1) div {unit}))")))
    bounds = steps.select("*", F.expr(f"greatest(_at, if(_often, {before('_step')}, _step * {unit}))").alias("_from"),
                          F.expr(f"least(_at + _n, if(_often, {before('_step + 1')}, (_step + 1) * {unit}))").alias("_to"),
                          F.expr(f"if(_often, _step, {round_of(f'(_step + 1) * {unit}')})").alias("_round"))
    return bounds.select("_row", "_source", "_round", F.col("_from").alias("_place"), (F.col("_from") - F.col("_at")).alias("_start"),
                         (F.col("_to") - F.col("_from")).alias("_len")).where("_len > 0")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", path: str | None = None,
         length: int = LENGTH, end_id: int = END_ID, unit: int = UNIT) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null text is empty: its document is the end id alone.  A null source is a queue of its
    own.  Repeated rows and rows with null ids are packed one by one.  An empty table gives an
    empty result; other columns are not read.  Texts of any length are encoded whole, in
    parts, and cut wherever a window ends.  Only the last sequence can be short; it is
    padded to ``length`` unless its tokens are a power of two.  Target proportions are the
    sources' shares of all tokens, so that all queues end together.
    """
    encoded = docs.select(F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("_source"),
                          token_ids(path or tokenizer_path(), end_id)(text_of(text_col).cast("binary")).alias("_t"))
    # the row number is written with the ids, so it stays the same in all later jobs
    rows = materialise(encoded.select(F.monotonically_increasing_id().alias("_row"), "_id", "_source", F.col("_t.n").alias("_n"), F.col("_t.ids").alias("_ids")))
    place = F.xxhash64("_id")
    light = materialise(rows.select("_row", "_id", "_source", "_n", place.alias("_h")))
    count, total = light.agg(F.count("*"), F.sum("_n")).first()
    total = total or 1
    buckets = count // BUCKET_ROWS + 1
    spread = light.withColumn("_bucket", F.floor(F.pmod("_h", F.lit(1 << 31)) * F.lit(buckets) / F.lit(1 << 31)))
    queues = prefix_sums(spread, ["_source"], "_bucket", ["_h", "_id", "_row"], "_n", "_at", total="_total")
    pieces = served(queues, total, length, unit).withColumn("_block", F.floor(F.col("_round") / BUCKET_ROUNDS))
    stream = prefix_sums(pieces, [], "_block", ["_round", "_source", "_place"], "_len", "_offset")
    first, last = F.expr(f"_offset div {length}"), F.expr(f"(_offset + _len - 1) div {length}")
    cut = stream.withColumn("_sequence", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col("_offset"), F.col("_sequence") * length)
    end = F.least(F.col("_offset") + F.col("_len"), (F.col("_sequence") + 1) * length)
    laid = cut.select("_row", F.struct((F.col("_start") + begin - F.col("_offset")).alias("start"), (end - begin).alias("length"),
                                       F.col("_sequence").alias("sequence_id"), (begin - F.col("_sequence") * length).alias("offset")).alias("_piece"))
    by_row = laid.groupBy("_row").agg(F.array_sort(F.collect_list("_piece")).alias("_pieces"))
    whole = rows.select("_row", "_id", "_n", "_ids").join(by_row, "_row")
    summed = whole.withColumn("_crc", checksums("_ids", "_n", F.col("_pieces.start"), F.col("_pieces.length")))
    out = summed.select("_id", "_n", F.explode(F.arrays_zip(F.col("_pieces").alias("p"), F.col("_crc").alias("c"))).alias("_z"))
    return out.select(F.col("_id").alias(id_col), F.col("_z.p.start").alias("start"), F.col("_z.p.length").alias("length"),
                      F.col("_z.c").alias("ids_crc32"), F.col("_n").alias("doc_tokens"), F.col("_z.p.sequence_id").alias("sequence_id"),
                      F.col("_z.p.offset").alias("offset"))
