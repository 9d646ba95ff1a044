"""Naive Bayes support vectors: a linear hinge-loss model over n-gram indicators that are
scaled by their class log-count ratios.

Features are the byte n-grams of orders 1 to 3 of the whole text, hashed to ``BUCKETS``
buckets; a feature is 1 if the text has the n-gram at all.  As most n-grams occur somewhere
in a long text, three classes of n-grams also mark a feature by their share of the text:
symbols and capitals among the bytes, and word pairs that repeat a word.  The model is fitted on a
bounded sample of the labelled rows (``SAMPLE_ROWS``): log-count ratios, then dual
coordinate descent, then a logistic calibration on sampled rows that the fit has not seen.
Every document is scored.

Spark joins the sample to the texts, extracts features and scores in parallel.  The fit
is one task over the sample, whose size is fixed: a row is a bitmap of BUCKETS bits.
"""

from __future__ import annotations

import bisect
import math
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.llm.common import slices, text_of

ORDERS = (1, 2, 3)
BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
#: Upper ends of the shares that have a feature of their own.
SHARES = (0.0, 0.003, 0.01, 0.03, 0.1, 0.3, 1.0)
SYMBOLS = np.frombuffer(b"#*$%&|<>!", np.uint8)
CAPITALS = np.arange(65, 91)
#: Bound on the labelled rows that are used to fit and to calibrate.
SAMPLE_ROWS = 8_000
#: One sampled row in so many is kept from the fit, for the calibration.
CALIBRATION_SHARE = 4
#: Bytes that are turned into n-grams at a time, which bounds the memory of a long text.
CHUNK = 1 << 20
SMOOTHING = 1.0
PENALTY = 1.0
EPOCHS = 15
THRESHOLD = 0.7


def held_out(id_col: str) -> Column:
    """Rows whose labels are never learned from."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def mark_ngrams(text: bytes, marks: np.ndarray) -> None:
    """Set ``marks`` at the bucket of every n-gram of ``text``."""
    reach = max(ORDERS) - 1
    seen = np.zeros(256, np.int64)
    for at in range(0, max(len(text), 1), CHUNK):
        b = np.frombuffer(text[at:at + CHUNK + reach], np.uint8).astype(np.uint32)
        seen += np.bincount(b[:CHUNK], minlength=256)
        code = b
        for order in ORDERS:
            if len(b) < order:
                break
            if order > 1:
                code = (code[:-1] << np.uint32(8)) | b[order - 1:]
            mixed = (code * np.uint32(0x9E3779B1) ^ np.uint32(order * 0x51C88647)) * np.uint32(0x85EBCA6B)
            marks[mixed >> np.uint32(32 - BUCKET_BITS)] = True
    words = text.split()
    repeats = sum(map(operator.eq, words, words[1:]))
    for kind, part, whole in ((0, seen[SYMBOLS].sum(), len(text)), (1, seen[CAPITALS].sum(), len(text)), (2, repeats, len(words) - 1)):
        marks[kind * len(SHARES) + bisect.bisect_left(SHARES, part / max(whole, 1))] = True


def bitmap(text: bytes) -> bytes:
    marks = np.zeros(BUCKETS, bool)
    mark_ngrams(text or b"", marks)
    return np.packbits(marks).tobytes()


@F.arrow_udf(T.BinaryType())
def bitmaps(texts: pa.Array) -> pa.Array:
    return pa.array([bitmap(t) for part in slices(texts) for t in part], pa.binary())


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int) -> DataFrame:
    """(_rank, _label, _bits): the sampled labelled rows, at most one per id.

    Labels of held-out rows, null labels and ids with contradicting labels are left out.
    The ids with the smallest hashes are taken, so the sample does not depend on partitions.
    """
    rank = F.xxhash64(F.col("_id").cast("string"))
    known = (labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label"))
             .where(F.col("_label").isin(0, 1) & F.col("_id").isNotNull() & ~held_out("_id"))
             .groupBy("_id").agg(F.min("_label").alias("_label"), F.max("_label").alias("_other")).where("_label = _other")
             .select("_id", "_label", rank.alias("_rank")).orderBy("_rank", "_id").limit(rows))
    texts = docs.select(F.col(id_col).alias("_id"), text_of(text_col).cast("binary").alias("_text"))
    # the sample has at most ``rows`` rows, so broadcasting it is safe at any size of the tables
    found = texts.join(F.broadcast(known), "_id").select("_rank", "_id", "_label", bitmaps("_text").alias("_bits"))
    return found.groupBy("_rank", "_id", "_label").agg(F.min("_bits").alias("_bits"))


def log_count_ratios(features: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """log of the smoothed share of each feature among the rows of class 1, over that of class 0."""
    counts = {c: np.full(BUCKETS, SMOOTHING) for c in (1, -1)}
    for f, c in zip(features, y):
        counts[c][f] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[-1] / counts[-1].sum())


def dual_coordinate_descent(features: list[np.ndarray], y: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of the linear hinge-loss model over r * indicators, scaled to unit length.

    A row's dual variable stays within 0 and PENALTY; each step solves for one of them.
    """
    order = np.random.default_rng(7)
    lengths = [math.sqrt(float(r[f] @ r[f])) for f in features]
    w, bias, alpha = np.zeros(BUCKETS), 0.0, np.zeros(len(y))
    norms = [1.0 + (s > 0) for s in lengths]
    for _ in range(EPOCHS):
        for i in order.permutation(len(y)):
            f = features[i]
            v = r[f] / max(lengths[i], 1e-12)
            gradient = y[i] * (float(w[f] @ v) + bias) - 1.0
            new = min(max(alpha[i] - gradient / norms[i], 0.0), PENALTY)
            step = (new - alpha[i]) * y[i]
            if step:
                w[f] += step * v
                bias += step
                alpha[i] = new
    return w, bias


def calibrate(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """a, b of 1 / (1 + exp(-(a * margin + b))), by Newton steps with targets drawn in from 0 and 1."""
    pos, neg = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.stack([margins, np.ones(len(y))], 1)
    ab = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ ab, -35, 35)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (target - p) - 1e-3 * ab)
        ab += step
        if np.abs(step).max() < 1e-8:
            break
    return float(ab[0]), float(ab[1])


def margin(f: np.ndarray, weighted: np.ndarray, squares: np.ndarray, bias: float) -> float:
    """The model's margin of a text with features ``f``; weighted = w * r, squares = r * r."""
    return float(weighted[f].sum()) / max(math.sqrt(float(squares[f].sum())), 1e-12) + bias


def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model from all rows of the sample: one row of weighted, squares, bias, a, b."""
    seen = []
    for batch in batches:
        for part in slices(batch.to_struct_array()):
            seen += [(r["_rank"], r["_label"], np.flatnonzero(np.unpackbits(np.frombuffer(r["_bits"], np.uint8))).astype(np.uint16)) for r in part]
    seen.sort(key=lambda r: r[:2])
    y = np.array([1 if label == 1 else -1 for _, label, _ in seen], int)
    features = [f for _, _, f in seen]
    apart = np.arange(len(y)) % CALIBRATION_SHARE == 0
    zero = np.zeros(BUCKETS)
    if len(set(y[~apart])) < 2 or len(set(y[apart])) < 2:  # too few labels to learn from: the share of label 1
        p = ((y > 0).sum() + 1) / (len(y) + 2)
        model = (zero, zero, 0.0, 0.0, math.log(p / (1 - p)))
    else:
        known = [f for f, x in zip(features, apart) if not x]
        r = log_count_ratios(known, y[~apart])
        w, bias = dual_coordinate_descent(known, y[~apart], r)
        weighted, squares = w * r, r * r
        margins = np.array([margin(f, weighted, squares, bias) for f, x in zip(features, apart) if x])
        model = (weighted, squares, bias, *calibrate(margins, y[apart]))
    yield pa.RecordBatch.from_pylist([{"weighted": model[0].tobytes(), "squares": model[1].tobytes(), "bias": model[2], "a": model[3], "b": model[4]}])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          sample_rows: int = SAMPLE_ROWS) -> dict:
    """The fitted model as plain values (two vectors of BUCKETS numbers, three scalars)."""
    sample = training_sample(docs, labels, id_col, text_col, label_col, sample_rows)
    fitted = sample.repartition(1).mapInArrow(fit, "weighted binary, squares binary, bias double, a double, b double").collect()
    # without any sampled row there may be no partition to fit on
    return fitted[0].asDict() if fitted else next(fit(iter(()))).to_pylist()[0]


def scorer(model: dict):
    """An Arrow UDF from text bytes to the score."""
    shared = dict(model)

    @F.arrow_udf(T.DoubleType())
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        weighted, squares = np.frombuffer(shared["weighted"]), np.frombuffer(shared["squares"])
        marks = np.zeros(BUCKETS, bool)

        def one(text: bytes) -> float:
            marks[:] = False
            mark_ngrams(text or b"", marks)
            z = shared["a"] * margin(np.flatnonzero(marks), weighted, squares, shared["bias"]) + shared["b"]
            return 1 / (1 + math.exp(-min(max(z, -35.0), 35.0)))

        for texts in batches:
            yield pa.array([one(t) for part in slices(texts) for t in part], pa.float64())

    return score


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
             threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per input row: id, held_out, score, predicted.

    Null texts count as empty and are scored like any other text.  Repeated rows get the
    same score.  A null id is scored; it has no label.  With too few labels to fit, every
    score is the smoothed share of label 1.  An empty table gives an empty result.  Only
    the id and the text of ``docs`` are read.  Texts of any length are scored whole.
    """
    model = train(docs, labels, id_col, text_col, label_col, sample_rows)
    scored = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), scorer(model)(text_of(text_col).cast("binary")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accept(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
           threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs``, all columns, without the rows whose score is below ``threshold``.

    The cases of ``classify`` hold here too; repeated rows stay or go together.
    """
    model = train(docs, labels, id_col, text_col, label_col, sample_rows)
    return docs.where(scorer(model)(text_of(text_col).cast("binary")) >= threshold)
