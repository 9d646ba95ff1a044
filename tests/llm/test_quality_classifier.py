import zlib

import numpy as np
import pytest
from cases import ROWS, SCHEMA, frame

from marketlens.llm import quality_classifier as qc


def test_held_out_rows_follow_the_checksum(spark):
    got = qc.classify(frame(spark), spark.createDataFrame([], "doc_id long, quality int")).collect()
    assert len(got) == len(ROWS)
    for r in got:
        text = "" if r.doc_id is None else str(r.doc_id)
        assert r.held_out == (zlib.crc32(text.encode()) % 4 == 2)
        assert r.score == pytest.approx(0.5) and r.predicted == 0  # nothing to learn from


def test_one_class_gives_its_share(spark):
    labels = spark.createDataFrame([(i, 1) for i in (1, 6, 8, 10)], "doc_id long, quality int")
    known = [i for i in (1, 6, 8, 10) if zlib.crc32(str(i).encode()) % 4 != 2]
    got = qc.classify(frame(spark), labels).collect()
    assert {round(r.score, 6) for r in got} == {round((len(known) + 1) / (len(known) + 2), 6)}


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = qc.classify(spark.read.parquet(f"{d}/documents.parquet"), labels).join(labels, "doc_id").where("held_out").toPandas()
    good, bad = got.score[got.quality == 1].to_numpy(), got.score[got.quality == 0].to_numpy()
    auc = (good[:, None] > bad[None, :]).mean() + 0.5 * (good[:, None] == bad[None, :]).mean()
    assert auc >= 0.97
    assert ((got.predicted == 1) == (got.quality == 1)).mean() >= 0.95


def test_sample_skips_held_out_contradicting_and_null_labels(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(40)] + [(3, "text 3")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(3, 0), (5, None), (None, 1)], "doc_id long, quality int")
    rows = qc.training_sample(docs, labels, "doc_id", "text", "quality", 100).collect()
    want = {i for i in range(40) if zlib.crc32(str(i).encode()) % 4 != 2} - {3}
    assert {r["_id"] for r in rows} == want and len(rows) == len(want)
    assert len(qc.training_sample(docs, labels, "doc_id", "text", "quality", 5).collect()) == 5


def test_dual_coordinate_descent_reaches_the_optimum():
    rng = np.random.default_rng(1)
    features = [np.sort(rng.choice(30, 6, replace=False)) for _ in range(60)]
    y = np.array([1 if (f < 15).sum() >= 3 else -1 for f in features])
    r = qc.log_count_ratios(features, y)
    assert r.shape == (qc.BUCKETS,) and (r[:15].mean() > r[15:30].mean())
    w, bias = qc.dual_coordinate_descent(features, y, r)
    x = np.zeros((60, 30))
    for i, f in enumerate(features):
        v = r[f]
        x[i, f] = v / np.sqrt(v @ v)
    loss = lambda w, b: 0.5 * (w @ w + b * b) + qc.PENALTY * np.maximum(0, 1 - y * (x @ w + b)).sum()
    here = loss(w[:30], bias)
    for _ in range(300):  # no step around the solution is clearly better
        assert loss(w[:30] + rng.normal(0, 0.05, 30), bias + rng.normal(0, 0.05)) >= here - 0.02 * here


def test_ngrams_of_a_long_text_do_not_depend_on_chunks(monkeypatch):
    text = ("some words, " * 5000).encode()
    whole = qc.bitmap(text)
    monkeypatch.setattr(qc, "CHUNK", 1000)
    assert qc.bitmap(text) == whole
    assert qc.bitmap(b"") == qc.bitmap(None)


def test_awkward_rows_through_a_fitted_model(spark):
    """Nulls, empty and very long texts and repeated rows are scored by a model of both classes, and all alike."""
    good = [(1000 + i, f"The council met on day {i} and agreed on the plan for the year.") for i in range(60)]
    bad = [(2000 + i, f"BUY NOW $$$ {i} !!! click click") for i in range(60)]
    docs = spark.createDataFrame([(i, t, "en", "a", 1, True, 1, 1, "x") for i, t in good + bad], SCHEMA).unionAll(frame(spark))
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad] + [(None, 1), (3, None)], "doc_id long, quality int")
    got = qc.classify(docs, labels)
    assert got.count() == len(ROWS) + 120
    rows = got.collect()
    by_id = {}
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        by_id.setdefault(r.doc_id, set()).add(r.score)
    assert all(len(s) == 1 for s in by_id.values()) and by_id[3] == by_id[4]  # null and empty
    held = lambda r: zlib.crc32(str(r.doc_id).encode()) % 4 == 2
    assert all(r.score > 0.5 for r in rows if r.doc_id and 1000 <= r.doc_id < 1060 and held(r))
    assert all(r.score < 0.5 for r in rows if r.doc_id and 2000 <= r.doc_id < 2060 and held(r))
    assert qc.classify(frame(spark, []), labels).count() == 0
    kept = qc.accept(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in rows)
