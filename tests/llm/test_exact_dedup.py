import hashlib
import re
from collections import defaultdict

from cases import ROWS, frame, key

from marketlens.llm import exact_dedup


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def expected(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[norm(r[1])].append(r[0])
    out = []
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        for n, i in enumerate(sorted(ids, key=lambda i: (i is None, i))):
            out.append((i, keep, len(ids), n == 0, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=key)


def test_matches_brute_force(spark):
    got = exact_dedup.exact_dedup(frame(spark))
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect()), key=key) == expected(ROWS)


def test_hot_group(spark):
    rows = [(i, "copy" if i % 3 else f"text {i}", "en", "a", 1, None, None, None, None) for i in range(900)]
    got = exact_dedup.exact_dedup(frame(spark, rows)).collect()
    assert sorted(map(tuple, got), key=key) == expected(rows)


def test_empty_table(spark):
    assert exact_dedup.exact_dedup(frame(spark, [])).count() == 0
    assert exact_dedup.deduplicate(frame(spark, [])).count() == 0


def test_deduplicate_keeps_one_row_of_each_text(spark):
    got = exact_dedup.deduplicate(frame(spark))
    assert got.columns == frame(spark).columns
    rows = got.collect()
    assert sorted(r.doc_id for r in rows if r.doc_id is not None) == [1, 3, 5, 6, 7, 8, 10]
    assert len(rows) == 8 and len({norm(r.text) for r in rows}) == 8


def test_equal_digests_with_other_checks_stay_apart(spark):
    rows = spark.createDataFrame([(1, b"d", 3, 7, 0), (2, b"d", 3, 8, 0), (3, b"d", 3, 7, 0)], "_id long, _digest binary, _bytes int, _check long, _leaf int")
    from pyspark.sql import functions as F
    entry = F.struct(F.lit(False).alias("unnamed"), F.col("_id").alias("id"), F.col("_leaf").alias("leaf"))
    runs = exact_dedup.merge_round(rows.withColumn("_best", entry).withColumn("_rows", F.lit(1)), F.col("_leaf"))
    assert sorted((r["_best"].id, r["_rows"]) for r in runs.collect()) == [(1, 2), (2, 1)]
