import hashlib
import re
from collections import Counter

import duckdb
import pytest
from cases import frame, water_fill
from compare import canon, duck_rows, spark_rows
from test_simhash import components, plain_fingerprint
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from marketlens.llm import quality_classifier, queries
from marketlens.llm.tokens import tokenizer_path

SMALL = "/root/testdata/sf0.001"


def test_all_operators_and_the_pipeline_are_registered():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry.queries() and set(queries.ORACLE) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_oracle(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SMALL}/{table}.parquet')")
    assert canon(*spark_rows(queries.QUERIES[name](spark, SMALL))) == canon(*duck_rows(con, queries.ORACLE[name]))


def by_hand(rows, scores, stage):
    """Documents (doc_id, text, source) that a stage keeps, each as often as it returns it."""
    if stage == "quality classifier":
        return [r for r in rows if scores[r[0]] >= 0.7]
    if stage == "exact dedup":
        first = {}
        for r in sorted(rows, key=lambda r: r[0]):
            first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r[1]), r)
        return list(first.values())
    if stage == "simhash near-dedup":
        ids, prints = [r[0] for r in rows], [plain_fingerprint(r[1]) for r in rows]
        return [r for r, lowest in zip(rows, components(ids, prints)) if r[0] == lowest]
    sizes, total = {}, {}
    for doc_id, text, source in rows:
        sizes[doc_id] = len(re.findall(r"[^\x20\x09-\x0D]+", text))
        total[source] = total.get(source, 0) + sizes[doc_id]
    targets = water_fill(total, {s: i % 3 + 1 for i, s in enumerate(sorted(total))}, sum(total.values()), 3)
    out = []
    for source, words in total.items():
        quota, before = int(targets[source] + 0.5), 0
        own = sorted((r for r in rows if r[2] == source), key=lambda r: hashlib.md5(f"mix:{r[0]}".encode()).hexdigest())
        for r in own:
            more = 2 * before + sizes[r[0]] <= 2 * (quota % words if words else 0) and quota % words > 0
            out += [r] * (quota // words + more)
            before += sizes[r[0]]
    return out


def test_stages_match_brute_force(spark, tmp_path):
    """Every stage takes all that its predecessor kept, and its decisions take effect."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    scores = {r.doc_id: r.score for r in quality_classifier.classify(docs, labels).collect()}
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / str(i)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(i)))
        assert docs.columns == columns
        assert docs.distinct().subtract(before.distinct()).count() == 0  # rows go through unchanged
        rows = by_hand(rows, scores, name)
        assert sorted(r.doc_id for r in docs.collect()) == sorted(r[0] for r in rows)
    packed = corpus_pipeline.STAGES[4][1](spark, docs, SMALL).collect()
    want = Counter()
    tokenizer = Tokenizer.from_file(tokenizer_path())
    for doc_id, text, _ in rows:
        want[doc_id] += len(tokenizer.encode(text, add_special_tokens=False).ids) + 1
    got = Counter()
    for p in packed:
        got[p.doc_id] += p.length
    assert got == want
    fill = Counter()
    for p in packed:
        fill[p.sequence_id] += p.length
    assert all(n == 2048 for s, n in fill.items() if s < max(fill))


def test_awkward_rows_go_through_all_stages(spark, tmp_path):
    (tmp_path / "d").mkdir()
    frame(spark).write.parquet(str(tmp_path / "d/documents.parquet"))
    rows = [(i, i % 2) for i in range(1, 11)]
    spark.createDataFrame(rows, "doc_id long, quality int").write.parquet(str(tmp_path / "d/labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path / "d"))
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    out.collect()
    for name, f in corpus_pipeline.STAGES:
        f(spark, frame(spark, []), str(tmp_path / "d")).collect()
