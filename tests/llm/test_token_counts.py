from collections import Counter

from cases import ROWS, frame

from marketlens.llm import token_counts as tc
from marketlens.llm.tokens import WordTokenizer, tokenizer_path


def encoder():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def once(text):
    return "\n".join(dict.fromkeys((text or "").split("\n")))


def test_word_cache_gives_the_tokenizers_ids(monkeypatch):
    import numpy as np

    from marketlens.llm import tokens
    texts = ["", " ", "Plain words, don't split.", "a\x1cb c\x85d e f", "É café ́x", "x<|endoftext|>y <|startoftext|>",
             "12 345\t6\n7\x0b8", "漢字 \U0001F600\U0001F600 ße İ", "long " * 300 + "tail"] + [r[1] or "" for r in ROWS]
    want = [encoder()(t) for t in texts]
    for chunk, cache in ((1 << 21, 250_000), (50, 3)):
        monkeypatch.setattr(tokens, "CHUNK", chunk)
        monkeypatch.setattr(tokens, "CACHE_WORDS", cache)
        words = WordTokenizer(tokenizer_path())
        for _ in range(2):
            got = [np.frombuffer(b, words.dtype).tolist() for b in words.encode([t.encode() for t in texts])]
            assert got == want


def test_totals_match_brute_force(spark, tmp_path):
    gone = spark.createDataFrame([(1,), (7,), (7,), (None,), (99,)], "doc_id long")
    got = tc.maintain(tc.counts(frame(spark)), gone, str(tmp_path / "r"))
    ids, docs, tokens, deleted, revised = encoder(), Counter(), Counter(), Counter(), Counter()
    for r in ROWS:
        k = (r[3], r[2], "word_bpe_49k")
        n, n_once = len(ids(r[1])), len(ids(once(r[1])))
        out = r[0] in (1, 7)
        docs[k] += not out
        tokens[k] += 0 if out else n_once
        deleted[k] += out
        revised[k] += n != n_once
    inserted = Counter((r[3], r[2], "word_bpe_49k") for r in ROWS)
    assert {tuple(r)[:3]: tuple(r)[3:] for r in got.collect()} == {k: (docs[k], tokens[k], inserted[k], deleted[k], revised[k]) for k in inserted}


def test_a_batch_that_is_committed_again_counts_once(spark, tmp_path):
    rows = spark.createDataFrame([("a", "en", "v1", 10), ("a", "en", "v1", 5), (None, "en", "v2", 1)], "source string, lang string, tokenizer string, n long")
    r = tc.Rollup(spark, str(tmp_path / "r"))
    for _ in range(3):
        r.commit(tc.inserts(rows), 0)
    r.commit(tc.deletes(rows.where("n = 5")), 1)
    r.commit(tc.revisions(rows.where("n = 10"), rows.where("n = 10").selectExpr("source", "lang", "'v2' as tokenizer", "12L as n")), 2)
    r.commit(tc.deletes(rows.where("n = 5")), 1)
    got = {(x.source, x.tokenizer): (x.n_docs, x.n_tokens, x.n_inserts, x.n_deletes, x.n_revisions) for x in r.totals().collect()}
    assert got == {("a", "v1"): (0, 0, 2, 1, 0), ("a", "v2"): (1, 12, 0, 0, 1), (None, "v2"): (1, 1, 1, 0, 0)}


def test_stream_of_deltas(spark, tmp_path):
    rows = spark.createDataFrame([("a", "en", "v1", 10), ("b", "en", "v1", 5)], "source string, lang string, tokenizer string, n long")
    source = str(tmp_path / "in")
    tc.inserts(rows).write.parquet(source)
    r = tc.Rollup(spark, str(tmp_path / "r"))
    stream = spark.readStream.schema(tc.SCHEMA).parquet(source)
    for _ in range(2):  # the second run finds nothing new
        q = r.commit_stream(stream, str(tmp_path / "ckpt"))
        q.processAllAvailable()
        q.stop()
    assert sorted((x.source, x.n_tokens) for x in r.totals().collect()) == [("a", 10), ("b", 5)]


def test_empty_table(spark, tmp_path):
    got = tc.maintain(tc.counts(frame(spark, [])), spark.createDataFrame([], "doc_id long"), str(tmp_path / "r"))
    assert got.count() == 0


def delta(spark, n):
    return tc.inserts(spark.createDataFrame([("a", "en", "v1", n)], "source string, lang string, tokenizer string, n long"))


def tokens(r):
    return sum(x.n_tokens for x in r.totals().collect())


def test_a_commit_that_fails_leaves_the_totals(spark, tmp_path, monkeypatch):
    """Between the attempt's sums and the file that makes it count, and for the first batch and one that is committed again."""
    r = tc.Rollup(spark, str(tmp_path / "r"))
    write = tc.files.write_text

    def lost(*args):
        raise OSError("lost")

    monkeypatch.setattr(tc.files, "write_text", lost)
    for n in (5, 6):
        try:
            r.commit(delta(spark, n), 0)
        except OSError:
            pass
        assert r.totals().count() == 0
    monkeypatch.setattr(tc.files, "write_text", write)
    r.commit(delta(spark, 7), 0)
    monkeypatch.setattr(tc.files, "write_text", lost)
    try:
        r.commit(delta(spark, 8), 0)
    except OSError:
        pass
    assert tokens(r) == 7
    monkeypatch.setattr(tc.files, "write_text", write)
    r.commit(delta(spark, 9), 0)
    assert tokens(r) == 9


def test_compaction_keeps_the_totals(spark, tmp_path):
    r = tc.Rollup(spark, str(tmp_path / "r"), most_batches=3)
    for batch in range(9):
        r.commit(delta(spark, 10 ** batch), batch)
        r.commit(delta(spark, 10 ** batch), batch)
        assert tokens(r) == int("1" * (batch + 1))
    assert len(r._batches()) <= 3 and len(tc.files.names(spark, f"{r.path}/sums")) <= 8
    r.commit(delta(spark, 5), 0)  # compacted: it has been counted
    r.commit(delta(spark, 0), 8)  # not compacted: it is replaced
    assert tokens(r) == 11111111
    r.compact(keep=0)
    assert tokens(r) == 11111111 and r._batches() == {} and len(tc.files.names(spark, f"{r.path}/sums")) == 1
