"""Token counts as rollups that are maintained by deltas.

A change is an insert, a delete or a revised count of a document.  It becomes signed
amounts: an insert adds the document and its tokens, a delete subtracts them, a revision
subtracts the old count where it stood and adds the new one where it stands now.  A batch
of changes is added up by source, language and tokenizer version, and the few sums are
written to a folder of the attempt's own.  Then one small file, exchanged in a single step,
says which attempt counts for the batch.  Totals are the sums over the attempts that count:
a commit that fails leaves the totals as they were, and a batch that is committed again,
after a failure or by a stream that restarts, counts once.

Batches are compacted: all up to a number become one table of sums, and again a single
small file says so.  A batch that is in it and comes once more is not counted again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.llm.common import slices, text_of
from marketlens.llm.tokens import TEXTS, tokenizer, tokenizer_path
from marketlens.session import ensure_checkpoint_dir
from marketlens.sources import files

KEY = ["source", "lang", "tokenizer"]
#: Additive measures of a rollup.
MEASURES = ["n_docs", "n_tokens", "n_inserts", "n_deletes", "n_revisions"]
#: Batches beyond which a commit compacts.
MOST_BATCHES = 200
SCHEMA = "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint, n_inserts bigint, n_deletes bigint, n_revisions bigint"


def counter(path: str):
    """An Arrow UDF from text bytes to (n, n_once): token counts of the text, and of the text without repeated lines."""
    schema = T.StructType([T.StructField("n", T.LongType()), T.StructField("n_once", T.LongType())])

    @F.arrow_udf(schema)
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = tokenizer(path)
        size = words.dtype.itemsize
        for batch in batches:
            whole, distinct = [], []
            for texts in slices(batch, TEXTS):
                once = [b"\n".join(dict.fromkeys(t.split(b"\n"))) for t in texts]
                n = [len(ids) // size for ids in words.encode(texts)]
                changed = [i for i, (a, b) in enumerate(zip(texts, once)) if len(a) != len(b)]
                again = dict(zip(changed, (len(ids) // size for ids in words.encode([once[i] for i in changed]))))
                whole += n
                distinct += [again.get(i, k) for i, k in enumerate(n)]
            yield pa.StructArray.from_arrays([pa.array(whole, pa.int64()), pa.array(distinct, pa.int64())], ["n", "n_once"])

    return count


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, version: str = "word_bpe_49k") -> DataFrame:
    """(id, source, lang, tokenizer, n, n_once) of every row; a null text has no tokens."""
    c = counter(path or tokenizer_path())(text_of(text_col).cast("binary"))
    counted = docs.select(F.col(id_col), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), c.alias("_c"))
    return counted.select(id_col, "source", "lang", F.lit(version).alias("tokenizer"), "_c.n", "_c.n_once")


def _signed(rows: DataFrame, sign: int, tokens: str, kind: str) -> DataFrame:
    flags = [F.lit(1 if kind == m else 0).cast("long").alias(m) for m in MEASURES[2:]]
    return rows.select(*KEY, F.lit(sign).cast("long").alias("n_docs"), (sign * F.col(tokens)).cast("long").alias("n_tokens"), *flags)


def inserts(rows: DataFrame, tokens: str = "n") -> DataFrame:
    """Deltas of documents that come in; ``rows`` has the key columns and the count."""
    return _signed(rows, 1, tokens, "n_inserts")


def deletes(rows: DataFrame, tokens: str = "n") -> DataFrame:
    """Deltas of documents that go; ``tokens`` is the count as it stands."""
    return _signed(rows, -1, tokens, "n_deletes")


def revisions(old: DataFrame, new: DataFrame, old_tokens: str = "n", new_tokens: str = "n") -> DataFrame:
    """Deltas of documents whose count, source, language or tokenizer changes; each is counted as a revision where it stands now."""
    return _signed(old, -1, old_tokens, "").unionByName(_signed(new, 1, new_tokens, "n_revisions"))


class Rollup:
    """Totals by source, language and tokenizer version in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, most_batches: int = MOST_BATCHES):
        self.spark, self.path, self.most_batches = spark, path.rstrip("/"), most_batches

    def _sums(self, deltas: DataFrame) -> str:
        """Write sums by key to a folder of their own; its name."""
        name = f"attempt-{uuid.uuid4().hex}"
        sums = deltas.groupBy(*KEY).agg(*[F.sum(m).cast("long").alias(m) for m in MEASURES])
        sums.write.parquet(f"{self.path}/sums/{name}")
        return name

    def _base(self) -> dict:
        """The compacted sums: ``through``, the last batch in them, and their ``attempt``."""
        text = files.read_text(self.spark, f"{self.path}/base")
        return json.loads(text) if text else {"through": -1, "attempt": None}

    def _batches(self) -> dict[int, str]:
        """The attempt that counts for each batch that is not compacted."""
        through = self._base()["through"]
        names = [n for n in files.names(self.spark, f"{self.path}/batches") if n.isdigit() and int(n) > through]
        return {int(n): files.read_text(self.spark, f"{self.path}/batches/{n}") for n in names}

    def commit(self, deltas: DataFrame, batch: int) -> None:
        """Add the deltas of ``batch``.  Committing a batch again replaces it, unless it is compacted."""
        if int(batch) <= self._base()["through"]:
            return
        files.write_text(self.spark, f"{self.path}/batches/{int(batch)}", self._sums(deltas))
        if len(self._batches()) > self.most_batches:
            self.compact()

    def commit_stream(self, deltas: DataFrame, checkpoint: str):
        """Commit every micro-batch of a streaming DataFrame of deltas; its number makes the commit idempotent."""
        return deltas.writeStream.foreachBatch(self.commit).option("checkpointLocation", checkpoint).start()

    def compact(self, keep: int = 1) -> None:
        """Put all batches but the last ``keep`` into one table, then remove what no longer counts.

        A stream may commit its last batch again, so that one is kept apart.  Compaction and
        commits of the same rollup run one after the other; attempts are removed only after
        the base is exchanged, and a reader that began before it fails and reads again.
        """
        before, batches = self._base(), self._batches()
        old = sorted(batches)[:max(0, len(batches) - keep)]
        if not old:
            return
        attempt = self._sums(self._read([before["attempt"], *[batches[b] for b in old]]))
        files.write_text(self.spark, f"{self.path}/base", json.dumps({"through": old[-1], "attempt": attempt}))
        for b in old:
            files.remove(self.spark, f"{self.path}/batches/{b}")
        used = {attempt, *self._batches().values()}
        for name in files.names(self.spark, f"{self.path}/sums"):
            if name not in used:
                files.remove(self.spark, f"{self.path}/sums/{name}")

    def _read(self, attempts: list[str | None]) -> DataFrame:
        paths = [f"{self.path}/sums/{a}" for a in attempts if a]
        return self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)

    def totals(self) -> DataFrame:
        """Sums over all batches.  Keys whose documents have all gone stay, with zeros."""
        rows = self._read([self._base()["attempt"], *self._batches().values()])
        return rows.groupBy(*KEY).agg(*[F.sum(m).cast("long").alias(m) for m in MEASURES])


def scratch(spark: SparkSession) -> str:
    """A new folder for a rollup, in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/rollup-{uuid.uuid4().hex}"


def maintain(counted: DataFrame, gone: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """Totals after three batches: all documents come in, those with repeated lines are
    recounted without them, and those in ``gone`` are deleted.

    Null sources and languages are keys of their own.  Repeated rows count each time they
    occur.  A null id is never deleted.  A repeated id in ``gone`` deletes once.  Texts of any
    length are counted whole.  An empty table gives no totals.
    """
    rollup = Rollup(counted.sparkSession, path)
    rollup.commit(inserts(counted), 0)
    revised = counted.where("n <> n_once")
    rollup.commit(revisions(revised, revised, "n", "n_once"), 1)
    leaving = counted.join(gone.select(F.col(id_col)).distinct(), id_col, "left_semi")
    rollup.commit(deletes(leaving, "n_once"), 2)
    return rollup.totals()
