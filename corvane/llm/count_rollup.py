"""Token counts as delta-maintained rollups.

A batch brings inserts, deletes and revised counts of (doc_id, tokenizer version). Against the ledger of what is counted
now it becomes signed numbers, which are added up by source, language and version: totals are the sum of all batches'
deltas and are never recounted. A batch is one folder under its id, written by a committer that makes it visible whole;
committing an id again changes nothing, so a driver that died can run its batches again. Now and then the ledger is
compacted, so a commit reads what is counted now and a few batches, not all of history.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as c

KEYS = ["source", "lang", "version"]
LEDGER = "doc_id long, version string, source string, lang string, n_tokens long, alive boolean, batch long"
COMPACT = 8  # batches between two compactions
DELTAS = "source string, lang string, version string, n_docs long, n_tokens long"


class Rollup:
    """Totals under ``path``, a folder that driver and executors share. One writer at a time; batch ids rise (0, 1, ...)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _whole(self, what: str, name: str) -> list[int]:
        """Numbers, ascending, of the folders ``name=number`` of ``what`` that a committer made visible whole."""
        fs, where = self._fs(f"{self.path}/{what}")
        names = [str(x.getPath().getName()) for x in fs.listStatus(where)] if fs.exists(where) else []
        found = sorted(int(n.partition("=")[2]) for n in names if n.startswith(f"{name}="))
        return [k for k in found if fs.exists(self._fs(f"{self.path}/{what}/{name}={k}/_SUCCESS")[1])]

    def _read(self, schema: str, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def batches(self) -> list[int]:
        """Ids of the batches that are committed."""
        return self._whole("deltas", "batch")

    def _ledger(self, batches: list[int]) -> DataFrame:
        """What each (doc_id, version) was counted as last, deletes included since the last compaction."""
        bases = self._whole("base", "upto")
        rows = self._read(LEDGER, [f"{self.path}/base/upto={b}" for b in bases[-1:]] + [f"{self.path}/ledger/batch={b}" for b in batches if not bases or b > bases[-1]])
        return rows.groupBy("doc_id", "version").agg(F.max_by(F.struct("source", "lang", "n_tokens", "alive", "batch"), "batch").alias("old"))

    def compact(self) -> None:
        """Write what is counted now as one table. Older ledger rows aren't read from then on, and are removed; totals don't change."""
        done, bases = self.batches(), self._whole("base", "upto")
        if not done or bases[-1:] == done[-1:]:
            return
        self._ledger(done).filter("old.alive").select("doc_id", "version", "old.*").write.mode("overwrite").parquet(f"{self.path}/base/upto={done[-1]}")
        for gone in [f"base/upto={b}" for b in bases] + [f"ledger/batch={b}" for b in done]:
            fs, where = self._fs(f"{self.path}/{gone}")
            fs.delete(where, True)

    def commit(self, batch: int, changes: DataFrame) -> bool:
        """Apply ``changes`` (doc_id, version, source, lang, n_tokens; ``n_tokens`` null: delete); False if the batch was committed before.

        Of several rows of one (doc_id, version) in a batch the one with the most tokens counts, a delete last. An
        insert of what is counted already is a revision: also its source and language may change. Deletes of what isn't
        counted do nothing. Null doc_ids, sources and languages are values like others, so all rows without a doc_id are
        one. Other columns are not read. A batch below one that is committed raises: it would be older than what is counted.
        """
        done = self.batches()
        if batch in done:
            return False
        if done and batch < done[-1]:
            raise ValueError(f"batch {batch} comes after batch {done[-1]}")
        row = F.struct(F.coalesce("n_tokens", F.lit(-1).cast("long")).alias("n"), "source", "lang")
        new = changes.select(F.col("doc_id").cast("long"), "version", "source", "lang", F.col("n_tokens").cast("long")).groupBy("doc_id", "version").agg(F.max(row).alias("new"))
        old = self._ledger(done)
        both = new.alias("a").join(old.alias("b"), F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & F.col("a.version").eqNullSafe(F.col("b.version")), "left").select("a.doc_id", "a.version", "new", "old")
        alive = F.col("new.n") >= 0
        was = F.when(F.col("old.alive"), F.col("old"))
        ledger = both.filter(alive | F.col("old.alive")).select("doc_id", "version", F.when(alive, F.col("new.source")).otherwise(F.col("old.source")).alias("source"), F.when(alive, F.col("new.lang")).otherwise(F.col("old.lang")).alias("lang"), F.when(alive, F.col("new.n")).otherwise(0).alias("n_tokens"), alive.alias("alive"), F.lit(batch).cast("long").alias("batch"), was.alias("old"))
        ledger.write.mode("overwrite").parquet(f"{self.path}/ledger/batch={batch}")
        held = self.spark.read.schema(ledger.schema).parquet(f"{self.path}/ledger/batch={batch}")
        plus = held.filter("alive").select(*KEYS, F.lit(1).cast("long").alias("n_docs"), "n_tokens")
        minus = held.filter("old is not null").select(F.col("old.source").alias("source"), F.col("old.lang").alias("lang"), "version", F.lit(-1).cast("long").alias("n_docs"), (-F.col("old.n_tokens")).alias("n_tokens"))
        plus.union(minus).groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).write.mode("overwrite").parquet(f"{self.path}/deltas/batch={batch}")
        if (len(done) + 1) % COMPACT == 0:
            self.compact()
        return True

    def totals(self) -> DataFrame:
        """source, lang, version, n_docs, n_tokens of what is counted now; groups without documents are left out."""
        return self._read(DELTAS, [f"{self.path}/deltas/batch={b}" for b in self.batches()]).groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).filter("n_docs <> 0 or n_tokens <> 0")


def with_bpe_counts(docs: DataFrame, vocabulary: str, name: str) -> DataFrame:
    """``docs`` with the tokens of each row's text by a vocabulary of the ``tokenizers`` library in place of the text (null: 0), in the column ``name``."""
    from pyspark.sql.types import LongType, StructField, StructType

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            n = [len(x) for x in c.word_ids(vocabulary).documents(batch.column("text"))]
            rest = [x for x in batch.schema.names if x != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in rest), pa.array(n, "int64")], [*rest, name])

    return docs.mapInArrow(run, StructType([*(f for f in docs.schema.fields if f.name != "text"), StructField(name, LongType())]))


def _rolled_up(spark, facts: DataFrame, versions: dict[str, str]) -> DataFrame:
    """Totals after three batches, each sent twice: all documents counted by each version (name: column of ``facts``); exact copies of an earlier document deleted; word counts of documents with several lines revised to count line ends too."""
    first = facts.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"))
    both = facts.join(first, ["h1", "h2"])
    counts = F.explode(F.array(*[F.struct(F.lit(v).alias("version"), F.col(x).alias("n_tokens")) for v, x in versions.items()]))
    expand = lambda d: d.select("doc_id", "source", "lang", counts.alias("x")).select("doc_id", "source", "lang", "x.*")
    copies = expand(both.filter("doc_id > first")).withColumn("n_tokens", F.lit(None).cast("long"))
    revised = both.filter("e > 0 and not (doc_id > first)").select("doc_id", "source", "lang", F.lit("words-1").alias("version"), (F.col("w") + F.col("e")).alias("n_tokens"))
    rollup = Rollup(spark, f"{c.shared_dir(spark)}/corvane/rollup-{uuid.uuid4().hex}")
    for k, changes in enumerate((expand(facts), copies, revised)):
        rollup.commit(k, changes)
        rollup.commit(k, changes)
    return rollup.totals()


def _facts(docs: DataFrame) -> DataFrame:
    t = c.text_or_empty()
    ends = F.length(t) - F.length(F.translate(t, "\n", ""))
    return docs.select("doc_id", "source", "lang", c.n_words(c.col("text")).alias("w"), F.octet_length(t).cast("long").alias("b"), ends.cast("long").alias("e"), F.xxhash64(t).alias("h1"), F.xxhash64(t, F.lit(1)).alias("h2"), t.alias("text"))


def op5(spark, sf_dir: str) -> DataFrame:
    """Totals by words, bytes and ``word_bpe_49k`` tokens, as in ``_rolled_up``. Null texts count 0; an empty table gives no rows; other columns are not read."""
    facts = with_bpe_counts(_facts(spark.read.parquet(f"{sf_dir}/documents.parquet")), c.public_vocabulary(), "k")
    return _rolled_up(spark, c.staged(facts, "count-facts"), {"words-1": "w", "bytes-1": "b", "word_bpe_49k": "k"})


def rollup_words_bytes(spark, sf_dir: str) -> DataFrame:
    """The same batches without the vocabulary's version, which SQL can't count."""
    facts = _facts(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text")
    return _rolled_up(spark, c.staged(facts, "count-facts"), {"words-1": "w", "bytes-1": "b"})


WORDS_BYTES_SQL = r"""
WITH d AS (SELECT *, coalesce(text, '') AS t, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents),
k AS (SELECT source, lang, len(list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '')) + length(t) - length(replace(t, chr(10), '')) AS w, strlen(t) AS b FROM d WHERE doc_id = first)
SELECT source, lang, 'words-1' AS version, count(*)::BIGINT AS n_docs, sum(w)::BIGINT AS n_tokens FROM k GROUP BY source, lang
UNION ALL SELECT source, lang, 'bytes-1', count(*)::BIGINT, sum(b)::BIGINT FROM k GROUP BY source, lang
"""
