"""A stored index of chunks: chunks, vectors and postings, written once a chunk and read by every search.

Each change is a segment: a folder of each table that a committer makes visible whole. A chunk's newest segment counts,
and a deleted chunk has a row in ``gone``; older rows are left out by a join on (id, seg). Postings lie sorted by term, so
a search reads the row groups that may have its terms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import embedding, lexical

VERSION, PUSHED = 1, 2000


class Index:
    """Chunks (id, doc_id, source, title, page, ordinal, text) under ``path``. One writer at a time."""

    COLUMNS = ("id", "doc_id", "source", "title", "page", "ordinal", "text")

    def __init__(self, spark: SparkSession, path: str, dim: int = 1024, embedder: str = "hashing"):
        self.spark, self.path, self.made = spark, path.rstrip("/"), (embedder, dim, VERSION)
        found = self._folders("settings")
        if found:
            was = tuple(self.spark.read.parquet(f"{self.path}/settings/seg=0").select("embedder", "dim", "version").first())
            if was != self.made:
                raise ValueError(f"index was made with {was}, not {self.made}")

    def _fs(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _folders(self, what: str) -> list[int]:
        fs, where = self._fs(f"{self.path}/{what}")
        names = [str(x.getPath().getName()) for x in fs.listStatus(where)] if fs.exists(where) else []
        return sorted(k for k in (int(n[4:]) for n in names if n.startswith("seg=")) if fs.exists(self._fs(f"{self.path}/{what}/seg={k}/_SUCCESS")[1]))

    def segments(self) -> list[int]:
        """Segments that are whole: their last table, ``gone``, is."""
        return self._folders("gone")

    def _table(self, what: str) -> DataFrame:
        seg = self.segments()
        return self.spark.read.option("basePath", f"{self.path}/{what}").parquet(*[f"{self.path}/{what}/seg={k}" for k in seg])

    def _write(self, seg: int, chunks: DataFrame | None, gone: DataFrame) -> None:
        if not self._folders("settings"):
            self.spark.createDataFrame([self.made], "embedder string, dim int, version int").write.mode("overwrite").parquet(f"{self.path}/settings/seg=0")
        put = lambda df, what: df.write.mode("overwrite").parquet(f"{self.path}/{what}/seg={seg}")
        if chunks is not None:
            put(chunks.withColumn("tokens", F.size(T.tokenize(F.col("text")))), "chunks")
            held = self.spark.read.parquet(f"{self.path}/chunks/seg={seg}")
            put(embedding.with_embedding(held.select("id", "seq", "text"), "text", self.made[1]).drop("text"), "vectors")
            tf = held.select("id", F.col("tokens").alias("len"), F.explode(T.tokenize(F.col("text"))).alias("term")).groupBy("term", "id", "len").agg(F.count("*").alias("tf"))
            put(tf.repartitionByRange(F.col("term")).sortWithinPartitions("term"), "postings")
        put(gone.select("id"), "gone")

    def add(self, chunks: DataFrame) -> None:
        """Index ``chunks``; one that is there is replaced, of equal ids in a batch the one of the largest ordinal and text counts. Missing columns are null."""
        seg = (self.segments() or [-1])[-1] + 1
        missing = {x: F.lit(None).cast("int" if x in ("page", "ordinal") else "string") for x in self.COLUMNS if x not in chunks.columns}
        rows = chunks.withColumns(missing).select(*self.COLUMNS)
        last = rows.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("ordinal"), F.desc("text")))).filter("n = 1").drop("n")
        # insertion order, for ties: later segments come later, and in one of them ids ascend
        numbered = last.repartitionByRange(F.col("id")).sortWithinPartitions("id").withColumn("seq", F.monotonically_increasing_id())
        self._write(seg, numbered, last.limit(0))

    def _live(self) -> DataFrame:
        """(id, seg) of the rows that count."""
        every = self._table("chunks").select("id", "seg", F.lit(False).alias("gone")).union(self._table("gone").select("id", "seg", F.lit(True)))
        return every.groupBy("id").agg(F.max("seg").alias("seg"), F.max_by("gone", "seg").alias("gone")).filter("not gone").drop("gone")

    def chunks(self) -> DataFrame:
        return self._table("chunks").join(self._live(), ["id", "seg"])

    def delete_documents(self, doc_ids: DataFrame) -> None:
        """Take out the chunks of the documents (doc_id)."""
        self._write(self.segments()[-1] + 1, self._table("chunks").limit(0).select(*self.COLUMNS, "seq"), self.chunks().join(doc_ids.select("doc_id"), "doc_id", "left_semi"))

    def clear(self) -> None:
        for what in ("chunks", "vectors", "postings", "gone", "settings"):
            fs, where = self._fs(f"{self.path}/{what}")
            fs.delete(where, True)

    def stats(self) -> DataFrame:
        return self.chunks().agg(F.count("*").alias("chunks"), F.countDistinct("doc_id").alias("documents"), F.round(F.avg("tokens"), 1).alias("mean_tokens"), F.max("tokens").alias("max_tokens"))

    def documents(self) -> DataFrame:
        """doc_id, title (of the first chunk), chunks and tokens of each document, by title."""
        return self.chunks().groupBy("doc_id").agg(F.min_by("title", "ordinal").alias("title"), F.count("*").alias("chunks"), F.sum("tokens").alias("tokens")).orderBy("title", "doc_id")

    def vectors(self) -> DataFrame:
        return self._table("vectors").join(self._live(), ["id", "seg"]).withColumn("seq", F.col("seq") + F.col("seg").cast("long") * F.lit(1 << 52))

    def bm25(self, questions: DataFrame, k: int) -> DataFrame:
        """The best ``k`` chunks of each question, from the stored postings. Up to ``PUSHED`` different terms are pushed into the scan; more are joined."""
        terms = lexical.question_terms(questions)
        asked = terms.select("term").distinct()
        few = [r.term for r in asked.limit(PUSHED + 1).collect()]
        postings = self._table("postings")
        postings = postings.filter(F.col("term").isin(few)) if len(few) <= PUSHED else postings.join(asked, "term", "left_semi")
        live = self._live()
        stats = self._table("chunks").select("id", "seg", "tokens").join(live, ["id", "seg"]).agg(F.count("*").alias("n"), F.avg("tokens").alias("mean"))
        return lexical.top(lexical.weighed(terms, postings.join(live, ["id", "seg"]), stats), k, "id")
