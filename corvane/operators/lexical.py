"""Lexical retrieval: postings, BM25 for a batch of questions, and upserts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..functions import text as T
from ..storage import staged

K1, B = 1.5, 0.75


def postings(corpus: DataFrame) -> DataFrame:
    """(term, id, tf) of ``corpus`` (id, text)."""
    return corpus.select("id", F.explode(T.tokenize(F.col("text"))).alias("term")).groupBy("term", "id").agg(F.count("*").alias("tf"))


def lengths(corpus: DataFrame) -> DataFrame:
    return corpus.select("id", F.size(T.tokenize(F.col("text"))).cast("long").alias("len"))


def document_frequency(corpus: DataFrame) -> DataFrame:
    return postings(corpus).groupBy("term").agg(F.count("*").alias("df"))


def question_terms(questions: DataFrame) -> DataFrame:
    """(qid, term), each term of a question once."""
    return questions.select("qid", F.explode(F.array_distinct(T.tokenize(F.col("question")))).alias("term"))


def isin(x: str, terms) -> str:
    """SQL that says whether ``x`` is one of some tokens, which are of few kinds of characters."""
    return f"{x} in ({', '.join(chr(34) + t + chr(34) for t in sorted(terms))})" if terms else "false"


class Places:
    """The best ``k`` of each of some questions of what is added, by ``key`` falling and then ``id`` (``falling`` too or not); what can't be among them any more is dropped early."""

    MOST = 1 << 20

    def __init__(self, questions: int, k: int, falling: bool = False):
        self.k, self.falling, self.held, self.waiting, self.size = k, falling, None, [], 0
        self.least, self.last = np.full(questions, -np.inf), None

    def add(self, q: np.ndarray, key: np.ndarray, id: np.ndarray, value: np.ndarray) -> None:
        keep = key >= self.least[q]
        if self.last is not None:
            last = self.last[q]
            keep &= (key > self.least[q]) | (id >= last if self.falling else id <= last)
        if keep.any():
            self.waiting.append((q[keep], key[keep], id[keep], value[keep]))
            self.size += len(self.waiting[-1][0])
        if self.size > self.MOST or (self.last is None and self.waiting):
            self.rows()

    def rows(self):
        """(question, key, id, value) arrays of what is held."""
        if self.waiting:
            parts = [*([self.held] if self.held else []), *self.waiting]
            q, key, id, value = (np.concatenate(x) for x in zip(*parts))
            place = np.unique(id, return_inverse=True)[1] if id.dtype == object else id
            order = np.lexsort((-place if self.falling else place, -key, q))
            q = q[order]
            order, q = (x[np.arange(len(q)) - np.searchsorted(q, q) < self.k] for x in (order, q))
            self.held, self.waiting, self.size = (q, key[order], id[order], value[order]), [], 0
            full = np.flatnonzero(np.diff(q, append=-1) != 0)  # the last row of each question
            full = full[full - np.searchsorted(q, q[full]) == self.k - 1]
            if len(full):
                if self.last is None:
                    self.last = np.full(len(self.least), self.held[2][0], self.held[2].dtype)
                self.least[q[full]], self.last[q[full]] = self.held[1][full], self.held[2][full]
        return self.held


class Asked:
    """The different terms of some lists of them (of questions), and which lists have each: what tasks need to count them in texts."""

    CELLS = 1 << 17  # pairs of text and list that are counted at a time

    def __init__(self, lists: list[list[str]]):
        self.terms = sorted({t for ts in lists for t in ts})
        code = {t: k for k, t in enumerate(self.terms)}
        pairs = np.array([(code[t], q) for q, ts in enumerate(lists) for t in ts], "i8").reshape(-1, 2)
        pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
        self.start, self.asking = np.searchsorted(pairs[:, 0], np.arange(len(self.terms) + 1)), pairs[:, 1]

    def _codes(self, found):
        """Code and row of each term of a batch's lists of terms."""
        import pyarrow as pa
        import pyarrow.compute as pc

        codes = pc.index_in(found.flatten(), pa.array(self.terms, found.type.value_type)).to_numpy(zero_copy_only=False)
        n = np.nan_to_num(pc.list_value_length(found).to_numpy(zero_copy_only=False)).astype("i8")
        return codes.astype("i8"), np.repeat(np.arange(len(n)), n)

    def _spread(self, codes: np.ndarray):
        """For each question of each code in turn: which code, and which question."""
        n = self.start[codes + 1] - self.start[codes]
        which = np.repeat(np.arange(len(codes)), n)
        within = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        return which, self.asking[self.start[codes][which] + within]


class Matches(Asked):
    """The asked terms of each document of a corpus (id, text), made once and staged, and what questions (qid, question) get from them.

    Questions are a stated set, whose terms the driver holds. A document's scores for all questions are made in the task
    that has its row, and a task sends on only its best of each question; so nothing is shuffled that grows with
    questions times documents. Rows whose id is null or comes again are joined and added up instead, as an id's
    score is the sum over its rows.
    """

    def __init__(self, questions: DataFrame, corpus: DataFrame):
        self.qid, self.id = questions.schema["qid"].dataType, corpus.schema["id"].dataType
        asked: dict = {}
        for r in questions.select("qid", F.array_distinct(T.tokenize(F.col("question"))).alias("t")).collect():
            asked.setdefault(r.qid, []).extend(r.t)
        self.qids = list(asked)
        super().__init__(list(asked.values()))
        tokens = T.once(corpus, t=T.tokenize(F.col("text")))
        self.packed = staged(tokens.select("id", F.size("t").alias("len"), F.expr(f"filter(t, x -> {isin('x', self.terms)})").alias("terms")), "matches")
        again = self.packed.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1 or id is null").select(F.col("id").alias("again_id"), F.lit(True).alias("again"))
        self.again = None if again.isEmpty() else again
        self.single, self.hits = self.packed, None
        if self.again is not None:
            marked = self.packed.join(self.again, F.col("id").eqNullSafe(F.col("again_id")), "left").drop("again_id")
            self.single = marked.filter("again is null").drop("again")
            self.hits = marked.filter("again").select("id", "len", F.explode("terms").alias("term")).groupBy("term", "id", "len").agg(F.count("*").alias("tf"))

    def frequency(self) -> DataFrame:
        """(term, df) of the asked terms."""
        df = self.single.select(F.explode(F.array_distinct("terms")).alias("term"))
        return (df if self.hits is None else df.unionByName(self.hits.select("term"))).groupBy("term").agg(F.count("*").alias("df"))

    def best(self, k: int, latest: int = 0, k1: float = K1, b: float = B) -> DataFrame:
        """(qid, id, score) that holds the best ``k`` of each question by score, then id, and the ``latest`` matches with the largest ids, among others."""
        known = {r.term: r.df for r in self.frequency().collect()}
        n, mean = self.packed.agg(F.count("*"), F.avg("len")).first()
        df = np.array([known.get(t, 0) for t in self.terms], "f8")
        idf, mean = np.log(1 + (n - df + 0.5) / (df + 0.5)), mean if mean and mean > 0 else 1.0
        m, asking, kind = self._free(), len(self.qids), self.id

        def run(batches):
            import pyarrow as pa
            from pyspark.sql.pandas.types import to_arrow_type

            top, late = Places(asking, k), Places(asking, latest, True)
            for batch in batches:
                step = max(1, m.CELLS // max(1, asking))
                for at in range(0, batch.num_rows, step):
                    part = batch.slice(at, step)
                    id = part.column("id").to_numpy(zero_copy_only=False)
                    codes, row = m._codes(part.column("terms"))
                    if not len(codes):
                        continue
                    pairs, tf = np.unique(row * len(m.terms) + codes, return_counts=True)
                    row, codes = pairs // len(m.terms), pairs % len(m.terms)
                    length = part.column("len").to_numpy(zero_copy_only=False)[row]
                    worth = idf[codes] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))
                    which, q = m._spread(codes)
                    scores = np.bincount(row[which] * asking + q, worth[which], len(id) * asking).reshape(len(id), asking)
                    r, q = np.nonzero((scores > 0) & (scores >= top.least - 1e-6))
                    top.add(q, np.round(scores[r, q], 6), id[r], scores[r, q])
                    if latest:
                        order = np.argsort(id, kind="stable")[::-1]
                        matched = scores[order] > 0
                        r, q = np.nonzero(matched & (np.cumsum(matched, axis=0) <= latest))
                        r = order[r]
                        late.add(q, np.zeros(len(r)), id[r], scores[r, q])
            for q, _, id, score in filter(None, [top.rows(), late.rows() if latest else None]):
                values = [pa.array([m.qids[i] for i in q], to_arrow_type(m.qid)), pa.array(id, to_arrow_type(kind)), pa.array(score)]
                yield pa.RecordBatch.from_arrays(values, ["qid", "id", "score"])

        fields = StructType([StructField("qid", self.qid), StructField("id", self.id), StructField("score", DoubleType())])
        got = self.single.mapInArrow(run, fields).withColumn("score", F.round("score", 6))
        if latest:
            got = got.distinct()
        if self.hits is not None:
            rows = [(q, t) for q, ts in enumerate(self._asked()) for t in ts]
            numbered = self.packed.sparkSession.createDataFrame(rows, "q long, term string")
            names = self.packed.sparkSession.createDataFrame(list(enumerate(self.qids)), StructType([StructField("q", LongType()), StructField("qid", self.qid)]))
            weights = self.packed.sparkSession.createDataFrame([(t, float(x)) for t, x in zip(self.terms, idf)], "term string, idf double")
            tf = F.col("tf")
            parts = self.hits.join(F.broadcast(weights), "term").select("term", "id", (F.col("idf") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / mean))).alias("part"))
            sums = numbered.join(parts, "term").groupBy("q", "id").agg(F.round(F.sum("part"), 6).alias("score")).join(names, "q")
            got = got.unionByName(sums.select("qid", "id", "score"))
        return got

    def _asked(self) -> list[list[str]]:
        """The terms of each question."""
        out = [[] for _ in self.qids]
        for code, t in enumerate(self.terms):
            for q in self.asking[self.start[code] : self.start[code + 1]]:
                out[q].append(t)
        return out

    def _free(self) -> Matches:
        """What tasks need of this: all but DataFrames."""
        out = object.__new__(Matches)
        out.qid, out.qids, out.terms, out.start, out.asking = self.qid, self.qids, self.terms, self.start, self.asking
        return out

    def counts(self, ids: DataFrame) -> DataFrame:
        """(qid, n): how many different of ``ids`` (id) have a term of the question; questions without any are left out."""
        rows = self.packed.join(ids.select("id"), "id", "left_semi").select("id", "terms")
        if self.again is not None:
            rows = rows.groupBy("id").agg(F.flatten(F.collect_list("terms")).alias("terms"))
        m, asking = self._free(), len(self.qids)

        def run(batches):
            import pyarrow as pa
            from pyspark.sql.pandas.types import to_arrow_type

            total = np.zeros(asking, "i8")
            for batch in batches:
                step = max(1, m.CELLS // max(1, asking))
                for at in range(0, batch.num_rows, step):
                    part = batch.slice(at, step)
                    codes, row = m._codes(part.column("terms"))
                    if len(codes):
                        which, q = m._spread(codes)
                        total += (np.bincount(row[which] * asking + q, minlength=part.num_rows * asking).reshape(-1, asking) > 0).sum(axis=0)
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([m.qids[i] for i in some], to_arrow_type(m.qid)), pa.array(total[some])], ["qid", "n"])

        return rows.mapInArrow(run, StructType([StructField("qid", self.qid), StructField("n", LongType())])).groupBy("qid").agg(F.sum("n").alias("n"))


def weighed(terms: DataFrame, hits: DataFrame, stats: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """BM25 (qid, id, score) from questions' ``terms`` (qid, term), all postings of those (term, id, len, tf) and one row of ``stats`` (n, mean)."""
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    tf, n, d, mean = F.col("tf"), F.col("n"), F.col("df"), F.when(F.col("mean") > 0, F.col("mean")).otherwise(1.0)
    idf = F.log(1 + (n - d + 0.5) / (d + 0.5))
    part = idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / mean))
    parts = hits.join(df, "term").crossJoin(F.broadcast(stats)).select("term", "id", part.alias("part"))
    return terms.join(parts, "term").groupBy("qid", "id").agg(F.round(F.sum("part"), 6).alias("score"))


def top(hits: DataFrame, k: int, *ties: str) -> DataFrame:
    """The best ``k`` of each question with ``rank`` from 1: by score, then ``ties`` ascending."""
    w = Window.partitionBy("qid").orderBy(F.desc("score"), *ties)
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def bm25(questions: DataFrame, corpus: DataFrame, k: int = 20, **options) -> DataFrame:
    return top(Matches(questions, corpus).best(k, **options), k, "id")


def upsert(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of the same key; in ``new`` the last by ``order`` counts."""
    last = new.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).filter("__n = 1").drop("__n")
    return old.join(last, key, "left_anti").unionByName(last)


def delete(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return rows.join(gone, key, "left_anti")
