"""Retrieval, text, citation and refusal metrics over batches of rankings and answers."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

from ..functions import text as T
from ..storage import staged
from . import lexical



def ranking_metrics(ranked: DataFrame, relevant: DataFrame, k: int, total: DataFrame | None = None) -> DataFrame:
    """Per question of ``ranked`` (qid, id, rank): recall, precision, hit rate and nDCG at ``k``, MRR and average precision against ``relevant`` (qid, id).

    With ``total`` (qid, n_rel), which says how many are relevant, ``relevant`` needs no others than those that are ranked.
    """
    rel = relevant.select("qid", "id").distinct()
    total = rel.groupBy("qid").agg(F.count("*").alias("n_rel")) if total is None else total.select("qid", "n_rel")
    first = ranked.groupBy("qid", "id").agg(F.min("rank").alias("r"))
    placed = first.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy("r"))).join(rel.withColumn("hit", F.lit(1)), ["qid", "id"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    placed = placed.withColumn("hits", F.sum("hit").over(Window.partitionBy("qid").orderBy("r")))
    inside = (F.col("hit") == 1) & (F.col("r") <= k)
    gain = 1 / F.log2(F.col("r") + 1)
    got = placed.groupBy("qid").agg(
        F.sum(inside.cast("int")).alias("found"),
        F.least(F.count("*"), F.lit(k)).alias("seen"),
        F.min(F.when(F.col("hit") == 1, F.col("r"))).alias("first"),
        F.sum(F.when(inside, gain).otherwise(0.0)).alias("dcg"),
        F.sum(F.when(F.col("hit") == 1, F.col("hits") / F.col("r")).otherwise(0.0)).alias("ap"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(k), F.col("n_rel")))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    d = got.join(total, "qid", "left").withColumn("n_rel", F.coalesce("n_rel", F.lit(0)))
    r6 = lambda c: F.round(c, 6)
    return d.select(
        "qid",
        r6(T.ratio(F.col("found"), F.col("n_rel"))).alias("recall"),
        r6(T.ratio(F.col("found"), F.col("seen"))).alias("precision"),
        (F.col("found") > 0).cast("double").alias("hit_rate"),
        r6(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"),
        r6(F.when(F.col("n_rel") > 0, F.col("dcg") / ideal).otherwise(0.0)).alias("ndcg"),
        r6(T.ratio(F.col("ap"), F.col("n_rel"))).alias("average_precision"),
    )


def with_token_f1(df: DataFrame, prediction: str, reference: str) -> DataFrame:
    """``df`` with ``token_f1``: harmonic mean of multiset precision and recall of tokens; 1 for two empty texts, 0 for one.

    The k-th of equal tokens is told apart by k, so common tokens are the intersection of two sets.
    """
    starts = lambda e: F.filter(F.when(F.size(e) > 0, F.sequence(F.lit(0), F.size(e) - 1)).otherwise(F.array().cast("array<int>")), lambda i: (i == 0) | (F.get(e, i) != F.get(e, i - 1)))
    numbered = lambda e, r: F.flatten(F.transform(r, lambda s, k: F.transform(F.sequence(s, F.coalesce(F.get(r, k + 1), F.size(e)) - 1), lambda i: F.concat_ws(" ", F.get(e, i), (i - s).cast("string")))))
    counted = lambda text: T.let(F.array_sort(T.tokenize(text)), lambda e: T.let(starts(e), lambda r: numbered(e, r)))
    d = T.once(df, __a=counted(F.col(prediction)), __b=counted(F.col(reference)))
    f1 = F.when((F.size("__a") == 0) & (F.size("__b") == 0), 1.0).otherwise(T.ratio(2 * F.size(F.array_intersect("__a", "__b")), F.size("__a") + F.size("__b")))
    return d.withColumn("token_f1", F.round(f1, 6)).drop("__a", "__b")


@F.pandas_udf(IntegerType())
def common_subsequence(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the longest common subsequence of two token lists, row by row of its table; a row is one step of array arithmetic."""

    def one(x, y) -> int:
        if len(x) < len(y):
            x, y = y, x
        if not len(y):
            return 0
        codes = {w: k for k, w in enumerate(dict.fromkeys([*x, *y]))}
        y = np.array([codes[w] for w in y])
        best = np.zeros(len(y) + 1, "i4")
        for w in x:
            # a cell is the best of the one above, one more than the one before that on a match, and all cells before it
            best[1:] = np.maximum.accumulate(np.maximum(best[1:], np.where(y == codes[w], best[:-1] + 1, 0)))
        return int(best[-1])

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="int32")


def with_rouge_l(df: DataFrame, prediction: str, reference: str) -> DataFrame:
    """``df`` with ``rouge_l``: F1 of the longest common subsequence of tokens; 1 for two empty texts, 0 for one."""
    d = T.once(df, __a=T.tokenize(F.col(prediction)), __b=T.tokenize(F.col(reference)))
    n = F.size("__a") + F.size("__b")
    return d.withColumn("rouge_l", F.round(F.when(n == 0, 1.0).otherwise(T.ratio(2 * common_subsequence("__a", "__b"), n)), 6)).drop("__a", "__b")


def exact_match(prediction: Column, reference: Column) -> Column:
    return (T.tokenize(prediction) == T.tokenize(reference)).cast("double")


def aggregate(rows: DataFrame, metrics: list[str], *group: str) -> DataFrame:
    """Mean and sample deviation (0 for one row) of each metric, without nulls and non-finite values."""
    clean = lambda m: F.when(F.isnan(m) | (F.abs(m) == float("inf")), None).otherwise(F.col(m))
    return rows.groupBy(*group).agg(F.count("*").alias("n"), *[x for m in metrics for x in (F.round(F.avg(clean(m)), 6).alias(f"{m}_mean"), F.round(F.coalesce(F.stddev_samp(clean(m)), F.lit(0.0)), 6).alias(f"{m}_std"))])


def by_tag(rows: DataFrame, metrics: list[str], tags: str = "tags") -> DataFrame:
    """``aggregate`` for each tag of the array ``tags``; rows without one are ``untagged``."""
    some = F.when(F.size(F.coalesce(tags, F.array().cast("array<string>"))) > 0, F.col(tags)).otherwise(F.array(F.lit("untagged")))
    return aggregate(rows.withColumn("tag", F.explode(some)), metrics, "tag")


def refusal_rates(rows: DataFrame) -> DataFrame:
    """Rates over (must_abstain, abstained), 0 where there is nothing to count."""
    must, did = F.col("must_abstain"), F.col("abstained")
    n = lambda c: F.coalesce(F.sum(c.cast("int")), F.lit(0))
    return rows.agg(
        n(must).cast("long").alias("n_unanswerable"),
        F.round(T.ratio(n(must & did), n(must)), 6).alias("abstain_recall"),
        F.round(T.ratio(n(must & ~did), n(must)), 6).alias("false_answer_rate"),
        F.round(T.ratio(n(~must & did), n(~must)), 6).alias("over_refusal_rate"),
    )


def relevant_chunks(passages: DataFrame, chunks: DataFrame, share: float = 0.6) -> DataFrame:
    """(pid, id): chunks (id, text) that hold a passage (pid, text) or lie in it, in canonical form; for a passage with none, those that share enough of the tokens of either.

    Passages are a stated set, which the driver holds. Each chunk's task counts the different tokens that it shares with
    each passage, and sends on only pairs that are relevant by one rule or the other. A text that lies in another has its
    tokens but the first and the last whole, so only pairs that share all but two of one's tokens are searched.
    """
    squeezed = lambda d, key: T.once(d.select(key, "text"), t=T.tokenize(T.squeeze(F.col("text")))).filter(F.size("t") > 0).select(key, F.array_join("t", " ").alias("c"), F.array_distinct("t").alias("s"))
    passed = squeezed(passages, "pid").collect()
    asked, held = lexical.Asked([list(r.s) for r in passed]), [r.c for r in passed]
    sizes, count = np.array([len(r.s) for r in passed], "i8"), len(passed)
    rows = squeezed(chunks, "id").select("id", "c", F.size("s").alias("b"), F.expr(f"filter(s, x -> {lexical.isin('x', asked.terms)})").alias("terms"))

    def run(batches):
        for batch in batches:
            step = max(1, asked.CELLS // max(1, count))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                codes, row = asked._codes(part.column("terms"))
                which, p = asked._spread(codes)
                n = np.bincount(row[which] * count + p, minlength=part.num_rows * count).reshape(part.num_rows, count)
                b = part.column("b").to_numpy()[:, None].astype("i8")
                near = (n >= share * np.minimum(b, sizes)) & (n > 0)
                texts, whole = part.column("c"), np.zeros(n.shape, bool)
                for i in np.flatnonzero(((n >= sizes - 2) | (n >= b - 2)).any(axis=1)):
                    h = texts[i].as_py()
                    for k in np.flatnonzero((n[i] >= sizes - 2) | (n[i] >= b[i] - 2)):
                        whole[i, k] = held[k] in h or h in held[k]
                i, k = np.nonzero(near | whole)
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(i)), pa.array(k), pa.array(whole[i, k])], ["id", "n", "whole"])

    found = staged(rows.mapInArrow(run, StructType([chunks.schema["id"], StructField("n", LongType()), StructField("whole", BooleanType())])), "relevant")
    names = passages.sparkSession.createDataFrame([(k, r.pid) for k, r in enumerate(passed)], StructType([StructField("n", LongType()), passages.schema["pid"]]))
    pairs = found.join(F.broadcast(names), "n").select("pid", "id", "whole")
    whole = pairs.filter("whole").select("pid", "id").distinct()
    return whole.union(pairs.join(F.broadcast(whole.select("pid").distinct()), "pid", "left_anti").select("pid", "id"))
