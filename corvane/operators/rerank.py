"""Heuristic reranking: coverage, proximity, fusion score and place in the document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import words as W
from .fusion import min_max

COVERAGE, PROXIMITY, FUSION, POSITION, DECAY = 0.45, 0.25, 0.25, 0.05, 0.08


def query_terms(question: Column) -> Column:
    return F.array_distinct(T.content_words(question, W.RERANK_STOPWORDS, 1))


def proximity(terms: Column, tokens: Column, matched: Column) -> Column:
    """``matched`` is the column of the terms among the tokens: (matched / asked) * (matched / tightest window over all matched terms); 0 below two.

    Reading on, each matched term has a last place; a window that ends here starts at the earliest of them.
    """
    hits = F.filter(F.transform(tokens, lambda t, i: F.struct((F.array_position(matched, t) - 1).cast("int").alias("k"), i.alias("i"))), lambda h: h["k"] >= 0)
    start = F.struct(F.transform(matched, lambda _: F.lit(-1)).alias("last"), F.lit(2**31 - 1).alias("best"))

    def step(s: Column, h: Column) -> Column:
        last = F.transform(s["last"], lambda x, k: F.when(k == h["k"], h["i"]).otherwise(x))
        return F.transform(F.array(last), lambda a: F.struct(a.alias("last"), F.when(F.array_min(a) >= 0, F.least(s["best"], h["i"] - F.array_min(a) + 1)).otherwise(s["best"]).alias("best")))[0]

    best = F.aggregate(hits, start, step, lambda s: s["best"])
    m = F.size(matched)
    return F.when(m < 2, F.lit(0.0)).otherwise(T.ratio(m, F.size(terms)) * T.ratio(m, F.greatest(best, m)))


def heuristic(candidates: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each question's candidates (qid, question, id, text, ordinal, score, rank): ``rerank_score`` and new ``rank``; ties keep their order."""
    phrase = lambda x: F.lower(T.squeeze(x))
    d = T.once(candidates, __q=query_terms(F.col("question")), __t=T.tokenize(F.col("text")), __prior=F.col("score"))
    d = T.once(d.withColumn("__prior", min_max(F.col("score"), "qid")), __m=F.array_intersect("__q", "__t"))
    whole = (F.size("__q") >= 2) & (phrase(F.col("question")) != "") & F.contains(phrase(F.col("text")), phrase(F.col("question")))
    near = F.when(whole, F.lit(1.0)).otherwise(proximity(F.col("__q"), F.col("__t"), F.col("__m")))
    place = 1 / (1 + DECAY * F.greatest(F.lit(0), F.col("ordinal")))
    value = COVERAGE * T.ratio(F.size("__m"), F.size("__q")) + PROXIMITY * near + FUSION * F.col("__prior") + POSITION * place
    d = T.once(d, rerank_score=F.round(value, 6)).drop("__q", "__t", "__m", "__prior")
    return d.withColumn("new_rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("rerank_score"), "rank"))).filter(F.col("new_rank") <= max(0, k))


def parse_scores(reply: Column, count: Column) -> Column:
    """map<index, score> of the outermost [...] of a model's reply: indexes 1 to ``count``, the first of each, scores of 10 on 0 to 1; null if there is none."""
    items = F.from_json(F.regexp_extract(reply, r"(?s)(\[.*\])", 1), "array<struct<index:int,score:double>>")
    good = F.filter(items, lambda x: (x["index"] >= 1) & (x["index"] <= count) & x["score"].isNotNull())
    once = F.filter(good, lambda x, i: ~F.exists(F.slice(good, F.lit(1), i), lambda y: y["index"] == x["index"]))
    return F.map_from_entries(F.transform(once, lambda x: F.struct(x["index"], F.least(F.lit(1.0), F.greatest(F.lit(0.0), x["score"] / 10)))))
