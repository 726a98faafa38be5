"""Retrieval and answers as plans over a batch of questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import citations, embedding, evaluation, fusion, guards, lexical, rerank
from ..storage import staged
from .index import Index

MODES = ("dense", "lexical", "hybrid")
BALANCE = 0.7


def _diversified(best: DataFrame, vectors: DataFrame, k: int, balance: float) -> DataFrame:
    """``best`` cut to ``k`` a question by maximal marginal relevance, ranked in the order of the picks."""
    row = F.struct("rank", "id", "vector", "score")
    lists = best.join(vectors.select("id", "vector"), "id").groupBy("qid").agg(F.sort_array(F.collect_list(row)).alias("c"))  # a pool's few rows
    picked = fusion.diversify(lists, "c", k, balance).select("qid", F.posexplode("picked").alias("p", "i"), "c").select("qid", F.get("c", F.col("i"))["id"].alias("id"), (F.col("p") + 1).alias("new_rank"))
    return best.drop("rank").join(picked, ["qid", "id"]).withColumnRenamed("new_rank", "rank")


def _found(q: DataFrame, chunks: DataFrame, vectors: DataFrame, found, mode: str, k: int, pool: int, reranked: bool, dim: int, weights: tuple[float, float], balance: float, blocks: DataFrame | None = None) -> DataFrame:
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    pool, hits = max(k, pool), []
    if mode != "lexical":
        dense = fusion.cosine(embedding.with_embedding(q, "question", dim), vectors, pool, blocks)
        hits.append(dense.select("qid", F.lit("dense").alias("list"), F.lit(weights[0]).alias("weight"), "id", "rank", "score", F.col("seq").alias("tie")))
    if mode != "dense":
        hits.append(found(q, pool).select("qid", F.lit("lexical").alias("list"), F.lit(weights[1]).alias("weight"), "id", "rank", "score", F.lit(0).cast("long").alias("tie")))
    every = hits[0] if len(hits) == 1 else hits[0].unionByName(hits[1])
    # one aggregation fuses the lists and keeps each one's own score beside
    of = lambda name: F.max(F.when(F.col("list") == name, F.col("score"))).alias(f"{name}_score")
    fused = F.round(F.sum(F.col("weight") / (fusion.RRF_K + F.col("rank"))), 9) if mode == "hybrid" else F.max("score")
    one = every.groupBy("qid", "id").agg(fused.alias("score"), of("dense"), of("lexical"), F.max("tie").alias("tie"))
    scaled = one.withColumn("score", fusion.rescale(F.col("score"), mode, sum(weights)))
    best = lexical.top(scaled, pool, "tie", "id") if mode == "dense" else lexical.top(scaled, pool, "id")
    best = best.drop("tie")
    if reranked:
        best = staged(best, "best")  # few rows: the chunks' texts aren't shuffled to meet them
        full = chunks.select("id", "text", "ordinal").join(F.broadcast(best), "id").join(F.broadcast(q), "qid")
        best = rerank.heuristic(full, k).select("qid", "id", F.col("rerank_score").alias("score"), "dense_score", "lexical_score", "rerank_score", F.col("new_rank").alias("rank"))
    else:
        best = best.withColumn("rerank_score", F.lit(None).cast("double"))
        best = _diversified(best, vectors, k, balance) if balance < 1 and pool > k else best.filter(F.col("rank") <= k)
    return best.select("qid", "id", "score", "rank", "dense_score", "lexical_score", "rerank_score")


def search(questions: DataFrame, chunks: DataFrame, mode: str = "hybrid", k: int = 5, pool: int = 24, reranked: bool = True, dim: int = 1024, weights: tuple[float, float] = (0.5, 0.5), balance: float = BALANCE) -> DataFrame:
    """The best ``k`` chunks (id, text, ordinal, seq) of each question (qid, question): qid, id, score, rank, dense_score, lexical_score, rerank_score.

    ``mode`` is dense, lexical or hybrid. The pool's best candidates are reranked or, with ``reranked`` off, diversified.
    Scores of a list that a chunk isn't in are null. Blank questions find nothing. ``indexed_search`` reads a stored index.
    """
    q = questions.filter(F.trim("question") != "")
    vectors = embedding.with_embedding(chunks.select("id", "seq", "text"), "text", dim).drop("text")
    return _found(q, chunks, vectors, lambda q, n: lexical.bm25(q, chunks.select("id", "text"), n), mode, k, pool, reranked, dim, weights, balance, fusion.text_blocks(chunks, dim))


def indexed_search(questions: DataFrame, index: Index, mode: str = "hybrid", k: int = 5, pool: int = 24, reranked: bool = True, weights: tuple[float, float] = (0.5, 0.5), balance: float = BALANCE) -> DataFrame:
    """``search`` over a stored index, which is neither tokenized nor embedded again."""
    q = questions.filter(F.trim("question") != "")
    return _found(q, index.chunks(), index.vectors(), index.bm25, mode, k, pool, reranked, index.made[1], weights, balance)


def answers(questions: DataFrame, contexts: DataFrame, corpus: DataFrame, strict: bool = True, budget: int = 6000) -> DataFrame:
    """Answers to questions (qid, question) from their contexts (qid, rank, id, doc_id, source, title, page, ordinal, text, score) over the ``corpus`` (id, text): qid, answer, reason, abstained, groundedness, citations.

    Gates come first: results, score, coverage, anchors. What passes gets the extractive answer from the contexts that
    fit ``budget`` tokens, its markers resolved and numbered anew, and is checked sentence by sentence against what it
    cites; a price that isn't stated, and with ``strict`` an answer that isn't grounded, are refused after all.
    """
    contexts = staged(contexts, "contexts")  # read in eight places
    named = contexts.withColumnRenamed("qid", "aid")
    pooled = contexts.groupBy("qid").agg(F.array_join(F.collect_list("text"), "\n").alias("pooled"), F.count("*").alias("n"), F.max_by("score", -F.col("rank")).alias("top"), F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("rank", "title"))), lambda x: x["title"])).alias("titles"))
    missed = staged(guards.missing_anchors(questions, contexts, corpus), "anchors").groupBy("qid").agg(F.sort_array(F.collect_set("anchor")).alias("anchors"))
    indexed = corpus.select(F.lit(1)).limit(1).agg(F.count("*").alias("indexed"))
    d = questions.join(pooled, "qid", "left").join(missed, "qid", "left").crossJoin(F.broadcast(indexed))
    none = F.array().cast("array<string>")
    d = d.withColumns({"anchors": F.coalesce("anchors", none), "titles": F.coalesce("titles", none), "n": F.coalesce("n", F.lit(0))})
    covered = guards.coverage(F.col("question"), F.coalesce("pooled", F.lit("")))
    gated = staged(T.once(d, gate=guards.gate(F.col("n"), F.coalesce("top", F.lit(0.0)), covered, F.size("anchors"), F.col("indexed"))).drop("pooled"), "gates")
    open_ = gated.filter("gate is null").select("qid", "question")
    fitting = citations.within_budget(named, budget).withColumnRenamed("aid", "qid")
    drafts = guards.extractive_answers(open_.join(fitting.select("qid", "rank", "text"), "qid"))
    drafts = staged(open_.join(drafts, "qid", "left").select(F.col("qid").alias("aid"), F.coalesce("answer", F.lit(guards.REFUSAL)).alias("answer")), "drafts")
    cited = staged(citations.resolved(drafts, named)[0], "citations")
    final = citations.renumbered(drafts, cited)
    sources = named.join(cited.select("aid", F.col("marker").alias("rank"), "new_marker"), ["aid", "rank"], "left").select("aid", F.col("text").alias("context"), F.col("new_marker").alias("marker"))
    grounded = guards.groundedness(final, sources, cited=True).select(F.col("aid").alias("qid"), F.col("score").alias("grounded"))
    rows = F.sort_array(F.collect_list(F.struct(F.col("new_marker").alias("marker"), "id", "doc_id", "quote"))).alias("cited")
    d = gated.join(final.withColumnRenamed("aid", "qid"), "qid", "left").join(grounded, "qid", "left").join(cited.groupBy(F.col("aid").alias("qid")).agg(rows), "qid", "left")
    refused = F.col("answer") == guards.REFUSAL
    reason = F.coalesce("gate", F.when(refused, "no_answer").when(T.money_slot_unfilled(F.col("question"), F.col("answer")), "money_slot_unfilled").when(F.lit(strict) & (F.col("grounded") < guards.MIN_GROUNDED), "ungrounded"))
    d = T.once(d, reason=reason)
    message = F.when(F.col("reason").isNull() | F.col("reason").isin("no_answer"), F.col("answer")).when(F.col("reason") == "ungrounded", F.lit(guards.REFUSAL)).otherwise(guards.abstention_message(F.col("reason"), F.col("titles"), F.col("anchors")))
    empty = F.slice("cited", 1, 0)
    return d.select("qid", message.alias("answer"), "reason", F.col("reason").isNotNull().alias("abstained"), F.when(F.col("reason").isNull() | (F.col("reason") == "ungrounded"), F.col("grounded")).otherwise(1.0).alias("groundedness"), F.when(F.col("reason").isNull(), F.col("cited")).otherwise(empty).alias("citations"))


def evaluated(golden: DataFrame, ranked: DataFrame, chunks: DataFrame, given: DataFrame | None = None, k: int = 5) -> DataFrame:
    """Retrieval metrics of each question of a golden set (qid, relevant_chunk_texts, relevant_doc_ids, must_abstain, tags) with its ranking (qid, id, rank) over ``chunks`` (id, doc_id, text): qid, tags and the metrics.

    A question's relevant chunks are those that hold its passages or share enough of their tokens; one whose passages
    are found nowhere takes the chunks of its documents. ``given`` (qid, id) are the chunks its answer cites, if known.
    """
    asked = golden.filter("not must_abstain")
    passages = asked.select("qid", F.posexplode("relevant_chunk_texts").alias("n", "text")).withColumn("pid", F.struct("qid", "n"))
    by_text = evaluation.relevant_chunks(passages.select("pid", "text"), chunks.select("id", "text")).select(F.col("pid.qid").alias("qid"), "id").distinct()
    by_doc = asked.join(by_text, "qid", "left_anti").select("qid", F.explode("relevant_doc_ids").alias("doc_id")).join(chunks.select("id", "doc_id"), "doc_id").select("qid", "id")
    relevant = by_text.union(by_doc)
    out = asked.select("qid", "tags").join(evaluation.ranking_metrics(ranked, relevant, k), "qid", "left")
    if given is not None:
        out = out.join(citations.citation_metrics(given, relevant), "qid", "left")
    return out.na.fill(0.0)

