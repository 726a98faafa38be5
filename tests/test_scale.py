"""Steps whose cost or memory once grew faster than their input."""

import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from corvane import catalog
from corvane.operators import embedding, evaluation, fusion, guards, lexical


def shuffled_rows(df) -> int:
    """Rows that the plan of ``df``, run once, sent through its exchanges."""
    df.collect()
    total, plans = 0, [df._jdf.queryExecution().executedPlan()]
    while plans:
        p = plans.pop()
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            plans.append(p.executedPlan())
        elif name in ("ShuffleQueryStageExec", "BroadcastQueryStageExec"):
            plans.append(p.plan())
        elif name != "ReusedExchangeExec":
            if name == "ShuffleExchangeExec":
                total += p.metrics().apply("shuffleRecordsWritten").value()
            plans += [p.children().apply(i) for i in range(p.children().size())]
    return total


def brute_bm25(questions, rows, k1=1.5, b=0.75):
    """Scores over rows (id, text); rows of one id and length are one document's, an id's score is the sum over its rows."""
    tok = lambda t: re.findall(r"[a-z0-9_]+(?:'[a-z]+)?", (t or "").lower())
    n, mean = len(rows), sum(len(tok(t)) for _, t in rows) / len(rows)
    tf = {}
    for i, t in rows:
        for w in tok(t):
            tf[w, i, len(tok(t))] = tf.get((w, i, len(tok(t))), 0) + 1
    df = {}
    for w, _, _ in tf:
        df[w] = df.get(w, 0) + 1
    out = {}
    for q, text in questions:
        for w in dict.fromkeys(tok(text)):
            for (x, i, size), f in tf.items():
                if x == w:
                    out[q, i] = out.get((q, i), 0) + math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * f * (k1 + 1) / (f + k1 * (1 - b + b * size / mean))
    return out


def test_bm25_shuffles_no_row_for_each_question_and_document(spark):
    rows = [(i, f"alpha beta w{i % 50} " * (i % 4 + 1)) for i in range(4000)]
    asked = [(q, f"alpha beta w{q}") for q in range(30)]
    corpus = spark.createDataFrame(rows, "id long, text string").repartition(4)
    questions = spark.createDataFrame(asked, "qid long, question string")
    hits = lexical.bm25(questions, corpus, 5)
    got = sorted((r.qid, r["rank"], r.id) for r in hits.collect())
    want, scores = [], brute_bm25(asked, rows)
    for q, _ in asked:
        best = sorted((-round(s, 6), i) for (p, i), s in scores.items() if p == q)[:5]
        want += [(q, k, i) for k, (_, i) in enumerate(best, 1)]
    assert got == want
    assert shuffled_rows(hits) <= 4 * 30 * 5  # best of each task and question; 120,000 pairs and their parts before


@pytest.mark.parametrize("kind", ["long", "string"])
def test_bm25_of_ids_that_come_again(spark, kind):
    dice = random.Random(3)
    name = (lambda i: i) if kind == "long" else (lambda i: f"d{i}")
    rows = [(None if i % 40 == 7 else name(i // 2 if i < 60 else i), " ".join(dice.choices("a b c d e f g".split(), k=dice.randint(0, 9)))) for i in range(200)]
    asked = [(1, "a b a"), (2, "c zz"), (3, "")]
    m = lexical.Matches(spark.createDataFrame(asked, "qid int, question string"), spark.createDataFrame(rows, f"id {kind}, text string"))
    scores = brute_bm25(asked, rows)
    got = {(r.qid, r.id): r.score for r in m.best(1000, 3).collect()}
    assert got.keys() == scores.keys() and all(abs(got[x] - scores[x]) < 2e-6 for x in got)
    few = {(r.qid, r.id) for r in m.best(1, 3).collect()}
    for q in (1, 2):
        last = sorted((i for p, i in scores if p == q and i is not None), reverse=True)[:3]
        assert {(q, i) for i in last} <= few
    ids = spark.createDataFrame([(name(i),) for i in range(0, 200, 3)], f"id {kind}")
    wanted = {q: sum(1 for p, i in scores if p == q and i in {name(x) for x in range(0, 200, 3)}) for q in (1, 2)}
    assert {r.qid: r.n for r in m.counts(ids).collect()} == wanted


def test_texts_of_candidates_are_not_shuffled(spark, sf_dir):
    plan = catalog.candidates(spark, sf_dir, 3)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan


def test_ranking_metrics_with_totals(spark):
    ranked = spark.createDataFrame([(1, f"c{i}", i) for i in range(1, 6)], "qid int, id string, rank int")
    rel = spark.createDataFrame([(1, "c2"), (1, "c5"), (1, "c9")], "qid int, id string")
    total = spark.createDataFrame([(1, 3)], "qid int, n_rel long")
    assert evaluation.ranking_metrics(ranked, rel.filter("id <> 'c9'"), 5, total).collect() == evaluation.ranking_metrics(ranked, rel, 5).collect()


def test_money_slot_has_the_words_ends_of_its_sql(spark, tmp_path):
    import duckdb

    texts = ["an ñdollar", "dollarñ", "Ñ. Dollarñ", "éfree of chargeé", "a dollar", "dollarx", "xdollar", "dollar_", "at no ñ cost", "poundſ", "ſdollar", "at no [1] cost", "free of  charge", "covered K in full", "€", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.unfilled for r in catalog.QUERIES["money_slot"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert got == dict(con.sql(catalog.ORACLE["money_slot"]).fetchall()) and got[0] is False


def test_questions_that_name_nothing_read_no_corpus(spark):
    q = spark.createDataFrame([(1, "what does it cost to be here")], "qid int, question string")
    unread = spark.range(3).select("id", F.raise_error(F.lit("read")).cast("string").alias("text"))
    for find in (guards.missing_identifiers, guards.unattested_code, guards.unattested_names):
        assert find(q, unread).collect() == []


def test_anchors_of_a_corpus_stem_asked_words_only(spark):
    texts = ["Charging prices, the price priced pricing_tables. Pricer's cities; city ities.", "annual_charges and Annual Reports", "reporting annually an", "", None]
    corpus = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    q = spark.createDataFrame([(1, "annual pricing cities"), (2, "table reports charges, cooked")], "qid int, question string")
    asked = {r.stem for r in guards.anchors_of(q).collect()}
    every = {r.stem: r.df for r in guards.anchor_frequency(corpus).collect()}
    some = {r.stem: r.df for r in guards.anchor_frequency(corpus, q).collect()}
    assert some == {s: n for s, n in every.items() if s in asked} and len(some) >= 4
    names = spark.createDataFrame([(1, "see the Annual Reports here"), (2, "see the Annual Prices here")], "qid int, question string")
    assert [r.qid for r in guards.unattested_names(names, corpus).collect()] == [2]


def test_pairs_of_a_label_meet_in_cells(spark):
    import numpy as np

    dice = np.random.default_rng(1)
    base = dice.normal(size=(40, 8))
    rows = [(int(i), int(i % 3) if i % 17 else None, (base[i % 40] + dice.normal(size=8) * 0.2).tolist()) for i in range(300)] + [(900, 1, [0.0] * 8), (901, 1, None), (902, 1, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "id long, label int, vector array<double>")
    got = {(r.a, r.b): r.cosine for r in fusion.alike(df, 0.9, together=20).collect()}
    want = {}
    for i, x, v in rows:
        for j, y, w in rows:
            if i < j and x == y and x is not None and v and w and len(v) == len(w):
                c = round(float(np.dot(v, w) / max(1e-12, np.linalg.norm(v) * np.linalg.norm(w))), 4)
                if c >= 0.9:
                    want[i, j] = c
    assert got == want and len(want) > 50
    assert "CartesianProduct" not in (plan := fusion.alike(df, 0.9)._jdf.queryExecution().executedPlan().toString()) and "FlatMapGroupsInArrow" in plan


def test_vectors_of_texts(spark):
    texts = ["", " ", "a", "The cat's  cat", "café ﬁ café", "\U0001d49c\U0001d4b7 e" * 3, "".join(map(chr, range(0x100, 0xD000))) + "".join(map(chr, range(0x10000, 0x1F000)))]
    held = embedding.Buckets(64)
    for _ in range(2):
        got = held.embed(texts)
        for t, v in zip(texts, got):
            want = [0.0] * 64
            for kind, found in embedding.features(t).items():
                for x, n in found.items():
                    h = int.from_bytes(hashlib.blake2b(f"{kind}\x1f{x}".encode(), digest_size=8).digest(), "big")
                    want[h % 64] += (1 if h >> 63 else -1) * embedding.PRIORS[kind] * min(1, (len(x) + 1) / 8) * (1 + math.log(n))
            norm = math.sqrt(sum(x * x for x in want)) or 1.0
            assert max(abs(a / norm - b) for a, b in zip(want, v)) < 1e-6
    held = embedding.Buckets(64)  # what is held is bounded
    held.WORDS, held.bigram.MOST = 50, 60
    held.CHARS = 200
    again = held.embed([f"w{i} x{i} y{i % 7}" * 3 for i in range(400)])
    assert (again == embedding.Buckets(64).embed([f"w{i} x{i} y{i % 7}" * 3 for i in range(400)])).all() and len(held.names) < 200


def test_relevant_chunks_by_every_pair(spark):
    dice = random.Random(5)
    text = lambda n: " ".join(dice.choices("ab cd ef gh ij kl mn op".split(), k=n))
    passages = [(k, text(dice.randint(1, 6))) for k in range(25)] + [(90, "zz"), (91, "b c"), (92, "")]
    chunks = [(k, text(dice.randint(0, 9))) for k in range(120)] + [(200, "xab cdx"), (201, "b"), (202, None), (203, "ab  c\xadd\nef"), (203, "kl")]
    df = evaluation.relevant_chunks(spark.createDataFrame(passages, "pid int, text string"), spark.createDataFrame(chunks, "id int, text string"))
    tok = lambda t: re.findall(r"[a-z0-9_]+(?:'[a-z]+)?", (t or "").replace("\xad", "").lower())
    pairs = [(p, c, tok(x), tok(y)) for p, x in passages for c, y in chunks if tok(x) and tok(y)]
    whole = {(p, c) for p, c, x, y in pairs if " ".join(x) in " ".join(y) or " ".join(y) in " ".join(x)}
    some = {(p, c) for p, c, x, y in pairs if p not in {q for q, _ in whole} and len(set(x) & set(y)) >= 0.6 * min(len(set(x)), len(set(y)))}
    assert {(r.pid, r.id) for r in df.collect()} == whole | some and whole and len({p for p, _ in whole}) < 27
    assert shuffled_rows(df) <= 4 * (len(whole) + len(some))  # every pair with a shared token before


def test_vectors_of_texts_in_blocks(spark):
    chunks = spark.createDataFrame([(i, i, f"word{i % 5} and word{i % 7}" if i else None) for i in range(40)], "id long, seq long, text string")
    asked = embedding.with_embedding(spark.createDataFrame([(1, "word3"), (2, "and word5")], "qid int, question string"), "question", 32)
    by_rows = fusion.cosine(asked, embedding.with_embedding(chunks, "text", 32), 5)
    by_blocks = fusion.cosine(asked, None, 5, fusion.text_blocks(chunks, 32))
    assert sorted(map(tuple, by_blocks.collect())) == sorted(map(tuple, by_rows.collect()))
