"""Gates before an answer, anchors of questions, support of sentences and extractive answers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import words as W
from ..storage import staged
from .lexical import isin

MIN_SCORE, MIN_COVERAGE, SUPPORTED, MIN_GROUNDED = 0.10, 0.70, 0.42, 0.60
# Fixed value: the plain refusal.
REFUSAL = "I could not find enough support for that in the indexed documents."
# Shapes of identifiers.
IDENTIFIER = r"\b([A-Za-z]{1,12})-?(\d{1,5}(?:\.\d{1,5})?)\b"
SPACED = r"\b([A-Za-z]{2,12}) (\d{1,5}(?:\.\d{1,5})?)\b"
CAPITALS = r"\b([A-Z]{2,12}) (\d{1,5}(?:\.\d{1,5})?)\b"
# Shapes of names in code.
CODE = (
    r"@[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*",
    r"--[a-z][a-z0-9]*(?:-[a-z0-9]+)+",
    r"\b[A-Za-z][A-Za-z0-9]*(?:_[A-Za-z0-9]+)+\b",
    r"\b[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]*){1,4}\b|\b[A-Z]{2,}[a-z][A-Za-z0-9]*\b",
)
DOTTED = r"\b[A-Za-z][A-Za-z0-9]{1,}(?:\.[A-Za-z][A-Za-z0-9]{1,}){1,3}\b"
FEW = 200  # asked names that texts are searched for one by one
# What a text with a name in code has somewhere.
CODE_SIGN = r"[`@_]|--|[a-z0-9][A-Z]|[A-Z]{2}[a-z]|[A-Za-z0-9]\.[A-Za-z]"
# Words that negate.
NEGATIONS = "no not never none neither nor without cannot cant doesn isn aren don wasn werent hasn havent".split()
# Words that name an attribute.
ATTRIBUTES = (
    "maximum minimum cap caps limit limits threshold thresholds target targets quota allowance budget deductible premium copay fee fees cost costs price rate "
    "charge duration period deadline notice frequency interval window timeout retention expiry size length count total number percentage percent share portion "
    "annual annually monthly weekly daily yearly hourly default standard base initial"
).split()


def coverage(question: Column, context: Column) -> Column:
    """Share of the question's content stems that the context's tokens have; 1 for a question without any."""
    asked = F.array_distinct(F.transform(F.filter(T.content_words(question), lambda w: ~w.isin(list(W.SCAFFOLD))), T.stem))
    return F.when(F.size(asked) == 0, 1.0).otherwise(T.containment(asked, T.stems(context)))


def gate(results: Column, score: Column, covered: Column, anchors: Column | None = None, indexed: Column | None = None) -> Column:
    """Why a question is refused before it is answered, by the first gate that says so; null if none does. ``anchors``: how many it misses; ``indexed``: chunks in the index."""
    reason = F.when((results == 0) & ((F.lit(1) if indexed is None else indexed) == 0), "empty_index").when(results == 0, "no_results").when(score < MIN_SCORE, "low_retrieval_score").when(covered < MIN_COVERAGE, "query_terms_absent")
    return reason if anchors is None else reason.when(anchors > 0, "anchor_missing")


def vocabulary(text: Column) -> Column:
    """Distinct stems of the tokens and of their parts of over two characters."""
    tokens = T.tokenize(text)
    parts = F.filter(F.flatten(F.transform(tokens, lambda t: F.split(t, r"[_\-]"))), lambda p: F.length(p) > 2)
    return F.array_distinct(F.transform(F.concat(tokens, parts), T.stem))


def prefix(p: Column) -> Column:
    low = F.lower(p)
    out = low
    for name, short in W.PREFIXES.items():
        out = F.when(low == name, short).otherwise(out)
    return out


def negated(left: Column) -> Column:
    """Whether one of the last six tokens of the clause that ``left`` ends in is a negation."""
    clause = F.element_at(F.split(left, r"[.;:!?]", -1), -1)
    tokens = T.tokenize(clause)
    return F.arrays_overlap(F.slice(tokens, F.greatest(F.size(tokens) - 5, F.lit(1)), F.lit(6)), T.array(NEGATIONS))


def occurrences(df: DataFrame, text: str, pattern: str, *keep: str) -> DataFrame:
    """(keep, prefix, digits, left) of each match in turn: what is left of it is told by splitting at the matches."""
    t = F.col(text)
    found = F.arrays_zip(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)).alias("m"), F.regexp_extract_all(t, F.lit(pattern), F.lit(1)).alias("p"), F.regexp_extract_all(t, F.lit(pattern), F.lit(2)).alias("d"))
    gaps = F.split(t, pattern, -1)
    d = df.select(*keep, gaps.alias("__g"), F.posexplode(found).alias("i", "x"))
    left = F.concat_ws("", F.flatten(F.transform(F.sequence(F.lit(0), F.col("i")), lambda j: F.array(F.get("__g", j)))))
    return d.select(*keep, prefix(F.col("x.p")).alias("prefix"), F.col("x.d").alias("digits"), left.alias("left"))


def families(corpus: DataFrame) -> DataFrame:
    """(prefix) that the corpus (id, text) uses for identifiers."""
    glued = occurrences(corpus, "text", IDENTIFIER, "id").select("prefix")
    capitals = occurrences(corpus, "text", CAPITALS, "id").select("prefix")
    aliased = occurrences(corpus, "text", SPACED, "id").filter(F.col("prefix") == "v").select("prefix")
    return glued.union(capitals).union(aliased).distinct()


def identifiers(corpus: DataFrame) -> DataFrame:
    """(prefix, digits) that the corpus states without negation."""
    glued = occurrences(corpus, "text", IDENTIFIER, "id")
    spaced = occurrences(corpus, "text", SPACED, "id").join(families(corpus), "prefix", "left_semi")
    return glued.unionByName(spaced).filter(~negated(F.col("left"))).select("prefix", "digits").distinct()


def missing_identifiers(questions: DataFrame, corpus: DataFrame) -> DataFrame:
    """(qid, prefix, digits) that questions name and the corpus doesn't. Questions are a stated set; only texts with a prefix that they name are searched in full."""
    glued, spaced = (occurrences(questions, "question", p, "qid").drop("left") for p in (IDENTIFIER, SPACED))
    named = {r.prefix for r in glued.union(spaced).select("prefix").distinct().collect()}
    if not named:
        return glued.select("qid", "prefix", "digits")
    forms = sorted(named | {long for long, short in W.PREFIXES.items() if short in named})
    sign = rf"(?i)\b(?:{'|'.join(forms)})[- ]?[0-9]" if len(forms) <= FEW else r"[A-Za-z][- ]?[0-9]"
    corpus = staged(corpus.select("id", "text").filter(F.col("text").rlike(sign)), "identified")
    spaced = spaced.join(families(corpus), "prefix", "left_semi")
    return glued.unionByName(spaced).select("qid", "prefix", "digits").distinct().join(identifiers(corpus), ["prefix", "digits"], "left_anti")


def code_tokens(text: Column, dotted: bool = False) -> Column:
    """Distinct lower-cased names in code; ``dotted`` takes bare dotted paths too, as of a corpus."""
    ticked = F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"`([^`\n]{2,60})`"), F.lit(1)), lambda s: F.regexp_replace(s, T.STRIP, "")), lambda s: F.length(s) > 2)
    paths = F.flatten(F.transform(ticked, lambda s: F.regexp_extract_all(s, F.lit(DOTTED), F.lit(0))))
    every = F.concat(ticked, paths, *[F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in CODE], *([F.regexp_extract_all(text, F.lit(DOTTED), F.lit(0))] if dotted else []))
    return F.array_sort(F.array_distinct(F.transform(F.filter(every, lambda x: F.length(x) > 2), F.lower)))


def unattested_code(questions: DataFrame, corpus: DataFrame) -> DataFrame:
    """(qid, token) of names in questions that are part of no name in the corpus; nothing if that has none. Questions are a stated set."""
    asked = questions.select("qid", F.explode(code_tokens(F.col("question"))).alias("token"))
    tokens = sorted({r.token for r in asked.select("token").collect()})
    if not tokens:
        return asked
    names = lambda d: d.filter(F.col("text").rlike(CODE_SIGN)).select(F.explode(code_tokens(F.col("text"), True)).alias("attested"))
    some = names(corpus).limit(1).select(F.lit(1).alias("one"))
    if len(tokens) <= FEW and "".join(tokens).isascii():  # what a name has, its text has
        corpus = corpus.filter(F.lower("text").rlike("|".join(re.escape(t) for t in tokens)))
    attested = names(corpus).distinct()
    return asked.join(attested, F.contains(F.col("attested"), F.col("token")), "left_anti").join(F.broadcast(some), F.lit(True), "left_semi")


def capitalised_runs(question: Column) -> Column:
    """Runs (array<array<string>>) of at least two words with a capital, the first word of the question aside; stopwords end a run."""
    words = F.regexp_extract_all(question, F.lit("[A-Za-z0-9_]+"), F.lit(0))
    rest = F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0)))
    named = lambda w: w.rlike("^[A-Z]") & ~F.lower(w).isin(list(W.STOPWORDS))
    joined = F.array_join(F.transform(rest, lambda w: F.when(named(w), w).otherwise("\n")), " ")
    runs = F.transform(F.split(joined, "\n"), lambda r: F.filter(F.split(r, " "), lambda w: w != ""))
    return F.filter(runs, lambda r: F.size(r) >= 2)


def case_informative(question: Column) -> Column:
    words = F.regexp_extract_all(question, F.lit("[A-Za-z0-9_]+"), F.lit(0))
    rest = F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0)))
    return (F.size(rest) > 0) & ~F.forall(rest, lambda w: w.rlike("^[A-Z]")) & ~F.exists(rest, lambda w: w.rlike("^[A-Z]") & F.array_contains(T.array(W.STOPWORDS), F.lower(w)))


def words_of(spark, stems) -> list[str]:
    """All words that have one of the ``stems``: suffix rules turned round, and what comes out held against ``text.stem``."""
    whole = {w for s in stems for w in (s, s + "e")}
    tried = whole | {w[: len(w) - len(new)] + suffix for w in whole for suffix, new in W.SUFFIXES if w.endswith(new)}
    if not tried:
        return []
    d = spark.createDataFrame([(w,) for w in sorted(tried)], "w string").select("w", T.stem(F.col("w")).alias("s"))
    return [r.w for r in d.collect() if r.s in stems]


def unattested_names(questions: DataFrame, corpus: DataFrame) -> DataFrame:
    """(qid, run) of capitalised runs none of whose neighbouring stems are neighbours in the corpus."""
    runs = questions.filter(case_informative(F.col("question"))).select("qid", F.posexplode(capitalised_runs(F.col("question"))).alias("n", "r"))
    pairs = runs.select("qid", "n", F.array_join("r", " ").alias("run"), F.explode(T.bigrams(F.transform("r", T.stem))).alias("pair"))
    words = words_of(pairs.sparkSession, {s for r in pairs.select("pair").distinct().collect() for s in r.pair.split(" ")})
    if not words:
        return runs.select("qid", F.array_join("r", " ").alias("run")).limit(0)
    tokens = T.once(corpus, t=T.tokenize(F.col("text")))
    beside = F.expr(f"filter(transform(t, (x, i) -> if({isin('x', words)} and {isin('get(t, i + 1)', words)}, struct(x as a, get(t, i + 1) as b), null)), x -> x is not null)")
    found = tokens.select(F.explode(F.array_distinct(beside)).alias("p")).distinct()
    known = found.select(F.concat_ws(" ", T.stem(F.col("p.a")), T.stem(F.col("p.b"))).alias("pair")).join(pairs.select("pair").distinct(), "pair", "left_semi").distinct()
    return pairs.join(known.withColumn("hit", F.lit(1)), "pair", "left").groupBy("qid", "n", "run").agg(F.max("hit").alias("hit")).filter("hit is null").select("qid", "run")


def anchors_of(questions: DataFrame) -> DataFrame:
    """(qid, n, stem): stems of a question's content in turn."""
    tokens = F.filter(T.content_words(F.col("question")), lambda w: ~w.isin(list(W.SCAFFOLD)))
    return questions.select("qid", F.posexplode(F.transform(tokens, T.stem)).alias("n", "stem"))


def anchor_frequency(corpus: DataFrame, questions: DataFrame | None = None) -> DataFrame:
    """(stem, df): in how many chunks of ``corpus`` (id, text) a stem or part of a token is; with ``questions``, of their anchors only, and only words that have those are stemmed."""
    if questions is not None:
        words = words_of(corpus.sparkSession, {r.stem for r in anchors_of(questions).select("stem").distinct().collect()})
        tokens = T.once(corpus, t=T.tokenize(F.col("text")))
        parts = "filter(flatten(transform(filter(t, x -> contains(x, '_')), x -> split(x, '_'))), p -> length(p) > 2)"
        found = tokens.select(F.expr(f"array_distinct(filter(concat(t, {parts}), x -> {isin('x', words)}))").alias("w"))
        return found.select(F.explode(F.array_distinct(F.transform("w", T.stem))).alias("stem")).groupBy("stem").agg(F.count("*").alias("df"))
    return corpus.select(F.explode(vocabulary(F.col("text"))).alias("stem")).groupBy("stem").agg(F.count("*").alias("df"))


def orphan_spans(questions: DataFrame, contexts: DataFrame, frequency: DataFrame, least: int = 2) -> DataFrame:
    """(qid, span): runs of at least ``least`` anchors of a question (qid, question), one of them an attribute, that the corpus has and its pivot chunk has not.

    The pivot is the context (qid, rank, text) whose vocabulary has most of the anchors, rare ones counting more, the
    first of equals. ``frequency`` is (stem, df) of the corpus.
    """
    anchors = anchors_of(questions).join(frequency, "stem", "left").na.fill(0, ["df"])
    vocab = contexts.select("qid", "rank", F.explode(vocabulary(F.col("text"))).alias("stem"))
    held = anchors.join(vocab, ["qid", "stem"])
    weight = contexts.select("qid", "rank").join(held.groupBy("qid", "rank").agg(F.sum(1 / (1 + F.col("df"))).alias("w")), ["qid", "rank"], "left")
    pivot = weight.groupBy("qid").agg(F.max_by("rank", F.struct(F.coalesce("w", F.lit(0.0)), -F.col("rank"))).alias("rank"))
    has = held.join(pivot, ["qid", "rank"]).select("qid", "n", F.lit(True).alias("has"))
    flags = anchors.join(pivot.select("qid"), "qid").join(has, ["qid", "n"], "left").groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("n", "stem", (F.col("has").isNull() & (F.col("df") >= 1)).alias("orphan")))).alias("a"))
    runs = F.split(F.array_join(F.transform("a", lambda x: F.when(x["orphan"], x["stem"]).otherwise("\n")), " "), "\n")
    words = F.transform(runs, lambda r: F.filter(F.split(r, " "), lambda w: w != ""))
    attributes = F.array_distinct(F.transform(T.array(ATTRIBUTES), T.stem))
    good = F.filter(words, lambda r: (F.size(r) >= least) & F.arrays_overlap(r, attributes))
    return flags.select("qid", F.explode(F.transform(good, lambda r: F.array_join(r, " "))).alias("span"))


def missing_anchors(questions: DataFrame, contexts: DataFrame, corpus: DataFrame) -> DataFrame:
    """(qid, detector, anchor): what questions name and the ``corpus`` (id, text), or for spans the contexts' pivot, doesn't have, by all four detectors."""
    q = questions.filter(F.trim("question") != "")
    found = [
        missing_identifiers(q, corpus).select("qid", F.lit("identifier").alias("detector"), F.concat_ws("-", "prefix", "digits").alias("anchor")),
        unattested_names(q, corpus).select("qid", F.lit("name_phrase"), F.col("run")),
        orphan_spans(q, contexts, anchor_frequency(corpus, q)).select("qid", F.lit("orphan_span"), F.col("span")),
        unattested_code(q, corpus).select("qid", F.lit("code_identifier"), F.col("token")),
    ]
    return found[0].union(found[1]).union(found[2]).union(found[3])


def support(sentence: Column, context: Column) -> Column:
    """0.65 of the sentence's content words in the context and 0.35 of their pairs (words alone without pairs)."""
    content = lambda x: T.content_words(x, W.SUPPORT_STOPWORDS, 1)

    def mixed(s: Column) -> Column:
        one = T.containment(s["a"], s["b"])
        both = lambda p: F.when(F.size(p) == 0, one).otherwise(0.65 * one + 0.35 * T.containment(p, T.bigrams(s["b"])))
        return F.when(F.size(s["a"]) == 0, 0.0).otherwise(T.let(F.array_distinct(T.bigrams(s["a"])), both))

    return T.let(F.struct(content(T.strip_markers(sentence)).alias("a"), content(context).alias("b")), mixed)


def groundedness(answers: DataFrame, contexts: DataFrame, cited: bool = False) -> DataFrame:
    """Per answer (aid, answer) the share of its sentences with content that one of its contexts (aid, context) supports: aid, total, supported, uncited, score.

    With ``cited`` contexts have a ``marker``, and a sentence with markers of some is held against those alone; sentences
    without are ``uncited`` and held against all. An answer that is the plain refusal scores 1.
    """
    s = answers.select("aid", F.posexplode(T.sentences(F.col("answer"))).alias("n", "s")).filter(F.size(T.content_words(T.strip_markers(F.col("s")), W.SUPPORT_STOPWORDS, 1)) > 0)
    marked = F.array_contains(T.markers(F.col("s")), F.col("marker")) if cited else F.lit(False)
    pairs = s.join(contexts, "aid", "left").withColumn("own", F.coalesce(marked, F.lit(False)))
    pairs = T.once(pairs, support=F.coalesce(support(F.col("s"), F.col("context")), F.lit(0.0)))
    best = pairs.groupBy("aid", "n").agg(F.max(F.when(F.col("own"), F.col("support"))).alias("mine"), F.max("support").alias("any"))
    good = (F.coalesce("mine", "any") >= SUPPORTED).cast("int")
    counts = best.groupBy("aid").agg(F.count("*").alias("total"), F.sum(good).cast("long").alias("supported"), F.count(F.when(F.col("mine").isNull(), 1)).alias("uncited"))
    every = answers.select("aid", "answer").join(counts, "aid", "left").na.fill(0, ["total", "supported", "uncited"])
    refused = F.lower(T.squeeze(F.col("answer"))) == F.lower(F.lit(REFUSAL))
    return every.select("aid", "total", "supported", "uncited", F.when(refused, 1.0).otherwise(F.round(T.ratio(F.col("supported"), F.col("total")), 4)).alias("score"))


def best_quote(df: DataFrame, text: str, focus: str, limit: int = 240, out: str = "quote") -> DataFrame:
    """``df`` with the sentence of ``text`` that covers the content of ``focus`` best, the first of equals."""
    content = lambda x: F.array_distinct(T.content_words(x, W.QUOTE_STOPWORDS, 1))
    d = df.withColumn("__s", T.sentences(F.col(text))).withColumn("__f", content(F.col(focus)))
    d = d.withColumn("__s", F.when(F.size("__s") == 0, F.array(F.col(text))).otherwise(F.col("__s")))
    scored = F.transform("__s", lambda s, i: F.struct(F.when(F.size(content(s)) == 0, F.lit(-1.0)).otherwise(T.containment(F.col("__f"), content(s)) + 0.25 * T.jaccard(F.col("__f"), content(s))).alias("v"), (-i).alias("i")))
    pick = F.when(F.size("__f") == 0, F.lit(0)).otherwise(-F.array_max(scored)["i"])
    return d.withColumn(out, T.truncate(T.squeeze(F.get("__s", pick)), limit)).drop("__s", "__f")


def answer_terms(question: Column) -> Column:
    return F.array_distinct(F.transform(T.content_words(question, W.ANSWER_STOPWORDS, 2), T.stem))


def answer_sentences(passages: DataFrame) -> DataFrame:
    """Sentences of passages (qid, question, rank, text) with the idf-weighted share of the question's terms: qid, rank, n, sentence, score.

    A term's weight is ln(1 + passages / (1 + those with it)), half of ln(1 + passages) if none has it.
    """
    p = passages.withColumn("__terms", answer_terms(F.col("question"))).withColumn("__v", F.array_distinct(T.stems(F.col("text"))))
    count = p.groupBy("qid").agg(F.count("*").alias("n_passages"))
    terms = p.select("qid", F.explode("__terms").alias("term")).distinct()
    df = p.select("qid", F.explode(F.array_intersect("__terms", "__v")).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("df"))
    weigh = terms.join(df, ["qid", "term"], "left").join(count, "qid").withColumn("w", F.when(F.col("df").isNull(), 0.5 * F.log(1 + F.col("n_passages"))).otherwise(F.log(1 + F.col("n_passages") / (1 + F.col("df")))))
    total = weigh.groupBy("qid").agg(F.sum("w").alias("total"))
    s = passages.select("qid", "rank", F.posexplode(T.sentences(F.col("text"))).alias("n", "sentence")).filter(~F.col("sentence").rlike(W.NOTHING_STATED))
    s = s.withColumn("stems", F.array_distinct(T.stems(F.col("sentence")))).filter(F.size("stems") > 0)
    got = s.select("qid", "rank", "n", F.explode("stems").alias("term")).join(weigh.select("qid", "term", "w"), ["qid", "term"]).groupBy("qid", "rank", "n").agg(F.sum("w").alias("w"))
    return s.join(got, ["qid", "rank", "n"], "left").join(total, "qid").select("qid", "rank", "n", "sentence", F.round(F.coalesce("w", F.lit(0.0)) / F.col("total"), 6).alias("score"))


def extractive_answers(passages: DataFrame, least: float = 0.28, share: float = 0.6, most: int = 3, alike: float = 0.75) -> DataFrame:
    """(qid, answer) of the best sentences with their passage's [rank], without near repeats; questions below ``least`` have none."""
    s = answer_sentences(passages)
    best = Window.partitionBy("qid")
    good = s.withColumn("best", F.max("score").over(best)).filter((F.col("score") >= least) & (F.col("score") >= share * F.col("best")))
    row = F.struct((-F.col("score")).alias("k"), "rank", "n", "sentence", F.array_distinct(T.stems(F.col("sentence"))).alias("stems"))
    lists = good.groupBy("qid").agg(F.sort_array(F.collect_list(row)).alias("rows"))  # sentences of one question's few passages
    near = lambda a, b: T.ratio(F.size(F.array_intersect(a, b)), F.least(F.size(a), F.size(b))) >= alike
    kept = F.aggregate("rows", F.expr("slice(rows, 1, 0)"), lambda acc, r: F.when((F.size(acc) >= most) | F.exists(acc, lambda k: near(k["stems"], r["stems"])), acc).otherwise(F.concat(acc, F.array(r))))
    body = lambda t: F.regexp_replace(F.regexp_replace(T.truncate(T.squeeze(t), 480), r"[.!?…]+$", ""), r"\s+$", "")
    return lists.select("qid", F.array_join(F.transform(kept, lambda r: F.concat(body(r["sentence"]), F.lit(" ["), r["rank"].cast("string"), F.lit("]."))), " ").alias("answer"))


def abstention_message(reason: Column, titles: Column, anchors: Column) -> Column:
    """What was missing, and where: ``titles`` and ``anchors`` are arrays; up to two of each are named."""
    seen = F.filter(F.array_distinct(titles), lambda t: t.isNotNull() & (t != ""))
    where = F.when((F.size(seen) == 0) | (F.size(seen) > 2), "the indexed documents").otherwise(F.array_join(seen, " or "))
    named = F.array_join(F.transform(F.slice(anchors, 1, 2), lambda a: F.concat(F.lit('"'), a, F.lit('"'))), " or ")
    return (
        F.when(reason == "empty_index", "No documents are indexed yet. Upload a file and ask again.")
        .when(reason == "no_results", "I could not find anything relevant in the indexed documents.")
        .when((reason == "anchor_missing") & (F.size(anchors) > 0), F.concat(F.lit("I could not find anything about "), named, F.lit(" in "), where, F.lit(".")))
        .when(reason == "money_slot_unfilled", F.concat(F.lit("I could not find a price for that in "), where, F.lit(".")))
        .otherwise(F.concat(F.lit("I could not find that in "), where, F.lit(".")))
    )
