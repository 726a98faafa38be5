"""Citations of answers: markers resolved to contexts, answers renumbered, contexts cut to a token budget, for batches of answers.

Answers are rows (aid, answer), contexts rows (aid, rank, id, doc_id, source, title, page, ordinal, text, score): marker n
is the context of rank n.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import guards

SHRINKS = 12  # tries to cut the first context, each to 0.7 of the one before


def focus(answers: DataFrame) -> DataFrame:
    """(aid, marker, focus): the first sentence that has a marker, without its markers."""
    s = answers.select("aid", F.posexplode(T.sentences(F.col("answer"))).alias("n", "s"))
    return s.select("aid", "n", "s", F.explode(T.markers(F.col("s"))).alias("marker")).groupBy("aid", "marker").agg(F.min_by(T.strip_markers(F.col("s")), "n").alias("focus"))


def resolved(answers: DataFrame, contexts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Citations (aid, marker, new_marker, id, doc_id, source, title, page, quote, score), numbered anew in the order of the answer, and markers without a context (aid, marker, place)."""
    asked = answers.select("aid", "answer", F.posexplode(T.markers(F.col("answer"))).alias("place", "marker"))
    found = asked.join(contexts, (asked["aid"] == contexts["aid"]) & (F.col("marker") == F.col("rank")), "left_semi")
    invalid = asked.join(contexts, (asked["aid"] == contexts["aid"]) & (F.col("marker") == F.col("rank")), "left_anti").select("aid", "marker", "place")
    numbered = found.withColumn("new_marker", F.row_number().over(Window.partitionBy("aid").orderBy("place")))
    full = numbered.join(contexts.withColumnRenamed("rank", "marker"), ["aid", "marker"]).join(focus(answers), ["aid", "marker"], "left")
    quoted = guards.best_quote(full.withColumn("focus", F.coalesce("focus", "answer")), "text", "focus")
    return quoted.select("aid", "marker", "new_marker", "id", "doc_id", "source", "title", "page", "quote", "score"), invalid


def rewritten(answer: Column, numbers: Column) -> Column:
    """``answer`` with its markers numbered by ``numbers`` (map<int,int>); others go, and only then blanks are put right. An empty map takes all markers out."""
    t = T.normalize_markers(answer)
    gaps, groups = F.split(t, T.MARKERS, -1), F.regexp_extract_all(t, F.lit(T.MARKERS), F.lit(1))
    new = F.transform(groups, lambda g: F.transform(F.split(g, r"\s*,\s*"), lambda x: F.try_element_at(numbers, x.cast("int"))))

    def put(made: Column) -> Column:
        kept = F.transform(made, lambda g: F.array_distinct(F.filter(g, lambda x: x.isNotNull())))
        names = F.transform(kept, lambda g: F.when(F.size(g) == 0, "").otherwise(F.concat(F.lit("["), F.array_join(F.transform(g, lambda x: x.cast("string")), ", "), F.lit("]"))))
        text = F.concat_ws("", F.flatten(F.zip_with(gaps, names, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))))
        return F.when(F.exists(made, lambda g: F.exists(g, lambda x: x.isNull())), T.tidy(text)).otherwise(text)

    return T.let(new, put)


def renumbered(answers: DataFrame, citations: DataFrame) -> DataFrame:
    """``answers`` with markers numbered as ``citations`` (aid, marker, new_marker) are, without those that have none."""
    numbers = citations.groupBy("aid").agg(F.map_from_entries(F.collect_list(F.struct("marker", "new_marker"))).alias("__numbers"))
    known = F.coalesce("__numbers", F.map_from_arrays(F.array().cast("array<int>"), F.array().cast("array<int>")))
    return answers.join(numbers, "aid", "left").withColumn("answer", rewritten(F.col("answer"), known)).drop("__numbers")


def within_budget(contexts: DataFrame, most: int) -> DataFrame:
    """The first contexts of each answer whose blocks fit ``most`` estimated tokens together, with ``block``, in rank order; a first one that doesn't fit alone is cut until it does, or goes."""
    by = Window.partitionBy("aid").orderBy("rank")
    head = lambda n: F.concat(F.lit("["), n.cast("string"), F.lit("] "), T.locator(F.col("title"), F.col("page"), F.col("ordinal")), F.lit(" :: "), F.col("source"), F.lit("\n"))
    body = F.regexp_replace("text", T.STRIP, "")
    d = T.once(contexts.withColumn("__n", F.row_number().over(by)), block=F.concat(head(F.col("__n")), body))
    so_far = F.sum(F.regexp_count("block", F.lit(T.COUNTED))).over(by.rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumn("__sum", so_far).withColumn("__fits", F.greatest(F.lit(1), F.round(F.col("__sum") * F.lit(1.32)).cast("int")) <= most)

    def shorter(s: Column, _: Column) -> Column:
        cut = F.concat(head(F.col("__n")), F.when(F.length(body) > s["n"], F.concat(F.regexp_replace(F.substring(body, F.lit(1), F.greatest(F.lit(0), s["n"] - 3)), r"(?U)\s+$", ""), F.lit("..."))).otherwise(body))
        fits = T.estimate_tokens(cut) <= most
        next_ = F.floor(s["n"] * F.lit(0.7)).cast("int")
        return F.when(s["done"], s).otherwise(F.struct(next_.alias("n"), (fits | (next_ <= 16)).alias("done"), F.when(fits, cut).alias("block")))

    tries = F.aggregate(F.sequence(F.lit(1), F.lit(SHRINKS)), F.struct(F.length(body).alias("n"), F.lit(False).alias("done"), F.lit(None).cast("string").alias("block")), shorter, lambda s: s["block"])
    d = d.withColumn("block", F.when(F.col("__fits"), F.col("block")).when(F.col("__n") == 1, tries)) if most > 0 else d.filter(F.lit(False))
    return d.filter("block is not null").drop("__n", "__sum", "__fits")


def citation_metrics(cited: DataFrame, relevant: DataFrame) -> DataFrame:
    """Per question of ``cited`` (qid, id): the share of its citations that are relevant (qid, id), and of what is relevant that it cites; 0 where there is nothing to count."""
    c, r = cited.select("qid", "id").distinct(), relevant.select("qid", "id").distinct()
    both = c.join(r.withColumn("hit", F.lit(1)), ["qid", "id"], "left").groupBy("qid").agg(F.count("*").alias("n"), F.count("hit").alias("hits"))
    n = both.join(r.groupBy("qid").agg(F.count("*").alias("n_rel")), "qid", "left")
    return n.select("qid", F.round(T.ratio(F.when(F.col("n_rel") > 0, F.col("hits")), F.col("n")), 6).alias("citation_precision"), F.round(T.ratio(F.col("hits"), F.col("n_rel")), 6).alias("citation_recall"))
