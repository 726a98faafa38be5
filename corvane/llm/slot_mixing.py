"""Mixing sources to target weights with a low-discrepancy schedule of equal-token blocks.

The van der Corput point of slot time ``t`` (its bits reversed) falls into one source's interval of the cumulative
target shares, so every stretch of time holds each source in its proportion. A source's slots, ranked by time, take the
blocks of its shuffled documents one after the other, again from the start when all are used. As the points of an
interval are consecutive numbers, each source lists its own slots: no slot is joined to sources by range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _common as c

BLOCK, WEIGHTS, REPEATS = 1024, (1, 2, 3), 3


def _running(df: DataFrame, group: list[str], bucket: str, order: list[str], value: Column, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows before each in its group, by (bucket, order): sums of buckets first, then within each."""
    sums = df.groupBy(*group, bucket).agg(F.sum(value).alias("__sum"))
    before = sums.select(*group, bucket, (F.sum("__sum").over(Window.partitionBy(*group).orderBy(bucket)) - F.col("__sum")).alias("__before"))
    inside = F.sum(value).over(Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn(name, F.coalesce(inside, F.lit(0))).join(before, [*group, bucket]).withColumn(name, F.col(name) + F.col("__before")).drop("__before")


def _targets(sources: DataFrame, weights: tuple[float, ...], repeats: int) -> DataFrame:
    """Rows (s, source_size) with rank, weight and target: weights go round by rank; targets stop at ``repeats`` times the size, and the excess goes to the others by weight. Each round is one sum."""
    n = c.partitions(sources.sparkSession)
    ranged = c.staged(sources.repartitionByRange(n, "s").withColumn("part", F.spark_partition_id()), "mix-sources")
    ranked = _rank(ranged)
    table = c.staged(ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))).withColumn("cap", F.col("source_size") * repeats), "mix-weights")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    capped = F.col("source_size") == 0
    while total:
        got = table.agg(F.sum(F.when(capped, F.col("cap")).otherwise(0)), F.sum(F.when(capped, F.lit(0.0)).otherwise(F.col("weight"))), F.count(F.when(capped, 1))).first()
        if got[2] == full or not got[1]:
            break
        full, level = got[2], (total - got[0]) / got[1]
        capped = F.col("cap") <= F.col("weight") * F.lit(level)
    return table.withColumn("target", F.when(capped, F.col("cap").cast("double")).otherwise(F.col("weight") * F.lit(level)))


def _rank(ranged: DataFrame) -> DataFrame:
    """Rank from 0 by ``s`` of rows that lie in ascending parts; what is broadcast has a row per part."""
    counts = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy("s")) - 1
    return ranged.withColumn("i", inside).join(F.broadcast(before), "part").withColumn("rank", F.col("i") + F.col("before")).drop("i", "before", "part")


def _schedule(sources: DataFrame, block: int, n: int) -> DataFrame:
    """(s, block, t, words) of every slot that is used: its time and how many words of the block it takes."""
    total = sources.agg(F.sum("target")).first()[0] or 0.0
    bits = max(0, (max(1, int(-(-total // block))) - 1).bit_length())
    slots = 1 << bits
    share = sources.withColumn("bucket", F.pmod(F.xxhash64("s"), F.lit(n)))
    # where the intervals lie in [0, 1) may be any order of sources; that of a hash needs no sort of all of them
    lows = _running(share.withColumn("one", F.lit(1)), ["one"], "bucket", ["s"], F.col("target"), "low").drop("one", "bucket")
    x = lambda v: F.ceil(F.least(F.lit(1.0), v / F.lit(total or 1.0)) * F.lit(float(slots))).cast("long")
    s = lows.withColumns({"from": x(F.col("low")), "to": x(F.col("low") + F.col("target")), "wanted": F.round("target").cast("long"), "blocks": F.ceil(F.col("source_size") / block).cast("long")})
    rest = F.col("wanted") % F.col("source_size")
    s = s.filter("wanted > 0").withColumn("needed", F.floor(F.col("wanted") / F.col("source_size")) * F.col("blocks") + F.ceil(rest / block)).withColumn("points", F.greatest(F.col("to") - F.col("from"), F.lit(0)))
    # runs of at most 65536 points, so that a large source's slots are made by many tasks
    run = 1 << 16
    own = s.filter("points > 0").withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("points") - 1) / run)))).repartition(n, "s", "run")
    own = own.withColumn("x", F.explode(F.sequence(F.col("from") + F.col("run") * run, F.least(F.col("to"), F.col("from") + (F.col("run") + 1) * run) - 1)))
    t = F.expr(f"cast(conv(substring(reverse(lpad(conv(x, 10, 2), {max(bits, 1)}, '0')), 1, {max(bits, 1)}), 2, 10) as bigint)")
    own = own.select("s", "source_size", "wanted", "blocks", "needed", t.alias("t"))
    extra = s.filter("points < needed").withColumn("t", F.explode(F.sequence(F.lit(slots) + 0 * F.col("needed"), F.lit(slots) + F.col("needed") - F.col("points") - 1))).select("s", "source_size", "wanted", "blocks", "needed", "t")
    every = own.unionByName(extra).withColumn("bucket", F.floor(F.col("t") * n / F.lit(slots)).cast("long"))
    ranked = _running(every, ["s"], "bucket", ["t"], F.lit(1), "r").filter("r < needed")
    epoch, place = F.floor(F.col("r") / F.col("blocks")), F.col("r") % F.col("blocks")
    words = F.least(F.lit(block), F.col("source_size") - place * block, F.col("wanted") - epoch * F.col("source_size") - place * block)
    return ranked.select("s", place.alias("block"), "t", words.alias("words"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, repeats: int = REPEATS, block: int = BLOCK, size: Column | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, source): doc_id, source, size, source_size, target, taken, first_slot and h and h2, hashes of the row.

    ``size`` is a document's tokens (default: words). A source takes its target, rounded, to the word; a row is taken as
    often as its source is gone through, so never more than ``repeats`` times its size. ``first_slot`` is the first time
    at which part of it is taken (null: never). Order, ties and repeated rows are settled by hashes, so reruns agree.
    A null source is a source, last in order; null and empty texts have size 0 and are not taken.
    """
    n = c.partitions(docs.sparkSession)
    own = docs.select(c.col("doc_id").cast("long").alias("doc_id"), c.col("source").cast("string").alias("source"), (c.n_words(c.col("text")) if size is None else size).cast("long").alias("size"), F.xxhash64(*c.cols(docs)).alias("h"), _second(docs).alias("h2"))
    own = c.staged(own.withColumn("s", F.when(F.col("source").isNull(), "1").otherwise(F.concat(F.lit("0"), "source"))).withColumn("order", F.xxhash64("doc_id", "h", F.lit("mix"))).withColumn("bucket", F.pmod("order", F.lit(n))), "mix-sizes")
    sources = c.staged(_targets(own.groupBy("s").agg(F.sum("size").alias("source_size")), weights, repeats).select("s", "source_size", "target"), "mix-targets")
    placed = c.staged(_running(own, ["s"], "bucket", ["order", "doc_id", "h", "h2", "size"], F.col("size"), "start"), "mix-places")
    slots = _schedule(sources, block, n)
    takes = slots.groupBy("s", "block").agg(F.sort_array(F.collect_list("words")).alias("takes"), F.min("t").alias("t"))  # at most `repeats` + 1 each
    pieces = placed.filter("size > 0").withColumn("block", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")))
    pieces = pieces.withColumn("from", F.greatest(F.col("start") - F.col("block") * block, F.lit(0))).withColumn("to", F.least(F.col("start") + F.col("size") - F.col("block") * block, F.lit(block)))
    joined = pieces.join(takes, ["s", "block"])
    got = F.aggregate("takes", F.lit(0).cast("long"), lambda a, w: a + F.greatest(F.lit(0), F.least("to", w) - F.col("from")))
    taken = joined.withColumn("got", got).filter("got > 0").groupBy("s", "start").agg(F.sum("got").alias("taken"), F.min("t").alias("first_slot"))
    rows = placed.filter("size > 0").join(taken, ["s", "start"], "left").unionByName(placed.filter("size = 0").withColumns({"taken": F.lit(None).cast("long"), "first_slot": F.lit(None).cast("long")}))
    return rows.join(sources, "s").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"), "first_slot", "h", "h2")


def _second(docs: DataFrame) -> Column:
    """Another hash of the row: two together tell any number of rows apart."""
    return F.xxhash64(*c.cols(docs), F.lit(1))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """Stage: each row as many times as the mix takes it, with the columns of ``docs``. A source's last, partly taken row counts if at least half of it is taken."""
    plan = mix(docs, **options).withColumn("copies", F.floor((2 * F.col("taken") + F.col("size")) / (2 * F.col("size"))).cast("int")).filter("size > 0 and copies > 0")
    h, h2, k = c.fresh(docs, "__h", "__h2", "__copies")
    wanted = plan.groupBy("h", "h2").agg(F.sum("copies").cast("int").alias(k)).withColumnsRenamed({"h": h, "h2": h2})
    rows = docs.withColumns({h: F.xxhash64(*c.cols(docs)), h2: _second(docs)}).join(wanted, [h, h2])
    # equal rows are interchangeable: one stands for all, with the copies of all
    return rows.dropDuplicates([h, h2]).withColumn(k, F.explode(F.sequence(F.lit(1), c.col(k)))).select(*c.cols(docs))


def op9(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for every document, with the first slot; nulls, ties and repeated rows as in ``mix``; an empty table gives no rows."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken", "first_slot")
