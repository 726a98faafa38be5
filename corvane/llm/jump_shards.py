"""Sharding by jump consistent hashing (Lamping and Veach, 2014), in column arithmetic.

A key jumps from bucket to bucket with a linear congruential generator until it would leave the range; the last bucket
is its shard. One more shard takes rows only into itself, about one in so many, and no table of a ring is kept. The
64-bit products are decimals of at most 38 digits, so nothing wraps or overflows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _common as c

SHARDS, MULTIPLIER, LONGEST = 8, 2862933555777941757, 256


def jump_shard(key: Column, shards: int) -> Column:
    """Shard (int, from 0) of a long key, null for null. Exact for any number of shards: a key that needs more than ``LONGEST`` jumps (expected: ln(shards)) raises instead of going to a wrong one."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    two64 = F.lit(str(1 << 64)).cast("decimal(20,0)")
    start = key.cast("decimal(20,0)")
    start = F.when(start < 0, (start + two64).cast("decimal(20,0)")).otherwise(start)
    state = F.struct(start.alias("k"), F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))

    def jump(s: Column, _: Column) -> Column:
        k = ((s["k"] * F.lit(str(MULTIPLIER)).cast("decimal(19,0)") + F.lit(1).cast("decimal(1,0)")) % two64).cast("decimal(20,0)")
        high = F.floor(k / F.lit(1 << 33).cast("decimal(10,0)")).cast("long")
        j = F.floor((s["j"] + 1).cast("double") * (F.lit(2147483648.0) / (high + 1).cast("double"))).cast("long")
        return F.when(s["j"] < shards, F.struct(k.alias("k"), s["j"].alias("b"), j.alias("j"))).otherwise(s)

    done = F.aggregate(F.sequence(F.lit(1), F.lit(min(shards, LONGEST))), state, jump, lambda s: F.when(s["j"] >= shards, s["b"]))
    return F.when(key.isNotNull(), F.coalesce(done, F.raise_error(F.lit("jump hash did not end")).cast("long"))).cast("int")


NAMES = ("size", "text_crc32", "shard", "slot", "grown_shard")


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> tuple[DataFrame, list[str]]:
    """``docs`` with its size, text_crc32, shard, slot and grown_shard (with one shard more), and the names of these five columns, which differ from those of ``docs``.

    A document's shard depends on doc_id and the number of shards alone, so rows of one doc_id are in one shard; a null
    doc_id counts as 0. Null texts have size 1 and crc32 0. Slots count from 0 in each shard without a gap, for equal
    rows in any order: a shard is divided by a hash of doc_id and text into as many parts as there are shuffle
    partitions, numbered within and one after the other, so no task holds a shard, nor all null doc_ids. Part sizes come
    from a scan before; their table (shards * partitions rows) is broadcast.
    """
    from pyspark.sql import Window

    size, crc, shard, slot, grown, key, part, before, hash_ = names = c.fresh(docs, *NAMES, "key", "part", "before", "hash")
    n = c.partitions(docs.sparkSession)
    t = c.text_or_empty()
    rows = docs.withColumns({key: F.coalesce(c.col("doc_id").cast("long"), F.lit(0).cast("long")), hash_: F.xxhash64(t)})
    rows = rows.withColumns({shard: jump_shard(F.col(key), shards), part: F.pmod(F.xxhash64(key, hash_), F.lit(n)).cast("int")})
    sizes = rows.groupBy(shard, part).agg(F.count("*").alias("n"))
    starts = sizes.select(shard, part, (F.sum("n").over(Window.partitionBy(shard).orderBy(part)) - F.col("n")).alias(before))
    full = rows.withColumns({size: (F.octet_length(t) + 1).cast("long"), crc: F.crc32(F.encode(t, "UTF-8")), grown: jump_shard(F.col(key), shards + 1)}).join(F.broadcast(starts), [shard, part])
    order = Window.partitionBy(shard, part).orderBy(key, hash_, size)
    return full.withColumn(slot, F.col(before) + F.row_number().over(order) - 1).select(*c.cols(docs), *names[:5]), names[:5]


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Write the rows of ``docs`` and their slots into ``path``, a folder ``shard=k`` (or the like, if there is such a column) for each shard, in as many files as tasks."""
    rows, (_, _, shard, slot, _) = shard_documents(docs, shards)
    rows.select(*c.cols(docs), shard, slot).write.mode("overwrite").partitionBy(shard).parquet(path)


def op3(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for every document, by the law ``key``; nulls and repeated rows as in ``shard_documents``; an empty table gives no rows."""
    rows, names = shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return rows.select("doc_id", *names[:2], F.lit("key").alias("law"), *names[2:])
