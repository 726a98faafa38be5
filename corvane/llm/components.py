"""Connected components of an edge table, by alternating large-star and small-star steps.

Both steps keep connectivity and end with every node linked to the smallest of its component. A step is a minimum per
node (combined before its shuffle) joined back to the edges; a node with very many edges is a skewed join key, which
adaptive execution splits, never a group in one task. Steps are staged in the shared folder, so no lineage grows and
nothing goes to the driver but a count and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as c


def _minima(sym: DataFrame) -> DataFrame:
    return sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    sym = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    return sym.filter("v > u").join(_minima(sym), "u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    joined = down.join(_minima(down), "u")
    return joined.select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a long, b long): root is the least node that it reaches, itself included.

    Loops and repeated edges are harmless; edges with a null end are left out; no edges give no rows.
    """
    clean = lambda e: e.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, mark = c.staged(clean(edges), "edges"), None
    while True:
        now = c.staged(clean(_small_star(clean(_large_star(now)))), "stars")
        seen = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum((F.xxhash64("a", "b") % 1000003).cast("long"))).first()
        if seen == mark:
            break
        mark = seen
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
