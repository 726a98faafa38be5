"""Near copies: SimHash candidates, an exact check of each, and an exact search for the links beyond SimHash's radius.

Texts are linked if the Jaccard similarity of their sets of 5-word shingles is 0.8 or more; there is no bound on bits, group
sizes or candidates. Shingles have one order, rare ones first: sets of such a similarity share one of the first fifth (and
one more) of the shingles of each, so each text is put into the buckets of those, and one alone in its buckets has no link.
Pairs are held against each other by their whole sets: first those that SimHash proposes (fingerprints of 5-word shingles,
compared as bit planes) and each member of a bucket with the one before it and the first one, which joins large groups by
few pairs; then, as a similarity of 0.8 can lie far outside the radius, all pairs of a bucket that aren't in one component yet.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _common as c
from . import simhash_planes
from .components import components

SHINGLE, SEED = 5, 42
NUM, DEN = 4, 5  # the similarity, as a fraction
SAMPLE, SAMPLED, COMMON = 16, 4000, 500_000  # for the order of shingles only, which changes no result
CHUNK = 1 << 16


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """The distinct hashes, ascending, of the shingles of the lower-cased (A-Z) words; of all words if there are fewer than ``size``."""
    import xxhash

    words = text.lower().split()
    if not words:
        return np.zeros(0, "u8")
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(b" ".join(words[i : i + size]), SEED) for i in range(max(1, len(words) - size + 1))], "u8"))


def _texts(docs: DataFrame) -> DataFrame:
    t = c.text_or_empty()
    return docs.select(_node().alias("node"), t.alias("text")).filter(t.rlike(r"[^\x20\x09-\x0D]"))


def _node():
    """A text's name: its hash, that of the empty text if it has no word."""
    t = c.text_or_empty()
    return F.when(t.rlike(r"[^\x20\x09-\x0D]"), F.xxhash64(t)).otherwise(F.xxhash64(F.lit("")))


def _common(texts: DataFrame) -> np.ndarray:
    """Shingles of several texts of a sample, the most common last."""
    share = min(1.0, max(1 / SAMPLE, SAMPLED / max(1, texts.count())))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            got = [shingles(t) for t in c.text_column(batch)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(got or [np.zeros(0, "u8")]).view("i8"), "int64")], ["h"])

    some = texts.filter(F.pmod(F.col("node"), F.lit(1 << 20)) < int(share * (1 << 20))).dropDuplicates(["node"]).select("text")
    top = some.mapInArrow(c.without_vocabularies(run), "h long").groupBy("h").agg(F.count("*").alias("k")).filter("k > 2").orderBy(F.desc("k"), "h").limit(COMMON)
    return np.array([r.h for r in top.collect()][::-1], "i8").view("u8")


def _entries(texts: DataFrame) -> DataFrame:
    """h, node, n (size of the set), i (place of h in it) of the first shingles of each text. Copies may repeat them."""
    common = _common(texts)
    by = np.argsort(common)
    common, rank = common[by], by + 1

    def run(batches):
        import pyarrow as pa

        seen = set()
        for batch in batches:
            out = []
            for node, text in zip(batch.column("node").to_pylist(), c.text_column(batch)):
                if node in seen:
                    continue
                seen.add(node)
                s = shingles(text)
                order = np.zeros(len(s), "i8")
                if len(common):
                    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
                    order = np.where(common[at] == s, rank[at], 0)
                n = len(s)
                first = s[np.argsort(order, kind="stable")][: n - -(-NUM * n // DEN) + 1]
                out.append((first, np.full(len(first), node, "i8"), np.full(len(first), n, "i4"), np.arange(len(first), dtype="i4")))
            if out:
                h, node, n, i = map(np.concatenate, zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(h.view("i8")), pa.array(node), pa.array(n), pa.array(i)], ["h", "node", "n", "i"])

    return texts.select("node", "text").mapInArrow(c.without_vocabularies(run), "h long, node long, n int, i int")


def _by_bucket(rows: DataFrame, names: list[str], found, schema: str) -> DataFrame:
    """``found`` (arrays of ``names`` to arrays of ``schema``) over whole buckets, whose rows lie by h, n and node."""

    def run(batches):
        import pyarrow as pa

        def batch_of(arrays):
            return pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], [x.split(" ")[0] for x in schema.split(", ")])

        held, size = [], 0
        for batch in batches:
            held.append([batch.column(x).to_numpy(zero_copy_only=False) for x in names])
            size += batch.num_rows
            if size >= CHUNK and held[-1][0][-1] != held[0][0][0]:
                all_ = [np.concatenate(x) for x in zip(*held)]
                at = int(np.flatnonzero(all_[0][1:] != all_[0][:-1])[-1]) + 1
                yield from map(batch_of, found(*(x[:at] for x in all_)))
                held, size = [[x[at:] for x in all_]], size - at
        if size:
            yield from map(batch_of, found(*(np.concatenate(x) for x in zip(*held))))

    # no number of partitions, so that adaptive execution puts small ones together: a staged file each costs more than their rows
    return rows.select(*names).repartition("h").sortWithinPartitions("h", "n", "node").mapInArrow(c.without_vocabularies(run), schema)


def _shared(h, node, n, i):
    """The rows of buckets with several texts, each once."""
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (node[1:] != node[:-1])))
    h, node, n, i = h[new], node[new], n[new], i[new]
    alike = h[1:] == h[:-1]
    keep = np.concatenate((alike, [False])) | np.concatenate(([False], alike))
    if keep.any():
        yield h[keep], node[keep], n[keep], i[keep]


def _apart(h, node, n, i, root):
    """Pairs of a bucket in different components whose sizes and places allow the similarity."""
    starts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    mixed = (np.minimum.reduceat(root, starts) != np.maximum.reduceat(root, starts)).tolist()
    ends = [*starts[1:].tolist(), len(h)]
    for a, b, several in zip(starts.tolist(), ends, mixed):
        for x in range(a, b - 1) if several else ():
            upto = a + int(np.searchsorted(n[a:b], n[x] * DEN // NUM, "right"))
            y = slice(x + 1, upto)
            most = np.minimum(n[x] - i[x], n[y] - i[y])
            fits = (root[y] != root[x]) & (most.astype("i8") * (NUM + DEN) >= (n[y].astype("i8") + n[x]) * NUM)
            other = node[y][fits]
            if len(other):
                yield np.minimum(other, node[x]), np.maximum(other, node[x])


def _joined(pieces):
    """Many small pieces as a few larger ones."""
    out, size = [], 0
    for p in pieces:
        out.append(p)
        size += len(p[0])
        if size >= CHUNK:
            yield tuple(map(np.concatenate, zip(*out)))
            out, size = [], 0
    if out:
        yield tuple(map(np.concatenate, zip(*out)))


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets have the similarity."""

    def run(batches):
        import pyarrow as pa

        sets: dict[int, np.ndarray] = {}

        def of(node, text):
            if node not in sets:
                if len(sets) >= 1000:
                    sets.clear()
                sets[node] = shingles(text)
            return sets[node]

        for batch in batches:
            a, b = (batch.column(x).to_pylist() for x in "ab")
            keep = []
            for x, y, s, t in zip(a, b, c.text_column(batch, "s"), c.text_column(batch, "t")):
                s, t = of(x, s), of(y, t)
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(DEN * both >= NUM * (len(s) + len(t) - both))
            got = [pa.array([x for x, k in zip(v, keep) if k], "int64") for v in (a, b)]
            yield pa.RecordBatch.from_arrays(got, ["a", "b"])

    s, t = texts.toDF("a", "s"), texts.toDF("b", "t")
    return pairs.distinct().join(s, "a").join(t, "b").select("a", "b", "s", "t").mapInArrow(c.without_vocabularies(run), "a long, b long")


def _proposed(texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of ``texts`` (node, text) by SimHash: each with the least of its fingerprint, and the least ones of fingerprints within the radius."""
    fps = c.staged(simhash_planes.fingerprints(texts, SHINGLE, ["node"]), "near-fingerprints")
    least = c.staged(fps.groupBy("__fp").agg(F.min("node").alias("least")), "near-fingerprint-values")
    same = fps.join(least, "__fp").filter("node <> least").select("least", "node")
    across = simhash_planes.links(least.select("__fp"))
    for end in "ab":
        across = across.join(least.toDF(end, f"node_{end}"), end)
    both = same.toDF("x", "y").union(across.select("node_a", "node_b"))
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def links(docs: DataFrame) -> DataFrame:
    """(node, root) of the texts that are linked to others, over all pairs of the similarity or more, and th2, a second hash of the node's text."""
    texts = _texts(docs)
    shared = c.staged(_by_bucket(_entries(texts), ["h", "node", "n", "i"], _shared, "h long, node long, n int, i int"), "shingle-buckets")
    texts = c.staged(texts.join(shared.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min("text").alias("text")), "shingle-texts")
    w = Window.partitionBy("h").orderBy("n", "node")
    near = shared.select("node", "n", F.struct("node", "n").alias("me"), F.lag(F.struct("node", "n")).over(w).alias("p"), F.first(F.struct("node", "n")).over(w).alias("f"))
    near = near.select("node", "n", F.explode(F.array("p", "f")).alias("o")).filter(F.col("o").isNotNull() & (F.col("o.node") != F.col("node")) & (F.col("o.n") * DEN >= F.col("n") * NUM))
    near = near.select(F.least("node", "o.node").alias("a"), F.greatest("node", "o.node").alias("b"))
    edges = c.staged(_verified(near.union(_proposed(texts)), texts), "near-edges")
    roots = c.staged(components(edges), "near-groups")
    apart = shared.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    apart = _by_bucket(apart, ["h", "node", "n", "i", "root"], lambda *x: _joined(_apart(*x)), "a long, b long").distinct()
    apart = c.staged(_verified(apart.join(edges, ["a", "b"], "left_anti"), texts), "apart-edges")
    roots = roots if apart.isEmpty() else c.staged(components(edges.union(apart)), "near-groups")
    return roots.join(texts.select("node", F.xxhash64("text", F.lit(1)).alias("th2")), "node")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """Stage: the row of the least doc_id of each group of linked texts (any one of equal rows), with the columns of ``docs``. Texts without words are alike."""
    row, node, second = c.fresh(docs, "__row", "__node", "__th2")
    t = c.text_or_empty()
    held = docs.withColumns({row: F.struct(c.col("doc_id").isNull().alias("n"), c.col("doc_id").alias("doc_id"), F.xxhash64("text").alias("h"), F.xxhash64(*c.cols(docs)).alias("r")), node: _node(), second: F.when(t.rlike(r"[^\x20\x09-\x0D]"), F.xxhash64(t, F.lit(1)))})
    # another text with the hash of a linked one isn't that text: it is a group by itself
    known = links(docs).toDF(node, "__root", second)
    groups = held.select(row, node, second).join(known, [node, second], "left").select(row, F.coalesce("__root", node).alias("g"), F.when(F.col("__root").isNull(), F.col(second)).alias("own"))
    one = groups.groupBy("g", "own").agg(F.min(row).alias("k"))
    wanted = one.select(F.col("k.doc_id").alias("__i"), F.col("k.h").alias("__h"), F.col("k.r").alias("__r")).distinct()
    kept = held.join(wanted, held[row]["doc_id"].eqNullSafe(F.col("__i")) & (held[row]["h"] == F.col("__h")) & (held[row]["r"] == F.col("__r")), "left_semi")
    return kept.dropDuplicates([row]).select(*c.cols(docs))
