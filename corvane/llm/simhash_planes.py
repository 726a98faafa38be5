"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints within ``RADIUS`` bits agree on all but two of eight 8-bit blocks, so each is put, by the 48 bits of any six
blocks, into 28 buckets. A bucket holds at most 2**16 different fingerprints whatever the data, and copies were merged
before, so no bucket needs a cap. In a bucket the fingerprints lie as vertical bit planes: the distances of all members to
the members ``d`` places on are counted together, plane by plane, in carry-save bit counters, and a block of lanes is
abandoned once all its distances exceed the radius.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as c
from .components import components

RADIUS, SHINGLE, SEED = 2, 3, 42
MASKS = [sum(0xFF << (8 * b) for b in kept) for kept in combinations(range(8), 6)]
_SIGNED = [m - (1 << 64) if m >> 63 else m for m in MASKS]
_FREE = [[b for b in range(64) if not m >> b & 1] for m in MASKS]
_MASK_ARRAY = np.array(MASKS, "u8")
LANES, CHUNK = 4096, 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the lower-cased (A-Z) words' shingles, repeats counted; 0 without a word."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), "i8", len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[:k].tolist(), (ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]).tolist())]
    counts = np.zeros(64, "i8")
    for at in range(0, k, 1 << 14):
        counts += np.unpackbits(np.array(hashes[at : at + (1 << 14)], "<u8").view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype="i8")
    return int(np.packbits(counts * 2 > k, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, keep: list[str] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` and ``__fp`` (long) of each row. Null texts are like empty ones: fingerprint 0."""
    from pyspark.sql.types import LongType, StructField, StructType

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            got = np.array([fingerprint(t, shingle) for t in c.text_column(batch, "__text")], "u8").view("i8")
            names = [n for n in batch.schema.names if n != "__text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(got, "int64")], [*names, "__fp"])

    chosen = docs.select(*(c.col(k) for k in keep), c.col("text").alias("__text"))
    return chosen.mapInArrow(c.without_vocabularies(run), StructType([*(f for f in chosen.schema.fields if f.name != "__text"), StructField("__fp", LongType())]))


def _lane_links(f: np.ndarray, t: np.ndarray, group: np.ndarray, radius: int = RADIUS):
    """Pairs of row numbers of one group whose fingerprints differ in at most ``radius`` bits. Rows lie group by group."""
    sizes = np.bincount(group)[group]
    keep = np.flatnonzero(sizes > 1)
    f, t, group, sizes = f[keep], t[keep], group[keep], sizes[keep]
    full = radius.bit_length()  # counters of so many bits, saturating at all ones or beyond the radius
    d = 1
    while len(f):
        alive_rows = np.flatnonzero(sizes > d)
        if len(alive_rows) < len(f) * 3 // 4 or not len(alive_rows):
            f, t, group, sizes, keep = f[alive_rows], t[alive_rows], group[alive_rows], sizes[alive_rows], keep[alive_rows]
            if not len(f):
                break
            planes = {}
        elif d == 1:
            planes = {}
        n = len(f)
        if d >= n:
            break
        same = group[:-d] == group[d:] if d < n else np.zeros(0, bool)
        for at in range(0, n - d, LANES):
            end = min(n - d, at + LANES)
            alive = int.from_bytes(np.packbits(same[at:end], bitorder="little").tobytes(), "little")
            if not alive:
                continue
            if at not in planes:
                planes[at] = {}
            counters = [0] * full
            for b in sorted({b for k in np.unique(t[at:end]) for b in _FREE[k]}):
                near = planes[at].get(b)
                if near is None:
                    near = planes[at][b] = int.from_bytes(np.packbits((f[at : at + LANES] >> np.uint64(b) & np.uint64(1)).astype("u1"), bitorder="little").tobytes(), "little")
                # the same plane, d lanes on: the rest of this block, then the start of those that follow
                far = _shifted(planes, f, b, at, d)
                carry = (near ^ far) & alive
                for i in range(full):
                    counters[i], carry = counters[i] ^ carry, counters[i] & carry
                over = carry | _above(counters, radius)
                alive &= ~over
                if not alive:
                    break
            if alive:
                bits = np.unpackbits(np.frombuffer(alive.to_bytes((end - at + 7) // 8, "little"), "u1"), bitorder="little")
                i = np.flatnonzero(bits) + at
                yield keep[i], keep[i + d]
        d += 1


def _shifted(planes: dict, f: np.ndarray, b: int, at: int, d: int) -> int:
    out, lane = 0, 0
    start = at + d
    while lane < LANES and start < len(f):
        block = start // LANES * LANES
        held = planes.setdefault(block, {})
        plane = held.get(b)
        if plane is None:
            plane = held[b] = int.from_bytes(np.packbits((f[block : block + LANES] >> np.uint64(b) & np.uint64(1)).astype("u1"), bitorder="little").tobytes(), "little")
        out |= (plane >> (start - block)) << lane
        step = block + LANES - start
        lane, start = lane + step, start + step
    return out & ((1 << LANES) - 1)


def _above(counters: list[int], radius: int) -> int:
    """Lanes whose counter is over ``radius``: compared from the top bit down."""
    over, equal = 0, -1
    for i in range(len(counters) - 1, -1, -1):
        if radius >> i & 1:
            equal &= counters[i]
        else:
            over |= equal & counters[i]
            equal &= ~counters[i]
    return over


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) between all different values of ``fps.__fp`` that differ in at most ``RADIUS`` bits, each once."""
    n = c.partitions(fps.sparkSession)
    masks = F.array(*map(F.lit, _SIGNED))
    rows = fps.select(F.explode(F.sequence(F.lit(0), F.lit(len(MASKS) - 1))).alias("t"), F.col("__fp").alias("f"))
    key = F.col("f").bitwiseAND(F.get(masks, F.col("t")))

    def run(batches):
        import pyarrow as pa

        def found(t, f):
            key = f & _MASK_ARRAY[t]
            group = np.cumsum(np.concatenate(([0], (key[1:] != key[:-1]) | (t[1:] != t[:-1]))).astype("i8"))
            for i, j in _lane_links(f, t, group):
                first = np.argmax((f[i] ^ f[j])[:, None] & _MASK_ARRAY == 0, axis=1)
                mine = first == t[i]  # of the buckets that both are in, the first one tells of them
                if mine.any():
                    yield pa.RecordBatch.from_arrays([pa.array(x[mine].view("i8"), "int64") for x in (f[i], f[j])], ["a", "b"])

        t, f = np.zeros(0, "i4"), np.zeros(0, "u8")
        for batch in batches:
            t = np.concatenate((t, batch.column("t").to_numpy(zero_copy_only=False)))
            f = np.concatenate((f, batch.column("f").to_numpy(zero_copy_only=False).view("u8")))
            if len(f) >= CHUNK:
                key = f & _MASK_ARRAY[t]
                new = np.flatnonzero((key[1:] != key[:-1]) | (t[1:] != t[:-1]))
                if len(new):
                    at = int(new[-1]) + 1
                    yield from found(t[:at], f[:at])
                    t, f = t[at:], f[at:]
        if len(f):
            yield from found(t, f)

    dealt = rows.repartition(n, "t", key).sortWithinPartitions("t", key, "f")
    return dealt.mapInArrow(c.without_vocabularies(run), "a long, b long")


def simhash_groups(docs: DataFrame, shingle: int = SHINGLE, keep: list[str] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, ``__fp``, ``__root`` (least signed fingerprint of the component) and ``__component`` (its least doc_id) of every row.

    Rows without words (null, empty or blank text) have fingerprint 0 and are linked like any other. A null doc_id is
    never a component's id unless all its rows have none: then it is null. Repeated rows stay, each in its component.
    """
    rows = c.staged(fingerprints(docs, shingle, keep), "fingerprints")
    fps = c.staged(rows.groupBy("__fp").agg(F.min("doc_id").alias("__least")), "fingerprint-values")
    linked = c.staged(components(links(fps)), "fingerprint-groups")
    ids = linked.join(fps, F.col("node") == F.col("__fp")).groupBy("root").agg(F.min("__least").alias("__first"))
    known = linked.join(ids, "root").select(F.col("node").alias("__fp"), "root", "__first")
    named = fps.join(known, "__fp", "left").select("__fp", F.coalesce("root", "__fp").alias("__root"), F.coalesce("__first", "__least").alias("__component"))
    return rows.join(c.staged(named, "fingerprint-names"), "__fp")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """Stage: the row of the least doc_id of each component (any one of equal rows), with the columns of ``docs``."""
    name = c.fresh(docs, "__row")[0]
    held = docs.withColumn(name, F.struct(c.col("doc_id").alias("doc_id"), F.xxhash64("text").alias("h"), F.xxhash64(*c.cols(docs)).alias("r")))
    chosen = simhash_groups(held.select("doc_id", "text", c.col(name)), keep=["doc_id", name])
    one = chosen.groupBy("__root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), F.col(f"{name}.doc_id").alias("doc_id"), F.col(f"{name}.h").alias("h"), F.col(f"{name}.r").alias("r"))).alias("k"))
    wanted = one.select(F.col("k.doc_id").alias("__i"), F.col("k.h").alias("__h"), F.col("k.r").alias("__r")).distinct()
    kept = held.join(wanted, held[name]["doc_id"].eqNullSafe(F.col("__i")) & (held[name]["h"] == F.col("__h")) & (held[name]["r"] == F.col("__r")), "left_semi")
    return kept.dropDuplicates([name]).select(*c.cols(docs))


def op4(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return simhash_groups(docs).select("doc_id", F.lower(F.lpad(F.hex("__fp"), 16, "0")).alias("fingerprint"), F.col("__component").alias("component_id"))
