"""Token-ID output: patched frame-of-reference (PFOR) blocks in ascending document order.

A *segment* is a byte string that stands alone: a header, an index of block starts, per block its minimum, packed width
and number of exceptions, then the packed blocks and the exception lists. A block holds ``block`` ids (the last of a
segment fewer): each less the block's minimum, packed at the width that holds the ``quantile`` of them; larger ones go
to the exception list as (position, whole difference). Segments are rows of a Parquet table, whose committer copes with
lost tasks; next to the payload a row has its documents and their lengths.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as c

MAGIC = b"PFR1"
BLOCK, QUANTILE, SEGMENT_IDS, END_ID = 256, 0.95, 1 << 18, 2


def _widths(x: np.ndarray) -> np.ndarray:
    """Bits that each number needs, 0 for 0."""
    return np.where(x > 0, np.floor(np.log2(np.maximum(x, 1).astype("f8"))).astype("i8") + 1, 0)


def _pack(low: np.ndarray, width: int) -> np.ndarray:
    """Rows of numbers under 2**width to rows of bytes, most significant bit first."""
    bits = np.unpackbits(low.astype(">u4").view("u1").reshape(len(low), -1, 4), axis=2)[:, :, 32 - width :]
    return np.packbits(bits.reshape(len(low), -1), axis=1)


def _unpack(rows: np.ndarray, width: int, n: int) -> np.ndarray:
    bits = np.zeros((len(rows), n, 32), "u1")
    bits[:, :, 32 - width :] = np.unpackbits(rows, axis=1)[:, : n * width].reshape(len(rows), n, width)
    return np.packbits(bits.reshape(len(rows), -1), axis=1).view(">u4").astype("u4")


def encode_segment(ids: np.ndarray, block: int = BLOCK, quantile: float = QUANTILE) -> bytes:
    """Ids (unsigned, 32 bits) to a segment. ``decode_segment`` gives them back exactly, none included."""
    ids = np.ascontiguousarray(ids, "<u4")
    n, nb = len(ids), -(-len(ids) // block)
    full = np.zeros(nb * block, "<u4")
    full[:n] = ids
    if n % block:
        full[n:] = ids[n - n % block :].min()
    full = full.reshape(nb, block)
    lows = full.min(axis=1) if nb else np.zeros(0, "<u4")
    rest = full - lows[:, None]
    at = min(block - 1, int(quantile * block))
    widths = _widths(np.partition(rest, at, axis=1)[:, at]) if nb else np.zeros(0, "i8")
    over = _widths(rest) > widths[:, None]
    counts = over.sum(axis=1)
    starts = np.zeros(nb + 1, "<u4")
    np.cumsum((block * widths + 7) // 8, out=starts[1:])
    packed = np.zeros(int(starts[-1]), "u1")
    for w in np.unique(widths[widths > 0]):
        rows = np.flatnonzero(widths == w)
        got = _pack(rest[rows] & np.uint32((1 << int(w)) - 1), int(w))
        packed[(starts[rows].astype("i8")[:, None] + np.arange(got.shape[1])).ravel()] = got.ravel()
    b, p = np.nonzero(over)
    return b"".join((struct.pack("<4sIII", MAGIC, n, block, nb), starts.tobytes(), lows.astype("<u4").tobytes(), widths.astype("u1").tobytes(), counts.astype("<u4").tobytes(), packed.tobytes(), p.astype("<u4").tobytes(), rest[b, p].astype("<u4").tobytes()))


def decode_segment(data: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids of blocks ``first`` to ``last`` (exclusive; None: to the end); the index makes any block readable alone."""
    magic, n, block, nb = struct.unpack_from("<4sIII", data)
    if magic != MAGIC:
        raise ValueError("not a PFOR segment")
    at, parts = 16, []
    for kind, k in (("<u4", nb + 1), ("<u4", nb), ("u1", nb), ("<u4", nb)):
        parts.append(np.frombuffer(data, kind, k, at))
        at += parts[-1].nbytes
    starts, lows, widths, counts = parts
    exc = np.zeros(nb + 1, "i8")
    np.cumsum(counts, out=exc[1:])
    packed = np.frombuffer(data, "u1", int(starts[-1]), at)
    where = np.frombuffer(data, "<u4", int(exc[-1]), at + len(packed))
    what = np.frombuffer(data, "<u4", int(exc[-1]), at + len(packed) + where.nbytes)
    last = nb if last is None else min(last, nb)
    out = np.zeros((max(0, last - first), block), "u4")
    for w in np.unique(widths[first:last]):
        rows = first + np.flatnonzero(widths[first:last] == w)
        if w:
            size = (block * int(w) + 7) // 8
            out[rows - first] = _unpack(packed[starts[rows].astype("i8")[:, None] + np.arange(size)], int(w), block)
    b = np.repeat(np.arange(nb), counts)
    some = (b >= first) & (b < last)
    out[b[some] - first, where[some]] = what[some]
    out += lows[first:last, None]
    return out.ravel()[: max(0, min(n, last * block) - first * block)]


SEGMENTS = "part int, seg int, start_in_part long, n_ids long, doc_ids array<long>, doc_lens array<long>, payload binary"


def write_token_blocks(docs: DataFrame, vocabulary: str, end_id: int | None = END_ID) -> DataFrame:
    """Tokenize ``docs`` (doc_id, text), put them in ascending doc_id order and write their segments to the shared folder.

    Null text: empty. Null doc_ids come first, rows of equal doc_id in the order of their texts, repeated rows each for
    itself. Other columns are not read. Returns the table of segments; ``start_in_part`` counts the ids before a segment
    in its part, and parts follow each other. One range shuffle of (doc_id, text); a task holds a segment's ids only.
    """
    n = c.partitions(docs.sparkSession)
    ordered = docs.select(c.col("doc_id").cast("long").alias("doc_id"), c.text_or_empty().alias("text")).repartitionByRange(n, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")

    def encode(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, ids_of = TaskContext.get().partitionId(), c.word_ids(vocabulary)
        names = [x.split()[0] for x in SEGMENTS.split(", ")]
        seg, before, docs_, lens, held, size = 0, 0, [], [], [], 0

        def row():
            ids = np.concatenate(held)
            return pa.RecordBatch.from_arrays([pa.array([part], "int32"), pa.array([seg], "int32"), pa.array([before], "int64"), pa.array([len(ids)], "int64"), pa.array([docs_], pa.list_(pa.int64())), pa.array([lens], pa.list_(pa.int64())), pa.array([encode_segment(ids)], pa.binary())], names)

        for batch in batches:
            for doc, got in zip(batch.column("doc_id").to_pylist(), ids_of.documents(batch.column("text"), end_id)):
                docs_.append(doc)
                lens.append(len(got))
                held.append(got)
                size += len(got)
                if size >= SEGMENT_IDS:
                    yield row()
                    seg, before, docs_, lens, held, size = seg + 1, before + size, [], [], [], 0
        if docs_:
            yield row()

    return c.staged(ordered.mapInArrow(encode, SEGMENTS), "token-blocks")


def read_token_blocks(segments: DataFrame) -> DataFrame:
    """Decode segments: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and the ids' bytes' source part.

    What is broadcast has one row per part, and the number of parts is ``spark.sql.shuffle.partitions``.
    """
    from pyspark.sql import Window

    def decode(batches):
        import pyarrow as pa

        for batch in batches:
            for part, before, docs_, lens, data in zip(*(batch.column(x).to_pylist() for x in ("part", "start_in_part", "doc_ids", "doc_lens", "payload"))):
                ids = decode_segment(data).astype("<u4").tobytes()
                ends = np.cumsum(lens)
                crcs = [zlib.crc32(ids[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), lens)]
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(lens), "int32"), pa.array(docs_, "int64"), pa.array(before + ends - np.array(lens, "i8"), "int64"), pa.array(lens, "int64"), pa.array(crcs, "int64")], ["part", "doc_id", "start_in_part", "n_tokens", "ids_crc32"])

    totals = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    base = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    got = segments.select("part", "start_in_part", "doc_ids", "doc_lens", "payload").mapInArrow(decode, "part int, doc_id long, start_in_part long, n_tokens long, ids_crc32 long")
    return got.join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32")


def op1(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_token_blocks(write_token_blocks(docs, c.public_vocabulary()))
