"""Packing along a space-filling curve: documents with like words are neighbours in the training sequences.

A document's hashed vector (its token ids through a fixed random projection, averaged) has a few dimensions; its cell on
a grid gives a Hilbert key. Documents are range-sorted by key, and each range is cut into full sequences one after the
other. What is left at the end of a range goes into sequences whose lengths are powers of two, so nothing is padded.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as c

LENGTH, DIMS, BITS, SEED, END_ID = 4096, 3, 10, 20240517, 2


def projection(size: int = 1 << 16, dims: int = DIMS, seed: int = SEED) -> np.ndarray:
    """A direction of each id: hashed, so the same everywhere."""
    x = (np.arange(size * dims, dtype="u8") + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    for shift, mul in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(mul)
    x ^= x >> np.uint64(31)
    return (x.astype("f8") / 2.0**63 - 1.0).reshape(size, dims).astype("f4")


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert index of each row of grid coordinates (n, dims), dims * bits of at most 63 bits.

    Coordinates are turned into the curve's transposed index by undoing its rotations from the top bit down, then
    Gray-decoded, and the bits of all dimensions are interleaved.
    """
    x = [cells[:, i].astype("i8") for i in range(cells.shape[1])]
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0]) ^ swap
            if i:
                x[i] = x[i] ^ swap
        q >>= 1
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where((x[-1] & q) != 0, turn ^ (q - 1), turn)
        q >>= 1
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for v in x:
            key = (key << 1) | (((v ^ turn) >> b) & 1)
    return key


def vectors(ids: list[np.ndarray], directions: np.ndarray) -> np.ndarray:
    """Mean direction of each document's ids, spread as if all ids were independent; zeros for none."""
    lens = np.fromiter((len(x) for x in ids), "i8", len(ids))
    out = np.zeros((len(ids), directions.shape[1]))
    if lens.sum():
        flat = np.concatenate(ids) & np.uint32(len(directions) - 1)
        some = np.flatnonzero(lens)
        starts = (np.cumsum(lens) - lens)[some]
        for d in range(directions.shape[1]):
            out[some, d] = np.add.reduceat(directions[flat, d].astype("f8"), starts) / lens[some]
    return out


def cells_of(vecs: np.ndarray, bits: int = BITS, scale: float = 12.0) -> np.ndarray:
    """Grid cells; arctan spreads the middle, where most documents are, and has no bounds to fit."""
    return np.clip(((np.arctan(vecs * scale) / np.pi + 0.5) * (1 << bits)).astype("i8"), 0, (1 << bits) - 1)


def token_table(docs: DataFrame, vocabulary: str, end_id: int | None = END_ID, keep: list[str] = ()) -> DataFrame:
    """doc_id, curve key, ids (little-endian, 16 bits where the vocabulary allows) of each row of ``docs``, staged once, so that sorting doesn't tokenize again. ``keep``: further columns."""

    def encode(batches):
        import pyarrow as pa

        ids_of, directions = c.word_ids(vocabulary), projection()
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                ids = list(ids_of.documents(batch.column("__text").slice(at, 2000), end_id))
                keys = hilbert_keys(cells_of(vectors(ids, directions)))
                part = batch.slice(at, 2000)
                rest = [part.column(i) for i, n in enumerate(part.schema.names) if n != "__text"]
                wide = any(len(x) and int(x.max()) >= 1 << 16 for x in ids)
                data = [(b"\x04" + x.tobytes()) if wide else (b"\x02" + x.astype("<u2").tobytes()) for x in ids]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(keys, "int64"), pa.array(data, pa.binary())], [*(n for n in part.schema.names if n != "__text"), "__key", "__ids"])

    chosen = docs.select(c.col("doc_id").cast("long").alias("doc_id"), *(c.col(k) for k in keep), c.text_or_empty().alias("__text"))
    kinds = [f for f in chosen.schema.fields if f.name != "__text"]
    from pyspark.sql.types import BinaryType, LongType, StructField, StructType

    return c.staged(chosen.mapInArrow(encode, StructType([*kinds, StructField("__key", LongType()), StructField("__ids", BinaryType())])), "curve-tokens")


def unpack_ids(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u4" if data[0] == 4 else "<u2", -1, 1).astype("<u4")


def cuts(total: int, length: int) -> list[int]:
    """Lengths of the sequences that ``total`` tokens fill: full ones, then falling powers of two."""
    out = [length] * (total // length)
    rest = total % length
    while rest:
        out.append(1 << (rest.bit_length() - 1))
        rest -= out[-1]
    return out


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, vocabulary: str, length: int = LENGTH, end_id: int | None = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of all ``docs`` (doc_id, text) in sequences of ``length`` tokens, in curve order; ``with_ids`` adds ``ids`` (array<int>), the piece's tokens.

    Each token of each row is in one piece; nothing is padded or dropped: a sequence has ``length`` tokens, or a power
    of two at the end of a range. ``sequence_id`` is the range's number times 2**32 plus the sequence's number there;
    order by (sequence_id, offset) to get the training order. Null texts are empty (the end id only; no piece where
    ``end_id`` is None), null doc_ids sort first, repeated rows are packed each, very long texts run over many
    sequences. Equal keys, as of copies, are split by a hash of doc_id, so a range holds a bounded share of any group.
    """
    table = token_table(docs, vocabulary, end_id)
    # no number of ranges, so that adaptive execution puts small neighbours together
    ordered = table.withColumn("__tie", F.xxhash64("doc_id")).repartitionByRange("__key", "__tie").sortWithinPartitions("__key", "__tie", "doc_id", "__ids").select("doc_id", "__ids")

    def pack(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 32
        names = [x.split()[0] for x in PIECES.split(", ")] + ["ids"] * with_ids
        sequence, offset, rows, tail = 0, 0, [], []  # tail: rows of the sequence that isn't full yet

        def batch_of(rows):
            columns = list(zip(*((r[0], r[1], len(r[2]), zlib.crc32(r[2].tobytes()), r[3], first + r[4], r[5]) for r in rows))) or [()] * 7
            return pa.RecordBatch.from_arrays([*(pa.array(x, "int64") for x in columns), *([pa.array([r[2].astype("i4") for r in rows], pa.list_(pa.int32()))] if with_ids else [])], names)

        for batch in batches:
            for doc, data in zip(batch.column("doc_id").to_pylist(), batch.column("__ids").to_pylist()):
                ids, at = unpack_ids(data), 0
                while at < len(ids):
                    k = min(len(ids) - at, length - offset)
                    tail.append((doc, at, ids[at : at + k], len(ids), sequence, offset))
                    at, offset = at + k, offset + k
                    if offset == length:
                        rows += tail
                        sequence, offset, tail = sequence + 1, 0, []
                if len(rows) >= 4000:
                    yield batch_of(rows)
                    rows = []
        lengths, at = cuts(offset, length), 0
        for doc, start, ids, total, _, _ in tail:
            while len(ids):
                k = min(len(ids), lengths[0] - at)
                rows.append((doc, start, ids[:k], total, sequence, at))
                ids, start, at = ids[k:], start + k, at + k
                if at == lengths[0]:
                    lengths.pop(0)
                    sequence, at = sequence + 1, 0
        if rows:
            yield batch_of(rows)

    return ordered.mapInArrow(c.without_vocabularies(pack), PIECES + (", ids array<int>" if with_ids else ""))


def op6(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), c.public_vocabulary())
