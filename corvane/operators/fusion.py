"""Dense retrieval, rank fusion, score scales and diversification, for batches of questions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, StructField, StructType

from ..functions import text as T
from . import embedding, lexical

RRF_K, HALF = 60, 4.0
NUMBERS, TOGETHER = 1 << 20, 4096  # numbers of a block of vectors; vectors of a cell's side


def _units(lists) -> np.ndarray:
    """Unit vectors of an Arrow array of lists; raises for different dimensions."""
    import pyarrow.compute as pc

    dims = pc.list_value_length(lists).unique().to_pylist()
    if len(dims) > 1:
        raise ValueError(f"vectors of different dimensions: {sorted(dims)}")
    m = lists.flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(len(lists), -1)
    return m / np.maximum(np.sqrt((m * m).sum(axis=1)), 1e-12)[:, None]


def _blocks(rows: DataFrame, ids: list[str], size: int) -> DataFrame:
    """``rows`` (ids, vector) as rows of up to ``size`` and ``NUMBERS``: arrays of their ids, and their unit vectors as one matrix; raises for vectors of different dimensions."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            step = max(1, min(size, NUMBERS // max(1, len(batch.column("vector")[0]) if batch.num_rows else 1)))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                m = _units(part.column("vector"))
                arrays = [pa.array([part.column(x).to_pylist()], pa.list_(part.schema.field(x).type)) for x in ids]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array([m.tobytes()], pa.binary()), pa.array([m.shape[1]], "int32")], [*ids, "m", "dim"])

    kinds = [StructField(x, ArrayType(rows.schema[x].dataType)) for x in ids]
    chosen = rows.select(*ids, "vector").filter("vector is not null")
    return chosen.mapInArrow(run, StructType([*kinds, StructField("m", BinaryType()), StructField("dim", IntegerType())]))


def text_blocks(chunks: DataFrame, dim: int) -> DataFrame:
    """The blocks of the hashed vectors of ``chunks`` (id, seq, text), made in one step: vectors don't go through rows."""
    kinds = [StructField(x, ArrayType(chunks.schema[x].dataType)) for x in ("id", "seq")]

    def run(batches):
        for batch in batches:
            step = max(1, NUMBERS // dim)
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                m = embedding.embedded([x or "" for x in part.column("text").to_pylist()], dim).astype("f8")
                m /= np.maximum(np.sqrt((m * m).sum(axis=1)), 1e-12)[:, None]
                arrays = [pa.array([part.column(x).to_pylist()], pa.list_(part.schema.field(x).type)) for x in ("id", "seq")]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array([m.tobytes()], pa.binary()), pa.array([dim], "int32")], ["id", "seq", "m", "dim"])

    return chunks.select("id", "seq", "text").mapInArrow(run, StructType([*kinds, StructField("m", BinaryType()), StructField("dim", IntegerType())]))


def cosine(questions: DataFrame, vectors: DataFrame, k: int = 10, blocks: DataFrame | None = None) -> DataFrame:
    """The ``k`` rows of ``vectors`` (id, seq, vector) nearest to each question (qid, vector), by exact cosine, ties by ``seq``: qid, id, seq, score, rank.

    Questions are a stated set: blocks of them meet blocks of rows as matrix products, of which each question's best
    ``k`` are left. Vectors of another dimension raise. Zero vectors have cosine 0 with all. ``blocks``, if they are made already, take the place of ``vectors``.
    """
    asked = _blocks(questions, ["qid"], 512).withColumnsRenamed({"m": "q", "dim": "qdim"})
    blocks = _blocks(vectors.select("id", "seq", "vector"), ["id", "seq"], NUMBERS) if blocks is None else blocks
    pairs = blocks.crossJoin(asked)

    def best(batches):
        import pyarrow as pa

        for batch in batches:
            for r in range(batch.num_rows):
                one = {x: batch.column(x)[r] for x in batch.schema.names}
                if one["dim"].as_py() != one["qdim"].as_py():
                    raise ValueError(f"vectors of {one['dim']} dimensions for questions of {one['qdim']}")
                v, q = (np.frombuffer(one[x].as_py(), "f8").reshape(-1, max(1, one["dim"].as_py())) for x in "mq")
                seq, at, of, near = one["seq"].values.to_numpy(zero_copy_only=False), [], [], []
                step = max(1, NUMBERS // max(1, len(v)))
                for begin in range(0, len(q), step):
                    scores = np.round(q[begin : begin + step] @ v.T, 6) + 0.0
                    least = np.partition(scores, -k, axis=1)[:, -k, None] if len(v) > k else -2.0
                    i, j = np.nonzero(scores >= least)
                    order = np.lexsort((seq[j], -scores[i, j], i))
                    i, j = i[order], j[order]
                    some = np.arange(len(i)) - np.searchsorted(i, i) < k
                    i, j = i[some], j[some]
                    at.append(j)
                    of.append(i + begin)
                    near.append(scores[i, j])
                at, of, near = (np.concatenate(x) for x in (at, of, near))
                take = lambda name, i: one[name].values.take(pa.array(i))
                yield pa.RecordBatch.from_arrays([take("qid", of), take("id", at), take("seq", at), pa.array(near)], ["qid", "id", "seq", "score"])

    fields = [StructField("qid", questions.schema["qid"].dataType), *(StructField(x, blocks.schema[x].dataType.elementType) for x in ("id", "seq")), StructField("score", DoubleType())]
    return lexical.top(pairs.mapInArrow(best, StructType(fields)), k, "seq")


def alike(rows: DataFrame, least: float, digits: int = 4, together: int = TOGETHER) -> DataFrame:
    """Pairs (a, b, cosine) of ``rows`` (id, label, vector) with one label, ``a`` below ``b``, whose cosine, rounded to ``digits``, is at least ``least``.

    A label's rows are dealt by hash into groups of about ``together``, and every two groups meet in one cell as a matrix
    product: a task holds one cell at a time, and cells of one label are dealt to all tasks. All pairs are compared.
    """
    r = rows.filter("label is not null and id is not null and vector is not null and not exists(vector, x -> x is null)").select("id", "label", "vector", F.size("vector").alias("dim"))
    groups = r.groupBy("label", "dim").agg(F.ceil(F.count("*") / together).cast("int").alias("groups"))
    r = r.join(groups, ["label", "dim"]).withColumn("g", F.pmod(F.xxhash64("id"), F.col("groups")).cast("int"))
    cells = r.select("id", "label", "dim", "vector", "g", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("h")).withColumns({"i": F.least("g", "h"), "j": F.greatest("g", "h")})

    def meet(table):
        import pyarrow as pa

        table = table.combine_chunks()
        ids, units = table.column("id").to_numpy(), _units(table.column("vector").combine_chunks())
        own = table.column("g").to_numpy() == table.column("i")[0].as_py()
        x, y = np.flatnonzero(own), np.flatnonzero(~own)
        y = y if table.column("i")[0] != table.column("j")[0] else x
        a, b, near = [], [], []
        for at in range(0, len(x), 512):
            c = np.round(units[x[at : at + 512]] @ units[y].T, digits)
            p, q = np.nonzero(~(c < least))
            one, two = ids[x[p + at]], ids[y[q]]
            some = one < two if y is x else one != two
            a.append(np.minimum(one, two)[some])
            b.append(np.maximum(one, two)[some])
            near.append(c[p, q][some])
        a, b, near = (np.concatenate(v) if v else np.empty(0) for v in (a, b, near))
        kind = table.schema.field("id").type
        return pa.table({"a": pa.array(a, kind), "b": pa.array(b, kind), "cosine": pa.array(near, pa.float64())})

    kind = rows.schema["id"].dataType
    return cells.groupBy("label", "dim", "i", "j").applyInArrow(meet, StructType([StructField("a", kind), StructField("b", kind), StructField("cosine", DoubleType())]))


def dedupe(hits: DataFrame) -> DataFrame:
    """Each id of a ranking (qid, list, id, rank) at its first place, ranked anew."""
    first = hits.groupBy("qid", "list", "id").agg(F.min("rank").alias("first"))
    return first.select("qid", "list", "id", F.row_number().over(Window.partitionBy("qid", "list").orderBy("first")).alias("rank"))


def rrf(hits: DataFrame, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of (qid, list, weight, id, rank)."""
    if k < 1:
        raise ValueError("k must be at least 1")
    return hits.groupBy("qid", "id").agg(F.round(F.sum(F.col("weight") / (k + F.col("rank"))), 9).alias("score"))


def min_max(score: Column, *group: str) -> Column:
    """Scores of a group on 0 to 1; all 0 where they don't differ."""
    w = Window.partitionBy(*group)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(high > low, (score - low) / (high - low)).otherwise(F.lit(0.0))


def weighted(hits: DataFrame) -> DataFrame:
    """Sum of weighted min-max scores of (qid, list, weight, id, score); what a list lacks adds nothing."""
    best = hits.groupBy("qid", "list", "weight", "id").agg(F.max("score").alias("score"))
    scaled = best.withColumn("scaled", min_max(F.col("score"), "qid", "list"))
    return scaled.groupBy("qid", "id").agg(F.round(F.sum(F.col("weight") * F.col("scaled")), 6).alias("score"))


def rescale(score: Column, mode: str, weights: float = 1.0, k: int = RRF_K) -> Column:
    if mode == "hybrid":
        ceiling = weights / (k + 1)
        return F.least(F.lit(1.0), score / ceiling) if ceiling > 0 else score
    if mode == "lexical":
        return score / (score + HALF)
    if mode == "dense":
        return F.greatest(F.lit(0.0), score)
    raise ValueError(f"unknown mode: {mode}")


def _picked(vectors: np.ndarray, scores: np.ndarray, k: int, balance: float) -> list[int]:
    total = lambda x: np.cumsum(x, axis=-1)[..., -1]  # noqa: E731  # one by one, as the rows' own functions add
    units = vectors / np.maximum(np.sqrt(total(vectors * vectors)), 1e-12)[:, None]
    chosen, free, near = [], np.ones(len(scores), bool), None
    while len(chosen) < min(k, len(scores)):
        worth = scores if near is None else balance * scores - (1 - balance) * near
        best = int(np.flatnonzero(free)[np.argmax(worth[free])])
        chosen.append(best)
        free[best] = False
        new = total(units * units[best])
        near = new if near is None else np.maximum(near, new)
    return chosen


def mmr(candidates: Column, k: int, balance: float) -> Column:
    """Positions (from 0) that maximal marginal relevance picks from array<struct<vector, score>>, in order; the first of equals."""

    @F.arrow_udf(ArrayType(IntegerType()))
    def run(vectors: pa.Array, scores: pa.Array) -> pa.Array:
        out = []
        for v, s in zip(vectors, scores):
            m = v.values.flatten().to_numpy(zero_copy_only=False).astype("f8") if v.is_valid and len(v) else None
            out.append([] if m is None else _picked(m.reshape(len(v), -1), s.values.to_numpy(zero_copy_only=False), k, balance))
        return pa.array(out, pa.list_(pa.int32()))

    return run(F.transform(candidates, lambda c: c["vector"]), F.transform(candidates, lambda c: c["score"].cast("double")))


def diversify(df: DataFrame, candidates: str, k: int, balance: float = 0.7, out: str = "picked") -> DataFrame:
    """``df`` with the picked positions of its column ``candidates``; all in order when there are at most ``k`` or ``balance`` is 1."""
    picks = mmr(F.col(candidates), k, balance)
    plain = F.slice(F.sequence(F.lit(0), F.greatest(F.size(candidates) - 1, F.lit(0))), 1, k)
    keep = F.lit(balance >= 1) | (F.size(candidates) <= k)
    return df.withColumn(out, F.when(F.size(candidates) == 0, F.array().cast("array<int>")).when(keep, plain).otherwise(picks))
