"""Document fingerprints: one invertible Bloom lookup sketch per document, in column functions.

A document's paragraphs (lines, cut after sentences, that have a word) have 64-bit digests; equal paragraphs are numbered,
so each copy has its own. A sketch has three tables of ``w`` cells, ``w`` a power of two; a digest is in one cell of each.
A cell holds the XOR of its digests, the XOR of their checks and their number; only cells in use are kept. Sketches of
one ``w`` subtract cell by cell, and peeling takes out, round by round, the digests that are alone in a cell, until no
cell is left. If cells are left, it is done again with twice the ``w``. A document's sketch is the smallest, from eight times as many cells
a table as it has paragraphs, that can be peeled by itself, so its digests can always be recovered from it, and with them
it can be enlarged. Its string, the fingerprint, holds all of it: any two fingerprints can be subtracted and peeled later.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _common as c

LEAST, WIDEST, ROUNDS = 4, 1 << 21, 48
#: Cells: number 3 * place + table, XOR of digests, XOR of checks, count.
CELLS, KEYS = "array<struct<c:bigint,x:bigint,g:bigint,n:bigint>>", "array<bigint>"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _long(v: int) -> Column:
    return F.lit(v).cast("long")


def _runs(e: Column, key) -> Column:
    """Where the runs of equal ``key`` begin in the sorted array ``e``."""
    n = F.size(e)
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(places, lambda i: (i == 0) | (key(F.get(e, i)) != key(F.get(e, i - 1))))


def digests(text: Column) -> Column:
    """Digests (array<long>) of the paragraphs of ``text``, the k-th of equal ones by its number too. None for no words: an empty array."""
    parts = F.split(F.coalesce(text, F.lit("")), r"\n|(?<=[.!?])[\x20\x09-\x0D]+")
    hashes = F.sort_array(F.transform(F.filter(parts, lambda p: p.rlike(r"[^\x20\x09-\x0D]")), lambda p: F.xxhash64(p)))

    def numbered(e: Column) -> Column:
        several = _let(_runs(e, lambda x: x), lambda r: F.flatten(F.transform(r, lambda s, k: F.transform(F.sequence(s, F.coalesce(F.get(r, k + 1), F.size(e)) - 1), lambda i: F.when(i == s, F.get(e, i)).otherwise(F.xxhash64(F.get(e, i), i - s))))))
        return F.when(F.size(F.array_distinct(e)) == F.size(e), e).otherwise(several)

    return _let(hashes, numbered)


def _cell(cell: Column, x: Column, g: Column, n: Column) -> Column:
    return F.struct(cell.alias("c"), x.alias("x"), g.alias("g"), n.alias("n"))


def _combined(cells: Column) -> Column:
    """Cells of one number become one; those with nothing in them go. What adds, subtracts and peels.

    What is sorted is one long for each cell, its number and its place in the array.
    """
    place = lambda k: k.bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
    plus = lambda a, q: _cell(a["c"], a["x"].bitwiseXOR(q["x"]), a["g"].bitwiseXOR(q["g"]), a["n"] + q["n"])

    def added(all_: Column, k: Column) -> Column:
        def one(s: Column, i: Column, r: Column) -> Column:
            first, n = F.get(all_, place(F.get(k, s))), F.coalesce(F.get(r, i + 1), F.size(k)) - s
            return F.when(n == 1, first).otherwise(F.aggregate(F.slice(k, s + 2, n - 1), first, lambda a, q: plus(a, F.get(all_, place(q)))))

        return _let(_runs(k, lambda x: F.shiftright(x, 32)), lambda r: F.transform(r, lambda s, i: one(s, i, r)))

    order = lambda all_: F.sort_array(F.transform(all_, lambda q, i: F.shiftleft(q["c"], 32).bitwiseOR(i.cast("long"))))
    return F.filter(_let(cells, lambda all_: _let(order(all_), lambda k: added(all_, k))), lambda q: (q["n"] != 0) | (q["x"] != 0) | (q["g"] != 0))


def _places(keys: Column, w: Column, n: int = 1) -> Column:
    """The cells of each of ``keys`` (digests) alone, counted ``n``."""
    at = lambda k, j: F.shiftright(k["g"], 21 * j).bitwiseAND(w - 1) * 3 + j
    checked = F.transform(keys, lambda x: F.struct(x.alias("x"), F.xxhash64(x).alias("g")))
    return F.flatten(F.transform(checked, lambda k: F.array(*[_cell(at(k, j), k["x"], k["g"], _long(n)) for j in range(3)])))


def _peel(cells: Column, w: Column) -> Column:
    """struct<cells, a, b, open>: what is left of ``cells`` and the digests that came out, with the count 1 (a) or -1 (b).

    Each digest is in three cells, so the XOR of all cells is that of all digests: if a round's digests have it, nothing is left.
    """
    pure = lambda s: F.filter(s["cells"], lambda q: (F.abs(q["n"]) == 1) & (q["g"] == F.xxhash64(q["x"])))
    of = lambda p, n: F.array_distinct(F.transform(F.filter(p, lambda q: q["n"] == n), lambda q: q["x"]))
    state = lambda cells, a, b, more: F.struct(cells.alias("cells"), a.alias("a"), b.alias("b"), more.alias("open"))

    def taken(s: Column, p: Column) -> Column:
        less = F.concat(s["cells"], _places(p["a"], w, -1), _places(p["b"], w, 1))
        held = F.aggregate(s["cells"], _long(0), lambda t, q: t.bitwiseXOR(q["x"]))
        out = F.aggregate(F.concat(p["a"], p["b"]), _long(0), lambda t, x: t.bitwiseXOR(x))
        return state(F.when(held == out, F.array().cast(CELLS)).otherwise(_combined(less)), F.concat(s["a"], p["a"]), F.concat(s["b"], p["b"]), F.lit(True))

    def round_(s: Column, p: Column) -> Column:
        more = _let(F.struct(of(p, 1).alias("a"), of(p, -1).alias("b")), lambda sides: taken(s, sides))
        return F.when(F.size(p) > 0, more).otherwise(state(s["cells"], s["a"], s["b"], F.lit(False)))

    step = lambda s, _: F.when(s["open"] & (F.size(s["cells"]) > 0), _let(pure(s), lambda p: round_(s, p))).otherwise(s)
    none = F.array().cast(KEYS)
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), state(cells, none, none, F.lit(True)), step)


def _smallest(w: Column, sketched) -> Column:
    """struct<w, cells, a, b>: what peeling takes from ``sketched(w)``, cells, at the first of w, 2 w, 4 w and so on where it leaves none."""
    state = lambda w, cells, a, b, ok: F.struct(w.alias("w"), cells.alias("cells"), a.alias("a"), b.alias("b"), ok.alias("ok"))
    none = state(_long(0), F.array().cast(CELLS), F.array().cast(KEYS), F.array().cast(KEYS), F.lit(False))
    once = lambda v: _let(sketched(v), lambda cells: _let(_peel(cells, v), lambda p: state(v, cells, p["a"], p["b"], F.size(p["cells"]) == 0)))
    step = lambda s, i: F.when(s["ok"], s).otherwise(_let(F.least(F.call_function("shiftleft", w, i), _long(WIDEST)), once))
    fails = F.raise_error(F.lit("a sketch of the largest size can't be peeled")).cast(f"struct<w:bigint,cells:{CELLS},a:{KEYS},b:{KEYS}>")
    return F.aggregate(F.sequence(F.lit(0), F.lit(WIDEST.bit_length())), none, step, lambda s: F.when(s["ok"], F.struct(s["w"], s["cells"], s["a"], s["b"])).otherwise(fails))


def sketch(keys: Column) -> Column:
    """struct<w, cells, got> of an array of different digests: the smallest sketch that can be peeled by itself, and the digests that peeling it recovers.

    Raises for texts of some millions of paragraphs, which the largest size can't hold.
    """

    def build(k: Column) -> Column:
        least = F.call_function("shiftleft", _long(1), F.length(F.bin(F.greatest(8 * F.size(k), F.lit(LEAST)) - 1)))
        return _let(least, lambda w: _let(_smallest(w, lambda v: _combined(_places(k, v))), lambda s: F.struct(s["w"].alias("w"), s["cells"].alias("cells"), s["a"].alias("got"))))

    return _let(keys, build)


def difference(a: Column, b: Column) -> Column:
    """struct<a, b>: the digests that only the sketch ``a`` holds and those that only ``b`` holds.

    The sketches are subtracted at the larger one's size, for which the smaller one is peeled and put in again, and
    what is left is peeled; after a failure both are put in again at twice the size, until it works.
    """
    at = lambda s, w: F.when(s["w"] == w, s["cells"]).otherwise(_combined(_places(s["got"], w)))
    less = lambda cells: F.transform(cells, lambda q: _cell(q["c"], q["x"], q["g"], -q["n"]))
    found = _let(F.greatest(a["w"], b["w"]), lambda w: _smallest(w, lambda v: _combined(F.concat(at(a, v), less(at(b, v))))))
    return _let(found, lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b")))


def likeness(a: Column, b: Column) -> Column:
    """Share of the paragraphs of both that both have (Dice), from the peeled difference of their sketches: 1 for equal ones and for two without any, 0 for nothing in common."""
    n = F.size(a["got"]) + F.size(b["got"])
    gone = _let(difference(a, b), lambda d: F.size(d["a"]) + F.size(d["b"]))
    return F.when(n == 0, F.lit(1.0)).otherwise(1.0 - gone.cast("double") / n.cast("double"))


def fingerprint(s: Column) -> Column:
    """The whole sketch as a string: ``w``, then for each cell in use, in order, its number, XOR of digests, XOR of checks and count, all in hex: ``10:0,1f..,9a..,1;4,..``."""
    cells = F.transform(s["cells"], lambda q: F.concat_ws(",", F.hex(q["c"]), F.hex(q["x"]), F.hex(q["g"]), F.hex(q["n"])))
    return F.lower(F.concat_ws(":", F.hex(s["w"]), F.array_join(cells, ";")))


def _bucket(k: Column, bounds: list[int]) -> Column:
    """How many of the ascending ``bounds`` are below ``k``, by binary search."""
    if not bounds:
        return F.lit(0)
    array = F.lit(bounds).cast("array<bigint>")
    steps = [1 << i for i in range(len(bounds).bit_length() - 1, -1, -1)]
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda lo, s: F.when((lo + s <= len(bounds)) & (F.get(array, lo + s - 1) < k), lo + s).otherwise(lo))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, sketch of each row and next_text, next_sketch of the row that follows it by descending doc_id, the first after the last.

    Null doc_ids come last, rows of one doc_id by descending hash of their texts. Rows are dealt to ranges of doc_id
    (bounds: quantiles of all doc_ids, as many as 4 for each shuffle partition); the first row of a range also goes to
    the range before it, so no window holds more than a range. One row follows itself.
    """
    n = c.partitions(docs.sparkSession)
    m = 4 * n
    t = c.text_or_empty()
    own = docs.select(c.col("doc_id").cast("long").alias("doc_id"), F.coalesce(c.col("doc_id").cast("long"), F.lit(-(2**63))).alias("k"), F.xxhash64(t).alias("th"), t.alias("text"))
    bounds = own.agg(F.percentile_approx("k", [i / m for i in range(1, m)], 100 * m)).first()[0]
    own = own.withColumn("range", _bucket(F.col("k"), sorted(set(bounds or []))))
    firsts = own.groupBy("range").agg(F.max(F.struct("k", "th")).alias("f"))  # at most m rows
    ring = Window.orderBy(F.desc("range"))
    before = firsts.select(F.coalesce(F.lag("range").over(ring), F.min("range").over(Window.partitionBy(F.lit(0)))).alias("to"), F.col("f.k").alias("k"), F.col("f.th").alias("th"))
    also = own.join(F.broadcast(before), ["k", "th"]).dropDuplicates(["to"]).select("doc_id", "k", "th", "text", F.col("to").alias("range"), F.lit(True).alias("guest"))
    every = own.withColumn("guest", F.lit(False)).unionByName(also).repartition(n, "range")
    every = every.sortWithinPartitions("range", "guest", F.desc("k"), F.desc("th")).withColumn("sketch", sketch(digests(F.col("text"))))
    order = Window.partitionBy("range").orderBy("guest", F.desc("k"), F.desc("th"))
    return every.withColumns({"next_text": F.lead("text").over(order), "next_sketch": F.lead("sketch").over(order)}).filter("not guest").select("doc_id", "text", "sketch", "next_text", "next_sketch")


def op8(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for every document. Null and empty texts have no paragraph and the fingerprint ``4:``; likenesses are those of ``likeness``; ties of doc_id go by the hash of the text; other columns are not read."""
    rows = with_next(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)))
    rows = rows.withColumn("edited_sketch", F.explode(F.array(sketch(digests(F.col("edited"))))))  # a generator's output is made once
    own, edited, after = (F.col(x) for x in ("sketch", "edited_sketch", "next_sketch"))
    return rows.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(own).alias("fingerprint"),
        fingerprint(edited).alias("edited_fingerprint"),
        likeness(own, edited).alias("near_edited"),
        likeness(own, after).alias("near_next"),
    )
