"""Substring dedup by difference-cover anchors.

``COVER`` is a perfect difference set modulo ``PERIOD``: for any two positions there is one shift under ``PERIOD`` that
takes both into the cover. So two equal windows of ``WINDOW`` words share, at one shift, an anchor of ``ANCHOR`` words at
cover positions of both documents, and only those positions (6 of 31) are hashed and shuffled. Around an anchor that
another text shares the match is extended: each window over it is hashed, with 128 bits, and its least document found. Equal texts are told apart from the rest by their hashes at first and stand for each other.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as c

#: A perfect difference set (31, 6, 1).
COVER, PERIOD = (1, 5, 11, 24, 25, 27), 31
WINDOW = 50
ANCHOR = WINDOW - PERIOD + 1
_BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
CHUNK = 6_000_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


class _Words:
    """Word hashes of consecutive texts and, from them, hashes of any run of words."""

    def __init__(self, texts):
        import pyarrow.compute as pc
        import xxhash

        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        flat, ends = split.flatten(), split.offsets.to_numpy()[1:].astype("i8") - split.offsets[0].as_py()
        full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)  # white space at an end makes an empty part
        before = np.concatenate(([0], np.cumsum(full)))
        coded = flat.filter(pc.not_equal(flat, "")).dictionary_encode()
        digest = xxhash.xxh64_intdigest
        self.hashes = np.array([digest(w) for w in coded.dictionary.to_pylist()], "u8")[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.zeros(0, "u8")
        self.ends = before[ends]
        self.starts = np.concatenate(([0], self.ends[:-1])) if len(self.ends) else self.ends
        self.sums: dict[int, tuple] = {}

    def runs(self, at: np.ndarray, length: int, which: int = 0) -> np.ndarray:
        """Hashes of the runs of ``length`` words from each word of ``at`` on."""
        if which not in self.sums:
            base = np.uint64(_BASES[which] | 1)
            power = np.full(len(self.hashes) + 1, base, "u8")
            power[0] = 1
            back = np.full(len(self.hashes) + 1, np.uint64(pow(int(base), -1, 1 << 64)), "u8")
            back[0] = 1
            words = self.hashes if which == 0 else _mix(self.hashes + np.uint64(_BASES[1]))
            power, back = np.multiply.accumulate(power), np.multiply.accumulate(back)
            self.sums[which] = np.concatenate((np.zeros(1, "u8"), np.cumsum(words * power[:-1], dtype="u8"))), back
        total, back = self.sums[which]
        return _mix((total[at + length] - total[at]) * back[at])


def _slices(batch, name: str):
    """(from, to) of parts of a batch with some MB of text each."""
    import pyarrow.compute as pc

    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False).astype("i8"))
    at = 0
    while at < batch.num_rows:
        upto = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + CHUNK, "right")))
        yield at, upto
        at = upto


def _anchor_words(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, word) of every anchor: cover positions, counted from each document's start, with ``ANCHOR`` words to come, of documents that have a window."""
    n = np.where(ends - starts >= WINDOW, ends - starts - ANCHOR + 1, 0)
    doc = np.repeat(np.arange(len(n)), n)
    place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    some = np.isin(np.arange(PERIOD), COVER)[place % PERIOD]
    return doc[some], starts[doc[some]] + place[some]


def _facts(docs: DataFrame) -> DataFrame:
    """d (doc_id; the largest long for null), null, th, th2, text."""
    t = c.text_or_empty()
    return docs.select(F.coalesce(c.col("doc_id").cast("long"), F.lit(c.LAST)).alias("d"), c.col("doc_id").isNull().alias("null"), F.xxhash64(t).alias("th"), F.xxhash64(t, F.lit(1)).alias("th2"), t.alias("text"))


def _shared(pairs: DataFrame) -> DataFrame:
    """Rows (h, th) whose h comes with at least two different th. A sorted stream: what is held is one group's rows until a second th comes."""

    def run(batches):
        import pyarrow as pa

        held_h = held_t = np.zeros(0, "i8")
        open_h, is_open = None, False  # the last group, already known to be shared
        for batch in batches:
            h, t = (np.concatenate((a, batch.column(x).to_numpy(zero_copy_only=False))) for a, x in ((held_h, "h"), (held_t, "th")))
            new = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            ends = np.concatenate((new[1:], [len(h)]))
            good = t[new] != t[ends - 1]
            if is_open and h[0] == open_h:
                good[0] = True
            last_good = bool(good[-1])
            rows = np.repeat(good, ends - new)
            if rows.any():
                yield pa.RecordBatch.from_arrays([pa.array(h[rows]), pa.array(t[rows])], ["h", "th"])
            open_h, is_open = h[-1], last_good
            held_h, held_t = (np.zeros(0, "i8"),) * 2 if last_good else (h[new[-1] :], t[new[-1] :])

    n = c.partitions(pairs.sparkSession)
    return pairs.repartition(n, "h").sortWithinPartitions("h", "th").mapInArrow(run, "h long, th long")


def _later(windows: DataFrame) -> DataFrame:
    """(d, th, p, more) of windows (h1, h2, d, th, p, more) that also start in a document with a smaller d."""

    def run(batches):
        import pyarrow as pa

        last = None
        for batch in batches:
            a, b, d = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("h1", "h2", "d"))
            new = np.concatenate(([last is None or last[0] != a[0] or last[1] != b[0]], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
            group = np.cumsum(new)
            least = np.concatenate(([last[2] if last else 0], d[new]))[group]
            later = d > least
            last = a[-1], b[-1], least[-1]
            if later.any():
                yield pa.RecordBatch.from_arrays([pa.array(d[later]), *(batch.column(x).filter(pa.array(later)) for x in ("th", "p", "more"))], ["d", "th", "p", "more"])

    n = c.partitions(windows.sparkSession)
    return windows.repartition(n, "h1", "h2").sortWithinPartitions("h1", "h2", "d").mapInArrow(run, "d long, th long, p long, more int")


def _anchors(facts: DataFrame) -> DataFrame:
    """For each row d, null, th, th2, n_words, sha (of all its words) and its anchors' hashes, which of copies in one task only the first has."""

    def run(batches):
        import pyarrow as pa

        seen: set[tuple] = set()  # bounded as the texts of a task are
        for batch in batches:
            for at, upto in _slices(batch, "text"):
                part = batch.slice(at, upto - at)
                w = _Words(part.column("text"))
                names = list(zip(*(part.column(x).to_pylist() for x in ("th", "th2"))))
                fresh = np.array([x not in seen and not seen.add(x) for x in names], bool)
                doc, word = _anchor_words(w.starts, np.where(fresh, w.ends, w.starts))
                h = w.runs(word, ANCHOR)
                order = np.lexsort((h, doc))
                doc, h = doc[order], h[order]
                once = np.concatenate(([True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1]))) if len(doc) else np.zeros(0, bool)
                doc, h = doc[once], h[once]
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(part.num_rows + 1)), "int32"), pa.array(h.view("i8")))
                sha = [hashlib.sha256(b" ".join(t.split())).hexdigest() for t in c.text_column(part)]
                yield pa.RecordBatch.from_arrays([*(part.column(x) for x in ("d", "null", "th", "th2")), pa.array(w.ends - w.starts, "int64"), pa.array(sha), lists], ["d", "null", "th", "th2", "n_words", "sha", "anchors"])

    return facts.mapInArrow(run, "d long, null boolean, th long, th2 long, n_words long, sha string, anchors array<long>")


def _windows(candidates: DataFrame) -> DataFrame:
    """Windows (h1, h2, d, th, p, more) of rows (d, th, text, anchors) with at least one anchor among the row's shared ``anchors``: a match has one at the same place in both.

    ``p`` is a window's first word; it comes again in the row ``more`` times, each as many words on as the upper half of
    ``p`` says: repeated words make few rows.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at, upto in _slices(batch, "text"):
                part = batch.slice(at, upto - at)
                w = _Words(part.column("text"))
                doc, word = _anchor_words(w.starts, w.ends)
                h = w.runs(word, ANCHOR).view("i8")
                known = np.zeros(len(h), bool)
                for i, have in enumerate(part.column("anchors").to_pylist()):
                    a, b = np.searchsorted(doc, (i, i + 1))
                    known[a:b] = np.isin(h[a:b], np.array(have, "i8"))
                found = np.zeros(len(w.hashes) + 1, "i8")  # a shared anchor starts at this word
                found[word[known]] = 1
                before = np.concatenate(([0], np.cumsum(found)))
                n = np.maximum(w.ends - w.starts - WINDOW + 1, 0)
                doc = np.repeat(np.arange(len(n)), n)
                p = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                s = w.starts[doc] + p
                good = before[s + PERIOD] > before[s]
                doc, p, s = doc[good], p[good], s[good]
                if not len(s):
                    continue
                d, th = (part.column(x).to_numpy(zero_copy_only=False) for x in ("d", "th"))
                h = w.runs(s, WINDOW)
                order = np.argsort(_mix(h + doc.astype("u8") * np.uint64(_BASES[0])), kind="stable")
                h, doc, p, s = h[order], doc[order], p[order], s[order]
                other = np.concatenate(([True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])))
                step = np.where(other, 0, np.diff(p, prepend=0))  # from the same window before
                new = other | np.concatenate(([False], ~other[:-1] & (step[1:] != step[:-1])))
                at_ = np.flatnonzero(new)
                more = np.diff(np.concatenate((at_, [len(s)]))) - 1
                h, doc, s, p = h[at_], doc[at_], s[at_], p[at_] | np.where(more > 0, step[np.minimum(at_ + 1, len(step) - 1)], 0) << 32
                for k in range(0, len(s), 200_000):
                    x = slice(k, k + 200_000)
                    yield pa.RecordBatch.from_arrays([pa.array(h[x].view("i8")), pa.array(w.runs(s[x], WINDOW, 1).view("i8")), pa.array(d[doc[x]]), pa.array(th[doc[x]]), pa.array(p[x]), pa.array(more[x], "int32")], ["h1", "h2", "d", "th", "p", "more"])

    return candidates.mapInArrow(run, "h1 long, h2 long, d long, th long, p long, more int")


def _cut(texts: DataFrame) -> DataFrame:
    """d, th, n_removed, kept of rows (d, th, text, places): ``places`` are the (p, more) of removed windows."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            got = []
            for t, places in zip(c.text_column(batch), batch.column("places").to_pylist()):
                words = t.split()
                edge = np.zeros(len(words) + 1, "i4")
                p, more = (np.array([x[k] for x in places], "i8") for k in ("p", "more"))
                again = np.arange(int((more + 1).sum())) - np.repeat(np.cumsum(more + 1) - more - 1, more + 1)
                first = np.repeat(p & 0xFFFFFFFF, more + 1) + again * np.repeat(p >> 32, more + 1)
                np.add.at(edge, first, 1)
                np.add.at(edge, first + WINDOW, -1)
                keep = np.cumsum(edge[:-1]) == 0
                got.append((len(words) - int(keep.sum()), b" ".join([words[i] for i in np.flatnonzero(keep).tolist()]).decode()))
            yield pa.RecordBatch.from_arrays([batch.column("d"), batch.column("th"), pa.array([g[0] for g in got], "int64"), pa.array([g[1] for g in got], "string")], ["d", "th", "n_removed", "kept"])

    return texts.mapInArrow(run, "d long, th long, n_removed long, kept string")


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, n_removed, kept_sha256 (of the kept words, joined by a space); ``with_text`` adds kept_text.

    A word goes if a window of ``WINDOW`` words over it, as the input has it, also starts in a row of smaller doc_id.
    Null and empty texts have no words. A null doc_id counts as larger than all; rows of one doc_id never remove from
    each other; repeated rows get equal results. Texts of any length are read whole.
    """
    facts = _facts(docs)
    first_pass = c.staged(_anchors(facts), "cover-anchors")
    rows = first_pass.drop("anchors")
    owners = c.staged(rows.groupBy("th", "th2").agg(F.min("d").alias("least")), "cover-texts")
    shared = _shared(first_pass.select("th", F.explode("anchors").alias("h")))
    lists = shared.groupBy("th").agg(F.collect_set("h").alias("anchors")).join(owners, "th").select(F.col("least").alias("d"), "th", "th2", "anchors")
    candidates = facts.select("d", "th", "th2", "text").join(lists, ["d", "th", "th2"]).dropDuplicates(["d", "th", "th2"])
    later = _later(_windows(candidates.select("d", "th", "text", "anchors")))
    places = c.staged(later.groupBy("d", "th").agg(F.collect_list(F.struct("p", "more")).alias("places")), "cover-places")
    where = places.join(owners.withColumnRenamed("least", "d"), ["d", "th"]).select("d", "th", "th2", "places")
    cut = _cut(facts.select("d", "th", "th2", "text").join(where, ["d", "th", "th2"]).dropDuplicates(["d", "th", "th2"]).select("d", "th", "text", "places"))
    cut = cut.select("d", "th", "n_removed", F.sha2("kept", 256).alias("cut_sha"), *(["kept"] if with_text else []))
    known = rows.join(owners.select("th", "th2", "least"), ["th", "th2"]).join(cut, ["d", "th"], "left")
    copied = (F.col("d") > F.col("least")) & (F.col("n_words") >= WINDOW)
    out = [
        F.when(~F.col("null"), F.col("d")).alias("doc_id"),
        "n_words",
        F.when(copied, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copied, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"),
    ]
    if with_text:
        # texts without a removal are not carried along: they are the row's own words
        own = facts.select("d", "null", "th", "th2", F.array_join(c.words(F.col("text")), " ").alias("own")).dropDuplicates(["d", "null", "th", "th2"])
        known = known.join(own, ["d", "null", "th", "th2"])
        out.append(F.when(copied, "").otherwise(F.coalesce("kept", "own")).alias("kept_text"))
    return known.select(*out)


def op10(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for every document; nulls, ties and repeated rows as in ``remove_repeats``; other columns are not read."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
