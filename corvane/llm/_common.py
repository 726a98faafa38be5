"""Shared pieces of the training-data operators: shared storage, keys and the public tokenizer."""

from __future__ import annotations

import gc
import json
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of every contract in this package: maximal runs of anything but space and 0x09-0x0D.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
LAST = 2**63 - 1


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``); where none is set, a temporary one in local mode, and an error on a cluster."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="corvane-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def staged(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: lineage ends at files that outlive executors."""
    path = f"{shared_dir(df.sparkSession)}/corvane/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that don't clash (in any case) with those of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def col(name: str) -> Column:
    """The column of this very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def cols(df: DataFrame) -> list[Column]:
    return [col(c) for c in df.columns]


def text_or_empty(c: str | Column = "text") -> Column:
    return F.coalesce(col(c) if isinstance(c, str) else c, F.lit(""))


def words(text: Column) -> Column:
    """The words of ``text`` in order; an empty array for an empty or null text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_column(batch, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of a string column of an Arrow batch; b"" for null."""
    import pyarrow as pa

    c = batch.column(name)
    return [x or b"" for x in c.cast(pa.large_binary() if pa.types.is_large_string(c.type) else pa.binary()).to_pylist()]


class WordIds:
    """Token ids of whole texts by a tokenizer that drops white space, through caches of words.

    As white space never joins tokens, a text's ids are its words' ids put together. A few MB of text at a time are
    split and dictionary-encoded by Arrow, so Python sees each distinct word of them once, and each word goes through
    the ``tokenizers`` library once while it stays cached. Letters with symbols after them are two pre-tokens, so
    their ids are those of the letters, in any case of A-Z, and of the symbols. The caches are emptied when they reach
    their limits, which bounds a worker's memory. All this holds for tokenizers with the stages in ``BY_WORDS``; with any
    other one, whole texts are encoded as they are.
    """

    # Normalizer and pre-tokenizer of vocabularies of lower-cased words without white space.
    BY_WORDS = (
        {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
        {
            "type": "Sequence",
            "pretokenizers": [
                {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
                {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
            ],
        },
    )

    LETTERS = re.compile("[a-zÀ-ÖØ-öø-ÿ]+")
    SYMBOLS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
    WORDS, STEMS, JOINED, CHUNK = 1_000_000, 700_000, 1000, 8_000_000

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        made = json.loads(self.tokenizer.to_str())
        plain = made["model"]["type"] == "BPE" and not made["model"].get("dropout") and not any(made[x] for x in ("post_processor", "truncation", "padding"))
        added = all(re.fullmatch(r"[!-~]+", x["content"]) and not (x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"]) for x in made["added_tokens"])
        self.by_words = plain and added and (made["normalizer"], made["pre_tokenizer"]) == self.BY_WORDS
        self.words: dict[bytes, bytes] = {}
        self.stems: dict[bytes, bytes] = {}

    def _encode(self, word: bytes) -> bytes:
        from array import array

        return array("I", self.tokenizer.encode(word.decode(), add_special_tokens=False).ids).tobytes()

    def _learn_stems(self, stems: list[bytes]) -> None:
        import numpy as np

        for i in range(0, len(stems), self.JOINED):
            some = stems[i : i + self.JOINED]
            e = self.tokenizer.encode(b" ".join(some).decode(), add_special_tokens=False)
            at = e.word_ids
            if at and None not in at and at[-1] == len(some) - 1:
                ids = np.array(e.ids, "<u4").tobytes()
                ends = (4 * np.cumsum(np.bincount(at, minlength=len(some)))).tolist()
                self.stems.update(zip(some, map(ids.__getitem__, map(slice, [0, *ends[:-1]], ends))))
            else:
                self.stems.update((s, self._encode(s)) for s in some)

    def _lookup(self, words: list[bytes]) -> list[bytes]:
        got = list(map(self.words.get, words))
        missing = [i for i, x in enumerate(got) if x is None]
        if not missing:
            return got
        if len(self.words) + len(missing) > self.WORDS:
            self.words.clear()
        if len(self.stems) > self.STEMS:
            self.stems.clear()
        collects = gc.isenabled()
        gc.disable()  # nothing here is in a cycle, and looking for cycles in large caches takes longer than the work
        try:
            self._learn(words, missing, got)
        finally:
            if collects:
                gc.enable()
        return got

    def _learn(self, words: list[bytes], missing: list[int], got: list) -> None:
        later, new = [], {}
        for i in missing:
            w = words[i]
            low = w.lower()
            stem = low.rstrip(self.SYMBOLS)
            mark = low[len(stem) :]
            known = self.stems.get(stem)
            if known is None and stem not in new:
                if not self.LETTERS.fullmatch(stem.decode()):
                    got[i] = self.words[w] = self._encode(w)
                    continue
                new[stem] = None
            if mark and mark not in self.stems:
                self.stems[mark] = self._encode(mark)
            later.append((i, w, stem, mark))
        self._learn_stems(list(new))
        stems, own = self.stems, self.words
        for i, w, stem, mark in later:
            got[i] = own[w] = stems[stem] + stems[mark] if mark else stems[stem]

    def many(self, texts):
        """(ids, ends) of consecutive slices of an Arrow string column: ids (uint32) of the slice's texts one after the other, and where each text's end. Null: none."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = pc.fill_null(texts, "")
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype("i8"))
        at = 0
        while at < len(texts):
            upto = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + self.CHUNK, "right")))
            if not self.by_words:
                whole = [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch(texts.slice(at, upto - at).to_pylist(), add_special_tokens=False)]
                yield np.concatenate(whole), np.cumsum([len(x) for x in whole])
                at = upto
                continue
            split = pc.ascii_split_whitespace(texts.slice(at, upto - at))
            coded = split.flatten().dictionary_encode()
            distinct = coded.dictionary
            parts = self._lookup(distinct.cast(pa.large_binary() if pa.types.is_large_string(distinct.type) else pa.binary()).to_pylist())
            lens = np.fromiter(map(len, parts), "i8", len(parts)) // 4
            flat, starts = np.frombuffer(b"".join(parts), "<u4"), np.cumsum(lens) - lens
            index = coded.indices.to_numpy(zero_copy_only=False)
            n = lens[index]
            ends = np.cumsum(n)
            total = int(ends[-1]) if len(ends) else 0
            ids = flat[np.repeat(starts[index] - (ends - n), n) + np.arange(total)]
            words = split.offsets.to_numpy()[1:] - split.offsets[0].as_py()
            yield ids, np.concatenate(([0], ends))[words]
            at = upto

    def documents(self, texts, end_id: int | None = None):
        """The ids (uint32) of each text of the column, followed by ``end_id`` if there is one."""
        import numpy as np

        tail = np.array([] if end_id is None else [end_id], "<u4")
        for ids, ends in self.many(texts):
            at = 0
            for e in ends.tolist():
                yield np.concatenate((ids[at:e], tail))
                at = e


_loaded: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One per Python worker and vocabulary, kept between tasks."""
    if path not in _loaded:
        _loaded[path] = WordIds(path)
    return _loaded[path]


def let_go() -> None:
    """Give back what a Python worker still holds from earlier tasks: vocabularies with their caches, and free pages of Arrow and the C library.

    Workers live on between the tasks of different operators, so one that doesn't encode shouldn't hold a vocabulary.
    """
    import ctypes

    import pyarrow as pa

    if _loaded:
        _loaded.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim:
        trim(0)


def without_vocabularies(run):
    """``run`` of mapInArrow, in a worker that lets go of earlier tasks' memory first."""

    def around(batches):
        let_go()
        yield from run(batches)

    return around


def public_vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
