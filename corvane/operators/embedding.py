"""Hashing embedder: words, neighbouring words and runs of four characters, signed into buckets."""

from __future__ import annotations

import hashlib
import unicodedata
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .chunking import TOKEN

# Weight of each kind of feature.
PRIORS = {"word": 1.0, "bigram": 0.7, "char": 0.35}


def normal(text: str) -> str:
    return " ".join((text if text.isascii() else unicodedata.normalize("NFKC", text).replace("\xad", "")).lower().split())


def features(text: str) -> dict[str, Counter]:
    """How often each feature of each kind is in a text."""
    line = normal(text)
    tokens = TOKEN.findall(line)
    return {"word": Counter(tokens), "bigram": Counter(map(" ".join, zip(tokens, tokens[1:]))), "char": Counter(map("".join, zip(line, line[1:], line[2:], line[3:])))}


def hashed(kind: str, names: list[bytes], lengths, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and weights of features by their names and lengths in characters."""
    start, blake = kind.encode() + b"\x1f", hashlib.blake2b
    h = np.frombuffer(b"".join([blake(start + x, digest_size=8).digest() for x in names]), ">u8").astype("u8")
    return (h % np.uint64(dim)).astype("i8"), np.where(h >> np.uint64(63), 1.0, -1.0) * PRIORS[kind] * np.minimum(1.0, (np.asarray(lengths) + 1) / 8)


class Table:
    """Bucket and weight of features by a number each, in sorted arrays; emptied at ``MOST``, which bounds a worker's memory."""

    MOST = 1_000_000

    def __init__(self):
        self.keys, self.bucket, self.weight = np.empty(0, "u8"), np.empty(0, "i8"), np.empty(0)

    def get(self, keys: np.ndarray, make) -> tuple[np.ndarray, np.ndarray]:
        """Of ``keys``; ``make`` gives buckets and weights of those that aren't there."""
        if len(self.keys) > self.MOST:
            self.__init__()
        at = np.searchsorted(self.keys, keys)
        new = np.unique(keys[self.keys[np.minimum(at, len(self.keys) - 1)] != keys] if len(self.keys) else keys)
        if len(new):
            bucket, weight = make(new)
            where = np.searchsorted(self.keys, new)
            self.keys, self.bucket, self.weight = (np.insert(x, where, y) for x, y in ((self.keys, new), (self.bucket, bucket), (self.weight, weight)))
            at = np.searchsorted(self.keys, keys)
        return self.bucket[at], self.weight[at]


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, and how often each comes."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, "i8")
    return keys[first], np.diff(first, append=len(keys))


class Buckets:
    """Vectors of texts. Words and characters have numbers while they are held, neighbouring words and runs of four characters are a number made of theirs; each is hashed once while it is held."""

    WORDS, SIGNS, CHARS = 200_000, 1 << 16, 1 << 19

    def __init__(self, dim: int):
        self.dim, self.char, self.bigram = dim, Table(), Table()
        self.number, self.names, self.bucket, self.weight = {}, [], np.empty(0, "i8"), np.empty(0)
        self.sign, self.signs = np.zeros(0x110000, "i4"), [""]

    def _words(self, line: str) -> np.ndarray:
        tokens = TOKEN.findall(line)
        for x in set(tokens).difference(self.number):
            self.number[x] = len(self.names)
            self.names.append(x.encode())
        return np.fromiter(map(self.number.__getitem__, tokens), "u8", len(tokens))

    def _runs(self, line: str) -> np.ndarray | None:
        """A number of each run of four characters; None if there are too many different characters."""
        codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), "u4")
        new = np.unique(codes[self.sign[codes] == 0])
        if len(self.signs) + len(new) > self.SIGNS:
            return None
        self.sign[new] = np.arange(len(self.signs), len(self.signs) + len(new))
        self.signs += map(chr, new.tolist())
        n = self.sign[codes].astype("u8")
        return n[:-3] << np.uint64(48) | n[1:-2] << np.uint64(32) | n[2:-1] << np.uint64(16) | n[3:] if len(n) > 3 else np.empty(0, "u8")

    def _bigrams(self, keys: np.ndarray):
        names = self.names
        made = [names[a] + b" " + names[b] for a, b in zip((keys >> np.uint64(32)).tolist(), (keys & np.uint64(0xFFFFFFFF)).tolist())]
        return hashed("bigram", made, list(map(len, made)), self.dim)

    def _fours(self, keys: np.ndarray):
        parts = [[self.signs[c] for c in (keys >> np.uint64(s) & np.uint64(0xFFFF)).tolist()] for s in (48, 32, 16, 0)]
        return hashed("char", ["".join(x).encode("utf-8", "ignore") for x in zip(*parts)], np.full(len(keys), 4), self.dim)

    def _some(self, lines: list[str]) -> np.ndarray:
        """Sums of a few texts, whose characters and words are numbered anew if too many are held."""
        if len(self.names) > self.WORDS or len(self.signs) > self.SIGNS // 2:
            self.__init__(self.dim)
        found = {kind: [] for kind in PRIORS}
        odd = []
        for line in lines:
            words, runs = self._words(line), self._runs(line)
            if runs is None:
                odd.append(len(found["char"]))
                runs = np.empty(0, "u8")
            found["word"].append(counted(words))
            found["bigram"].append(counted(words[:-1] << np.uint64(32) | words[1:]))
            found["char"].append(counted(runs))
        out = np.zeros(len(lines) * self.dim)
        for kind, made in found.items():
            keys, n = (np.concatenate(x) for x in zip(*made))
            if not len(keys):
                continue
            if kind == "word":
                new = self.names[len(self.bucket) :]
                bucket, weight = hashed(kind, new, list(map(len, new)), self.dim)
                self.bucket, self.weight = np.concatenate([self.bucket, bucket]), np.concatenate([self.weight, weight])
                bucket, weight = self.bucket[keys.astype("i8")], self.weight[keys.astype("i8")]
            elif kind == "bigram":
                bucket, weight = self.bigram.get(keys, self._bigrams)
            else:
                bucket, weight = self.char.get(keys, self._fours)
            row = np.repeat(np.arange(len(lines)), [len(k) for k, _ in made])
            out += np.bincount(row * self.dim + bucket, weight * (1 + np.log(n)), len(out))
        out = out.reshape(len(lines), self.dim)
        for k in odd:  # its runs by their names
            runs = features(lines[k])["char"]
            bucket, weight = hashed("char", [x.encode("utf-8", "ignore") for x in runs], np.full(len(runs), 4), self.dim)
            out[k] += np.bincount(bucket, weight * (1 + np.log(list(runs.values()))), self.dim)
        return out

    def embed(self, texts: list[str]) -> np.ndarray:
        """Unit vectors (float32) of texts; zeros for blank ones."""
        out, lines, size = [], [], 0
        for k, t in enumerate(texts):
            lines.append(normal(t))
            size += len(lines[-1])
            if size > self.CHARS or k == len(texts) - 1:
                v = self._some(lines)
                out.append((v / np.maximum(np.linalg.norm(v, axis=1), 1e-12)[:, None]).astype("f4"))
                lines, size = [], 0
        return np.concatenate(out) if out else np.zeros((0, self.dim), "f4")


_held: dict[int, Buckets] = {}


def embedded(texts: list[str], dim: int = 1024) -> np.ndarray:
    if dim not in _held:
        _held[dim] = Buckets(dim)
    return _held[dim].embed(texts)


def embed_one(text: str, dim: int = 1024) -> np.ndarray:
    return embedded([text], dim)[0]


def embed(text: Column, dim: int = 1024) -> Column:
    @F.pandas_udf(ArrayType(FloatType()))
    def run(s):
        return pd.Series(list(embedded([x or "" for x in s], dim)), dtype=object)

    return run(text)


def with_embedding(df: DataFrame, text: str, dim: int = 1024, out: str = "vector") -> DataFrame:
    return df.withColumn(out, embed(F.col(text), dim))
