"""Hashed n-gram features and logistic regression with follow-the-regularised-leader updates."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import by_place

#: A token of a text: letters, digits, or other signs; white space is not part of any.
TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
#: Names a worker's cache holds; it is emptied when full.
CACHE = 500_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


class Features:
    """The hashed n-grams of a text, as distinct indices and values of unit length.

    Word n-grams up to ``words``: letters keep their case, digits and signs are tokens of their own, and a token equal
    to the one before is written as a repeat, which makes stuttering a feature. With ``chars`` also byte n-grams of
    that length. Values are square roots of counts, scaled so that a text's length doesn't matter; the two kinds
    weigh the same.
    """

    def __init__(self, bits: int = 18, words: int = 2, chars: int = 0):
        self.bits, self.words, self.chars, self.known = bits, words, chars, {}

    def _tokens(self, text: str) -> np.ndarray:
        found, known = TOKEN.findall(text), self.known
        if len(known) > CACHE:
            known.clear()
        for t in set(found).difference(known):
            known[t] = xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass"))
        h = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
        if len(h) > 1:
            h[1:][h[1:] == h[:-1]] = np.uint64(7)
        return h

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        text, parts = text or "", []
        h = self._tokens(text)
        if len(h):
            grams = [h]
            for k in range(1, min(self.words, len(h))):
                grams.append(_mix(grams[-1][:-1] * np.uint64(3) + h[k:]))
            parts.append(np.concatenate(grams))
        if self.chars:
            b = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
            n = len(b) - self.chars + 1
            if n > 0:
                x = np.full(n, 1 + self.chars, np.uint64)
                for i in range(self.chars):
                    x = (x << np.uint64(8)) ^ b[i : i + n]
                parts.append(_mix(x))
        at, values = [], []
        for i, p in enumerate(parts):
            index = (_mix(p + np.uint64(i)) >> np.uint64(64 - self.bits)).astype(np.int64)
            if len(index) > 1 << (self.bits - 2):
                count = np.bincount(index, minlength=1 << self.bits)
                u = np.flatnonzero(count)
                n = count[u]
            else:
                u, n = np.unique(index, return_counts=True)
            x = np.sqrt(n)
            at.append(u)
            values.append(x / np.sqrt(n.sum()))
        if not at:
            return np.empty(0, np.int64), np.empty(0)
        return np.concatenate(at), np.concatenate(values)


class Ftrl:
    """Logistic regression by FTRL-Proximal; the last weight is the bias."""

    def __init__(self, size: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.001, l2: float = 0.01):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, x: np.ndarray, y: int, rate: float) -> None:
        at, x = np.append(at, len(self.z) - 1), np.append(x, 1.0)
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - y) * x * rate
        s = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - s * w
        self.n[at] += g * g


def labelled(docs: DataFrame, labels: DataFrame, label: str, folds: tuple[int, ...], most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, y) of at most ``most`` labelled documents whose crc32(id as text) mod 3 is in ``folds``.

    Which ones is decided by a hash of the id. Ids with contradicting or null labels are left out. The ids are at
    most ``most``, so they are broadcast. Of a repeated id the least text is taken.
    """
    l, (i, y) = by_place(labels, id_col, label)
    l = l.select(F.col(i).alias("_id"), F.col(y).cast("int").alias("y")).where("_id is not null and y in (0, 1)")
    l = l.where(F.pmod(F.crc32(F.col("_id").cast("string").cast("binary")), F.lit(3)).isin(list(folds)))
    l = l.groupBy("_id").agg(F.min("y").alias("y"), F.max("y").alias("_y")).where("y = _y").drop("_y")
    l = l.orderBy(F.xxhash64("_id"), "_id").limit(most)
    d, (i, t) = by_place(docs, id_col, text_col)
    d = d.select(F.col(i).alias("_id"), F.col(t).alias("text"))
    return d.join(F.broadcast(l), "_id").groupBy("_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))


def train(sample: DataFrame, features: Features, shards: int = 2, epochs: int = 4) -> np.ndarray:
    """Weights fitted on ``sample`` (_id, text, y): each shard by hash runs FTRL over its rows, the shards' weights are averaged.

    ``sample`` is bounded by its maker, and a shard returns one array of weights, so the driver gets ``shards`` arrays.
    Rows of the rarer label count for more, by the ratio of the labels, at most 20 times.
    """
    size = 1 << features.bits

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_id")
        rows = [(*features(t), int(y)) for t, y in zip(pdf["text"], pdf["y"], strict=True)]
        ones = sum(y for *_, y in rows)
        model, most = Ftrl(size), max(ones, len(rows) - ones)
        weight = [min(20.0, most / max(1, n)) for n in (len(rows) - ones, ones)]
        for e in range(epochs):
            for i in np.random.default_rng(e).permutation(len(rows)):
                at, x, y = rows[i]
                model.learn(at, x, y, weight[y])
        return pd.DataFrame({"n": [len(rows)], "w": [model.weights().astype("<f4").tobytes()]})

    by = F.pmod(F.xxhash64("_id", F.lit(3)), F.lit(shards))
    got = sample.groupBy(by.alias("shard")).applyInPandas(fit, "n long, w binary").collect()
    if not got:
        return np.zeros(size + 1, np.float32)
    total = sum(r["n"] for r in got)
    return sum(np.frombuffer(r["w"], "<f4") * (r["n"] / total) for r in sorted(got, key=lambda r: (r["n"], bytes(r["w"])))).astype(np.float32)


def margin(w: np.ndarray, at: np.ndarray, x: np.ndarray) -> float:
    return float(w[at] @ x + w[-1])


def scored(docs: DataFrame, w: np.ndarray, features: Features, text_col: str = "text", out: str = "margin") -> DataFrame:
    """``docs`` plus the sparse dot product of each text's features with the weights, which are broadcast (their size is fixed)."""
    sent = docs.sparkSession.sparkContext.broadcast(w)
    place = docs.columns.index(text_col)
    schema = StructType([*docs.schema.fields, StructField(out, DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = Features(features.bits, features.words, features.chars)
        for b in batches:
            got = [margin(sent.value, *mine(t)) for t in b.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.float64())], [*b.schema.names, out])

    return docs.mapInArrow(score, schema)


def probability(m):
    return 1 / (1 + np.exp(-np.clip(m, -30, 30)))
