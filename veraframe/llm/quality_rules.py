"""Operator 8, quality rules: exact counts, and a calibrated classifier of hashed word and character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_place, table, text_of
from .words import Features, labelled, margin, probability, scored, train

#: Folds of crc32(doc_id) mod 3: for the weights, and for the calibration; the most labelled rows for each.
LEARNT, CALIBRATED, MOST_ROWS = (0,), (2,), 8_000
FEATURES = Features(bits=18, words=2, chars=4)
#: Least calibrated probability of label 1 that keeps a document.
THRESHOLD = 0.5
_SYMBOLS = b"#*$%&|<>"
_WINDOW = 5


@dataclass(frozen=True)
class Verdict:
    """Weights, and the line by which a margin becomes a probability."""

    weights: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def __call__(self, m: float) -> float:
        return float(probability(self.slope * m + self.shift))


def calibrate(m: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift of Platt's logistic curve, with his smoothed targets; (1, 0) if a label is missing."""
    ones = int(y.sum())
    if not 0 < ones < len(y):
        return 1.0, 0.0
    t = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (len(y) - ones + 2))
    x, w = np.column_stack([m, np.ones(len(m))]), np.array([1.0, 0.0])
    for _ in range(rounds):
        p = probability(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (p - t))
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def fit_rules(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MOST_ROWS) -> Verdict:
    """Learnt from one fold of labelled rows and calibrated on another, at most ``most`` rows of each."""
    w = train(labelled(docs, labels, label, LEARNT, most), FEATURES)
    # Two numbers a row, at most ``most`` rows.
    rows = scored(labelled(docs, labels, label, CALIBRATED, most).select("text", "y"), w, FEATURES).select("margin", "y").collect()
    return Verdict(w, *calibrate(np.array([r["margin"] for r in rows]), np.array([r["y"] for r in rows], int)))


def counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at ASCII white space only
    n = len(words)
    chars = len(text) - (len(raw) - sum(map(len, words)))
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()] if b"\n" in raw else []
    repeats = 0
    if n > _WINDOW:
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
        w = np.zeros(n - _WINDOW + 1, np.uint64)
        for i in range(_WINDOW):
            w = (w ^ h[i : n - _WINDOW + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            w ^= w >> np.uint64(32)
        order = np.sort(w)
        twice = order[1:][order[1:] == order[:-1]]
        if len(twice):
            at = np.zeros(n + 1, np.int64)
            hit = np.flatnonzero(np.isin(w, twice))
            np.add.at(at, hit, 1)
            np.add.at(at, hit + _WINDOW, -1)
            repeats = int((np.cumsum(at[:-1]) > 0).sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeats


def apply_rules(docs: DataFrame, verdict: Verdict, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The counts of each whole text, base_failed, the calibrated probability and kept.

    Null and empty texts have no words, so they fail the base rules. Null and repeated ids get a row each; extra
    columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(verdict)  # its size is fixed

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, v = Features(FEATURES.bits, FEATURES.words, FEATURES.chars), sent.value
        for b in batches:
            rows = []
            for t in b.column(1).to_pylist():
                n, chars, symbols, dup, repeat = counts(t)
                failed = n < 10 or 100 * repeat > 20 * n
                p = v(margin(v.weights, *features(t)))
                rows.append((n, chars, symbols, dup, repeat, failed, p, not failed and p >= threshold))
            cols = list(zip(*rows, strict=True)) or [()] * 8
            types = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], [b.schema.names[0], "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "probability", "kept"])

    d, (i, t) = by_place(docs, id_col, text_col)
    rows = d.select(F.col(i).alias(id_col), text_of(t).alias("_text"))
    kind = dict(rows.dtypes)[id_col]
    return rows.mapInArrow(judge, f"`{id_col}` {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, probability double, kept boolean")


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Rules and verdict for every document."""
    docs = table(spark, sf_dir, "documents")
    return apply_rules(docs, fit_rules(docs, table(spark, sf_dir, "labels")))
