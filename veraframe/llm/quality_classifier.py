"""Operator 6, quality classifier: hashed word n-grams, logistic regression by FTRL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_place, table
from .words import Features, labelled, scored, train

#: Folds of crc32(doc_id) mod 3 that are learnt from, and the most labelled rows that are.
LEARNT, MOST_ROWS = (0, 2), 12_000
FEATURES = Features(bits=18, words=2)


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MOST_ROWS) -> np.ndarray:
    """Weights learnt from at most ``most`` labelled rows of the learnt folds; all zero where there are none."""
    return train(labelled(docs, labels, label, LEARNT, most), FEATURES)


def classify(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score, predicted for each row of ``docs``.

    Null and empty texts get the score of the bias alone. A null id is not held out. Extra columns are not read, and
    repeated rows get a row each. Without any label to learn from each score is 0.5, and nothing is rejected.
    """
    d, (i, t) = by_place(docs, id_col, text_col)
    rows = scored(d.select(F.col(i).alias("id"), F.col(t).alias("text")), weights, FEATURES)
    held = F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(3)) == 1
    score = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("margin")))))
    return rows.select(F.col("id").alias(id_col), F.coalesce(held, F.lit(False)).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, weights: np.ndarray, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, in their own columns, whose text is not rejected."""
    d, (text,) = by_place(docs, text_col)
    rows = scored(d, weights, FEATURES, text, "_margin")
    return rows.where("_margin >= 0").drop("_margin").toDF(*docs.columns)


def op6_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """A score for every document, learnt from labelled rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return classify(docs, fit_quality(docs, table(spark, sf_dir, "labels")))

