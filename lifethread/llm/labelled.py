"""Bounded samples of labelled documents, and logistic regression on what is gathered from them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lifethread.runtime import materialize


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, where: Column | None = None) -> DataFrame:
    """(doc_id, text, y) of at most ``max_rows`` labelled ids, the first by a hash of the id, as a stored table.

    An id labelled twice counts once with its largest label; null ids and labels are left out. Only the ids are bounded: every row of
    ``documents`` with such an id is taken, with its whole text. The ids are at most ``max_rows`` rows, which is what may be broadcast.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    known = known.dropna().filter(F.lit(True) if where is None else where).groupBy("doc_id").agg(F.max("y").alias("y"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialize(rows.join(F.broadcast(picked), "doc_id").select("doc_id", "text", "y"), "labelled")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_line(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and intercept of P(y = 1 | x) by Newton's method with a weak prior; one class or no rows give slope 0 and a smoothed share."""
    share = (y.sum() + 1) / (len(y) + 2)
    if len(np.unique(y)) < 2 or np.ptp(x) == 0:
        return 0.0, float(np.log(share / (1 - share)))
    scale = x.std()
    a = np.stack([x / scale, np.ones(len(x))], 1)
    w = np.array([0.0, np.log(share / (1 - share))])
    for _ in range(rounds):
        p = sigmoid(a @ w)
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2), a.T @ (y - p) - 1e-3 * w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])
