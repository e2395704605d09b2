"""Logistic regression for one process, and bounded samples of labelled texts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._frames import column, text_or_empty


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, rows: np.ndarray | None = None, ridge: float = 0.3, steps: int = 200) -> np.ndarray:
    """Weights and, last, the intercept, by accelerated gradient steps of fixed length.

    ``rows`` (rows by fits, 0 or 1) says which rows each fit uses; the fits run together and
    are the result's columns.  Without it there is one fit, of all rows.
    """
    one = rows is None
    rows = np.ones((len(x), 1), dtype=np.float32) if one else rows.astype(np.float32)
    x = np.hstack([x, np.ones((len(x), 1))]).astype(np.float32)
    y = y.astype(np.float32)[:, None]
    w = np.zeros((x.shape[1], rows.shape[1]), dtype=np.float32)
    penalty = np.full((x.shape[1], 1), ridge, dtype=np.float32)
    penalty[-1] = 1e-3
    if len(y):
        # The largest curvature, by a few power iterations.
        v = np.ones(x.shape[1], dtype=np.float32)
        for _ in range(8):
            v = x.T @ (x @ v)
            v /= np.linalg.norm(v)
        rate = np.float32(1 / (0.25 * float(v @ (x.T @ (x @ v))) * 1.1 + ridge))
        z, t = w.copy(), 1.0
        for _ in range(steps):
            g = x.T @ (rows * (sigmoid(x @ z) - y)) + penalty * z
            new = z - rate * g
            t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
            z = new + np.float32((t - 1) / t2) * (new - w)
            w, t = new, t2
    for k in range(w.shape[1]):  # one class only
        held = y[rows[:, k] > 0]
        if not len(held) or held.min() == held.max():
            w[:, k] = 0
            w[-1, k] = 8.0 if len(held) and held.min() > 0.5 else -8.0
    w = w.astype(np.float64)
    return w[:, 0] if one else w


def labelled(docs: DataFrame, labels: DataFrame, columns: list[str], most: int, id_col: str = "doc_id", text_col: str = "text", where=None) -> DataFrame:
    """Texts of at most ``most`` labelled rows, those whose ids have the smallest hashes.

    Only the chosen ids (bounded by ``most``) travel to the tasks that read the texts.  Ids
    that are null, or labelled more than once, are left out.
    """
    own = labels.select(column(id_col).alias("_id"), *[column(c).cast("int").alias(c) for c in columns]).where("_id is not null")
    for c in columns:
        own = own.where(F.col(c).isNotNull())
    if where is not None:
        own = own.where(where(F.col("_id")))
    chosen = own.orderBy(F.xxhash64("_id"), "_id").limit(most)
    once = chosen.groupBy("_id").agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in columns]).where("_n = 1").drop("_n")
    texts = docs.select(column(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    return texts.join(F.broadcast(once), "_id")
