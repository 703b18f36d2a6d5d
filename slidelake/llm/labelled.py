"""A bounded sample of labelled documents, and the small models fitted to it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remainder

#: Learning uses ids whose crc32 modulo this is not 0.
FOLDS = 5


def fold_of(labels: DataFrame) -> DataFrame:
    """The labels that may be learned from. Whatever is fitted starts here, so no figure depends on a held-out label."""
    return labels.where(remainder(F.col("doc_id"), FOLDS) != 0)


def shares_of(labels: DataFrame, label: str) -> dict[int, int]:
    """How many ids have each label in the learning fold; ids labelled twice count once, by their larger label."""
    own = fold_of(labels).select("doc_id", F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    own = own.groupBy("doc_id").agg(F.max("y").alias("y"))
    return {r.y: r.c for r in own.groupBy("y").agg(F.count(F.lit(1)).alias("c")).collect()}


def sample_of(docs: DataFrame, labels: DataFrame, label: str, most_each: int) -> DataFrame:
    """(doc_id, y, text) of at most most_each documents per label value, of those that may be learned from.

    Ids are taken in the order of a hash, so the sample does not depend on partitions. Ids labelled twice count by their
    larger label; rows with a null id or label are left out. The ids are bounded and broadcast.
    """
    own = labels.select(F.col("doc_id").alias("l_id"), F.col(label).cast("int").alias("y")).where(F.col("y").isNotNull() & F.col("l_id").isNotNull())
    own = own.groupBy("l_id").agg(F.max("y").alias("y")).where(remainder(F.col("l_id"), FOLDS) != 0)
    part = [own.where(F.col("y") == v).orderBy(F.xxhash64("l_id"), "l_id").limit(most_each) for v in (0, 1)]
    ids = part[0].unionByName(part[1])
    return docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("l_id")).select("doc_id", "y", "text")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, weight: np.ndarray | None = None, rounds: int = 50) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last coefficient is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, c = np.zeros(x.shape[1]), np.ones(len(x)) if weight is None else weight
    pull = np.full(x.shape[1], ridge)
    pull[-1] = 1e-3
    for _ in range(rounds):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (c * p * (1 - p))[:, None]).T @ x + np.diag(pull), x.T @ (c * (y - p)) - pull * w)
        w = w + step / max(1.0, np.abs(step).max() / 4)
        if np.abs(step).max() < 1e-6:
            break
    return w
