"""Labelled samples, held-out folds and calibration that both classifiers share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds (null ids: null)."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def labelled_sample(labels: DataFrame, label: str, folds: int, held_out: int, max_rows: int) -> DataFrame:
    """(doc_id, y) of at most about max_rows labelled documents outside the held-out fold.

    One row a document: repeats of a label are averaged, half counts as 1.  The
    sample is by a hash of the id, so it is the same whatever the partitions.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold(F.col("doc_id"), folds) != held_out))
    one = usable.groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("double").alias("y"))
    n = one.count()
    if n <= max_rows:
        return one
    return one.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000)) < int(1_000_000 * max_rows / n))


def isotonic(x: np.ndarray, total: np.ndarray, positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the increasing step fit of positive / total over sorted x (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for a, n, p in zip(x.tolist(), total.tolist(), positive.tolist()):
        blocks.append([a * n, n, p])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [u + v for u, v in zip(blocks[-1], last)]
    return np.array([b[0] / b[1] for b in blocks]), np.array([b[2] / b[1] for b in blocks])
