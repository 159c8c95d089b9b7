"""Quality classifier: random Fourier features of document statistics.

Statistics of the whole text (sizes, shares of character kinds, repetition) are
standardised and mapped by random Fourier features, which approximate a Gaussian
kernel.  Ridge scores come from the normal equations, summed over the partitions
by Spark, for each of ``PARTS`` parts of the sample.  Each part is scored by the sums of
the others, and an isotonic fit on these scores of rows left out calibrates the model
of all parts.

The fit uses at most ``MAX_LABELLED`` labelled rows (by a hash of the id); scoring
covers every row.  Labels, lang, source and doc_id are no inputs of a score.
Defined results: null and empty texts are scored by their (zero) statistics; with
no labelled rows, or one class only, the score is the smoothed share of label 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table
from .learning import fold, isotonic, labelled_sample

#: Bound of the labelled rows of a fit.
MAX_LABELLED = 20_000
FEATURES = 384
RIDGE = 1e-3
#: Parts of the labelled rows, each left out once for calibration.
PARTS = 4
#: Held-out rows are those with fold HELD_OUT of FOLDS.
FOLDS, HELD_OUT = 5, 0
STATISTICS = 22
_KINDS = np.zeros((7, 256), np.float64)
_KINDS[0, [*range(ord("A"), ord("Z") + 1)]] = 1
_KINDS[1, [*range(ord("a"), ord("z") + 1)]] = 1
_KINDS[2, [*range(ord("0"), ord("9") + 1)]] = 1
_KINDS[3, list(b"#*$%&|<>{}[]\\^~_=+@/")] = 1
_KINDS[4, list(b".,;:!?'\"()-")] = 1
_KINDS[5, 128:] = 1
_KINDS[6, list(b" \t\n\x0b\x0c\r")] = 1


def statistics(text: str | None) -> list[float]:
    """STATISTICS numbers about a text."""
    data = (text or "").encode()
    words = data.split()
    n = len(words)
    if not n:
        return [0.0] * STATISTICS
    bytes_of = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    share = bytes_of[bytes_of > 0] / len(data)
    kinds = _KINDS @ bytes_of / len(data)
    sizes = np.fromiter(map(len, words), np.int64, n)
    low = data.lower().split()
    counts: dict[bytes, int] = {}
    for w in low:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in data.split(b"\n") if x.strip()]
    same = sum(map(bytes.__eq__, low, low[1:]))
    return [
        np.log1p(n), np.log1p(len(data)), float(sizes.mean()), float(sizes.std()), np.log1p(float(sizes.max())),
        len(counts) / n, max(counts.values()) / n, same / n, len(set(zip(low, low[1:], low[2:]))) / max(1, n - 2),
        1 - len(set(lines)) / max(1, len(lines)), np.log1p(n / max(1, len(lines))),
        *kinds.tolist(), float(-(share * np.log2(share)).sum()), bytes_of[ord("!")] / n, float((sizes == 1).mean()), float((sizes >= 20).mean()),
    ]


def _stats_of(few: pa.RecordBatch, column: int) -> np.ndarray:
    return np.array([statistics(t) for t in few.column(column).to_pylist()], np.float64).reshape(-1, STATISTICS)


class Model:
    """Standardisation, random features, weights and calibration."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray):
        rng = np.random.default_rng(5)
        self.mean, self.scale = mean, scale
        self.directions = rng.normal(size=(STATISTICS, FEATURES)) / np.sqrt(STATISTICS)
        self.phases = rng.uniform(0, 2 * np.pi, FEATURES)
        self.weights = np.zeros(FEATURES + 1)
        self.knots: tuple[np.ndarray, np.ndarray] = (np.zeros(1), np.full(1, 0.5))

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -6, 6)
        return np.c_[np.sqrt(2 / FEATURES) * np.cos(z @ self.directions + self.phases), np.ones(len(z))]

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), *self.knots)


def ridge_weights(gram: np.ndarray, n: int) -> np.ndarray:
    """The solution of summed normal equations [X'X | X'y]; the constant is hardly held back."""
    ridge = RIDGE * n * np.eye(len(gram))
    ridge[-1, -1] = 1e-9 * max(n, 1)
    return np.linalg.solve(gram[:, :-1] + ridge, gram[:, -1])


def _summed(group: pa.Table) -> pa.Table:
    sums = np.sum(group["sums"].to_pylist(), axis=0)
    return pa.table({"i": group["i"].slice(0, 1), "sums": pa.array([sums], pa.list_(pa.float64()))})


def _labelled_statistics(documents: DataFrame, sample: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                few = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays([few.column(1), few.column(2), pa.array(list(_stats_of(few, 0)), pa.list_(pa.float64()))], names=["y", "part", "stats"])

    rows = documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # MAX_LABELLED rows of two numbers
    part = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(PARTS)).cast("int").alias("part")
    return rows.select("text", "y", part).mapInArrow(run, "y double, part int, stats array<double>")


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """The model from labelled rows outside the held-out fold."""
    rows = cut(_labelled_statistics(documents, labelled_sample(labels, label, FOLDS, HELD_OUT, MAX_LABELLED)))
    each = rows.select(F.posexplode("stats").alias("i", "v")).groupBy("i").agg(F.avg("v"), F.stddev_pop("v")).collect()
    mean, scale = np.zeros(STATISTICS), np.ones(STATISTICS)
    for i, a, b in each:
        mean[i], scale[i] = a, b or 1.0
    model = Model(mean, scale)
    n, positive = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    model.knots = (np.zeros(1), np.full(1, (positive + 1) / (n + 2)))
    if not 0 < positive < n:
        return model

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = np.zeros((PARTS, FEATURES + 1, FEATURES + 2))
        for batch in batches:
            x = model.features(np.array(batch.column("stats").to_pylist(), np.float64).reshape(-1, STATISTICS))
            both, part = np.c_[x, batch.column("y").to_numpy()], batch.column("part").to_numpy()
            for p in range(PARTS):
                gram[p] += x[part == p].T @ both[part == p]
        place = np.arange(PARTS * (FEATURES + 1), dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(list(gram.reshape(len(place), -1)), pa.list_(pa.float64()))], names=["i", "sums"])

    parts = rows.coalesce(8).mapInArrow(sums, "i int, sums array<double>")  # MAX_LABELLED rows
    total = parts.groupBy("i").applyInArrow(_summed, "i int, sums array<double>")  # eight rows an i
    gram = np.zeros((PARTS * (FEATURES + 1), FEATURES + 2))
    for r in total.toLocalIterator():  # PARTS times FEATURES squared numbers
        gram[r["i"]] = r["sums"]
    gram = gram.reshape(PARTS, FEATURES + 1, FEATURES + 2)
    model.weights = ridge_weights(gram.sum(axis=0), n)
    left_out = [ridge_weights(gram.sum(axis=0) - gram[p], n) for p in range(PARTS)]

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = model.features(np.array(batch.column("stats").to_pylist(), np.float64).reshape(-1, STATISTICS))
            raw = (x * np.array(left_out)[batch.column("part").to_numpy()]).sum(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(np.clip(np.floor(raw * 500), -500, 1000).astype(np.int32)), batch.column("y")], names=["bin", "y"])

    bins = rows.mapInArrow(binned, "bin int, y double").groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("p")).orderBy("bin").collect()
    x = np.array([(b["bin"] + 0.5) / 500 for b in bins])
    total_n, total_p = np.array([float(b["n"]) for b in bins]), np.array([b["p"] for b in bins])
    knots, heights = isotonic(x, total_n, total_p)
    model.knots = (knots, np.clip(heights, 1 / (n + 2), 1 - 1 / (n + 2)))
    return model


def score(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                few = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays([few.column(0), pa.array(shared.value.score(_stats_of(few, 1)))], names=["doc_id", "score"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    documents = table(spark, sf_dir, "documents")
    scored = score(documents, fit(documents, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
