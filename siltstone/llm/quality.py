"""Quality scores: ridge regression on random Fourier features of document statistics, then isotonic calibration.

The Fourier features approximate a Gaussian kernel.  Each partition sums its part of the normal equations, so
what reaches the driver has the size of the model.  Null and empty texts have the statistics of an empty text
and get a score like any other; with no labels (or one class) the score is the share of label 1, 0.5 if none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import arrowtext as at
from siltstone.llm.idstore import shared_dir
from siltstone.llm.rules import measure
from siltstone.llm.training import held_out, training_labels

N_STATS = 14
N_FOURIER = 192
GAMMA = 0.08
RIDGE = 1e-3
SEED = 20240229
BINS = 2048
THRESHOLD = 0.3
_LOW, _HIGH = -0.5, 1.5


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """N_STATS numbers for each text."""
    m = {k: v.astype(float) for k, v in measure(data, offsets).items()}
    words, lines, chars = np.maximum(m["n_words"], 1), np.maximum(m["n_lines"], 1), np.maximum(m["word_chars"], 1)
    digits = at.sum_by_row((data >= 48) & (data <= 57), offsets)
    pipes = at.sum_by_row(data == 124, offsets)
    stops = at.sum_by_row((data == 46) | (data == 63), offsets)
    commas = at.sum_by_row((data == 44) | (data == 59), offsets)
    wide = at.sum_by_row(data >= 0xC0, offsets)
    return np.stack([
        np.log1p(m["n_words"]), m["word_chars"] / words, np.log1p(m["n_symbols"] / words * 10), m["n_dup_lines"] / lines, m["n_repeat_words"] / words,
        m["n_upper"] / np.maximum(m["n_upper"] + m["n_lower"], 1), np.log1p(m["n_bangs"] / words * 10), np.log1p(digits / chars * 20), np.log1p(pipes / words * 10),
        stops / words * 4, commas / words * 4, np.log1p(words / lines), wide / chars * 4, m["n_controls"] / chars,
    ], axis=1)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and statistics (array<double>) of every row.  Map only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in at.slices(batch):
                x = statistics(data, offsets)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), N_STATS).cast(pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, x array<double>")


class Model:
    """Fourier map, ridge weights and the calibration's steps: all of fixed size."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = mean, scale
        self.frequencies = rng.normal(0, np.sqrt(2 * GAMMA), (N_STATS, N_FOURIER))
        self.phases = rng.uniform(0, 2 * np.pi, N_FOURIER)
        self.weights = np.zeros(N_FOURIER + 1)
        self.knots, self.levels = np.array([_LOW, _HIGH]), np.array([0.5, 0.5])

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([np.sqrt(2 / N_FOURIER) * np.cos(z @ self.frequencies + self.phases), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.features(x) @ self.weights, _LOW, _HIGH)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.knots, self.levels), 0, 1)


def isotonic(at_: np.ndarray, mean: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots and non-decreasing levels."""
    pools: list[list[float]] = []  # level, weight, weighted place
    for x, m, w in zip(at_.tolist(), mean.tolist(), weight.tolist(), strict=True):
        pools.append([m, w, x * w])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            m1, w1, x1 = pools.pop()
            m0, w0, x0 = pools[-1]
            pools[-1] = [(m0 * w0 + m1 * w1) / (w0 + w1), w0 + w1, x0 + x1]
    return np.array([p[2] / p[1] for p in pools]), np.array([p[0] for p in pools])


def _matrix(batch: pa.RecordBatch, column: str = "x") -> np.ndarray:
    lists = batch.column(batch.schema.get_field_index(column))
    return np.asarray(lists.flatten()).reshape(len(lists), N_STATS)


def fit(train: DataFrame) -> Model:
    """``train`` has x and y; every row is used."""
    stats = train.select(*(F.col("x")[i].alias(f"x{i}") for i in range(N_STATS)), "y")
    row = stats.agg(F.count("*").alias("n"), F.avg("y").alias("y"), *(F.avg(f"x{i}").alias(f"m{i}") for i in range(N_STATS)), *(F.stddev_pop(f"x{i}").alias(f"s{i}") for i in range(N_STATS))).first()
    n = row["n"]
    if not n:
        return Model(np.zeros(N_STATS), np.ones(N_STATS))
    model = Model(np.array([row[f"m{i}"] for i in range(N_STATS)]), np.array([row[f"s{i}"] or 1.0 for i in range(N_STATS)]))
    if row["y"] in (0.0, 1.0):
        model.levels = np.full(2, row["y"])
        return model
    size = N_FOURIER + 1

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size + 1))
        for batch in batches:
            z, y = model.features(_matrix(batch)), np.asarray(batch.column(1))
            total[:, :size] += z.T @ z
            total[:, size] += z.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.FixedSizeListArray.from_arrays(pa.array(total.ravel()), size + 1).cast(pa.list_(pa.float64()))], ["i", "row"])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": group["i"].iloc[:1].to_numpy(), "row": [np.sum(np.stack(group["row"].to_list()), axis=0)]})

    rows = train.select("x", "y").mapInArrow(partial, "i long, row array<double>").groupBy("i").applyInPandas(add, "i long, row array<double>").collect()
    total = np.array([r["row"] for r in sorted(rows, key=lambda r: r["i"])])
    model.weights = np.linalg.solve(total[:, :size] + RIDGE * n * np.eye(size) / size, total[:, size])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.raw(_matrix(batch))
            bins = np.minimum(((s - _LOW) / (_HIGH - _LOW) * BINS).astype(np.int64), BINS - 1)
            yield pa.RecordBatch.from_arrays([pa.array(bins), pa.array(s), batch.column(1)], ["bin", "s", "y"])

    bins = train.select("x", "y").mapInArrow(placed, "bin long, s double, y double").groupBy("bin").agg(F.avg("s").alias("s"), F.avg("y").alias("y"), F.count("*").alias("w")).orderBy("bin").collect()
    # two weak rows at the mean keep the ends off 0 and 1
    mean = row["y"]
    model.knots, model.levels = isotonic(np.array([b["s"] for b in bins]), np.array([(b["y"] * b["w"] + mean * 0.02) / (b["w"] + 0.02) for b in bins]), np.array([b["w"] for b in bins], float))
    return model


def score(stats: DataFrame, model: Model) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(_matrix(batch)))], ["doc_id", "score"])

    out = stats.select("doc_id", "x").mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def quality_scores(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.  Texts are read once: their statistics are written to the shared folder.

    Null and empty texts have statistics of 0; repeated rows stay, each with the same score; a null doc_id is not
    held out and takes no label; without labels every score is 0.5, with labels of one class that class; other
    columns are ignored; an empty table gives none.
    """
    path = shared_dir(spark, "quality")
    measured(docs).write.parquet(path)
    stats = spark.read.parquet(path)
    train = stats.join(training_labels(labels, "quality"), "doc_id").select("x", "y")
    return score(stats, fit(train))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
