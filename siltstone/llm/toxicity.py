"""Toxicity scores: a linear classifier on character n-grams whose features are scaled by naive Bayes log-count ratios.

N-grams of the lower-cased UTF-8 bytes are hashed.  The classifier is fitted on a bounded sample of labelled
rows (SAMPLE of each class, those with the smallest hash of doc_id), weighted back to the classes' true sizes;
every text is scored whole.  Null and empty texts have no n-gram and get the score of the intercept; with
labels of one class (or none) every score is that class's share (0 if none).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import arrowtext as at
from siltstone.llm.idstore import shared_dir
from siltstone.llm.training import held_out, training_labels

SIZES = (4, 5, 6)
BUCKETS = 1 << 18
#: Labelled rows of each class in the sample at most, and features with the strongest evidence that are kept.
SAMPLE = 8_000
FEATURES = 4_096
SMOOTHING = 1.0
RIDGE = 2e-3
STEPS = 300
THRESHOLD = 0.5


def buckets(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram size: the bucket at each start, and the starts whose n-gram crosses no text's end."""
    low = at.lower_ascii(data)
    low = np.where(at.is_space(low), np.uint8(32), low).astype(np.uint64)
    ends = np.repeat(offsets[1:], np.diff(offsets))
    h = None
    for k in range(max(SIZES)):
        if len(low) <= k:
            return
        h = low.copy() if h is None else h[:-1] * np.uint64(257) + low[k:]
        if k + 1 in SIZES:
            valid = np.arange(len(h)) + k + 1 <= ends[: len(h)]
            x = (h + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)
            yield (x >> np.uint64(64 - 18)).astype(np.int32), valid


class Model:
    """Weight of each bucket (0 for most) and the intercept."""

    def __init__(self, table: np.ndarray, intercept: float):
        self.table, self.intercept = table, intercept

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        row, bucket = present(data, offsets, self.table != 0)
        total = np.bincount(row, weights=self.table[bucket], minlength=n) + self.intercept
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def present(data: np.ndarray, offsets: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of each chosen bucket that a text has, once each."""
    keys = []
    for bucket, valid in buckets(data, offsets):
        hit = np.flatnonzero(chosen[bucket] & valid)
        keys.append((np.searchsorted(offsets, hit, side="right") - 1) * BUCKETS + bucket[hit])
    key = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
    return key // BUCKETS, key % BUCKETS


def ratios(positive: np.ndarray, negative: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-count ratio of each bucket, and the FEATURES buckets that tell most (by signed likelihood ratio)."""
    p, q = positive + SMOOTHING, negative + SMOOTHING
    r = np.log(p / p.sum()) - np.log(q / q.sum())
    both = positive + negative
    share = positive.sum() / max(both.sum(), 1)
    evidence = (positive - both * share) ** 2 / np.maximum(both * share * (1 - share), 1e-9)
    evidence[both < 5] = 0
    order = np.argsort(-evidence, kind="stable")[:FEATURES]
    return r, order[evidence[order] > 6.0]


def logistic(row: np.ndarray, feature: np.ndarray, value: np.ndarray, y: np.ndarray, weight: np.ndarray, n_features: int) -> tuple[np.ndarray, float]:
    """Weighted logistic regression with a ridge, by accelerated gradient steps with adaptive scaling."""
    w, b = np.zeros(n_features), float(np.log(max(np.average(y, weights=weight), 1e-6) / max(1 - np.average(y, weights=weight), 1e-6)))
    m, v, mb, vb = np.zeros(n_features), np.zeros(n_features), 0.0, 0.0
    weight = weight / weight.sum()
    for t in range(1, STEPS + 1):
        z = np.bincount(row, weights=value * w[feature], minlength=len(y)) + b
        g = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        gw, gb = np.bincount(feature, weights=value * g[row], minlength=n_features) + RIDGE * w, g.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw**2, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        rate = 0.05 / (1 + t / 100) / (1 - 0.9**t) * np.sqrt(1 - 0.999**t)
        w -= rate * m / (np.sqrt(v) + 1e-9)
        b -= rate * mb / (np.sqrt(vb) + 1e-9)
    return w, b


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> Model:
    train = training_labels(labels, "toxic").select("doc_id", (F.col("y") > 0).cast("int").alias("y"))
    totals = {r.y: r.n for r in train.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(totals) < 2:
        rate = 1.0 if 1 in totals else 0.0
        return Model(np.zeros(BUCKETS), 30.0 if rate else -30.0)
    pick = [train.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE) for y in (0, 1)]
    # at most 2 * SAMPLE ids are broadcast
    path = shared_dir(spark, "toxicity")
    docs.join(F.broadcast(pick[0].unionByName(pick[1])), "doc_id").select("doc_id", "text", "y").write.parquet(path)
    sample = spark.read.parquet(path)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for part, data, offsets in at.slices(batch):
                y = np.repeat(np.asarray(part.column(2)), np.diff(offsets))
                for bucket, valid in buckets(data, offsets):
                    for c in (0, 1):
                        total[c] += np.bincount(bucket[valid & (y[: len(bucket)] == c)], minlength=BUCKETS)
        some = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[1, some]), pa.array(total[0, some])], ["bucket", "p", "q"])

    counted = sample.mapInArrow(count, "bucket long, p long, q long").groupBy("bucket").agg(F.sum("p").alias("p"), F.sum("q").alias("q")).toPandas()  # BUCKETS rows at most
    positive, negative = np.zeros(BUCKETS), np.zeros(BUCKETS)
    positive[counted["bucket"]], negative[counted["bucket"]] = counted["p"], counted["q"]
    r, kept = ratios(positive, negative)
    place = np.full(BUCKETS, -1, np.int64)
    place[kept] = np.arange(len(kept))
    chosen = place >= 0

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in at.slices(batch):
                row, bucket = present(data, offsets, chosen)
                cut = np.searchsorted(row, np.arange(part.num_rows + 1))
                ids = place[bucket].astype(np.uint16)
                yield pa.RecordBatch.from_arrays([part.column(2), pa.array([ids[cut[i] : cut[i + 1]].tobytes() for i in range(part.num_rows)], pa.binary())], ["y", "features"])

    rows = sample.mapInArrow(describe, "y int, features binary").toPandas()  # 2 * SAMPLE rows of at most 2 * FEATURES bytes
    if rows.empty:  # no labelled row is among the documents
        return Model(np.zeros(BUCKETS), float(np.log(totals[1] / totals[0])))
    lists = [np.frombuffer(f, np.uint16) for f in rows["features"]]
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    feature = np.concatenate(lists).astype(np.int64) if lists else np.zeros(0, np.int64)
    y = rows["y"].to_numpy(float)
    sizes = {c: max(int((y == c).sum()), 1) for c in (0, 1)}
    weight = np.where(y == 1, totals[1] / sizes[1], totals[0] / sizes[0])
    scale = r[kept]
    w, b = logistic(row, feature, scale[feature], y, weight, len(kept))
    table = np.zeros(BUCKETS)
    table[kept] = w * scale
    return Model(table, b)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Scores every row of ``docs``.  Map only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in at.slices(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.score(data, offsets))], ["doc_id", "score"])

    out = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def toxicity_scores(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Null and empty texts get the intercept's score; repeated rows stay, each with the same score; a null doc_id is
    not held out and takes no label; other columns are ignored; an empty table gives none.
    """
    return score(docs, fit(spark, docs, labels))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
