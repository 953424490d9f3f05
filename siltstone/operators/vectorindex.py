"""Exact nearest chunks by lists around centroids.

Chunks are assigned to the nearest of a bounded number of centroids, range-sorted by (list, angle to the centroid, id) and
packed in parts of bounded size, so each part is a thin ring around its centroid, and a list of any size is many parts.
By the triangle inequality a chunk is at least as far from a query as its ring is, so once a query knows k chunks, every
ring that lies further than the k-th of them is skipped.  Nothing is approximate: what is skipped cannot be in the answer.

Queries travel as rows: those that ask for a part follow it in one order and are scored by matrix products of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.vectors import matrix
from siltstone.operators.graph import shared_dir, written
from siltstone.operators.hits import DATES, DIGITS, GROUP, admitted, best_of, dates_of, topk

#: Vectors that the centroids are fitted on, those whose ids have the smallest hashes; centroids at most; chunks of a part at most.
SAMPLE, LISTS, PART = 4096, 256, 4096
#: Sampled vectors for each centroid, and rounds of fitting.
SHARE, ROUNDS = 64, 8
#: Columns of a part, then of a query that asks for it.
MET = ("ids", "vectors", "dates", "query_id", "cutoff", "theta", "embedding")
#: Slack of an angle's and of a score's rounding.
_ANGLE, _SCORE = 1e-7, 1e-8


def fitted(vectors: np.ndarray, lists: int) -> np.ndarray:
    """Unit centroids of unit vectors, by rounds of nearest means from evenly spaced first ones."""
    c = vectors[np.linspace(0, len(vectors) - 1, lists).astype(int)]
    for _ in range(ROUNDS):
        of = np.argmax(vectors @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, of, vectors)
        length = np.sqrt((sums * sums).sum(axis=1))
        c = np.where(length[:, None] > 0, sums / np.maximum(length, 1e-300)[:, None], c)
    return c


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1.0, 1.0))


def _gap(angle: Column, low: Column, high: Column) -> Column:
    """The highest cosine with a query at ``angle`` from the centroid that the ring from ``low`` to ``high`` allows."""
    return F.cos(F.greatest(F.lit(0.0), angle - high - F.lit(_ANGLE), low - angle - F.lit(_ANGLE)))


def build(points: DataFrame, path: str, lists: int | None = None) -> VectorIndex:
    """Writes the index of ``points`` (chunk_id, embedding, DATES if cut-offs are to be asked for).

    The width is the commonest of the sample; vectors of another width, null ones and zero ones are not in the index.
    """
    spark = points.sparkSession
    some = points.where("embedding is not null").select("embedding", F.xxhash64("chunk_id").alias("h")).orderBy("h").limit(SAMPLE).collect()
    widths = sorted(len(r.embedding) for r in some)
    width = max(sorted(set(widths)), key=widths.count) if widths else 0
    _, unit = matrix([r.embedding for r in some], width)
    centroids = fitted(unit, min(lists or max(1, len(unit) // SHARE), LISTS, max(1, len(unit)))) if len(unit) else np.zeros((1, width))
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "list int, vector array<double>").write.parquet(f"{path}/centroids")
    shared = spark.sparkContext.broadcast(centroids)  # LISTS vectors at most
    kinds = dict(points.dtypes)
    dated = [c for c in DATES if c in points.columns]
    columns = ["chunk_id", "embedding", *dated]
    assigned = ", ".join(["list int", "angle double", *(f"{c} {kinds[c]}" for c in columns)])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            at, u = matrix(batch.column(1), c.shape[1])
            if not len(at):
                continue
            cosine = u @ c.T
            of = np.argmax(cosine, axis=1)
            rows = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([pa.array(of, pa.int32()), pa.array(_angle(cosine[np.arange(len(of)), of])), *rows.columns], ["list", "angle", *columns])

    packed = f"list int, part long, n long, low double, high double, ids array<{kinds['chunk_id']}>, vectors binary, dates binary"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, number, held = TaskContext.get().partitionId(), 0, []

        def part() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            angle = np.asarray(rows.column(1))
            _, u = matrix(rows.column(3), shared.value.shape[1])
            values = [[rows.column(0)[0].as_py()], [task << 32 | number], [len(angle)], [float(angle.min())], [float(angle.max())], [rows.column(2).to_pylist()], [u.tobytes()], [dates_of(rows, dated).tobytes()]]
            kinds_of = [pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(rows.column(2).type), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds_of, strict=True)], [c.split()[0] for c in packed.split(", ")])

        for batch in batches:
            lists_of, start = np.asarray(batch.column(0)), 0
            while start < batch.num_rows:
                have = sum(b.num_rows for b in held)
                if have and (have >= PART or held[0].column(0)[0].as_py() != lists_of[start]):
                    yield part()
                    number, held, have = number + 1, [], 0
                stop = min(start + PART - have, int(np.searchsorted(lists_of, lists_of[start], side="right")))
                held.append(batch.slice(start, stop - start))
                start = stop
        if held:
            yield part()

    order = ["list", "angle", "chunk_id"]
    rows = points.where("embedding is not null").select(*columns).mapInArrow(assign, assigned)
    rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pack, packed).write.parquet(f"{path}/parts")
    return VectorIndex(spark, path)


def faults(points: DataFrame, width: int) -> DataFrame:
    """(chunk_id, fault) of the chunks that a table of vectors of ``width`` does not take: missing, or of another width."""
    size = F.size("embedding")
    fault = F.when(F.col("embedding").isNull(), "missing").when(size != width, F.concat(F.lit("width "), size.cast("string")))
    return points.select("chunk_id", fault.alias("fault")).where("fault is not null")


def verified(points: DataFrame, width: int) -> DataFrame:
    """``points``, for a table of vectors of ``width``; a vector of another width ends the query with an error."""
    good = F.when(F.col("embedding").isNull() | (F.size("embedding") == width), True)
    said = F.concat(F.lit(f"a vector of this table has {width} numbers, that of "), F.col("chunk_id").cast("string"), F.lit(" has "), F.size("embedding").cast("string"))
    return points.where(good | F.raise_error(said).cast("boolean"))


def temporary(points: DataFrame) -> VectorIndex:
    """An index in the shared folder, for one job."""
    return build(points, shared_dir(points.sparkSession, "vectors"))


@dataclass
class VectorIndex:
    """``parts``: list, part, n, low and high (angles), ids, vectors, dates; ``centroids``: list, vector."""

    spark: SparkSession
    path: str

    def parts(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/parts")

    @cached_property
    def lists(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(centroids, chunks, lowest and highest angle) of each list: LISTS rows at most."""
        c = np.array([r.vector for r in self.spark.read.parquet(f"{self.path}/centroids").orderBy("list").collect()])
        n, low, high = np.zeros(len(c), np.int64), np.full(len(c), 9.0), np.full(len(c), -9.0)
        for r in self.parts().groupBy("list").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).collect():
            n[r.list], low[r.list], high[r.list] = r.n, r.low, r.high
        return c, n, low, high

    def _pairs(self, asked: DataFrame, k: int, seeds: bool) -> DataFrame:
        """``asked`` with each list that a query has to see: the nearest ones that hold k chunks (``seeds``), or the others that
        may hold a chunk as good as ``theta``; ``angle`` is that between query and centroid."""
        shared = self.spark.sparkContext.broadcast(self.lists)
        kinds = dict(asked.dtypes)
        names = asked.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c, n, low, high = shared.value
            for batch in batches:
                at, u = matrix(batch.column(names.index("embedding")), c.shape[1])
                if not len(at):
                    continue
                angle = _angle(u @ c.T)
                order = np.argsort(angle, axis=1, kind="stable")
                before = np.cumsum(n[order], axis=1) - n[order]
                near = np.zeros(angle.shape, bool)
                np.put_along_axis(near, order, before < k, axis=1)
                if not seeds:
                    theta = np.asarray(batch.column(names.index("theta")))[at]
                    bound = np.cos(np.maximum(0.0, np.maximum(angle - high, low - angle) - _ANGLE))
                    near = ~near & (bound >= theta[:, None] - _SCORE)
                q, of = np.nonzero(near & (n > 0))
                rows = batch.take(pa.array(at[q]))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(of, pa.int32()), pa.array(angle[q, of])], [*names, "list", "angle"])

        return asked.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in names), "list int", "angle double"]))

    def wanted(self, pairs: DataFrame) -> DataFrame:
        """The parts whose ring may hold a chunk as good as a query's ``theta``."""
        rings = self.parts().select("list", "part", "low", "high")
        return pairs.join(rings, "list").where(_gap(F.col("angle"), F.col("low"), F.col("high")) >= F.col("theta") - F.lit(_SCORE)).drop("low", "high")

    def met(self, pairs: DataFrame) -> DataFrame:
        """Each part, and after it the queries that want it, a row each: a part comes once, however many ask for it."""
        asked = self.wanted(pairs).select("list", "part", *MET[3:])
        rows = asked.unionByName(self.parts().select("list", "part", *MET[:3]), allowMissingColumns=True)
        return rows.repartition("list", "part").sortWithinPartitions("list", "part", F.col("vectors").isNull()).select(*MET)

    def _scored(self, pairs: DataFrame, k: int) -> DataFrame:
        """The k best chunks of each part for each query that asks for it, none below the query's ``theta``."""
        kinds = dict(pairs.dtypes) | {"chunk_id": self.parts().schema["ids"].dataType.elementType.simpleString()}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids = m = dates = None
            for batch in batches:
                of = dict(zip(MET, batch.columns, strict=True))
                parts = np.flatnonzero(np.asarray(of["vectors"].is_valid())).tolist()
                for start, stop in zip([-1, *parts], [*parts, batch.num_rows], strict=True):
                    if start >= 0:
                        ids, dates = pa.array(of["ids"][start].as_py(), of["ids"].type.value_type), of["dates"][start].as_py()
                        m = np.frombuffer(of["vectors"][start].as_py()).reshape(len(ids), -1)
                    for i in range(start + 1, stop, GROUP):
                        queries = {c: of[c].slice(i, min(GROUP, stop - i)) for c in MET[3:]}
                        _, q = matrix(queries["embedding"], m.shape[1])
                        scores = np.round(q @ m.T, DIGITS)
                        allowed = admitted(queries["cutoff"], dates) & (scores >= np.asarray(queries["theta"])[:, None])
                        yield best_of(queries["query_id"], ids, scores, allowed, k)

        return self.met(pairs).mapInArrow(run, f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, score double")

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, chunk_id, score, rank): the k chunks of the index with the highest cosine for each query (query_id, embedding,
        cutoff), of those that its cut-off admits; ties go to the smaller id.  Queries without a vector of the index's width have no rows.

        First each query sees its nearest lists, then only those rings that may still hold a better chunk.
        """
        width = self.lists[0].shape[1]
        cutoff = F.col("cutoff") if "cutoff" in queries.columns else F.lit(None).cast("date")
        rows = queries.where(F.coalesce(F.size("embedding") == width, F.lit(False))).select("query_id", cutoff.alias("cutoff"), F.col("embedding"))
        asked = written(rows, "asked")
        first = written(topk(self._scored(self._pairs(asked.withColumn("theta", F.lit(-2.0)), k, True), k), "query_id", [F.desc("score"), F.asc("chunk_id")], k), "nearest")
        theta = first.where(F.col("rank") == k).select("query_id", F.col("score").alias("theta"))
        more = asked.join(theta, "query_id", "left").withColumn("theta", F.coalesce("theta", F.lit(-2.0)))
        rest = self._scored(self._pairs(more, k, False), k)
        return topk(first.drop("rank").unionByName(rest), "query_id", [F.desc("score"), F.asc("chunk_id")], k)
