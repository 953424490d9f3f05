"""Vectors as arrays of numbers."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

#: Queries of one pass over a table, at most: their vectors go to every task.
BLOCK = 1024


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision, in order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 for empty vectors, unequal lengths and zero norms."""
    ok = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm(a) > 0) & (norm(b) > 0)
    return F.when(ok, dot(a, b) / (norm(a) * norm(b))).otherwise(F.lit(0.0))


def l2_normalize(a: Column) -> Column:
    """Unit length; a zero vector stays."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def query_blocks(queries: DataFrame, size: int | None = None) -> Iterator[list[Row]]:
    """The rows of a query set, at most ``size`` (BLOCK) on the driver at a time."""
    rows = queries.toLocalIterator()
    while block := list(islice(rows, size or BLOCK)):
        yield block


def matrix(column: pa.Array | list, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, unit vectors) of the vectors that have ``width`` numbers and are not zero; others are left out."""
    rows = [(i, v) for i, v in enumerate(column.to_pylist() if isinstance(column, pa.Array) else column) if v is not None and len(v) == width and None not in v]
    m = np.array([v for _, v in rows], np.float64).reshape(len(rows), width)
    length = np.sqrt((m * m).sum(axis=1))
    some = length > 0
    return np.array([i for i, _ in rows], np.int64)[some], m[some] / length[some, None]


def cosines(queries: DataFrame, rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(a, b, cosine) of every query a with every other row b: a matrix product for each Arrow batch and block of queries.

    Pairs without a cosine (null or zero vectors, other lengths) have 0.  Only the blocks' vectors go to the driver.
    """
    kind = dict(rows.dtypes)[key]
    schema = f"a {kind}, b {kind}, cosine double"

    def against(block: list[Row]) -> DataFrame:
        ids = [r[key] for r in block]
        width = max((len(r[vector]) for r in block if r[vector] is not None), default=0)
        at, q = matrix([r[vector] for r in block], width)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in range(0, batch.num_rows, 1000):
                    part = batch.slice(start, 1000)
                    i, m = matrix(part.column(1), width)
                    out = np.zeros((len(ids), part.num_rows))
                    out[np.ix_(at, i)] = q @ m.T
                    a = np.repeat(np.arange(len(ids)), part.num_rows)
                    b = part.column(0).take(pa.array(np.tile(np.arange(part.num_rows), len(ids))))
                    a = pa.array(ids, b.type).take(pa.array(a))
                    yield pa.RecordBatch.from_arrays([a, b, pa.array(out.ravel())], ["a", "b", "cosine"])

        return rows.select(key, vector).mapInArrow(run, schema).where("a <> b")

    parts = [against(block) for block in query_blocks(queries.select(key, vector))]
    return reduce(DataFrame.unionByName, parts) if parts else rows.sparkSession.createDataFrame([], schema)
