"""What the legs of a search share: ranks, cut-offs on dates, and the best chunks of a block for a group of queries."""

from __future__ import annotations

from datetime import date

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DIGITS = 9
DATES = ("failure_date", "founding_date", "failure_unknown", "founding_unknown")
#: Queries that a task scores at once.
GROUP = 512
_NEVER = -(2**31)


def topk(df: DataFrame, by: str | list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group, with their rank from 1."""
    w = Window.partitionBy(*([by] if isinstance(by, str) else by)).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w).cast("long")).where(F.col(rank) <= k)


def query_group(queries: DataFrame, size: int) -> DataFrame:
    """Adds ``group``, by a hash of query_id: groups have some ``size`` queries each, however many there are."""
    return queries.withColumn("group", F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-queries.count() // size)))).cast("int"))


def dates_of(rows: pa.RecordBatch, dated: list[str]) -> np.ndarray:
    """(4 x chunks) day numbers of failure and founding, and whether they are unknown; nothing where there are no dates."""
    if len(dated) < len(DATES):
        return np.zeros((0, rows.num_rows), np.int32)
    of = [rows.column(rows.schema.get_field_index(c)) for c in DATES]
    days = [np.asarray(c.cast(pa.int32()).fill_null(_NEVER)) for c in of[:2]]
    return np.array([*days, *(np.asarray(c.fill_null(False)).astype(np.int32) for c in of[2:])], np.int32)


def admitted(cutoffs: pa.Array, dates: bytes) -> np.ndarray:
    """(queries x chunks): which chunks a query's cut-off admits: failed since, or with an unknown end founded since, or both unknown."""
    days = np.array([-(2**40) if c is None else (c - date(1970, 1, 1)).days for c in cutoffs.to_pylist()])[:, None]
    every = days < -(2**32)
    if not len(dates):
        if not every.all():
            raise ValueError("a cut-off needs an index with dates")
        return every
    failure, founding, no_failure, no_founding = np.frombuffer(dates, np.int32).reshape(4, -1).astype(np.int64)
    no_failure, no_founding = no_failure > 0, no_founding > 0
    return every | (~no_failure & (failure >= days)) | (no_failure & ~no_founding & (founding >= days)) | (no_failure & no_founding)


def best_of(queries: pa.Array, ids: pa.Array, scores: np.ndarray, allowed: np.ndarray, k: int) -> pa.RecordBatch:
    """The k best chunks of each query (``scores``, ``allowed``: queries x chunks): higher score, then smaller id."""
    keys = ids.to_numpy(zero_copy_only=False)
    place = np.empty(len(keys), np.int64)
    place[np.argsort(keys, kind="stable")] = np.arange(len(keys))
    q_of, c_of = [], []
    for q in range(len(queries)):
        c = np.flatnonzero(allowed[q])
        if len(c) > k:
            s = scores[q, c]
            c = c[s >= np.partition(s, len(s) - k)[len(s) - k]]
            c = c[np.lexsort((place[c], -scores[q, c]))][:k]
        q_of.append(np.full(len(c), q)), c_of.append(c)
    q_at, c_at = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (q_of, c_of))
    return pa.RecordBatch.from_arrays([queries.take(pa.array(q_at)), ids.take(pa.array(c_at)), pa.array(scores[q_at, c_at].astype(np.float64))], ["query_id", "chunk_id", "score"])
