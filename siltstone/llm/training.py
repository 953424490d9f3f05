"""Labelled rows for the classifiers: a fixed fifth of the documents is held out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def training_labels(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, y double) of the labelled rows that are not held out; null labels and ids are left out, repeated rows count once."""
    rows = labels.select("doc_id", F.col(column).cast("double").alias("y")).where("doc_id is not null and y is not null")
    return rows.where(~held_out()).groupBy("doc_id").agg(F.max("y").alias("y"))
