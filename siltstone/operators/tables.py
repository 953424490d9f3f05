"""Keyed tables without MERGE: every mutation is a function (current, changes) -> current."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(changes: DataFrame, key: list[str], seq: str, deleted: Column | None = None) -> DataFrame:
    """The last change of each key; keys whose last change deletes are gone."""
    w = Window.partitionBy(*key).orderBy(F.desc(seq))
    rows = changes.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return rows if deleted is None else rows.where(~F.coalesce(deleted, F.lit(False)))


def delete_keys(current: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    return current.join(gone.select(*key).distinct(), key, "left_anti")


def update_coalesce(current: DataFrame, changes: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """New values where they are given, old ones elsewhere; other rows stay."""
    new = changes.select(*key, *(F.col(c).alias(f"_new_{c}") for c in columns))
    rest = [c for c in current.columns if c not in columns]
    return current.join(new, key, "left").select(*rest, *(F.coalesce(f"_new_{c}", c).alias(c) for c in columns))


def incremental(batch: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """The rows whose whole key (ids and skip key) is not yet complete."""
    return batch.join(done.select(*key).distinct(), key, "left_anti")


def memoized(rows: DataFrame, memo: DataFrame, key: list[str], value: str, default: Column) -> DataFrame:
    """``value`` from the memo, ``default`` on a miss, and whether it was a hit."""
    found = memo.select(*key, F.col(value).alias("_memo"))
    return rows.join(found, key, "left").select(*rows.columns, F.coalesce("_memo", default).alias(value), F.col("_memo").isNotNull().alias("hit"))


def upsert_flipped(journal: DataFrame, flips: DataFrame) -> DataFrame:
    """Rows of the same (source, source_id) under another canonical go, the flipped row comes, with the prior id kept."""
    prior = journal.select("source", "source_id", F.col("canonical_id").alias("prior_canonical_id"))
    rows = flips.join(prior, ["source", "source_id"], "left").withColumn("merge_state", F.lit("resolver_flipped"))
    rest = journal.join(flips.select("source", "source_id").distinct(), ["source", "source_id"], "left_anti")
    return rest.unionByName(rows, allowMissingColumns=True)
