"""Connected components of an edge table, as rounds of joins."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder name in the folder that all executors share (spark.checkpoint.dir)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, so that what reads it several times does not compute it again."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of an id points to the smallest id around it."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of an id, and the id itself, point to the smallest of them."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id that each end of an edge (a, b) reaches; directions do not matter.

    Large and small stars in turn: after each, an id has an edge to a smaller one only, and rounds grow with the
    logarithm of the ids.  Minima are partial sums and no row is keyed by a component's label, so no task holds
    a component.  Every round is written to the shared folder, which survives a lost executor.
    """
    spark = edges.sparkSession

    def cut(df: DataFrame) -> tuple[DataFrame, tuple]:
        path = shared_dir(spark, "components")
        df.write.parquet(path)
        rows = spark.read.parquet(path)
        return rows, tuple(rows.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now, before = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(rounds):
        new, after = cut(_small_star(_large_star(now)))
        if after == before:
            linked = edges.where("a <> b")
            ends = linked.select(F.col("a").alias("id")).unionByName(linked.select(F.col("b").alias("id"))).distinct()
            return ends.join(new.select(F.col("u").alias("id"), F.col("v").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
        now, before = new, after
    raise RuntimeError("components did not settle")


def collapse_aliases(candidates: DataFrame, edges: DataFrame) -> DataFrame:
    """Components over edges with both ends among a query's candidates; the best candidate stays and lists the others.

    ``candidates``: query_id, canonical_id, score, alias_canonicals (array); ``edges``: canonical_id, target.
    A query has its k candidates only, so one row holds a query and its components are found in place.
    """
    ends = candidates.select("query_id", F.col("canonical_id").alias("target")).distinct()
    within = candidates.select("query_id", "canonical_id").join(edges.distinct(), "canonical_id").join(ends, ["query_id", "target"], "left_semi")
    rows = candidates.join(within, ["query_id", "canonical_id"], "left")
    item = F.struct("canonical_id", "score", "alias_canonicals", "target")
    grouped = rows.groupBy("query_id").agg(F.collect_list(item).alias("items"))
    kinds = dict(candidates.dtypes)
    schema = f"query_id {kinds['query_id']}, canonical_id {kinds['canonical_id']}, score double, alias_canonicals {kinds['alias_canonicals']}"

    def collapse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for query, items in zip(batch["query_id"], batch["items"], strict=True):
                best = {x["canonical_id"]: (-x["score"], x["canonical_id"], list(x["alias_canonicals"])) for x in items}
                root = {c: c for c in best}

                def find(c, root=root):
                    while root[c] != c:
                        root[c] = root[root[c]]
                        c = root[c]
                    return c

                for x in items:
                    if x["target"] in root:
                        root[find(x["target"])] = find(x["canonical_id"])
                parts: dict = {}
                for c in sorted(best.values(), key=lambda b: b[:2]):
                    parts.setdefault(find(c[1]), []).append(c)
                for members in parts.values():
                    lead = members[0]
                    out.append((query, lead[1], -lead[0], list(dict.fromkeys([*lead[2], *(m[1] for m in members[1:])]))))
            yield pd.DataFrame(out, columns=["query_id", "canonical_id", "score", "alias_canonicals"])

    return grouped.mapInPandas(collapse, schema)
