"""Connected components of an edge table, and tables written to the shared folder to cut lineage."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.idstore import shared_dir


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: what reads it survives a lost executor and does not compute it again."""
    path = shared_dir(spark, name)
    df.write.parquet(path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()  # lets Spark remove shuffle files of what came before
    return spark.read.parquet(path)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(spark: SparkSession, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component): for each id of an edge (a, b) that is not the smallest of its component, that smallest id.

    Alternating large and small stars: the number of rounds grows with the logarithm of the number of ids, and
    no task holds a component.  Loops and repeated edges do no harm; an empty table gives an empty one.
    """
    now = written(spark, edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    sign = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = sign(now)
    for _ in range(rounds):
        if before[0] == 0:
            break
        now = written(spark, _small_star(_large_star(now)), "edges")
        after = sign(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component"))
