"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm.idstore import shared_dir


class Scratch:
    """Tables of one job.  Writing one cuts its lineage: a lost executor costs the tasks of the step at hand only."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, shared_dir(spark, name)

    def put(self, df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{self.root}/{name}")
        return self.spark.read.parquet(f"{self.root}/{name}")

    def drop(self, name: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
