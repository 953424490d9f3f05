"""Incremental ingest: a stream of documents merged into a keyed table, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.hashing import joined_key
from siltstone.operators.graph import shared_dir
from siltstone.operators.tables import incremental, latest

CHANGE = "source string, source_id string, skip_key string, n_chars long, seq long"


def merge_batch(spark: SparkSession, log: str, batch: DataFrame, epoch: int) -> None:
    """Appends the rows of a batch that are new or changed; a batch that is run again replaces its own rows."""
    rows = batch.select("source", F.col("doc_id").cast("string").alias("source_id"), joined_key(F.col("doc_id"), F.sha2("text", 256)).alias("skip_key"), F.col("n_chars"), F.lit(epoch).cast("long").alias("seq"))
    done = spark.read.schema(CHANGE).option("basePath", log).parquet(log) if _exists(spark, log) else spark.createDataFrame([], CHANGE)
    fresh = incremental(rows, done.where(F.col("seq") < epoch), ["source", "source_id", "skip_key"])
    fresh.write.mode("overwrite").parquet(f"{log}/batch={epoch}")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def ingest_documents(spark: SparkSession, d: str) -> DataFrame:
    """Runs the stream over what is there and gives the current table (last change of each key)."""
    root = shared_dir(spark, "stream")
    source = spark.read.parquet(f"{d}/documents.parquet")
    stream = spark.readStream.schema(source.schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/documents.parquet*")
    run = stream.writeStream.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True)
    run.foreachBatch(lambda batch, epoch: merge_batch(spark, f"{root}/log", batch, epoch)).start().awaitTermination()
    log = spark.read.schema(CHANGE).option("basePath", f"{root}/log").parquet(f"{root}/log")
    return latest(log.select("source", "source_id", "skip_key", "n_chars", "seq"), ["source", "source_id"], "seq")
