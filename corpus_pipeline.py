"""Corpus pipeline: stages over the documents table, each written and read again as the next one's input.

Every stage takes and returns the columns of its input, whatever they are (the last returns ids and digests).
Repeated rows: the rules, the substrings and the mixing treat each row by itself; of rows that repeat a doc_id
near-dedup keeps one, by a stated order.  Rows with a null doc_id have no identity and end at near-dedup.  Empty tables give
empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.bpe import bpe_encode
from siltstone.llm.idstore import shared_dir
from siltstone.llm.mixing import mixed
from siltstone.llm.neardup import near_duplicates
from siltstone.llm.rules import kept_documents
from siltstone.llm.substrings import PASSAGE, repeated_substrings

#: Copies of a document that mixing may make, at most.
MOST = 1.0


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality policy keeps."""
    return kept_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near-duplicates (five words, 0.8).

    Of rows that repeat a doc_id stays the one with the smallest text (none before all others), then the smallest rest of the row as JSON.
    """
    kept = near_duplicates(spark, docs).where("kept").select("doc_id").distinct()
    # always by a shuffle: the ids grow with the documents
    rows = docs.join(kept.hint("merge"), "doc_id", "left_semi")
    rest = F.to_json(F.struct(*(c for c in docs.columns if c not in ("doc_id", "text"))))
    return rows.groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.struct("text", rest.alias("rest"))).alias("one")).select("one.*")


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of repeated strings of a passage's length; a document of which nothing is left goes.  n_chars follows the text."""
    left = repeated_substrings(spark, docs, length=PASSAGE, keep_rows=True).where("n_bytes = 0 or n_removed < n_bytes").select("row.*")
    return left.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else left


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rates keep which bring the domains to their target weights; clean text keeps its size.

    No document comes twice: a domain that is too large is lowered, one that is too small stays as it is.
    """
    return mixed(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), keep="1", most=MOST)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document, and digests of ids and decoded text."""
    return bpe_encode(spark, docs, keep_ids=True).drop("decoded")


STAGES = [("rules", rules), ("near_dedup", near_dedup), ("substrings", substrings), ("mixing", mixing), ("bpe", encode)]
#: The stages of hashing, rates and BPE have no SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = shared_dir(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{k}-{name}")
        docs = spark.read.parquet(f"{root}/{k}-{name}")
    return docs
