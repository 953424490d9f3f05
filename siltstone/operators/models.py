"""Models as table functions: prompts in, answers out.

A ``Completer`` gets calls (key, stage, model, system, prompt) and gives a row of answers for each key (key, text,
cost_usd, error).  An ``Embedder`` adds a vector to rows with a text.  Answers come from tables (recorded, or
made by another system); a heuristic is a column expression and is only ever used where it is passed in.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions.hashing import response_key, sha256
from siltstone.functions.prompts import TEMPLATES, rendered

ANSWER = "key string, text string, cost_usd double, error string"


class Completer(Protocol):
    def complete(self, calls: DataFrame) -> DataFrame: ...


class Embedder(Protocol):
    def embed(self, rows: DataFrame, text: str = "text", vector: str = "embedding") -> DataFrame: ...


class Classifier(Protocol):
    """(key, judged) of rows with a text; null where it failed."""

    def score(self, rows: DataFrame, key: str) -> DataFrame: ...


class Recorded:
    """Answers from a table (key, text, and cost_usd and error if it has them).  A call without one ends the query with an error."""

    def __init__(self, answers: DataFrame):
        cost = F.col("cost_usd").cast("double") if "cost_usd" in answers.columns else F.lit(0.0)
        error = F.col("error") if "error" in answers.columns else F.lit(None).cast("string")
        self.answers = answers.select("key", "text", cost.alias("cost_usd"), error.alias("error"), F.lit(True).alias("_hit"))

    def complete(self, calls: DataFrame) -> DataFrame:
        rows = calls.select("key").distinct().join(self.answers, "key", "left")
        found = F.when(F.col("_hit"), True).otherwise(F.raise_error(F.concat(F.lit("no recorded answer for key "), "key")).cast("boolean"))
        return rows.where(found).drop("_hit")


class Heuristic:
    """Answers by a column expression over the call's columns."""

    def __init__(self, answer: Callable[[], Column], cost: float = 0.0):
        self.answer, self.cost = answer, cost

    def complete(self, calls: DataFrame) -> DataFrame:
        return calls.dropDuplicates(["key"]).select("key", self.answer().alias("text"), F.lit(self.cost).alias("cost_usd"), F.lit(None).cast("string").alias("error"))


class Routed:
    """Each call goes to its model's completer; a model without one is an error."""

    def __init__(self, by_model: dict[str, Completer]):
        self.by_model = by_model

    def complete(self, calls: DataFrame) -> DataFrame:
        known = F.when(F.col("model").isin(*self.by_model), True).otherwise(F.raise_error(F.concat(F.lit("no completer for model "), F.coalesce("model", F.lit("null")))).cast("boolean"))
        calls = calls.where(known)
        return reduce(DataFrame.unionByName, [c.complete(calls.where(F.col("model") == m)).select("key", "text", "cost_usd", "error") for m, c in self.by_model.items()])


class Recording:
    """Passes calls on and appends the answers to a table that ``Recorded`` reads; a key is recorded once."""

    def __init__(self, inner: Completer, path: str):
        self.inner, self.path = inner, path

    def complete(self, calls: DataFrame) -> DataFrame:
        spark = calls.sparkSession
        fresh = self.inner.complete(calls).select("key", "text", "cost_usd", "error")
        try:
            fresh = fresh.join(spark.read.schema(ANSWER).parquet(self.path).select("key"), "key", "left_anti")
        except Exception as missing:  # noqa: BLE001  nothing is recorded yet
            if "PATH_NOT_FOUND" not in str(missing):
                raise
        fresh.write.mode("append").parquet(self.path)
        return calls.select("key").distinct().join(spark.read.schema(ANSWER).parquet(self.path).dropDuplicates(["key"]), "key")


class HashEmbedder:
    """Vectors of the bytes of sha256("0:text"), sha256("1:text"), ... scaled to [-1, 1]: equal texts, equal vectors."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, rows: DataFrame, text: str = "text", vector: str = "embedding") -> DataFrame:
        digests = [F.unhex(F.sha2(F.concat(F.lit(f"{i}:"), F.coalesce(F.col(text), F.lit(""))), 256)) for i in range(-(-self.dim // 32))]
        dim = self.dim

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def scaled(raw: pd.Series) -> pd.Series:
            return raw.map(lambda b: (np.frombuffer(b, np.uint8)[:dim] / 127.5 - 1.0).tolist())

        return rows.withColumn(vector, scaled(F.concat(*digests)))


class TableEmbedder:
    """Vectors from a table (text_sha, embedding); a text without one ends the query with an error."""

    def __init__(self, vectors: DataFrame):
        self.vectors = vectors.select(F.col("text_sha").alias("_sha"), F.col("embedding").alias("_v"))

    def embed(self, rows: DataFrame, text: str = "text", vector: str = "embedding") -> DataFrame:
        found = rows.withColumn("_sha", sha256(F.coalesce(F.col(text), F.lit("")))).join(self.vectors, "_sha", "left")
        v = F.coalesce("_v", F.raise_error(F.concat(F.lit("no vector for text "), "_sha")).cast("array<double>"))
        return found.withColumn(vector, v).drop("_sha", "_v")


class LabelClassifier:
    """Judgements from a table (key, score between 0 and 1)."""

    def __init__(self, labels: DataFrame, score: str):
        self.labels, self.column = labels, score

    def score(self, rows: DataFrame, key: str) -> DataFrame:
        return rows.select(key).join(self.labels.select(key, F.col(self.column).cast("double").alias("judged")), key, "left")


def calls(rows: DataFrame, stage: str, values: dict[str, Column], model: str) -> DataFrame:
    """``rows`` with stage, model, system, prompt and key of their call."""
    system, prompt = (rendered(t, values) for t in TEMPLATES[stage])
    out = rows.withColumn("stage", F.lit(stage)).withColumn("model", F.lit(model)).withColumn("system", system).withColumn("prompt", prompt)
    return out.withColumn("key", response_key(F.col("system"), F.col("prompt")))


def asked(rows: DataFrame, stage: str, values: dict[str, Column], schema: str, completer: Completer, model: str = "default") -> DataFrame:
    """``rows`` with ``answer`` (a struct of ``schema``), ``cost_usd`` and ``error``: what failed, or did not parse, for a row of its own.

    Equal prompts are one call.  A failing call leaves its error beside its row and does not end the others.
    """
    made = calls(rows, stage, values, model)
    answers = completer.complete(made.select("key", "stage", "model", "system", "prompt")).select("key", F.col("text").alias("_t"), "cost_usd", F.col("error").alias("_e"))
    found = made.join(answers, "key")
    parsed = F.when(F.coalesce(F.schema_of_variant(F.try_parse_json("_t")).startswith("OBJECT"), F.lit(False)), F.from_json("_t", schema))
    error = F.coalesce("_e", F.when(parsed.isNull(), "malformed answer"))
    found = found.withColumn("answer", F.when(F.col("_e").isNull(), parsed)).withColumn("error", error)
    return found.drop("stage", "model", "system", "prompt", "key", "_t", "_e")
