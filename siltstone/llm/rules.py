"""Quality rules as a ledger of bits: each rule is evaluated once, policies and ablations read the bits.

Words are ``[^\\x20\\x09-\\x0D]+``, lines are cut at ``\\n``.  A null text has no words; a text without words
measures 0 everywhere and fails ``few_words``.  Repeated rows give repeated rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm import arrowtext as at

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_bangs", "n_controls")
SCHEMA = "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES)


@dataclass(frozen=True)
class Rule:
    """A document fails where ``sql`` holds.  The bit of a rule never changes; new rules take new bits."""

    bit: int
    name: str
    sql: str


RULES = (
    Rule(0, "few_words", "n_words < 10"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 20 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > 3 * n_words"),
    Rule(3, "long_words", "word_chars > 25 * n_words"),
    Rule(4, "short_words", "word_chars < 2 * n_words"),
    Rule(5, "repeated_lines", "n_dup_lines >= 3 and 10 * n_dup_lines > 3 * n_lines"),
    Rule(6, "capitals", "n_upper > n_lower"),
    Rule(7, "bangs", "2 * n_bangs > n_words"),
    Rule(8, "controls", "10 * n_controls > word_chars"),
)
#: Versions of the policy: the rules that reject.
POLICIES = {"base": ("few_words", "repeated_words"), "v1": tuple(r.name for r in RULES)}
POLICY = "v1"


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The measurements of each text of the buffer."""
    n = len(offsets) - 1
    space = at.is_space(data)
    start, stop, row = at.words(data, offsets, space)
    running = at.prefix_hash(data)
    n_words = at.count_by_row(row, n)
    out = {"n_words": n_words, "word_chars": at.sum_by_row(~space & ((data & 0xC0) != 0x80), offsets)}
    symbols = np.zeros(256, bool)
    symbols[list(b"#*$%&|<>")] = True
    out["n_symbols"] = at.sum_by_row(symbols[data], offsets)
    # lines: one more than the line feeds of a text; those with a word, and equal to an earlier one
    feed = np.flatnonzero(data == 10)
    line_start = np.sort(np.concatenate([offsets[:-1], feed + 1]))
    line_row = np.empty(len(line_start), np.int64)
    edge = np.concatenate([np.arange(n), np.searchsorted(offsets, feed, side="right") - 1])
    line_row = np.sort(edge)
    line_stop = np.empty(len(line_start), np.int64)
    last = np.empty(len(line_start), bool)
    last[:-1] = line_row[1:] != line_row[:-1]
    if len(last):
        last[-1] = True
    line_stop[~last] = line_start[1:][~last[:-1]] - 1
    line_stop[last] = offsets[1:][line_row[last]]
    words_before = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~space, out=words_before[1:])
    full = words_before[line_stop] > words_before[line_start]
    out["n_lines"] = at.count_by_row(line_row[full], n)
    key = at.mix(at.span_hash(running, line_start[full], line_stop[full]) + line_row[full].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), bool)
    again[order[1:]] = key[order[1:]] == key[order[:-1]]
    out["n_dup_lines"] = at.count_by_row(line_row[full][again], n)
    # five-word windows that occur again in the same text
    gram, gram_row = at.ngrams(at.span_hash(running, start, stop), row, 5)
    valid = np.flatnonzero(gram_row >= 0)
    key = at.mix(gram[valid] + gram_row[valid].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(key), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    cover = np.zeros(len(start) + 6, np.int64)
    np.add.at(cover, valid[twice], 1)
    np.add.at(cover, valid[twice] + 5, -1)
    out["n_repeat_words"] = at.count_by_row(row[np.cumsum(cover)[: len(start)] > 0], n)
    out["n_upper"] = at.sum_by_row((data >= 65) & (data <= 90), offsets)
    out["n_lower"] = at.sum_by_row((data >= 97) & (data <= 122), offsets)
    out["n_bangs"] = at.sum_by_row(data == 33, offsets)
    out["n_controls"] = at.sum_by_row((data < 32) & ~space | (data == 127), offsets)
    return out


def measure_documents(docs: DataFrame) -> DataFrame:
    """doc_id and MEASURES of every row.  Map only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in at.slices(batch):
                m = measure(data, offsets)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(m[k], pa.int64()) for k in MEASURES)], ["doc_id", *MEASURES])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def measured_rows(docs: DataFrame) -> DataFrame:
    """``row``, a struct of all columns of ``docs``, and MEASURES beside it.  Map only."""
    kind = docs.select(F.struct(*docs.columns).alias("row")).schema["row"]
    schema = T.StructType([kind, *(T.StructField(m, T.LongType()) for m in MEASURES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0)
            texts = pa.RecordBatch.from_arrays([rows, rows.field("text")], ["row", "text"])
            for part, data, offsets in at.slices(texts):
                m = measure(data, offsets)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(m[k], pa.int64()) for k in MEASURES)], ["row", *MEASURES])

    return docs.select(F.struct(*docs.columns).alias("row")).mapInArrow(run, schema)


def failure_bits() -> Column:
    bits = F.lit(0).cast("long")
    for r in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(r.sql), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long"))
    return bits


def policy_mask(policy: str) -> int:
    return sum(1 << r.bit for r in RULES if r.name in POLICIES[policy])


def ledger(docs: DataFrame) -> DataFrame:
    """The measurements of every document and ``failures``, a bit for each rule that it fails.

    Null and empty texts measure 0 and fail the rules on too few words; repeated rows stay; other columns are
    ignored; an empty table gives none.
    """
    return measure_documents(docs).withColumn("failures", failure_bits())


def apply_policy(rows: DataFrame, policy: str = POLICY) -> DataFrame:
    """Adds base_failed and kept from a ledger's bits alone."""
    hit = lambda name: F.col("failures").bitwiseAND(F.lit(policy_mask(name))) != 0
    return rows.withColumn("base_failed", hit("base")).withColumn("kept", ~(hit("base") | hit(policy)))


def kept_documents(docs: DataFrame, policy: str = POLICY) -> DataFrame:
    """The rows of ``docs``, with their columns, that the policy keeps."""
    rows = measured_rows(docs).withColumn("failures", failure_bits())
    return apply_policy(rows, policy).where("kept").select("row.*")


def ablations(rows: DataFrame, policy: str = POLICY) -> DataFrame:
    """For each rule of a policy: documents that fail it, and that only it rejects.  At most 2**rules rows meet after partial counts."""
    mask = policy_mask(policy)
    counts = rows.groupBy(F.col("failures").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in RULES if r.name in POLICIES[policy]))
    each = counts.select("bits", "n", F.explode(rules).alias("r")).select("bits", "n", "r.rule", "r.bit")
    return each.groupBy("rule").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"),
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_policy(ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")))


_CASES = " + ".join(f"CASE WHEN {r.sql} THEN {1 << r.bit} ELSE 0 END" for r in RULES)
ORACLE = rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(ws[i : i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
rep AS (
  SELECT doc_id, count(DISTINCT p)::BIGINT AS n FROM (
    SELECT doc_id, unnest(range(i, i + 5)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1) GROUP BY 1),
line AS (
  SELECT doc_id, l, count(*) AS c FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM w) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY 1, 2),
dup AS (SELECT doc_id, sum(c)::BIGINT AS n_lines, sum(c - 1)::BIGINT AS n_dup FROM line GROUP BY 1),
m AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup, 0)::BIGINT AS n_dup_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_lines,
    length(regexp_replace(t, '[^A-Z]', '', 'g'))::BIGINT AS n_upper, length(regexp_replace(t, '[^a-z]', '', 'g'))::BIGINT AS n_lower,
    length(regexp_replace(t, '[^!]', '', 'g'))::BIGINT AS n_bangs, length(regexp_replace(t, '[^\x01-\x08\x0E-\x1F\x7F]', '', 'g'))::BIGINT AS n_controls
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id)),
f AS (SELECT *, ({_CASES})::BIGINT AS failures FROM m)
SELECT *, (failures & {policy_mask("base")}) <> 0 AS base_failed, (failures & {policy_mask("base") | policy_mask(POLICY)}) = 0 AS kept FROM f
"""
