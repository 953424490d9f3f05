"""Importance resampling towards a target: hashed features, a gain for each bucket, Gumbel scores, and the highest ones drawn.

Features are runs of 1 to n words.  One scan of a document keeps a ring with the CRC-32 states of the runs that
began at the last n words; each further word extends them by a space and itself, and every state is a feature's hash.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import accumulate
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import arrowtext as at
from siltstone.llm.scratch import Scratch

NGRAM, BUCKETS, SEED, LEAST_WORDS, PERCENT = 1, 10_000, 2024, 20, 10
#: Words of a lower-cased text's bytes: digits, letters, and all bytes of characters outside ASCII.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_FEATURES = "doc_id long, n_words long, n_features long, buckets binary"


def features(text: bytes, n: int) -> tuple[int, list[int]]:
    """(number of words, CRC-32 of each run of 1 to n words)."""
    found = _WORD.findall(text.lower())  # of bytes: A-Z only
    if n == 1:  # the ring holds the word's own start only
        return len(found), list(map(crc32, found))
    ring: list[int] = []
    out: list[int] = []
    for word in found:
        more = b" " + word
        ring = [crc32(more, state) for state in ring[-(n - 1) :]]
        ring.append(crc32(word))
        out += ring
    return len(found), out


def hashed(docs: DataFrame, n: int, buckets: int) -> DataFrame:
    """doc_id, n_words, n_features and the features' buckets (little-endian, of 2 or 4 bytes) of every row.  Map only."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in at.slices(batch):
                text = data.tobytes()
                words, counts, packed = [], [], []
                for first, last in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    n_words, crcs = features(text[first:last], n)
                    words.append(n_words), counts.append(len(crcs))
                    packed.append((np.array(crcs, np.uint32) % np.uint32(buckets)).astype(kind).tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(words, pa.int64()), pa.array(counts, pa.int64()), pa.array(packed, pa.binary())], ["doc_id", "n_words", "n_features", "buckets"])

    return docs.select("doc_id", "text").mapInArrow(run, _FEATURES)


def _unpacked(column: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all rows, one row after the other; offsets of the rows in them)."""
    kind = np.dtype("<u2" if buckets <= 1 << 16 else "<u4")
    data, offsets = at.buffers(column)
    return np.frombuffer(data.tobytes(), kind), offsets // kind.itemsize


def bucket_counts(rows: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n): summed within each task, then over tasks; at most ``buckets`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(_unpacked(batch.column(0), buckets)[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    return rows.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: dict[int, int], target: dict[int, int], buckets: int) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) of each bucket, in doubles."""
    all_source, all_target = float(sum(source.values()) + buckets), float(sum(target.values()) + buckets)
    return np.array([math.floor(1000 * math.log((target.get(b, 0) + 1) * all_source / ((source.get(b, 0) + 1) * all_target))) for b in range(buckets)], np.int64)


def weights(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """Adds weight: the floored mean of the gains of a document's features, 0 without any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, offsets = _unpacked(batch.column(3), len(gain))
            sums = np.concatenate([[0], np.cumsum(gain[of])])
            count = np.diff(offsets)
            mean = (sums[offsets[1:]] - sums[offsets[:-1]]) // np.maximum(count, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(mean, pa.int64())], ["doc_id", "n_words", "n_features", "weight"])

    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln((h + 0.5) / 2**32))), h the first 8 hex digits of sha256 of ``seed:doc_id``."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def ranked(scratch: Scratch, rows: DataFrame, order: list[Column], name: str = "ranked") -> DataFrame:
    """``rows`` with rank 1, 2, 3, ... in a total order: ranges are sorted by themselves and written, then start where the ones before end.

    The driver sees one row per range.
    """
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    stored = scratch.put(placed, name)
    part = F.shiftrightunsigned("place", 33)
    counts = stored.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()
    starts = [0, *accumulate(r.n for r in counts)]
    table = rows.sparkSession.createDataFrame([(r.part, s) for r, s in zip(counts, starts, strict=False)], "part long, before long")
    inside = F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    return stored.withColumn("part", part).join(table, "part").withColumn("rank", F.col("before") + inside + 1).drop("part", "before", "place")


def resampled(spark: SparkSession, docs: DataFrame, target: DataFrame, n: int = NGRAM, buckets: int = BUCKETS, seed: int = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_words, n_features, weight, score, and rank, 1 and up, of those drawn.

    ``target`` has the texts that the draw leans to.  Drawn are the highest scores, ``percent`` of the documents with
    ``least_words`` words at least, rounded down; ties go to the smaller doc_id.  Null texts have no features, weight 0,
    and are never drawn, nor are texts with fewer words.  A row without an id draws as the empty id and comes last
    among ties; repeated rows are documents of their own and have ranks of their own; an empty table gives no rows;
    an empty target counts as one of which nothing is known.  Other columns are ignored.
    """
    scratch = Scratch(spark, "resample")
    rows = scratch.put(hashed(docs, n, buckets), "features")
    aimed = hashed(target.select(F.lit(0).cast("long").alias("doc_id"), "text"), n, buckets)
    source, wanted = ({r.bucket: r.n for r in bucket_counts(x, buckets).collect()} for x in (rows, aimed))  # at most ``buckets`` numbers each
    scored = weights(rows, gains(source, wanted, buckets)).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    scored = scratch.put(scored, "scored")
    scratch.drop("features")
    eligible = scored.where(F.col("n_words") >= least_words)
    drawn = percent * eligible.count() // 100
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight")]
    first = ranked(scratch, eligible, order)
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return first.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))).unionByName(rest)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return resampled(spark, docs, benchmark).select("doc_id", "n_features", "weight", "score", "rank")


#: CRC-32 of each distinct word, byte by byte.
ORACLE = f"""
WITH slot AS (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)) AS v FROM (SELECT unnest(range(256)) AS i)),
slots AS MATERIALIZED (SELECT list(v ORDER BY i) AS v FROM slot),
dw AS (SELECT doc_id, r, regexp_extract_all(lower_ascii, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM (
  SELECT doc_id, row_number() OVER () AS r, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii FROM documents)),
bw AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM benchmark),
dx AS (SELECT r, unnest(ws) AS w FROM dw),
vocab AS (SELECT DISTINCT w FROM (SELECT w FROM dx UNION ALL SELECT w FROM bw)),
crc AS (
  SELECT w, xor(list_reduce([4294967295] || list_transform(range(1, octet_length(encode(w)) + 1), lambda i: ('0x' || hex(array_slice(encode(w), i, i)))::BIGINT),
    lambda c, x: xor(c >> 8, v[(xor(c, x) & 255) + 1])), 4294967295) % {BUCKETS} AS b FROM vocab, slots),
df AS (SELECT r, b FROM dx JOIN crc USING (w)),
s AS (SELECT b, count(*) AS s FROM df GROUP BY 1), t AS (SELECT b, count(*) AS t FROM bw JOIN crc USING (w) GROUP BY 1),
every AS (SELECT (SELECT coalesce(sum(s), 0) FROM s) AS s_all, (SELECT coalesce(sum(t), 0) FROM t) AS t_all),
gain AS (SELECT b, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (s_all + {BUCKETS})::DOUBLE / ((s + 1)::DOUBLE * (t_all + {BUCKETS})::DOUBLE)))::BIGINT AS g FROM s LEFT JOIN t USING (b), every),
w AS (SELECT r, count(*) AS n_features, floor(sum(g)::DOUBLE / count(*))::BIGINT AS weight FROM df JOIN gain USING (b) GROUP BY 1),
sc AS (SELECT doc_id, r, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::BIGINT + 0.5) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM dw LEFT JOIN w USING (r)),
ok AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM sc WHERE n_features >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT {PERCENT} * count(*) // 100 FROM ok) THEN rank END AS rank FROM sc LEFT JOIN ok USING (r)"""
