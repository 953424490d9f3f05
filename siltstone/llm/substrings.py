"""Exact repeated substrings by bucket-pointer refinement of suffixes.

A byte is removed if a string of LENGTH bytes that covers it starts at two places or more, in one document or two.
So suffixes need to be told apart by their first LENGTH bytes only, and those alone in a bucket are done with.

1. Initial buckets.  The anchor of a suffix is the q-gram in its first LENGTH bytes with the smallest hash (the
   leftmost of equal ones), a function of those bytes alone.  Neighbouring suffixes share anchors, so a document
   has one anchor, with the interval of suffixes that belong to it, for some LENGTH / 2 bytes.  The bucket of an
   interval is its anchor's q-gram: equal strings are in one bucket.  ``settled`` counts the intervals of a bucket
   with partial sums: one that is alone is dropped, those of equal context (the bytes of all their strings)
   are repeated whole and one of them stands for them from then on.
2. Buckets of more than SMALL contexts are split (``divided``): an interval is halved at fixed distances from the
   anchor, and a half's bucket is made of all bytes that its strings have in common, which are more than those of
   the whole.  Halves are settled as before, and split again where they are still many; an interval of one suffix
   has no more to split.  No task holds a large bucket, and no row is made for each suffix.
3. Buckets of up to SMALL contexts are refined in one task each (``refined``): suffixes get identifiers of their
   q-gram buckets, and sorting pairs of identifiers, a suffix's own and that of the suffix h bytes later, gives
   those of the buckets for twice the length, until LENGTH is reached.  A suffix alone in its bucket has no
   identifier, so that all that point to it drop out in the next step.

q-grams and contexts are told apart by 64-bit hashes of their bytes.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm import arrowtext as at
from siltstone.llm.idstore import shared_dir

LENGTH, GRAM = 400, 32
#: A passage of 50 words, of four letters and a space.
PASSAGE = 250
#: Contexts in a bucket up to which it is not split (some 600 kB of text).
SMALL = 1024
_STEP = 1 << 20
_POS_BITS = 22
_SALT = np.uint64(0x9FB21C651E98DF25)
KEYS = ["did", "th"]


def _keyed(docs: DataFrame, keep_rows: bool) -> DataFrame:
    """doc_id, its null-free form, a hash of the text (equal ids with different texts stay apart), text; and ``row``, all columns."""
    text = F.coalesce("text", F.lit(""))
    row = [F.struct(*docs.columns).alias("row")] if keep_rows else []
    return docs.select("doc_id", F.coalesce("doc_id", F.lit(-(2**63))).alias("did"), F.xxhash64(text).alias("th"), text.alias("text"), *row)


def anchored(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(q-gram hash, context hash, anchor, first start, last start) of the anchors of a buffer of texts."""
    gram = min(GRAM, length)
    span = length - gram + 1
    running = at.prefix_hash(data)
    ends = np.repeat(offsets[1:], np.diff(offsets))
    for begin in range(0, len(data), _STEP):
        stop = min(begin + _STEP + length - 1, len(data))
        if stop - begin < length:
            return
        grams = at.span_hash(running, np.arange(begin, stop - gram + 1), np.arange(begin + gram, stop + 1))
        m = (grams >> np.uint64(1)).astype(np.int64) >> _POS_BITS << _POS_BITS | np.arange(len(grams))
        size = 1
        while size * 2 <= span:
            m = np.minimum(m[:-size], m[size:])
            size *= 2
        if span > size:
            m = np.minimum(m[: len(m) - (span - size)], m[span - size :])
        a = (m & ((1 << _POS_BITS) - 1)) + begin
        s = np.arange(begin, begin + len(a))
        ok = (s + length <= ends[s]) & (s < begin + _STEP)
        s, a = s[ok], a[ok]
        if not len(s):
            continue
        new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (s[1:] != s[:-1] + 1)]))
        lo, hi, a = s[new], s[np.append(new[1:], len(s)) - 1], a[new]
        context = at.mix(at.span_hash(running, lo, hi + length) ^ (a - lo).astype(np.uint64) * _SALT)
        yield grams[a - begin], context, a, lo, hi


def anchors(docs: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in at.slices(batch):
                for h, c, a, lo, hi in anchored(data, offsets, length):
                    row = np.searchsorted(offsets, lo, side="right") - 1
                    base = offsets[row]
                    cols = [part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)), pa.array(h.view(np.int64)), pa.array(c.view(np.int64)), *(pa.array((x - base).astype(np.int32)) for x in (a, lo, hi))]
                    yield pa.RecordBatch.from_arrays(cols, ["did", "th", "h", "c", "a", "lo", "hi"])

    return docs.select("did", "th", "text").mapInArrow(run, "did long, th long, h long, c long, a int, lo int, hi int")


_ITEM = "struct<h:long,a:int,lo:int,hi:int,k:long>"


def contexts(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of each wanted interval's strings.  ``wanted`` has for each document its list of intervals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at_ in range(0, batch.num_rows, 64):
                part = batch.slice(at_, 64)
                out: list[list] = [[] for _ in range(7)]
                for did, th, text, items in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
                    raw = text.encode("utf-8", "replace")
                    for x in items:
                        for col, v in zip(out, (did, th, x["h"], x["k"], x["lo"], x["a"] - x["lo"], raw[x["lo"] : x["hi"] + length]), strict=True):
                            col.append(v)
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["did", "th", "h", "k", "lo", "off", "body"])

    joined = docs.join(wanted.hint("merge"), KEYS).select("did", "th", "text", "items")
    return joined.mapInArrow(run, "did long, th long, h long, k long, lo int, off int, body binary")


def same_buckets(keys: np.ndarray) -> np.ndarray:
    """The identifier of each key's bucket, -1 where it is alone."""
    order = np.argsort(keys)
    same = np.concatenate([[False], keys[order[1:]] == keys[order[:-1]]]) if len(keys) else np.zeros(0, bool)
    bucket = np.cumsum(~same) - 1
    many = np.bincount(bucket)[bucket] > 1 if len(keys) else same
    out = np.full(len(keys), -1, np.int64)
    out[order[many]] = bucket[many]
    return out


def refined(bodies: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(context, start in it) of the suffixes whose first ``length`` bytes occur twice among these contexts."""
    data = np.frombuffer(b"".join(bodies), np.uint8)
    size = np.array([len(b) for b in bodies], np.int64)
    ends = np.repeat(np.cumsum(size), size)
    h = min(GRAM, length)
    at_ = np.flatnonzero(np.arange(len(data)) + h <= ends)
    bucket = np.full(len(data), -1, np.int64)
    bucket[at_] = same_buckets(at.span_hash(at.prefix_hash(data), at_, at_ + h))
    while h < length:
        step = min(h, length - h)
        at_ = at_[(at_ + h + step <= ends[at_]) & (bucket[at_] >= 0)]
        later = bucket[np.minimum(at_ + step, len(data) - 1)]
        at_, later = at_[later >= 0], later[later >= 0]
        finer = same_buckets(bucket[at_] * np.int64(len(data)) + later)
        bucket = np.full(len(data), -1, np.int64)
        bucket[at_] = finer
        h += step
    found = np.flatnonzero(bucket >= 0)
    first = np.cumsum(size) - size
    owner = np.searchsorted(first, found, side="right") - 1
    return owner, found - first[owner]


def _runs(owner: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring starts of one context as intervals."""
    order = np.lexsort((inner, owner))
    owner, inner = owner[order], inner[order]
    new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (inner[1:] != inner[:-1] + 1)])) if len(owner) else np.zeros(0, np.int64)
    return owner[new], inner[new], inner[np.append(new[1:], len(owner)) - 1] if len(new) else inner[new]


_INTERVALS = "did long, th long, lo int, hi int"


def refine_small(rows: DataFrame, length: int) -> DataFrame:
    """Intervals of repeated suffixes; each bucket is refined by one task, several at once."""

    def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        owner, inner = refined(t["body"].to_pylist(), length)
        o, first, last = _runs(owner, inner)
        lo = np.asarray(t["lo"])[o]
        return pa.RecordBatch.from_arrays([t["did"].combine_chunks().take(pa.array(o)), t["th"].combine_chunks().take(pa.array(o)), pa.array((lo + first).astype(np.int32)), pa.array((lo + last).astype(np.int32))], ["did", "th", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            h = np.asarray(batch.column(2))
            turns = np.flatnonzero(h[1:] != h[:-1]) + 1
            at_ = 0
            if held and h[0] != np.asarray(held[-1].column(2))[-1] and n > 2000:
                yield flush(held)
                held, n = [], 0
            for t in turns.tolist():
                if n + t - at_ > 2000:
                    yield flush([*held, batch.slice(at_, t - at_)])
                    held, n, at_ = [], 0, t
            held.append(batch.slice(at_))
            n += batch.num_rows - at_
        if held:
            yield flush(held)

    return rows.select("did", "th", "h", "lo", "body").repartition("h").sortWithinPartitions("h").mapInArrow(run, _INTERVALS)


_PARTS = "did long, th long, h long, c long, lo int, off int, body binary"


def divided(rows: DataFrame, length: int, block: int) -> DataFrame:
    """The intervals cut at multiples of ``block`` of a suffix's distance to its anchor; ``off`` is that of the first suffix.

    A part's bucket is the bytes that strings at all distances of its block have in common; ``c`` is its context.
    """
    most = length - min(GRAM, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for did, th, lo, off, body in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                near = off - (len(body) - length)  # the distance of the last suffix
                for part in range(near // block, off // block + 1):
                    first, last = max(near, part * block), min(off, (part + 1) * block - 1)
                    own = body[off - last : off - first + length]
                    low, high = part * block, min((part + 1) * block - 1, most)
                    core = body[off - low : off + length - high]
                    tag = b"%d %d " % (block, part)
                    keys = (int.from_bytes(hashlib.blake2b(tag + x, digest_size=8).digest(), "little", signed=True) for x in (core, b"%d " % last + own))
                    for column, x in zip(out, (did, th, *keys, lo + off - last, last, own), strict=True):
                        column.append(x)
            kinds = [*[pa.int64()] * 4, pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["did", "th", "h", "c", "lo", "off", "body"])

    return rows.select("did", "th", "lo", "off", "body").mapInArrow(run, _PARTS)


def settled(found: DataFrame) -> DataFrame:
    """The intervals of buckets that hold two or more, with ``k``, their bucket's contexts; ``whole`` if their context occurs twice;
    ``open`` where a bucket has other contexts, for one interval of each context."""
    mine = F.xxhash64("did", "th", "lo")
    each = found.groupBy("h", "c").agg(F.count("*").alias("n"), F.min(mine).alias("one"))
    bucket = each.groupBy("h").agg(F.count("*").alias("k"), F.sum("n").alias("total")).where("total > 1").select("h", "k")
    known = found.join(each.join(bucket, "h"), ["h", "c"])
    return known.withColumn("whole", F.col("n") > 1).withColumn("open", (F.col("k") > 1) & ((F.col("n") == 1) | (mine == F.col("one")))).drop("n", "one", "c")


_RESULT = {"doc_id": T.LongType(), "n_bytes": T.LongType(), "n_removed": T.LongType(), "n_spans": T.LongType(), "kept_sha256": T.StringType()}


def covered(n: int, intervals: list, length: int) -> np.ndarray:
    """Which bytes the windows that start in these intervals cover."""
    edge = np.zeros(n + 1, np.int64)
    for x in intervals:
        edge[x["lo"]] += 1
        edge[x["hi"] + length] -= 1
    return np.cumsum(edge[:n]) > 0


def remove(docs: DataFrame, intervals: DataFrame, length: int, passages: DataFrame | None, passage: int) -> DataFrame:
    """The digests of _RESULT, with ``passages`` also n_passage_bytes and, where ``docs`` has it, ``row`` with the text that is left."""
    carried = [f for f in docs.schema if f.name == "row"]
    extra = [T.StructField("n_passage_bytes", T.LongType())] if passages is not None else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at_ in range(0, batch.num_rows, 256):
                part = batch.slice(at_, 256)
                out: list[list] = [[] for _ in _RESULT]
                texts, inside = [], []
                for doc_id, text, items, more in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
                    raw = text.encode("utf-8", "replace")
                    kept, removed, spans = raw, 0, 0
                    if items:
                        gone = covered(len(raw), items, length)
                        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                        removed = len(raw) - len(kept)
                        spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    for col, v in zip(out, (doc_id, len(raw), removed, spans, hashlib.sha256(kept).hexdigest()), strict=True):
                        col.append(v)
                    inside.append(int(covered(len(raw), more, passage).sum()) if more else 0)
                    if carried:
                        texts.append(kept.decode("utf-8", "ignore"))
                arrays = [pa.array(c, t) for c, t in zip(out, [*[pa.int64()] * 4, pa.string()], strict=True)]
                if extra:
                    arrays.append(pa.array(inside, pa.int64()))
                if carried:
                    row = part.column(4)
                    fields = [row.type.field(i) for i in range(row.type.num_fields)]
                    arrays.append(pa.StructArray.from_arrays([pa.array(texts, f.type) if f.name == "text" else row.field(i) for i, f in enumerate(fields)], fields=fields))
                yield pa.RecordBatch.from_arrays(arrays, [*_RESULT, *(f.name for f in [*extra, *carried])])

    def lists(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*KEYS).agg(F.collect_list(F.struct("lo", "hi")).alias(name)).hint("merge")

    joined = docs.join(lists(intervals, "items"), KEYS, "left")
    joined = joined.withColumn("more", F.lit(None).cast("array<struct<lo:int,hi:int>>")) if passages is None else joined.join(lists(passages, "more"), KEYS, "left")
    schema = T.StructType([*(T.StructField(k, t) for k, t in _RESULT.items()), *extra, *carried])
    return joined.select("doc_id", "text", "items", "more", *(f.name for f in carried)).mapInArrow(run, schema)


def intervals(spark: SparkSession, docs: DataFrame, length: int) -> DataFrame:
    """(did, th, lo, hi): the starts of strings of ``length`` bytes that start at two places or more."""
    root = shared_dir(spark, "substrings")

    def drop(name: str) -> None:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def put(df: DataFrame, name: str, gone: str | None = None) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{root}/{name}")
        if gone:
            drop(gone)
        gc.collect()
        spark.sparkContext._jvm.System.gc()  # lets Spark remove shuffle files of the step before
        return spark.read.parquet(f"{root}/{name}")

    first = put(settled(put(anchors(docs, length), "anchors")), "settled", gone="anchors")
    found = [first.where("whole").select("did", "th", "lo", "hi")]
    wanted = first.where("open").groupBy(*KEYS).agg(F.collect_list(F.struct("h", "a", "lo", "hi", "k")).alias("items"))
    rows = put(contexts(docs, wanted, length), "contexts")
    used = ["contexts"]
    small = rows.where(F.col("k") <= SMALL)
    block = 1 << (length - 1).bit_length()
    while block > 1 and not (large := rows.where(F.col("k") > SMALL)).isEmpty():
        block //= 2
        parts = put(settled(put(divided(large, length, block), f"parts{block}")), f"halves{block}", gone=f"parts{block}")
        found.append(parts.where("whole").select("did", "th", "lo", (F.col("lo") + F.length("body") - length).alias("hi")))
        rows = parts.where("open")
        used.append(f"halves{block}")
        small = small.unionByName(rows.where(F.col("k") <= SMALL), allowMissingColumns=True)
    every = put(reduce(DataFrame.unionByName, [refine_small(small, length), *found]), "intervals")
    for name in ["settled", *used]:
        drop(name)
    return every


def repeated_substrings(spark: SparkSession, docs: DataFrame, length: int = LENGTH, keep_rows: bool = False, passage: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256; with ``passage`` also
    n_passage_bytes, the bytes (removed or not) that a repeated string of ``passage`` bytes covers; with ``keep_rows`` also
    ``row``, a struct of the columns of ``docs`` in which ``text`` is what is left.

    Null texts are empty; texts under ``length`` bytes keep all.  Strings are judged on the input, overlaps
    count, copies of a row remove each other.  Removal may cut a character's bytes: the hash is over the bytes
    left, the text in ``row`` drops such incomplete characters.  Other columns are ignored; an empty table gives none.
    """
    docs = _keyed(docs, keep_rows)
    passages = intervals(spark, docs, passage) if passage else None
    return remove(docs, intervals(spark, docs, length), length, passages, passage or length)


def op7_suffix_bucket_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_substrings(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), passage=PASSAGE)


def _covered_sql(name: str, length: int) -> str:
    """CTEs that end in {name}_span: the maximal runs of bytes that repeated strings of ``length`` bytes cover."""
    return f"""
  {name}_start AS (SELECT r, b, unnest(range(1, n - {length} + 2)) AS s FROM docs),
  {name}_hash AS (SELECT r, s, md5(array_slice(b, s, s + {length} - 1)) AS h FROM {name}_start),
  {name}_hit AS (SELECT r, s FROM {name}_hash WHERE h IN (SELECT h FROM {name}_hash GROUP BY h HAVING count(*) > 1)),
  {name}_edge AS (SELECT r, s, coalesce(s - lag(s) OVER (PARTITION BY r ORDER BY s) > {length}, true) AS opens FROM {name}_hit),
  {name}_run AS (SELECT r, s, sum(opens::INT) OVER (PARTITION BY r ORDER BY s) AS k FROM {name}_edge),
  {name}_span AS (SELECT r, min(s) AS first, max(s) + {length} - 1 AS last FROM {name}_run GROUP BY r, k)"""


#: Every string of every text; some 3 seconds a megabyte.
ORACLE = f"""
WITH docs AS (SELECT r, doc_id, b, octet_length(b) AS n FROM (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents)),{_covered_sql("cut", LENGTH)},{_covered_sql("passage", PASSAGE)},
  piece AS (
    SELECT r, last + 1 AS first, coalesce(lead(first) OVER (PARTITION BY r ORDER BY first) - 1, n) AS last
    FROM (SELECT r, first, last FROM cut_span UNION ALL SELECT r, 0, 0 FROM docs) JOIN docs USING (r)),
  kept AS (SELECT r, string_agg(hex(array_slice(b, first, last)), '' ORDER BY first) AS x FROM piece JOIN docs USING (r) WHERE first <= last GROUP BY r),
  removed AS (SELECT r, sum(last - first + 1) AS n_removed, count(*) AS n_spans FROM cut_span GROUP BY r),
  passages AS (SELECT r, sum(last - first + 1) AS n_passage FROM passage_span GROUP BY r)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(x, ''))) AS kept_sha256, coalesce(n_passage, 0)::BIGINT AS n_passage_bytes
FROM docs LEFT JOIN removed USING (r) LEFT JOIN passages USING (r) LEFT JOIN kept USING (r)"""
