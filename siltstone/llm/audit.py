"""Filter interaction audit: what each filter removes alone, after others, and at the cost of which labelled documents.

Every document gets one mask of the filters that it fails.  Copies are found by sorting: documents are range-sorted
by (fingerprint, text, doc_id), each is compared with its predecessor, and where a run of copies goes on in the next
range, the ranges' edges are compared by themselves.  A group of copies of any size is cut at ids into as many
ranges as it fills.  Masks are then counted for each part: at most 32 counters of a part, whatever its size, from which
all orders of the filters follow.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import arrowtext as at
from siltstone.llm.scratch import Scratch

#: The filters, in the order of their bits: too few words, too few distinct words, too many capitals, symbols, copies.
FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#$%&*|")] = True
_SPREAD = np.uint64(0xD6E8FEB86659FD93)
#: A document: doc_id, part, mask and, if it stands at the head of its range, the run of copies that it belongs to.
#: A range's edge: its fingerprint, its text, and the smallest id of its run.
_ROW = "doc_id long, part string, mask int, task int, run long, fingerprint long, text string, least long"
_NO_ID = np.iinfo(np.int64).max


def text_masks(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The bits A to D of each text of the buffer."""
    n = len(offsets) - 1
    start, stop, row = at.words(data, offsets)
    n_words = at.count_by_row(row, n)
    key = at.mix(at.span_hash(at.prefix_hash(data), start, stop) + row.astype(np.uint64) * _SPREAD)
    order = np.argsort(key)
    new = np.ones(len(order), bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    n_distinct = at.count_by_row(row[order[new]], n)
    capitals = at.sum_by_row((data >= 65) & (data <= 90), offsets)
    points = at.sum_by_row((data & 0xC0) != 0x80, offsets)
    fails = (n_words < 100, 100 * n_distinct < 80 * n_words, 100 * capitals > 10 * points, at.sum_by_row(_SYMBOL[data], offsets) > 0)
    return sum(np.where(f, 1 << bit, 0) for bit, f in enumerate(fails)).astype(np.int32)


@dataclass
class _Run:
    """A run of equal texts within a range."""

    number: int
    fingerprint: int
    text: str
    mask: int
    least: int


@dataclass
class _Range:
    """What is known of a sorted range while its rows pass: the last run, and the runs of its first and last fingerprint."""

    task: int
    last: _Run | None = None
    head: dict[int, _Run] = field(default_factory=dict)
    tail: dict[int, _Run] = field(default_factory=dict)
    first: int | None = None

    def rows(self, part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        n = part.num_rows
        prints, texts, ids, parts = (part.column(c) for c in ("fingerprint", "text", "doc_id", "part"))
        number, known = np.asarray(prints), np.asarray(ids.is_valid())
        id_of = np.where(known, np.asarray(ids.fill_null(_NO_ID)), _NO_ID)
        same = np.zeros(n, bool)  # as the predecessor
        near = np.flatnonzero(number[1:] == number[:-1]) + 1
        same[near] = np.asarray(pc.equal(texts.take(pa.array(near)), texts.take(pa.array(near - 1))))
        same[0] = self.last is not None and number[0] == self.last.fingerprint and texts[0].as_py() == self.last.text
        begins = np.flatnonzero(~same)
        from_last = int(same[0])  # run 0 of these rows is the last one of the rows before
        run = np.cumsum(~same) - 1 + from_last
        at_run = np.concatenate([[0], begins]) if from_last else begins
        base = self.last.number + 1 - from_last if self.last else 0
        keep = np.repeat(~same, np.diff(offsets))
        sizes = np.diff(offsets)[begins]
        masks = text_masks(data[keep], np.concatenate([[0], np.cumsum(sizes)])) if len(begins) else np.zeros(0, np.int32)
        least = np.minimum.reduceat(id_of, at_run)
        if from_last:
            masks = np.concatenate([[self.last.mask], masks]).astype(np.int32)
            least[0] = min(least[0], self.last.least)
        if self.first is None:
            self.first = int(number[0])
        ends = number[at_run]
        if self.last is None or number[-1] != self.last.fingerprint:
            self.tail = {}
        for kept, value in ((self.head, self.first), (self.tail, number[-1])):
            for i in np.flatnonzero(ends == value).tolist():
                kept[base + i] = _Run(base + i, int(value), texts[int(at_run[i])].as_py(), int(masks[i]), int(least[i]))
        i = len(at_run) - 1
        self.last = _Run(base + i, int(number[-1]), texts[n - 1].as_py(), int(masks[i]), int(least[i]))
        mask = masks[run] | np.where(known & (id_of > least[run]), COPY, 0).astype(np.int32)
        head = pa.array(number == self.first)
        nulls = [pa.nulls(n, t) for t in (pa.int64(), pa.string(), pa.int64())]
        of_head = [pc.if_else(head, x, None) for x in (pa.array(np.full(n, self.task, np.int32)), pa.array((base + run).astype(np.int64)))]
        return pa.RecordBatch.from_arrays([ids, parts, pa.array(mask, pa.int32()), *of_head, *nulls], names=_NAMES)

    def edges(self) -> pa.RecordBatch:
        runs = list((self.head | self.tail).values())
        n = len(runs)
        return pa.RecordBatch.from_arrays(
            [pa.nulls(n, pa.int64()), pa.nulls(n, pa.string()), pa.nulls(n, pa.int32()), pa.array([self.task] * n, pa.int32()), pa.array([r.number for r in runs], pa.int64()),
             pa.array([r.fingerprint for r in runs], pa.int64()), pa.array([r.text for r in runs], pa.string()), pa.array([r.least for r in runs], pa.int64())],
            names=_NAMES,
        )


_NAMES = [c.split()[0] for c in _ROW.split(", ")]


def _range_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = _Range(TaskContext.get().partitionId())
    for batch in batches:
        for part, data, offsets in at.slices(batch):
            yield seen.rows(part, data, offsets)
    yield seen.edges()


def failure_masks(scratch: Scratch, docs: DataFrame, part: str = "lang") -> DataFrame:
    """(doc_id, part, mask) of every row of ``docs``: bits A to E of FILTERS.

    Null texts are empty, and equal to other empty ones.  A row fails E if its text is that of a row with a smaller
    doc_id: rows that repeat an id do not fail for each other, and a row without an id neither fails E nor makes
    others fail.  A null part is the empty string.  Other columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(F.xxhash64(text).alias("fingerprint"), text.alias("text"), "doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"))
    # ranges are cut by (fingerprint, doc_id): their samples hold no texts, and copies in later ranges have larger ids
    ranged = keyed.repartitionByRange("fingerprint", "doc_id").sortWithinPartitions("fingerprint", "text", "doc_id")
    rows = scratch.put(ranged.mapInArrow(_range_rows, _ROW), "masks")
    edges = rows.where("fingerprint is not null")
    least = edges.groupBy("fingerprint", "text").agg(F.min("least").alias("before"))
    late = edges.join(least, ["fingerprint", "text"]).where("before < least").select("task", "run", "before")  # a few rows of each range
    settled = rows.where("fingerprint is null and run is null").select("doc_id", "part", "mask")
    open_ = rows.where("fingerprint is null and run is not null").join(late, ["task", "run"], "left")
    again = F.when(F.col("doc_id") > F.col("before"), F.col("mask").bitwiseOR(F.lit(COPY))).otherwise(F.col("mask"))
    return settled.unionByName(open_.select("doc_id", "part", again.alias("mask")))


def part_counters(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic), additive: documents, those labelled quality=1, those labelled toxic=1.

    Labels that say neither are left out before the join; an id that is labelled twice counts once.
    """
    said = labels.where("doc_id is not null and (quality = 1 or toxic = 1)")
    said = said.groupBy("doc_id").agg(F.max((F.coalesce("quality", F.lit(0)) == 1).cast("long")).alias("good"), F.max((F.coalesce("toxic", F.lit(0)) == 1).cast("long")).alias("toxic"))
    every = masks.select("part", "mask", F.lit(1).cast("long").alias("n"), *(F.lit(0).cast("long").alias(c) for c in ("good", "toxic")))
    marked = masks.join(said, "doc_id").select("part", "mask", F.lit(0).cast("long").alias("n"), "good", "toxic")
    return every.unionByName(marked).groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))


def order_rows(counters: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, from a part's counters.

    A document goes at the first filter of the order that it fails, so over all orders each of the m filters that
    it fails removes it in a fraction 1/m of them.
    """
    orders = ["".join(p) for p in permutations(FILTERS)]
    rows = counters.withColumn("filter_order", F.explode(F.array(*map(F.lit, orders))))
    rows = rows.select("*", F.posexplode(F.split("filter_order", "")).alias("at", "filter")).where("filter <> ''")
    bit = sum((F.when(F.col("filter") == f, F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(FILTERS)), F.lit(0))
    earlier = sum((F.when(F.instr("filter_order", f) <= F.col("at"), F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(FILTERS)), F.lit(0))
    rows = rows.withColumn("bit", bit).withColumn("earlier", earlier)
    fails, gone = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("earlier")) != 0
    total = lambda when, of="n": F.sum(F.when(when, F.col(of)).otherwise(F.lit(0))).cast("long")
    return rows.groupBy("part", "filter_order", (F.col("at") + 1).cast("int").alias("step")).agg(
        total(~fails & ~gone).alias("kept"),
        total(fails & ~gone).alias("removed"),
        total(fails & gone).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(fails & ~gone, "good").alias("good_lost"),
        total(fails & ~gone, "toxic").alias("toxic_lost"),
        F.sum(F.when(fails, F.expr(f"n * {len(orders)} div bit_count(mask)")).otherwise(F.lit(0))).cast("long").alias("shapley"),
    )


def interaction_audit(spark: SparkSession, docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """One row per part, order (all 120) and step, with zeros; see ``order_rows``.  An empty table has no parts and gives no rows."""
    scratch = Scratch(spark, "audit")
    counters = scratch.put(part_counters(failure_masks(scratch, docs, part), labels), "counters")
    scratch.drop("masks")
    return order_rows(counters)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interaction_audit(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS ws,
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY coalesce(text, '')), false) AS e FROM documents),
m AS (
  SELECT doc_id, part, (len(ws) < 100)::INT + 2 * (100 * len(list_distinct(ws)) < 80 * len(ws))::INT
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * e::INT AS mask FROM d),
l AS (SELECT doc_id, max((coalesce(quality, 0) = 1)::INT) AS good, max((coalesce(toxic, 0) = 1)::INT) AS toxic FROM labels GROUP BY 1),
c AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(f, bit)),
o AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a, f b, f c, f d, f e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (
  SELECT filter_order, step, (SELECT bit FROM f WHERE f = filter_order[step]) AS bit, coalesce((SELECT sum(bit) FROM f WHERE instr(filter_order, f) < step), 0)::INT AS earlier
  FROM o, (SELECT unnest(range(1, 6))::INT AS step)),
r AS (SELECT *, mask & bit <> 0 AS fails, mask & earlier <> 0 AS gone FROM c, s)
SELECT part, filter_order, step, coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (fails AND NOT gone), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (fails AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (fails AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (fails AND NOT gone), 0)::BIGINT AS toxic_lost,
  coalesce(sum(n * 120 // greatest(bit_count(mask), 1)) FILTER (fails), 0)::BIGINT AS shapley
FROM r GROUP BY 1, 2, 3"""
