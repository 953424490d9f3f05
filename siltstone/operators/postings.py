"""An inverted index: exact BM25 and word search without reading texts.

Chunks are numbered within blocks of bounded size, and a block is a row that holds its terms and their chunks as packed
numbers.  A posting is a term's chunks in one block, with their counts and what bounds their weight: the largest count and
the smallest length.  Postings are partitioned by a hash of the term and sorted by term and block, so a word search reads
the shards of its terms only, and of those the row groups that may hold them.  Counts of a term over all blocks, of chunks
and of words are sums over blocks, so blocks can be added at any time (``append``).

A ranked search sees all blocks, in waves.  Queries are packed as blocks are, in strips; a tray of blocks comes once for each
group of strips, and a strip once for each tray.  The k-th score of the waves before is what a chunk has to reach, and what the bound
of a block has to reach to be scored.  Nothing that grows with pairs of queries and blocks is a row.  Queries travel as rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.operators.graph import shared_dir, written
from siltstone.operators.hits import DATES, GROUP, admitted, best_of, dates_of, query_group, topk

#: Shards of the terms; chunks and words of a block at most (a longer chunk is a block by itself).
SHARDS, BLOCK, BLOCK_WORDS = 32, 4096, 4_000_000
K1, B = 1.2, 0.75
#: Queries whose terms are cut at once, and rows of scores that a product is added to at once.
QUERIES = 64
#: Queries of a group that a block is copied for, on average; they are scored GROUP at once.
ASKED = 16384
#: Blocks of a tray that a strip of queries is copied for, on average; blocks of the first wave, and how many times as many have been seen after each further one.
TRAY, FIRST, MORE = 16, 12, 8
#: Terms of one matrix product, how sparse a term's part of it may be, and pairs of a query's and a chunk's term that are added at once.
TERMS, SPARSE, PAIRS = 256, 100, 1 << 18
#: Decimals of a score, and slack of its rounding.
DIGITS, _SCORE = 6, 1e-5
_TERM = re.compile(r"[a-z0-9]+")


def words(text: str | None) -> list[str]:
    """Lower-case runs of letters a-z and digits."""
    return _TERM.findall((text or "").lower())


def shard_of(term: str) -> int:
    return crc32(term.encode()) % SHARDS


def weight(tf, dl, mean, k1: float, b: float):
    """A term's weight in a text of ``dl`` words, as numpy numbers or columns."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / mean))


def products(row: np.ndarray, term: np.ndarray, w: np.ndarray, begin: np.ndarray, count: np.ndarray, chunk: np.ndarray, impact: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """(queries x chunks) rounded scores: sums over terms, in their order, of a query's ``w`` (of ``row``, ``term``) times a chunk's ``impact``;
    term i has the ``count[i]`` chunks from ``begin[i]`` on."""
    scores = np.zeros(shape)
    asked = np.bincount(term, minlength=len(count))
    # terms that many queries and many chunks have: as matrix products, TERMS at once; the others pair by pair
    common = asked * count * SPARSE >= scores.size
    dense = np.flatnonzero(common & (asked > 0))
    at_of = np.full(len(count), -1, np.int32)
    for start in range(0, len(dense), TERMS):
        mine = dense[start : start + TERMS]
        at_of[mine] = np.arange(len(mine))
        q, c = (np.zeros((len(mine), n)) for n in shape)
        q_in = at_of[term] >= 0
        q[at_of[term[q_in]], row[q_in]] = w[q_in]
        for i, t in enumerate(mine.tolist()):
            its = slice(begin[t], begin[t] + count[t])
            c[i, chunk[its]] = impact[its]
        for i in range(0, shape[0], QUERIES):
            scores[i : i + QUERIES] += q[:, i : i + QUERIES].T @ c
        at_of[mine] = -1
    # in the order of the queries, PAIRS at once, so that additions stay in a few rows of scores
    alone = np.flatnonzero(~common[term])
    alone = alone[np.argsort(row[alone].astype(np.int16), kind="stable")]
    edges = np.searchsorted(row[alone], np.arange(0, shape[0] + QUERIES, QUERIES))
    to = np.append(0, np.cumsum(count[term[alone]], dtype=np.int64))
    for i, (start, end) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
        rows = scores[i * QUERIES : (i + 1) * QUERIES]
        while start < end:
            stop = min(end, max(start + 1, int(np.searchsorted(to, to[start] + PAIRS, side="right")) - 1))
            one, n = alone[start:stop], np.diff(to[start : stop + 1])
            at = np.arange(to[stop] - to[start]) + np.repeat(begin[term[one]] - (to[start:stop] - to[start]), n)
            place = np.repeat((row[one].astype(np.int64) - i * QUERIES) * shape[1], n) + chunk[at]
            rows += np.bincount(place, np.repeat(w[one], n) * impact[at], rows.size).reshape(rows.shape)
            start = stop
    return np.round(scores, DIGITS, out=scores)


def narrow(numbers: np.ndarray) -> bytes:
    """Numbers from 0 on, in as few bytes each as the largest needs."""
    return numbers.astype(np.min_scalar_type(int(numbers.max(initial=0)))).tobytes()


def widened(packed: bytes, n: int) -> np.ndarray:
    return np.frombuffer(packed, f"u{len(packed) // n}" if n else "u1")


def terms_of(packed: bytes) -> pa.Array:
    """The terms that a space parts."""
    return pc.split_pattern(pa.array([packed.decode()]), " ").values if packed else pa.array([], pa.string())


#: A term's rows in a block or a strip: the terms, how many rows each has, those rows, and how often they have it.
_PACKED = "words binary, counts binary, at binary, tf binary"


def _block_schema(kind: str) -> str:
    return f"block string, n long, n_words long, with_words long, ids array<{kind}>, dl array<int>, dates binary, {_PACKED}"


PACKED = [c.split()[0] for c in _PACKED.split(", ")]
_POSTING = "shard int, term string, block string, n long, most int, least int, at array<int>, tf array<int>"


class Packed:
    """A block, or a strip of queries, as numbers: term i has the ``count[i]`` rows ``at`` from ``begin[i]`` on, which have it ``tf`` times and have ``dl`` words."""

    def __init__(self, row: dict[str, pa.Scalar]):
        words, counts, at, tf = (row[c].as_py() for c in PACKED)
        self.terms, self.dl = terms_of(words), np.asarray(row["dl"].values)
        self.count = widened(counts, len(self.terms)).astype(np.int64)
        pairs = int(self.count.sum())
        self.at, self.tf, self.begin = widened(at, pairs), widened(tf, pairs), np.cumsum(self.count) - self.count


class Strip:
    """Up to GROUP queries while a task scores blocks for them; ``best`` has the k highest scores that the task found for each."""

    def __init__(self, row: dict[str, pa.Scalar], k: int):
        self.its, self.idf, self.k = Packed(row), np.frombuffer(row["idf"].as_py()), k
        self.asked, self.cutoff = (row[c].values for c in ("asked", "cutoff"))
        self.theta, self.best = np.array(row["theta"].values), np.full((len(self.asked), k), -np.inf)
        #: Numbers of the terms among those of all strips.
        self.number: np.ndarray

    def found(self, block: Packed, at: np.ndarray, impact: np.ndarray, upper: np.ndarray, ids: pa.Array, dates: bytes, weigh) -> pa.RecordBatch:
        """The chunks of ``block`` that may be among the k best of a query; ``at``: the place of each term of the strip in the block, or -1."""
        its, there = self.its, at >= 0
        mine, met = np.repeat(there, its.count), at[there]
        row, count = its.at[mine].astype(np.int32), its.count[there]
        w, term = np.repeat(self.idf[there], count) * weigh(its.tf[mine], its.dl[row]), np.repeat(np.arange(len(met), dtype=np.int32), count)
        # queries that the block's bounds rule out are not scored
        bound = np.bincount(row, w * upper[met][term], minlength=len(self.asked))
        live = np.flatnonzero((bound > 0) & (bound >= self.theta - _SCORE))
        if len(live) < len(self.asked):
            to = np.full(len(self.asked), -1, np.int32)
            to[live] = np.arange(len(live))
            kept = to[row] >= 0
            row, term, w = to[row[kept]], term[kept], w[kept]
        scores = products(row, term, w, block.begin[met], block.count[met], block.at, impact, (len(live), len(ids)))
        good = scores >= np.maximum(self.theta[live], 10.0**-DIGITS / 2)[:, None]
        some = np.flatnonzero(good.any(axis=1))
        live, scores, good = live[some], scores[some], good[some]
        good &= admitted(self.cutoff.take(pa.array(live)), dates)
        out = best_of(pa.array(live), ids, scores, good, self.k)
        self._learn(np.asarray(out.column(0)), np.asarray(out.column(2)))
        return pa.RecordBatch.from_arrays([self.asked.take(out.column(0)), *out.columns[1:]], out.schema.names)

    def _learn(self, of: np.ndarray, scores: np.ndarray) -> None:
        """``theta`` rises to the k-th score found; ``of``: each score's query, in order."""
        rows, first, count = np.unique(of, return_index=True, return_counts=True)
        new = np.full((len(rows), self.k), -np.inf)
        new[np.repeat(np.arange(len(rows)), count), np.arange(len(of)) - np.repeat(first, count)] = scores
        if len(rows):
            both = np.concatenate([self.best[rows], new], axis=1)
            self.best[rows] = np.partition(both, self.k, axis=1)[:, self.k :]
            self.theta[rows] = np.maximum(self.theta[rows], self.best[rows].min(axis=1))


def append(points: DataFrame, path: str, name: str = "0", sharded: bool = True) -> PostingIndex:
    """Adds the chunks of ``points`` (chunk_id, text, DATES if cut-offs are to be asked for) to the index as blocks of their own.

    ``sharded``: also writes the postings by term, which word searches read and ranked ones do not; else the first word search does.

    ``name`` tells this addition from others; the same name again replaces it.  Chunks without words are counted, and have no postings.
    """
    spark = points.sparkSession
    schema = _block_schema(dict(points.dtypes)["chunk_id"])
    names = [c.split()[0] for c in schema.split(", ")]
    dated = [c for c in DATES if c in points.columns]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, number_of = TaskContext.get().partitionId(), 0
        held, found, lengths = [], [], []

        def block() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            dl, coded = np.array(lengths, np.int32), pa.chunked_array(found, pa.string()).combine_chunks().dictionary_encode()
            # terms in their order, so that sums do not depend on how they were met
            order = np.asarray(pc.sort_indices(coded.dictionary))
            number = np.empty(len(order), np.int64)
            number[order] = np.arange(len(order))
            # (term, chunk) of each word, in order: a run of equal ones is a chunk that has the term so many times
            pair = np.sort(number[np.asarray(coded.indices)] * len(dl) + np.repeat(np.arange(len(dl)), dl))
            first = np.flatnonzero(np.diff(pair, prepend=-1))
            term, at = np.divmod(pair[first], max(len(dl), 1))
            packed = [" ".join(coded.dictionary.take(pa.array(order)).to_pylist()).encode(), *map(narrow, (np.bincount(term, minlength=len(order)), at, np.diff(np.append(first, len(pair)))))]
            values = [f"{name}-{task}-{number_of}", len(dl), int(dl.sum(dtype=np.int64)), int((dl > 0).sum())]
            lists = [pa.ListArray.from_arrays(pa.array([0, len(dl)], pa.int32()), x) for x in (rows.column(0), pa.array(dl))]
            return pa.RecordBatch.from_arrays([*(pa.array([v]) for v in values), *lists, *(pa.array([v], pa.binary()) for v in (dates_of(rows, dated).tobytes(), *packed))], names)

        for batch in batches:
            begin = 0
            for i, text in enumerate(batch.column(1).to_pylist()):
                its = words(text)
                if lengths and (len(lengths) >= BLOCK or sum_words + len(its) > BLOCK_WORDS):
                    if i > begin:
                        held.append(batch.slice(begin, i - begin))
                    yield block()
                    number_of, begin, held, found, lengths = number_of + 1, i, [], [], []
                sum_words = len(its) + (sum_words if lengths else 0)
                found.append(pa.array(its, pa.string()))
                lengths.append(len(its))
            held.append(batch.slice(begin))
        if lengths:
            yield block()

    # a block is one row of some MB: small row groups, as readers hold a row group
    points.select("chunk_id", "text", *dated).mapInArrow(blocks, schema).write.mode("overwrite").option("parquet.block.size", 1 << 24).parquet(f"{path}/blocks/name={name}")
    index = PostingIndex(spark, path, dict(points.dtypes)["chunk_id"])
    if sharded:
        index.shard(name)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for held, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                terms = terms_of(held)
                yield pa.RecordBatch.from_arrays([pa.array([*map(shard_of, terms.to_pylist())], pa.int32()), terms, pa.array(widened(n, len(terms)).astype(np.int64))], ["shard", "term", "n"])

    each = index._blocks().select("words", "counts").mapInArrow(counts, "shard int, term string, n long")
    counted = each.groupBy("shard", "term").agg(F.sum("n").alias("df"))
    counted.hint("rebalance", "shard").sortWithinPartitions("shard", "term").write.mode("overwrite").partitionBy("shard").parquet(f"{path}/terms")
    index.sharded = sharded
    return index


def temporary(points: DataFrame, sharded: bool = True) -> PostingIndex:
    """An index in the shared folder, for one job."""
    return append(points, shared_dir(points.sparkSession, "postings"), sharded=sharded)


@dataclass
class PostingIndex:
    spark: SparkSession
    path: str
    #: Type of the chunks' ids.
    id_type: str = "bigint"
    #: Whether the postings are also there by term.
    sharded: bool = True

    def _blocks(self) -> DataFrame:
        return self.spark.read.schema(f"{_block_schema(self.id_type)}, name string").parquet(f"{self.path}/blocks")

    def shard(self, name: str) -> None:
        """Writes the postings of an addition by term."""

        def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The postings of blocks, a block at once."""
            for batch in batches:
                for row in (dict(zip(batch.schema.names, c, strict=True)) for c in zip(*batch.columns, strict=True)):
                    its = Packed(row)
                    if not len(its.terms):
                        continue
                    most, least = np.maximum.reduceat(its.tf, its.begin), np.minimum.reduceat(its.dl[its.at], its.begin)
                    offsets = pa.array(np.append(its.begin, len(its.at)), pa.int32())
                    lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (its.at, its.tf)]
                    shards = pa.array([*map(shard_of, its.terms.to_pylist())], pa.int32())
                    columns = [shards, its.terms, pa.array([row["block"].as_py()] * len(shards)), pa.array(its.count), *(pa.array(x.astype(np.int32)) for x in (most, least)), *lists]
                    yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _POSTING.split(", ")])

        rows = self._blocks().where(F.col("name") == name).select("block", "dl", *PACKED).mapInArrow(posted, _POSTING)
        # each shard to as many tasks as there are partitions for it, none with two shards: hashes of so few keys would meet, and a task sort several
        each = -(-int(self.spark.conf.get("spark.sql.shuffle.partitions")) // SHARDS)
        task = F.col("shard") * each + F.pmod(F.xxhash64("block"), F.lit(each)).cast("int")
        dealt = rows.repartitionById(SHARDS * each, task).sortWithinPartitions("shard", "term", "block")
        dealt.withColumn("kind", F.lit("posting")).write.mode("overwrite").partitionBy("kind", "shard").parquet(f"{self.path}/index/name={name}")

    def postings(self) -> DataFrame:
        """(shard, term, block, n, most, least, at, tf): a term's chunks in a block, by their places in it."""
        if not self.sharded:
            for r in self._blocks().select("name").distinct().collect():
                self.shard(r.name)
            self.sharded = True
        rows = self.spark.read.schema(f"kind string, {_POSTING}, name string").parquet(f"{self.path}/index")
        return rows.where("kind = 'posting'").select("shard", "term", "block", "n", "most", "least", "at", "tf")

    def blocks(self) -> DataFrame:
        """(block, n, n_words, with_words, ids, dl, dates)"""
        return self._blocks().select("block", "n", "n_words", "with_words", "ids", "dl", "dates")

    def terms(self) -> DataFrame:
        """(shard, term, df)"""
        return self.spark.read.schema("shard int, term string, df long").parquet(f"{self.path}/terms")

    @cached_property
    def statistics(self) -> tuple[int, float]:
        """(chunks, mean words of those that have words)"""
        r = self.blocks().agg(F.sum("n").alias("n"), F.sum("n_words").alias("w"), F.sum("with_words").alias("c")).first()
        return r.n or 0, (r.w or 0) / max(r.c or 0, 1)

    # word search

    def holding(self, asked: list[str]) -> DataFrame:
        """(chunk_id): the chunks that hold all of these words.  Reads the postings of these words only."""
        found = sorted(set(asked))
        mine = self.postings().where(F.col("shard").isin(sorted({shard_of(w) for w in found})) & F.col("term").isin(found))
        both = mine.select("block", F.explode("at").alias("at")).groupBy("block", "at").agg(F.count("*").alias("n")).where(F.col("n") == len(found))
        return both.join(self.blocks().select("block", "ids"), "block").select(F.element_at("ids", F.col("at") + 1).alias("chunk_id"))

    # BM25

    def _asked(self, queries: DataFrame, mean: float, n: int, k1: float, b: float) -> DataFrame:
        """(group, place, query_id, cutoff, shard, term, qf, ql, idf, w): queries numbered within their groups, with the weights of their terms."""
        cutoff = F.col("cutoff") if "cutoff" in queries.columns else F.lit(None).cast("date")
        rows = query_group(written(queries.select("query_id", cutoff.alias("cutoff"), "text"), "queries"), ASKED)
        rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("group").orderBy("query_id")) - 1)
        kept = "group int, place int, query_id " + dict(queries.dtypes)["query_id"] + ", cutoff date"

        names = ["group", "place", "query_id", "cutoff"]

        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in (whole.slice(i, QUERIES) for i in range(0, whole.num_rows, QUERIES)):
                    row, shard, term, qf, ql = [], [], [], [], []
                    for i, text in enumerate(batch.column(4).to_pylist()):
                        found = words(text)
                        for t, count in Counter(found).items():
                            row.append(i), shard.append(shard_of(t)), term.append(t), qf.append(count), ql.append(len(found))
                    own = batch.select(names).take(pa.array(row, pa.int64())).columns  # not the text: that would be copied for each of its terms
                    yield pa.RecordBatch.from_arrays([*own, pa.array(shard, pa.int32()), pa.array(term, pa.string()), pa.array(qf, pa.int32()), pa.array(ql, pa.int32())], [*names, "shard", "term", "qf", "ql"])

        terms = rows.select(*names, "text").mapInArrow(split, f"{kept}, shard int, term string, qf int, ql int")
        df = F.col("df").cast("double")
        idf = F.log((F.lit(float(n)) - df + 0.5) / (df + 0.5) + 1)
        weighed = terms.join(self.terms(), ["shard", "term"]).withColumn("idf", idf).withColumn("w", F.col("idf") * weight(F.col("qf"), F.col("ql"), F.lit(mean), k1, b))
        return written(weighed.drop("df"), "query-terms")

    def bounds(self, weighed: DataFrame, mean: float, k1: float = K1, b: float = B) -> DataFrame:
        """(group, place, query_id, cutoff, block, bound): no chunk of the block scores higher for the query.  Reads no posting's chunks."""
        limits = self.postings().select("shard", "term", "block", "most", "least")
        each = weighed.join(limits, ["shard", "term"]).groupBy("group", "place", "query_id", "cutoff", "block")
        return each.agg(F.sum(F.col("w") * weight(F.col("most"), F.col("least"), F.lit(mean), k1, b)).alias("bound"))

    @staticmethod
    def _strips(weighed: DataFrame) -> DataFrame:
        """(group, strip, asked, cutoff, dl, words, counts, at, tf, idf): up to GROUP queries of a group, packed as a block is, with their terms' weights."""
        query_id = dict(weighed.dtypes)["query_id"]
        schema = f"group int, strip int, asked array<{query_id}>, cutoff array<date>, dl array<int>, {_PACKED}, idf binary"
        size = GROUP

        def pack(found: pa.Table) -> pa.Table:
            found = found.sort_by([("term", "ascending"), ("place", "ascending")]).combine_chunks()
            places, first, at = np.unique(np.asarray(found["place"].combine_chunks()), return_index=True, return_inverse=True)
            of = lambda name: found[name].combine_chunks()
            coded = of("term").dictionary_encode()
            count = np.bincount(np.asarray(coded.indices), minlength=len(coded.dictionary))
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            lists = [one(of(c).take(pa.array(first))) for c in ("query_id", "cutoff", "ql")]
            packed = [" ".join(coded.dictionary.to_pylist()).encode(), narrow(count), narrow(at), narrow(np.asarray(of("qf"))), np.asarray(of("idf"))[np.cumsum(count) - count].tobytes()]
            group = int(found["group"][0].as_py())
            return pa.Table.from_arrays([pa.array([group], pa.int32()), pa.array([int(places[0]) // size], pa.int32()), *lists, *(pa.array([x], pa.binary()) for x in packed)], [c.split()[0] for c in schema.split(", ")])

        strip = F.floor(F.col("place") / size).cast("int")
        rows = weighed.select("group", strip.alias("strip"), "place", "query_id", "cutoff", "term", "qf", "ql", "idf")
        return written(rows.groupBy("group", "strip").applyInArrow(pack, schema), "strips")

    @staticmethod
    def met(strips: DataFrame, blocks: DataFrame, groups: int, trays: int) -> DataFrame:
        """What tasks see, one tray of ``blocks`` for one group each: the strips of the group, then the blocks.  A strip comes once for each tray, a block once for each group."""
        numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        rows = strips.withColumn("tray", numbers(trays)).unionByName(blocks.drop("n", "n_words", "with_words").withColumn("group", numbers(groups)), allowMissingColumns=True)
        task = (F.col("group") * trays + F.col("tray")).cast("int")
        return rows.withColumn("task", task).repartitionById(groups * trays, F.col("task")).sortWithinPartitions("task", F.col("block").isNotNull()).drop("group", "tray", "task", "strip")

    def _scored(self, strips: DataFrame, blocks: DataFrame, groups: int, trays: int, k: int, mean: float, k1: float, b: float) -> DataFrame:
        """(query_id, chunk_id, score): the chunks of ``blocks`` (with the tray of each) that may be among the k best of a query, none below its ``theta``."""
        kinds = {"query_id": dict(strips.dtypes)["asked"][6:-1], "chunk_id": self.id_type}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, asked = [], None
            for batch in batches:
                for row in (dict(zip(batch.schema.names, c, strict=True)) for c in zip(*batch.columns, strict=True)):
                    if not row["block"].is_valid:
                        held, asked = [*(held if asked is None else []), Strip(row, k)], None
                        continue
                    if asked is None:  # the terms of all strips, numbered
                        coded = pa.chunked_array([s.its.terms for s in held], pa.string()).combine_chunks().dictionary_encode()
                        asked, codes = coded.dictionary, np.split(np.asarray(coded.indices), np.cumsum([len(s.its.terms) for s in held])[:-1]) if held else []
                        for s, number in zip(held, codes, strict=True):
                            s.number, s.its.terms = number, None
                    block, ids, dates = Packed(row), row["ids"].values, row["dates"].as_py()
                    if not len(block.terms):
                        continue
                    at = np.asarray(pc.index_in(asked, block.terms).fill_null(-1))
                    impact = weight(block.tf, block.dl[block.at], mean, k1, b)
                    upper = weight(np.maximum.reduceat(block.tf, block.begin), np.minimum.reduceat(block.dl[block.at], block.begin), mean, k1, b)
                    for s in held:
                        yield s.found(block, at[s.number], impact, upper, ids, dates, lambda tf, dl: weight(tf, dl, mean, k1, b))

        return self.met(strips, blocks, groups, trays).mapInArrow(run, f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, score double")

    def search(self, queries: DataFrame, k: int, k1: float = K1, b: float = B) -> DataFrame:
        """(query_id, chunk_id, score, rank) by BM25, both sides weighted: the ``k`` best chunks for each query (query_id, text, cutoff), of those
        that its cut-off admits; ties go to the smaller id, chunks without a shared term are not in it.

        Statistics are those of all chunks, whatever a query's cut-off admits.  Blocks are seen in waves by a hash of their names: FIRST of them, then so many that MORE
        times as many have been seen, and so on; what a wave has found tells the next one what a chunk has to reach.
        """
        n, mean = self.statistics
        strips = self._strips(self._asked(queries, mean, n, k1, b))
        groups = (strips.agg(F.max("group")).first()[0] or 0) + 1
        member = strips.select("group", "strip", F.posexplode("asked").alias("at", "query_id"))
        total, order = self.blocks().count(), [F.desc("score"), F.asc("chunk_id")]
        hashed = self._blocks().drop("name").withColumn("h", F.xxhash64("block"))
        best, low, high = None, 0.0, min(1.0, FIRST / max(total, 1))
        while low < 1.0:
            high = high if high <= 0.5 else 1.0
            mine = max(1, round(total * (high - low)))
            trays = max(-(-mine // TRAY), min(mine, 4 * self.spark.sparkContext.defaultParallelism))
            place = F.pmod("h", F.lit(1 << 20)) / (1 << 20)
            blocks = hashed.where((place >= low) & (place < high)).withColumn("tray", F.pmod(F.shiftright("h", 20), F.lit(trays)).cast("int")).drop("h")
            known = member.withColumn("theta", F.lit(-1.0))
            if best is not None:
                reached = best.where(F.col("rank") == k).select("query_id", F.col("score").alias("theta"))
                known = member.join(reached, "query_id", "left").withColumn("theta", F.coalesce("theta", F.lit(-1.0)))
            theta = known.groupBy("group", "strip").agg(F.array_sort(F.collect_list(F.struct("at", "theta"))).alias("t")).select("group", "strip", F.col("t.theta").alias("theta"))
            found = self._scored(strips.join(theta, ["group", "strip"]), blocks, groups, trays, k, mean, k1, b)
            rows = topk(found if best is None else best.drop("rank").unionByName(found), "query_id", order, k)
            best, low, high = written(rows, "best"), high, min(1.0, high * MORE)
        return best

    @staticmethod
    def homes(bounds: DataFrame) -> DataFrame:
        """(group, place, query_id, cutoff, block): the block that promises most to each query.  Queries of one block are in groups of their
        own, so a block's postings are copied for each GROUP of those queries, not for every group that has one of them."""
        best = topk(bounds, "query_id", [F.desc("bound"), F.asc("block")], 1).drop("rank", "bound", "group", "place")
        share = F.pmod(F.xxhash64("query_id"), F.ceil(F.count("*").over(Window.partitionBy("block")) / GROUP)).cast("int")
        return best.withColumn("group", share).withColumn("place", F.row_number().over(Window.partitionBy("block", "group").orderBy("query_id")) - 1)

    @staticmethod
    def remaining(bounds: DataFrame, theta: DataFrame) -> DataFrame:
        """Pairs of query and block whose bound reaches the query's ``theta``."""
        floor: Column = F.coalesce("theta", F.lit(-1.0))
        return bounds.join(theta, "query_id", "left").withColumn("theta", floor).where(F.col("bound") >= F.col("theta") - F.lit(_SCORE)).drop("bound")
