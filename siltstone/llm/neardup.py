"""MinHash near-duplicates by an LSH forest.

Documents with equal shingle sets are one class from the start.  Each class has a signature of TREES labels of
DEPTH min-hashes.  For each tree the classes are sorted by label; a class's candidates are its neighbours in
that order with the longest common prefix, LEAST_DEPTH values at least.  Where a prefix region is small, all of
it lies in the window; where it is large, the window narrows to the next few, which share more values: the
depth adapts to the region.  Candidates that pass a bound from a two-bit sketch are confirmed on full sets.
Classes of large regions are joined once more once components are known, exactly: each class lists its rarest
shingles, as many as any similar class must share one of, and classes of other components that meet on one,
early enough in both lists for their sizes, are candidates.  Nothing is cut: lists of a frequent shingle are
split by a salt, and cells of all pairs of salts are compared.

A pair of similarity 0.8 shares LEAST_DEPTH values in one tree or more with probability 1 - (1 - 0.8**3)**16,
over 0.99998; then it is in a window, or both are classes of large regions and are joined.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import arrowtext as at
from siltstone.llm.components import components, written

TREES, DEPTH, LEAST_DEPTH = 16, 8, 3
N_HASHES = TREES * DEPTH
#: Neighbours looked at in regions of up to WINDOW + 1 classes, and in larger ones.
WINDOW, NARROW = 16, 3
#: Shingles are ordered by how often their bucket of 2**BUCKET_BITS is met; a list of more than CELL classes is split.
BUCKET_BITS, CELL = 20, 8192
#: Lists up to this length are compared at all distances at once, longer ones in blocks.
SHORT = 64
SKETCH_BYTES = N_HASHES // 4
#: A sketch of a linked pair falls this far below the threshold once in some 10**6 pairs.
SKETCH_MARGIN = 0.2
_MULTIPLIERS = at.mix(np.arange(1, N_HASHES + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every run of ``size`` lower-cased words, or of the whole sequence of a shorter text; rows ascend."""
    low = at.lower_ascii(data)
    start, stop, row = at.words(low, offsets)
    hashes = at.span_hash(at.prefix_hash(low), start, stop)
    gram, gram_row = at.ngrams(hashes, row, size)
    keep = gram_row >= 0
    found, rows = [gram[keep]], [gram_row[keep]]
    n_words = at.count_by_row(row, len(offsets) - 1)
    first = np.concatenate([[0], np.cumsum(n_words)[:-1]])
    for k in range(1, size):
        short = np.flatnonzero(n_words == k)
        if len(short):
            g, _ = at.ngrams(hashes, row, k)
            found.append(at.mix(g[first[short]] + np.uint64(k)))
            rows.append(short)
    if len(found) == 1:
        return found[0], rows[0]
    h, r = np.concatenate(found), np.concatenate(rows)
    order = np.argsort(r, kind="stable")
    return h[order], r[order]


def sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    h, row = shingles(data, offsets, size)
    cut = np.searchsorted(row, np.arange(len(offsets)))
    out = []
    for i in range(len(offsets) - 1):
        s = np.sort(h[cut[i] : cut[i + 1]])
        out.append(s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s)
    return out


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, two sums that identify the set, and its min-hashes.  Map only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in at.slices(batch):
                each = sets(data, offsets, size)
                n = np.array([len(s) for s in each], np.int64)
                some = np.flatnonzero(n)
                h = np.concatenate([each[i] for i in some]) if len(some) else np.zeros(0, np.uint64)
                start = np.concatenate([[0], np.cumsum(n[some])[:-1]]).astype(np.int64)
                sig = np.zeros((len(each), N_HASHES), ">u4")
                low, high = np.zeros(len(each), np.uint64), np.zeros(len(each), np.uint64)
                if len(some):
                    for j in range(N_HASHES):
                        x = h * _MULTIPLIERS[j]
                        x ^= x >> np.uint64(29)
                        sig[some, j] = np.minimum.reduceat((x * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)).astype(np.uint32), start)
                    low[some] = np.add.reduceat(at.mix(h), start)
                    high[some] = np.add.reduceat(at.mix(h ^ np.uint64(0x5DEECE66D)), start)
                raw = sig.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n), pa.array(low.view(np.int64)), pa.array(high.view(np.int64)), pa.array([raw[i * 4 * N_HASHES : (i + 1) * 4 * N_HASHES] for i in range(len(each))], pa.binary())],
                    ["doc_id", "n_shingles", "low", "high", "sig"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, low long, high long, sig binary")


_ROWS = "tree int, label binary, class_id long, n long, component long"


def forest_rows(classes: DataFrame) -> DataFrame:
    """TREES rows for each class (class_id, n, sig, component): its label in the tree, with a sketch of two bits of each min-hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at_ in range(0, batch.num_rows, 1000):
                part = batch.slice(at_, 1000)
                m = part.num_rows
                sig = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint8).reshape(m, N_HASHES, 4)
                bits = (sig[:, :, 3] & 3).reshape(m, SKETCH_BYTES, 4)
                sketch = (bits[..., 0] | bits[..., 1] << 2 | bits[..., 2] << 4 | bits[..., 3] << 6).astype(np.uint8)
                body = np.concatenate([sig.reshape(m, TREES, 4 * DEPTH), np.broadcast_to(sketch[:, None, :], (m, TREES, SKETCH_BYTES))], axis=2)
                width = 4 * DEPTH + SKETCH_BYTES
                raw = np.ascontiguousarray(body).tobytes()
                spread = [pa.array(np.repeat(np.asarray(part.column(i)), TREES)) for i in (0, 1, 3)]
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(TREES, dtype=np.int32), m)), pa.array([raw[i : i + width] for i in range(0, len(raw), width)], pa.binary()), *spread], ["tree", "label", "class_id", "n", "component"])

    return classes.select("class_id", "n", "sig", "component").mapInArrow(run, _ROWS)


_ONES = np.array([bin(b).count("1") for b in range(256)], np.uint8)


class Sorted:
    """Neighbouring rows of the order by (tree, label)."""

    def __init__(self, tree: np.ndarray, label: np.ndarray, ids: np.ndarray, n: np.ndarray, component: np.ndarray):
        self.columns = tree, label, ids, n, component
        self.label, self.ids, self.n, self.component = label, ids, n, component
        prefix = label[:, : 4 * LEAST_DEPTH]
        new = np.concatenate([[True], (tree[1:] != tree[:-1]) | (prefix[1:] != prefix[:-1]).any(axis=1)])
        self.region = np.cumsum(new) - 1
        self.size = np.bincount(self.region)[self.region]

    def agreement(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Min-hashes of which the sketches agree."""
        x = self.label[i, 4 * DEPTH :] ^ self.label[j, 4 * DEPTH :]
        return N_HASHES - _ONES[(x | x >> 1) & 0x55].sum(axis=1, dtype=np.int64)

    def possible(self, i: np.ndarray, threshold: float, shift: int) -> tuple[np.ndarray, np.ndarray]:
        """Those pairs (i, i + shift) whose sizes admit the similarity."""
        j = i + shift
        small, large = np.minimum(self.n[i], self.n[j]), np.maximum(self.n[i], self.n[j])
        ok = (self.ids[i] != self.ids[j]) & (small >= threshold * large - 1e-9)
        return i[ok], j[ok]

    def window(self, fresh: int, threshold: float, least: float) -> tuple[np.ndarray, np.ndarray]:
        """First round: candidates (i, j), i < j, with j at ``fresh`` or after it."""
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for s in range(1, min(WINDOW, len(self.ids) - 1) + 1):
            i = np.flatnonzero(self.region[s:] == self.region[:-s])
            i = i[i + s >= fresh]
            if s > NARROW:
                i = i[self.size[i] <= WINDOW + 1]
            i, j = self.possible(i, threshold, s)
            ok = self.agreement(i, j) >= least
            a.append(i[ok]), b.append(j[ok])
        return np.concatenate(a), np.concatenate(b)


def neighbours(rows: DataFrame, threshold: float) -> DataFrame:
    """Candidate pairs a < b from rows sorted by (tree, label), and (class, null) for classes of large or divided regions."""
    least = max(threshold - SKETCH_MARGIN, 0.0)
    least = (least + (1 - least) / 4) * N_HASHES  # two bits agree by chance in a quarter of the cases
    carry = WINDOW + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Sorted | None = None

        def found(a: np.ndarray, b: np.ndarray, crowd: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([a, crowd])), pa.concat_arrays([pa.array(b), pa.nulls(len(crowd), pa.int64())])], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            label = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            now = (np.asarray(batch.column(0)), label, *(np.asarray(batch.column(i)) for i in (2, 3, 4)))
            first, fresh = held is None, 0
            if held is not None:
                last = [x[-carry:] for x in held.columns]
                fresh = len(last[0])
                now = tuple(np.concatenate([x, y]) for x, y in zip(last, now, strict=True))
            held = Sorted(*now)
            i, j = held.window(fresh, threshold, least)
            a, b = np.minimum(held.ids[i], held.ids[j]), np.maximum(held.ids[i], held.ids[j])
            # the first and last region of a partition may go on in another one
            crowd = (held.size > WINDOW + 1) | (first & (held.region == 0))
            yield found(a, b, np.unique(held.ids[crowd]))
        if held is not None:
            none = np.zeros(0, np.int64)
            yield found(none, none, np.unique(held.ids[held.region == held.region[-1]]))

    ordered = rows.repartitionByRange("tree", "label", "class_id").sortWithinPartitions("tree", "label", "class_id")
    return ordered.mapInArrow(run, "a long, b long").distinct()


def frequencies(docs: DataFrame, size: int) -> np.ndarray:
    """How often each bucket of shingles is met, saturating within a partition.  Any counts give a right order; good ones a fast one."""
    block = 1 << 14

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BUCKET_BITS, np.int64)
        for batch in batches:
            for _, data, offsets in at.slices(batch):
                for s in sets(data, offsets, size):
                    total[(s >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)] += 1
        if total.any():
            raw = [zlib.compress(total[i : i + block].astype("<u4").tobytes(), 1) for i in range(0, len(total), block)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(raw), dtype=np.int32)), pa.array(raw, pa.binary())], ["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(zlib.decompress(raw), "<u4").astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["block", "counts"])

    schema = "block int, counts binary"
    out = np.zeros(1 << BUCKET_BITS, np.int64)
    for row in docs.select("doc_id", "text").mapInArrow(count, schema).repartition("block").mapInArrow(add, schema).collect():
        out[row.block * block : (row.block + 1) * block] = np.frombuffer(row.counts, np.int64)
    return out


_LISTED = "cell long, class_id long, component long, n int, top int, side int"


def listed(crowded: DataFrame, counts: np.ndarray, size: int, threshold: float) -> DataFrame:
    """A row for each of the rarest shingles of each class (class_id, text, component): a class of the similarity shares one of them.

    ``top`` is the size of the largest class that may have the similarity if this is the first shared shingle.
    A frequent shingle has one cell for each two salts; ``side`` tells the salts of a cell apart, -1 if they are equal.
    """
    whole = max(round(threshold * 100), 1)
    shared = crowded.sparkSession.sparkContext.broadcast((counts, int(2 * counts.mean())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, usual = shared.value
        for batch in batches:
            for part, data, offsets in at.slices(batch):
                out: list[list[np.ndarray]] = [[], [], [], [], [], []]
                ids, component = np.asarray(part.column(0)), np.asarray(part.column(2))
                salt = at.mix(ids.astype(np.uint64)) >> np.uint64(32)
                for k, s in enumerate(sets(data, offsets, size)):
                    n = len(s)
                    much = counts[(s >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]
                    top = (n - np.arange(n)) * (100 + whole) // whole - n
                    some = int((100 * top >= whole * n).sum())  # top falls along the list
                    order = np.lexsort((s, much))[:some]
                    token, top = s[order], top[:some]
                    salts = 1 + np.maximum(much[order] - usual, 0) // CELL
                    rep = np.repeat(np.arange(some), salts)
                    other = np.arange(len(rep)) - np.repeat(np.cumsum(salts) - salts, salts)
                    own = (salt[k] % salts[rep].astype(np.uint64)).astype(np.int64)
                    low, high = np.minimum(own, other), np.maximum(own, other)
                    cell = at.mix(token[rep] + at.mix((low << 32 | high).astype(np.uint64)))
                    side = np.where(low == high, -1, (own == high).astype(np.int64))
                    for column, x in zip(out, (cell.view(np.int64), np.full(len(rep), ids[k]), np.full(len(rep), component[k]), np.full(len(rep), n), top[rep], side), strict=True):
                        column.append(x)
                columns = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64 if i < 3 else np.int32)) for i, x in enumerate(columns)], ["cell", "class_id", "component", "n", "top", "side"])

    return crowded.select("class_id", "text", "component").mapInArrow(run, _LISTED)


def met(cell: np.ndarray, ids: np.ndarray, component: np.ndarray, n: np.ndarray, top: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of classes of different components, from whole cells in order, whose sizes and places in the lists admit the similarity."""
    if not len(cell):
        return
    first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    length = np.diff(np.append(first, len(cell)))
    mixed = np.minimum.reduceat(component, first) != np.maximum.reduceat(component, first)

    def fits(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return (component[i] != component[j]) & (n[i] <= top[j]) & (n[j] <= top[i]) & ((side[i] < 0) | (side[i] != side[j]))

    short = np.repeat(mixed & (length <= SHORT), length)
    i, s = np.flatnonzero(short), 0
    while len(i):
        s += 1
        i = i[i + s < len(cell)]
        i = i[cell[i + s] == cell[i]]
        ok = i[fits(i, i + s)]
        yield ids[ok], ids[ok + s]
    for g in np.flatnonzero(mixed & (length > SHORT)):
        rows = np.arange(first[g], first[g] + length[g])
        names, count = np.unique(component[rows], return_counts=True)
        light = rows[component[rows] != names[count.argmax()]]  # of two different components one is not the largest
        for k in range(0, len(light), 256):
            x = light[k : k + 256]
            a, b = np.nonzero(fits(x[:, None], rows[None, :]))
            yield ids[x[a]], ids[rows[b]]


def meetings(rows: DataFrame) -> DataFrame:
    """Candidate pairs a < b from the rows of ``listed``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            for x, y in met(*columns):
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

        held: list[list[np.ndarray]] = []  # rows of the last cell, which may go on
        for batch in batches:
            now = [np.asarray(c) for c in batch.columns]
            if not len(now[0]):
                continue
            last = np.searchsorted(now[0], now[0][-1])  # sorted by cell
            if last == 0 and held and held[0][0][0] == now[0][-1]:
                held.append(now)
                continue
            yield from pairs([np.concatenate(x) for x in zip(*held, [c[:last] for c in now], strict=True)])
            held = [[c[last:] for c in now]]
        if held:
            yield from pairs([np.concatenate(x) for x in zip(*held, strict=True)])

    return rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "a long, b long").where("a < b").distinct()


def confirmed(docs: DataFrame, pairs: DataFrame, size: int, threshold: float) -> DataFrame:
    """The pairs whose full sets have the similarity; ``docs`` has one row for each id of a pair at least."""

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in at.slices(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in sets(data, offsets, size)], pa.binary())], ["id", "shingles"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = round(threshold * 100)
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= whole * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

    needed = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    # always by a shuffle: the ids grow with the documents and are not broadcast at any size
    found = docs.select("doc_id", "text").join(needed.hint("merge"), "doc_id", "left_semi").mapInArrow(to_sets, "id long, shingles binary")
    left = pairs.join(found.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")
    both = left.join(found.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long")


def near_duplicates(spark: SparkSession, docs: DataFrame, size: int = 5, threshold: float = 0.8) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable), kept (doc_id = component_id).

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a document's set has its distinct runs of ``size``
    words, or the whole sequence if it has fewer.  A document without words (or with a null text) has an empty
    set, no links, and is kept.  Rows with a null doc_id are left out; rows that repeat a doc_id with another
    text are documents of the same id; other columns are ignored; an empty table gives an empty result.
    """
    docs = docs.where("doc_id is not null")
    signed = written(spark, signatures(docs, size), "signatures")
    key = ["low", "high", "n_shingles"]
    classes = written(spark, signed.where("n_shingles > 0").groupBy(*key).agg(F.min("doc_id").alias("class_id"), F.first("sig").alias("sig")).withColumnRenamed("n_shingles", "n"), "classes")
    alone = classes.withColumn("component", F.col("class_id"))
    found = written(spark, neighbours(forest_rows(alone), threshold), "candidates")
    parts = components(spark, confirmed(docs, found.where("b is not null"), size, threshold))
    crowd = found.where("b is null").select(F.col("a").alias("class_id"))
    crowded = classes.join(crowd, "class_id").join(parts.withColumnRenamed("id", "class_id"), "class_id", "left").withColumn("component", F.coalesce("component", "class_id"))
    texts = docs.select(F.col("doc_id").alias("class_id"), "text").join(crowded.select("class_id", "component").hint("merge"), "class_id")
    more = written(spark, meetings(listed(texts, frequencies(docs, size), size, threshold)), "candidates")
    # the stars of the first round take few more rounds to settle with the new links
    parts = components(spark, parts.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(confirmed(docs, more, size, threshold)))
    placed = classes.select("low", "high", F.col("n").alias("n_shingles"), "class_id").join(parts.withColumnRenamed("id", "class_id"), "class_id", "left")
    placed = placed.select(*key, F.coalesce("component", "class_id").alias("component"))
    out = signed.select("doc_id", *key).join(placed, key, "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def op4_minhash_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), size=2)


#: All pairs of documents that share a shingle, counted: for small tables only.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN [ws[1]] ELSE [ws[i] || ' ' || ws[i + 1] FOR i IN range(1, len(ws))] END) AS g FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
df AS (SELECT g, count(*) AS f FROM s GROUP BY 1),
r AS (SELECT s.doc_id, s.g, n.n, row_number() OVER (PARTITION BY s.doc_id ORDER BY df.f, s.g) AS pos FROM s JOIN df USING (g) JOIN n USING (doc_id)),
p AS (SELECT * FROM r WHERE pos <= n - ceil(0.8 * n) + 1),
c AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b, x.n AS na, y.n AS nb FROM p x JOIN p y ON x.g = y.g AND x.doc_id < y.doc_id WHERE 10 * least(x.n, y.n) >= 8 * greatest(x.n, y.n)),
e AS (SELECT a, b FROM c JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b AND y.g = x.g GROUP BY a, b, na, nb HAVING 100 * count(*) >= 80 * (na + nb - count(*))),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a),
comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN comp USING (doc_id)
"""
