"""Token ids in a content-addressed store.

Layout of a store directory:

- ``objects/kind=chunk``: one row per distinct chunk (sha256, number of ids, ids as little-endian uint16, or
  uint32 where an id needs it);
- ``objects/kind=recipe``: one row per document with the addresses of its chunks in order (unsorted staging);
- ``recipes``: the same rows in ascending doc_id order, each with its file's number (``shard``) and the
  document's root over its chunks' addresses; ``manifest``: one row per shard (the Merkle root over its documents'
  roots in order; its rows; its ids).

A chunk ends where a rolling hash of the last ids meets a mask, so equal runs of ids in different documents
make equal chunks.  Reading checks every chunk against its address, every document against its root and every
shard against the manifest's.
"""

from __future__ import annotations

import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.llm.arrowtext import mix
from siltstone.llm.bpe import tokenizer_bytes
from siltstone.llm.pretokens import Vocabulary, byte_chars
from siltstone.llm.units import Ids, blocks, held

#: The id that ends each document.
END_ID = 2
WINDOW, MASK_BITS, LEAST, MOST = 16, 9, 128, 4096
#: Pre-tokens and units that a worker remembers.
MEMO_ENTRIES = 600_000
SEEN_CHUNKS = 50_000
#: Children of a node of a shard's tree (a power of two) and its levels: places have 33 bits.
FAN_BITS, LEVELS = 9, 4


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder name in the folder that all executors share (spark.checkpoint.dir)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


class LibraryIds(Ids):
    """Ids by the tokenizers library.  Its BPE model is given pre-tokens, many at once: in the characters that stand
    for their bytes there is no white space, so spaces part them, and the ids divide by the bytes they stand for."""

    def __init__(self, tokenizer_json: bytes, limit: int = MEMO_ENTRIES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        vocabulary = Vocabulary(tokenizer_json)
        self._library = Tokenizer(Tokenizer.from_str(tokenizer_json.decode()).model)
        self._library.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self._bytes = np.array([len(s) for s in vocabulary.strings], np.int64)
        self._chars = np.array([ord(c) for c in byte_chars()], "<u4")
        super().__init__(limit, vocabulary.special)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, lengths, n = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], len(words)
        data = np.frombuffer("".join(words).encode("utf-8", "replace"), np.uint8)
        first = np.append(np.flatnonzero(data & 0xC0 != 0x80), len(data))  # of each character
        ends = np.concatenate([[0], first[np.cumsum(np.fromiter(map(len, words), np.int64, n))]])  # of the words, in bytes
        spaced = np.full(len(data) + n, 32, "<u4")
        spaced[np.arange(len(data)) + np.repeat(np.arange(n), np.diff(ends))] = self._chars[data]
        for at in range(0, n, 2000):
            to = min(at + 2000, n)
            text = spaced[ends[at] + at : ends[to] + to - 1].tobytes().decode("utf-32-le")
            found = np.array(self._library.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            ids.append(found)
            lengths.append(np.diff(np.searchsorted(np.cumsum(self._bytes[found]), ends[at + 1 : to + 1] - ends[at]) + 1, prepend=0))
        return np.concatenate(ids), np.concatenate(lengths)


def library_of(tokenizer_json: bytes) -> LibraryIds:
    return held("library", tokenizer_json, LibraryIds)


def marks_of(ids: np.ndarray) -> np.ndarray:
    """The ends at which a rolling hash of the last WINDOW ids meets the mask."""
    if len(ids) < WINDOW:
        return np.zeros(0, np.int64)
    h = mix(ids.astype(np.uint64) + np.uint64(1))
    total = np.zeros(len(ids) + 1, np.uint64)
    np.cumsum(h, out=total[1:])
    rolling = mix(total[WINDOW:] - total[:-WINDOW] + h[WINDOW - 1 :] * np.uint64(3))
    return np.flatnonzero(rolling & np.uint64((1 << MASK_BITS) - 1) == 0) + WINDOW


def cuts(marks: list[int], n: int) -> list[int]:
    """Ends of the chunks of a stream of ``n`` ids with these marks, which depend on LEAST and MOST too."""
    if n <= LEAST:
        return [n]
    out, last = [], 0
    for m in marks:
        while m - last > MOST:
            last += MOST
            out.append(last)
        if m - last >= LEAST:
            out.append(m)
            last = m
    while n - last > MOST:
        last += MOST
        out.append(last)
    if last < n:
        out.append(n)
    return out


def pack(ids: np.ndarray) -> bytes:
    """One width byte (2 or 4), then the ids."""
    return b"\x02" + ids.astype("<u2").tobytes() if not len(ids) or int(ids.max()) < 65536 else b"\x04" + ids.astype("<u4").tobytes()


def unpack(stored: bytes) -> np.ndarray:
    return np.frombuffer(stored, "<u2" if stored[0] == 2 else "<u4", offset=1).astype("<u4")


def recipe_root(recipe: bytes) -> bytes:
    """A document's root: over the addresses of its chunks in order."""
    return hashlib.sha256(b"".join(recipe[i : i + 32] for i in range(0, len(recipe), 36))).digest()


def shard_roots(recipes: DataFrame) -> DataFrame:
    """(shard, tree) of (shard, pos, root): a Merkle tree of SHA-256 over the roots in order of ``pos``.

    Every node has at most 2**FAN_BITS children, by place in the shard, so no group grows with the table, and
    LEVELS levels take every place that a position can name.
    """
    level = recipes.select("shard", F.col("pos").bitwiseAND(F.lit(2**33 - 1)).alias("place"), F.hex("root").alias("tree"))
    for _ in range(LEVELS):
        children = F.array_sort(F.collect_list(F.struct("place", "tree")))["tree"]
        level = level.groupBy("shard", F.shiftrightunsigned("place", FAN_BITS).alias("above")).agg(F.sha2(F.concat_ws("", children), 256).alias("tree")).withColumnRenamed("above", "place")
    return level.select("shard", "tree")


_OBJECT = "kind string, key long, doc_id long, n long, address binary, body binary"


def write_store(spark: SparkSession, docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Encodes every text, stores each distinct chunk once, and returns the manifest.

    One pass encodes; each task sends a chunk that it meets again as an address only, so a chunk that many
    documents share travels once per task.  Null texts are empty; each document ends with ``end_id``.
    Repeated rows are documents of their own; a null doc_id comes first; other columns are ignored; an empty table
    makes an empty store.
    """
    shared = spark.sparkContext.broadcast(tokenizer_bytes(tokenizer))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen = library_of(shared.value), set()
        for batch in batches:
            for part, texts in blocks(batch):
                flat, ends = encoder.encode(texts)
                flat, ends = np.insert(flat, ends[1:], end_id), ends + np.arange(len(ends))
                marks = marks_of(flat)  # those of a document are the marks whose last WINDOW ids are its own
                mine = zip(np.searchsorted(marks, ends[:-1] + WINDOW).tolist(), np.searchsorted(marks, ends[1:], side="right").tolist(), strict=True)
                narrow = flat.astype("<u2").tobytes() if flat.max(initial=0) < 65536 else None
                kind, key, doc, n, address, body = [], [], [], [], [], []
                for row, (doc_id, first, last, (m, to)) in enumerate(zip(part.column(0).to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), mine, strict=True)):
                    start, recipe = first, []
                    for cut in cuts((marks[m:to] - first).tolist(), last - first):
                        stop = first + cut
                        packed = pack(flat[start:stop]) if narrow is None else b"\x02" + narrow[2 * start : 2 * stop]
                        sha = hashlib.sha256(packed).digest()
                        recipe.append(sha + (stop - start).to_bytes(4, "little"))
                        if sha not in seen:
                            if len(seen) >= SEEN_CHUNKS:
                                seen.clear()
                            seen.add(sha)
                            kind.append("chunk"), key.append(int.from_bytes(sha[:8], "little", signed=True)), doc.append(None)
                            n.append(stop - start), address.append(sha), body.append(packed)
                        start = stop
                    kind.append("recipe"), key.append(hash((doc_id, row)) & 0x7FFFFFFFFFFFFFFF), doc.append(doc_id)
                    n.append(last - first), address.append(None), body.append(b"".join(recipe))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(kind, pa.string()), pa.array(key, pa.int64()), pa.array(doc, pa.int64()), pa.array(n, pa.int64()), pa.array(address, pa.binary()), pa.array(body, pa.binary())],
                    ["kind", "key", "doc_id", "n", "address", "body"],
                )

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = set()  # the addresses of one partition, which holds every row of an address
        for batch in batches:
            keep = [a is None or not (a in met or met.add(a)) for a in batch.column(4).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    objects = docs.select("doc_id", "text").mapInArrow(encode, _OBJECT).repartition("key").mapInArrow(once, _OBJECT)
    objects.write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/objects")

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            root = [recipe_root(r) for r in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(root, pa.binary())], ["doc_id", "n", "body", "root"])

    recipes = spark.read.schema(_OBJECT).parquet(f"{path}/objects").where("kind = 'recipe'")
    recipes = recipes.select("doc_id", "n", "body").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "body").mapInArrow(roots, "doc_id long, n long, body binary, root binary")
    recipes.withColumn("shard", F.spark_partition_id()).withColumn("pos", F.monotonically_increasing_id()).write.parquet(f"{path}/recipes")
    stored = spark.read.parquet(f"{path}/recipes")
    manifest = stored.groupBy("shard").agg(F.sum("n").alias("n_ids"), F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
    manifest.join(shard_roots(stored), "shard").withColumnRenamed("tree", "root").coalesce(1).write.parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


def _shift_tables() -> np.ndarray:
    """tables[k][i][b]: what appending 2**k zero bytes does to byte i of a CRC-32 (linear over GF(2))."""
    one = np.array([_append_zero(1 << b) for b in range(32)], np.uint32)
    out = []
    for _ in range(48):
        table = np.zeros((4, 256), np.uint32)
        for i in range(4):
            for b in range(8):
                bit = (np.arange(256) >> b & 1).astype(bool)
                table[i] ^= np.where(bit, one[8 * i + b], np.uint32(0))
        out.append(table)
        one = _apply(table, one)
    return np.array(out)


def _append_zero(state: int) -> int:
    for _ in range(8):
        state = state >> 1 ^ (0xEDB88320 if state & 1 else 0)
    return state


def _apply(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    return table[0][x & 255] ^ table[1][x >> 8 & 255] ^ table[2][x >> 16 & 255] ^ table[3][x >> 24]


def shift_crc(crc: np.ndarray, n_bytes: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """What each CRC-32 adds to that of a stream in which ``n_bytes`` more bytes follow."""
    out = crc.astype(np.uint32)
    for k in range(int(n_bytes.max(initial=0)).bit_length()):
        out = np.where(n_bytes >> k & 1, _apply(tables[k], out), out)
    return out


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """One row per document from the stored files: doc_id, start, n_tokens, ids_crc32, verified, n_chunks, in no order.

    Each stored chunk is read once and checked against its address; documents join the chunks' lengths and
    CRC-32s, not their bytes, and their CRC-32 is combined from those.  A document is verified if its chunks are,
    its recipe has its root, and its shard's documents have the manifest's root, number and ids.
    Repeated documents stay apart by their place; an empty store gives no rows.
    """
    tables = _shift_tables()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc, n, good = [], [], []
            for address, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = unpack(body)
                crc.append(zlib.crc32(ids.tobytes()))
                n.append(len(ids))
                good.append(hashlib.sha256(body).digest() == address)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(crc, pa.int64()), pa.array(n, pa.int64()), pa.array(good, pa.bool_())], ["address", "crc", "n_ids", "good"])

    chunks = spark.read.schema(_OBJECT).parquet(f"{path}/objects").where("kind = 'chunk'")
    chunks = chunks.select("address", "body").mapInArrow(digest, "address binary, crc long, n_ids long, good boolean")
    recipes = spark.read.parquet(f"{path}/recipes")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pos, address, after = [], [], []
            for p, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                lengths = [int.from_bytes(body[i + 32 : i + 36], "little") for i in range(0, len(body), 36)]
                rest = 4 * sum(lengths)
                for i, length in enumerate(lengths):
                    rest -= 4 * length
                    pos.append(p), address.append(body[36 * i : 36 * i + 32]), after.append(rest)
            yield pa.RecordBatch.from_arrays([pa.array(pos, pa.int64()), pa.array(address, pa.binary()), pa.array(after, pa.int64())], ["pos", "address", "after"])

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = shift_crc(batch.column(1).to_numpy(), batch.column(2).to_numpy(), tables)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(part.astype(np.int64)), batch.column(3), batch.column(4)], ["pos", "part", "n_ids", "good"])

    refs = recipes.select("pos", "body").mapInArrow(spread, "pos long, address binary, after long")
    parts = refs.join(chunks, "address").select("pos", "crc", "after", "n_ids", "good").mapInArrow(combine, "pos long, part long, n_ids long, good boolean")
    docs = parts.groupBy("pos").agg(F.bit_xor("part").alias("ids_crc32"), F.sum("n_ids").alias("n_tokens"), F.bool_and("good").alias("good"), F.count("*").alias("n_chunks"))
    starts = spark.read.parquet(f"{path}/manifest").select("shard", "n_ids", "n_docs", "root").orderBy("shard").collect()  # one row per file
    offsets, total = [], 0
    for row in starts:
        offsets.append((row.shard, total, row.n_ids, row.n_docs, row.root))
        total += row.n_ids
    before = F.broadcast(spark.createDataFrame(offsets, "shard int, shard_start long, shard_ids long, shard_docs long, shard_root string"))

    def rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = [recipe_root(r) == root for r, root in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(same, pa.bool_())], ["doc_id", "pos", "n", "shard", "same"])

    found = recipes.select("doc_id", "pos", "n", "shard", "body", "root").mapInArrow(rooted, "doc_id long, pos long, n long, shard int, same boolean")
    shard = Window.partitionBy("shard").orderBy("pos")
    every, order = shard.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), shard.rowsBetween(Window.unboundedPreceding, -1)
    trees = shard_roots(recipes)  # of the stored roots; each document's is checked against its recipe
    found = found.withColumn("inside", F.coalesce(F.sum("n").over(order), F.lit(0)))
    found = found.withColumn("all_ids", F.sum("n").over(every)).withColumn("all_docs", F.count("*").over(every))
    placed = found.join(before, "shard", "left").join(trees, "shard", "left").join(docs, "pos", "left")
    whole = (F.col("tree") == F.col("shard_root")) & (F.col("all_ids") == F.col("shard_ids")) & (F.col("all_docs") == F.col("shard_docs"))
    verified = F.coalesce(F.col("good") & F.col("same") & whole & (F.col("n") == F.col("n_tokens")), F.lit(False))
    return placed.select("doc_id", (F.col("shard_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", verified.alias("verified"), "n_chunks")


def op6_token_id_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "idstore")
    write_store(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_store(spark, path).drop("n_chunks")
