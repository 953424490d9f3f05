"""Byte-level BPE by rank files, in two tiers: whole pre-tokens by a minimal perfect hash, the rest by a heap over linked bytes."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from siltstone.llm import arrowtext as at
from siltstone.llm.perfecthash import PerfectHash
from siltstone.llm.units import Ids, blocks, held, ragged

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Pre-tokens and units that a worker remembers.
MEMO_ENTRIES = 600_000
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class RankFile:
    """A vocabulary of byte strings by rank; the rank is the id.  Lines are a string in base64 and its rank."""

    def __init__(self, data: bytes):
        pairs = [line.split() for line in data.splitlines() if line.strip()]
        self.ranks = {base64.b64decode(text): int(rank) for text, rank in pairs}
        self.strings = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for text, rank in self.ranks.items():
            self.strings[rank] = text


class Tier:
    """The first tier: the vocabulary's strings in the slots of a perfect hash, as one run of bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        texts = list(ranks)
        data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
        keys = at.span_hash(at.prefix_hash(data), ends[:-1], ends[1:])
        self.hash = PerfectHash(keys)
        slot = self.hash.slots(keys)
        order = np.argsort(slot)
        self.ids = np.array([ranks[t] for t in texts], np.uint32)[order]
        self.data, self.start, self.length = data, ends[:-1][order], np.diff(ends)[order]

    def find(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether each of the words data[ends[i]:ends[i + 1]] is in the vocabulary, its id if so).  Exact: bytes are compared."""
        start, length = ends[:-1], np.diff(ends)
        slot = self.hash.slots(at.span_hash(at.prefix_hash(data), start, ends[1:]))
        found = (self.length[slot] == length) & (length > 0)
        some = np.flatnonzero(found)
        alike = data[ragged(start[some], length[some])] == self.data[ragged(self.start[slot[some]], length[some])]
        if len(some):
            found[some] = np.logical_and.reduceat(alike, np.cumsum(length[some]) - length[some])
        return found, self.ids[slot]


def merge_bytes(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token that is not in the vocabulary: the neighbours of the smallest rank merge first, the leftmost of equal ones.

    Parts are known by where they start; ``after`` and ``before`` link them.  An entry of the heap whose part has
    gone or grown since is stale and skipped.
    """
    n = len(word)
    after, before = list(range(1, n + 2)), list(range(-1, n))
    stop = list(range(1, n + 1))  # of each part; 0 once it has been merged into another
    get = ranks.get
    heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := get(word[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        _, i, end = heappop(heap)
        j = after[i]
        if not stop[i] or j >= n or stop[j] != end:
            continue
        stop[i], stop[j] = end, 0
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (rank := get(word[i : stop[k]])) is not None:
                heappush(heap, (rank, i, stop[k]))
        if (h := before[i]) >= 0 and (rank := get(word[h:end])) is not None:
            heappush(heap, (rank, h, end))
    return [ranks[word[i:end]] for i, end in enumerate(stop) if end]


class TieredCodec(Ids):
    """encode: texts -> ids.  decode: ids -> bytes.  There are no special tokens: their strings are ordinary text."""

    def __init__(self, rank_file: bytes, limit: int = MEMO_ENTRIES):
        vocabulary = RankFile(rank_file)
        self.ranks, self.strings = vocabulary.ranks, vocabulary.strings
        self.decimals = [str(i) for i in range(len(self.strings))]
        self.tier = Tier(self.ranks)
        self.hits = self.misses = 0  # of distinct pre-tokens
        super().__init__(limit)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = [w.encode("utf-8", "replace") for w in words]
        ends = np.cumsum([0, *map(len, raw)])
        found, ids = self.tier.find(np.frombuffer(b"".join(raw), np.uint8), ends)
        missed = np.flatnonzero(~found).tolist()
        self.hits, self.misses = self.hits + len(words) - len(missed), self.misses + len(missed)
        merged = [merge_bytes(raw[i], self.ranks) for i in missed]
        length = np.ones(len(words), np.int64)
        length[missed] = [len(m) for m in merged]
        out = np.zeros(int(length.sum()), np.uint32)
        start = np.cumsum(length) - length
        out[start[found]] = ids[found]
        out[ragged(start[missed], length[missed])] = [i for m in merged for i in m]
        return out, length

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.strings.__getitem__, ids))

    def decimal(self, ids: list[int]) -> str:
        """The ids in decimal, joined by commas."""
        return ",".join(map(self.decimals.__getitem__, ids))


def rank_bytes(path: str | None = None) -> bytes:
    """The rank file, read on the driver; its size is fixed (under 2 MB), so it may be broadcast."""
    with open(path or public_tokenizers.path(RANKS), "rb") as f:
        return f.read()


def tiered_encode(spark: SparkSession, docs: DataFrame, path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256 (of decimal ids joined by commas), decoded_sha256 (of the decoded bytes),
    with ``keep_ids`` also ids (array<int>) and decoded (binary).

    Null and empty texts have no ids and decode to nothing.  Repeated rows give repeated rows; an empty table
    gives none; other columns of ``docs`` are ignored.  No shuffle; a worker builds its hash once and holds a block
    of text and a bounded memo.
    """
    shared = spark.sparkContext.broadcast(rank_bytes(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = held("tiered", shared.value, TieredCodec)
        for batch in batches:
            for part, texts in blocks(batch):
                flat, ends = codec.encode(texts)
                ids_sha, bytes_sha, kept, decoded = [], [], [], []
                for first, last in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    ids = flat[first:last].tolist()
                    data = codec.decode(ids)
                    ids_sha.append(hashlib.sha256(codec.decimal(ids).encode()).hexdigest())
                    bytes_sha.append(hashlib.sha256(data).hexdigest())
                    if keep_ids:
                        kept.append(ids)
                        decoded.append(data)
                out = {"doc_id": part.column(0), "n_tokens": pa.array(np.diff(ends)), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(bytes_sha, pa.string())}
                if keep_ids:
                    out |= {"ids": pa.array(kept, pa.list_(pa.int32())), "decoded": pa.array(decoded, pa.binary())}
                yield pa.RecordBatch.from_pydict(out)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA + (", ids array<int>, decoded binary" if keep_ids else ""))


def op12_tiered_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiered_encode(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
