"""BPE encoding and decoding: a priority queue of merge ranks over a doubly linked list of symbols."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from siltstone.llm.pretokens import Vocabulary
from siltstone.llm.units import Ids, blocks, held

TOKENIZER = "byte_bpe_50k.json"
#: Pre-tokens and units that a worker remembers.
MEMO_ENTRIES = 600_000
#: Special tokens decode as their text.  Unused truncation and padding have no settings here.
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def merge_word(word: bytes, vocabulary: Vocabulary) -> list[int]:
    """Ids of one pre-token.  Entries of the queue whose pair has changed since are stale and skipped."""
    merges = vocabulary.merges
    ids = [vocabulary.of_byte[b] for b in word]
    n = len(ids)
    if n < 2:
        return ids
    if n == 2:
        found = merges.get(ids[0] << 20 | ids[1])
        return ids if found is None else [found & 0xFFFFF]
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    get = merges.get
    # an entry: rank, then position (the leftmost of equal ranks goes first), then the merged id
    queue = [(f >> 20) << 60 | k << 20 | (f & 0xFFFFF) for k in range(n - 1) if (f := get(ids[k] << 20 | ids[k + 1])) is not None]
    heapify(queue)
    while queue:
        entry = heappop(queue)
        k = entry >> 20 & 0xFFFFFFFFFF
        left = ids[k]
        if left < 0:
            continue
        j = after[k]
        if j >= n:
            continue
        found = get(left << 20 | ids[j])
        if found is None or found >> 20 != entry >> 60:
            continue
        ids[k] = found & 0xFFFFF
        ids[j] = -1
        after[k] = nxt = after[j]
        if nxt < n:
            before[nxt] = k
            f = get(ids[k] << 20 | ids[nxt])
            if f is not None:
                heappush(queue, (f >> 20) << 60 | k << 20 | (f & 0xFFFFF))
        prev = before[k]
        if prev >= 0:
            f = get(ids[prev] << 20 | ids[k])
            if f is not None:
                heappush(queue, (f >> 20) << 60 | prev << 20 | (f & 0xFFFFF))
    return [x for x in ids if x >= 0]


class Codec(Ids):
    """encode: texts -> ids.  decode: ids -> text."""

    def __init__(self, tokenizer_json: bytes | str, limit: int = MEMO_ENTRIES):
        self.vocabulary = Vocabulary(tokenizer_json)
        self._string = self.vocabulary.strings.__getitem__
        super().__init__(limit, self.vocabulary.special)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        each = [merge_word(w.encode("utf-8", "replace"), self.vocabulary) for w in words]
        return np.array([i for ids in each for i in ids], np.uint32), np.array([len(ids) for ids in each], np.int64)

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self._string, ids)).decode("utf-8", "replace")


def codec_of(tokenizer_json: bytes) -> Codec:
    return held("codec", tokenizer_json, Codec)


def tokenizer_bytes(path: str | None = None) -> bytes:
    """The tokenizer's file, read on the driver; its size is fixed (under 3 MB), so it may be broadcast."""
    with open(path or public_tokenizers.path(TOKENIZER), "rb") as f:
        return f.read()


def bpe_encode(spark: SparkSession, docs: DataFrame, path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256, with ``keep_ids`` also ids (array<int>) and decoded.

    Null and empty texts have no ids and decode to the empty text.  Repeated rows give repeated rows; an empty
    table gives none; other columns of ``docs`` are ignored.  No shuffle; a worker holds a block of text and a bounded memo.
    """
    shared = spark.sparkContext.broadcast(tokenizer_bytes(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared.value)
        for batch in batches:
            for part, texts in blocks(batch):
                flat, ends = codec.encode(texts)
                ids_sha, text_sha, kept, decoded = [], [], [], []
                for first, last in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    ids = flat[first:last].astype("<u4")
                    numbers = ids.tolist()
                    text = codec.decode(numbers)
                    ids_sha.append(hashlib.sha256(ids.tobytes()).hexdigest())
                    text_sha.append(hashlib.sha256(text.encode("utf-8", "replace")).hexdigest())
                    if keep_ids:
                        kept.append(numbers)
                        decoded.append(text)
                out = {"doc_id": part.column(0), "n_tokens": pa.array(np.diff(ends)), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(text_sha, pa.string())}
                if keep_ids:
                    out |= {"ids": pa.array(kept, pa.list_(pa.int32())), "decoded": pa.array(decoded, pa.string())}
                yield pa.RecordBatch.from_pydict(out)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA + (", ids array<int>, decoded string" if keep_ids else ""))


def op9_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_encode(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
