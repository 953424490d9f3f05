"""Token counts under a unigram model, by dynamic programming over a trie of distinct pre-tokens.

Pieces are the byte strings of a public vocabulary, all of them.  No unigram model comes with it and
tokenizers are not trained, so a piece's log-probability follows Zipf's law over the vocabulary's order.
The distinct pre-tokens that a block of texts adds are put in a trie, whose nodes are computed level by level:
each shared prefix's forward score (over all segmentations) and best segmentation once, from the nodes above it
that a piece reaches back to (pieces are told apart by 64-bit hashes).  What the terminal nodes hold is kept, texts
sum over the terminals of their pre-tokens, and ``terminal_counts`` gives the terminals with their occurrences.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import arrowtext as at
from siltstone.llm.bpe import tokenizer_bytes
from siltstone.llm.pretokens import PATTERN, Vocabulary
from siltstone.llm.units import Entries, blocks, held

#: Pre-tokens and units that a worker remembers.
MEMO_ENTRIES = 600_000
#: Depth of the trie up to which it is walked level by level.
LEVELS = 64
_BASE = 0x5851F42D4C957F2D
SCHEMA = "doc_id long, n_pretokens long, n_tokens long, log_forward double"


def piece_scores(vocabulary: Vocabulary) -> dict[bytes, float]:
    """Log-probability of each piece; the 256 single bytes are among them, so every text has a segmentation."""
    pieces = [s for i, s in enumerate(vocabulary.strings) if s and i not in vocabulary.special.values()]
    total = math.log(sum(1 / (k + 2.7) for k in range(len(pieces))))
    return {s: -math.log(k + 2.7) - total for k, s in enumerate(pieces)}


class Forward:
    """Walks sorted byte strings, keeping the scores of the path from the trie's root to the last one."""

    def __init__(self, scores: dict[bytes, float]):
        self.scores = scores
        self.longest = max(map(len, scores))
        endings: dict[bytes, None] = {}
        for s in scores:
            for i in range(len(s)):
                endings[s[i:]] = None
        self.endings = endings  # what some piece ends with: a longer ending need not be tried beyond the first miss
        self.path, self.alpha, self.best, self.count = b"", [0.0], [0.0], [0]

    def visit(self, word: bytes) -> tuple[int, float]:
        """(tokens of the best segmentation, forward log-score over all segmentations)."""
        path, alpha, best, count = self.path, self.alpha, self.best, self.count
        same, most = 0, min(len(path), len(word))
        while same < most and path[same] == word[same]:
            same += 1
        del alpha[same + 1 :], best[same + 1 :], count[same + 1 :]
        scores, endings, longest = self.scores, self.endings, self.longest
        for j in range(same + 1, len(word) + 1):
            terms, top, n = [], -math.inf, 0
            for i in range(j - 1, max(j - longest, 0) - 1, -1):
                piece = word[i:j]
                s = scores.get(piece)
                if s is not None:
                    terms.append(alpha[i] + s)
                    b = best[i] + s
                    if b > top or b == top and count[i] + 1 < n:
                        top, n = b, count[i] + 1
                elif piece not in endings:
                    break
            high = max(terms)
            alpha.append(high if len(terms) == 1 else high + math.log(sum(math.exp(t - high) for t in terms)))
            best.append(top)
            count.append(n)
        self.path = word
        return count[-1], alpha[-1]


class Trie:
    """Forward scores of sorted byte strings, level by level over their trie: every shared prefix is one node."""

    def __init__(self, scores: dict[bytes, float]):
        self.longest = max(map(len, scores))
        table, mask = at.BYTE_TABLE.tolist(), (1 << 64) - 1
        self.power = [pow(_BASE, k, 1 << 64) for k in range(self.longest + 1)]
        #: for each length: the hashes of what some piece ends with, and its score where that is a piece itself
        found: list[dict[int, float]] = [{} for _ in range(self.longest + 1)]
        for piece in scores:
            h = 0
            for length in range(1, len(piece) + 1):
                h = h + table[piece[-length]] * self.power[length - 1] & mask
                ending = piece[-length:]
                if h not in found[length]:
                    found[length][h] = scores.get(ending, -math.inf)
        self.hashes = [np.array(sorted(x), np.uint64) for x in found]
        self.scores = [np.array([x[h] for h in sorted(x)]) for x in found]

    def walk(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """For each word, in sorted order: (tokens of the best segmentation, forward log-score over all segmentations)."""
        data = np.frombuffer(b"".join(words), np.uint8)
        length = np.array([len(w) for w in words], np.int64)
        start = np.cumsum(length) - length
        tokens, log = np.zeros(len(words), np.int64), np.zeros(len(words))
        live, node = np.arange(len(words)), np.zeros(len(words), np.int64)
        # a list of levels: each node's parent, path hash, forward score, best score and its number of tokens
        levels = [(np.zeros(1, np.int64), np.zeros(1, np.uint64), np.zeros(1), np.zeros(1), np.zeros(1, np.int64))]
        depth = 0
        while True:
            stay = length[live] > depth
            live, node = live[stay], node[stay]
            if not len(live):
                return tokens, log
            byte = data[start[live] + depth]
            depth += 1
            new = np.concatenate([[True], (node[1:] != node[:-1]) | (byte[1:] != byte[:-1])])
            parent, byte, node = node[new], byte[new], np.cumsum(new) - 1
            levels.append(self._level(levels, depth, parent, levels[-1][1][parent] * np.uint64(_BASE) + at.BYTE_TABLE[byte]))
            ends = length[live] == depth
            tokens[live[ends]], log[live[ends]] = levels[-1][4][node[ends]], levels[-1][2][node[ends]]

    def _level(self, levels: list[tuple], depth: int, parent: np.ndarray, path: np.ndarray) -> tuple:
        m = len(parent)
        high, mass, best, count = np.full(m, -np.inf), np.zeros(m), np.full(m, -np.inf), np.zeros(m, np.int64)
        here, above = np.arange(m), parent
        for size in range(1, min(depth, self.longest) + 1):
            parents, paths, alphas, bests, counts = levels[depth - size]
            ending = path[here] - paths[above] * np.uint64(self.power[size])
            k = np.minimum(np.searchsorted(self.hashes[size], ending), len(self.hashes[size]) - 1)
            hit = self.hashes[size][k] == ending
            here, above, k = here[hit], above[hit], k[hit]
            if not len(here):
                break
            score = self.scores[size][k]
            piece = score > -np.inf
            i, a, score = here[piece], above[piece], score[piece]
            term = alphas[a] + score
            top = np.maximum(high[i], term)
            mass[i] = mass[i] * np.exp(high[i] - top) + np.exp(term - top)
            high[i] = top
            b, c = bests[a] + score, counts[a] + 1
            better = (b > best[i]) | (b == best[i]) & (c < count[i])
            best[i[better]], count[i[better]] = b[better], c[better]
            above = parents[above]
        return parent, path, high + np.log(mass), best, count


class Scores(Entries):
    """Entries with their pre-tokens, tokens and forward log-scores."""

    def __init__(self, tokenizer_json: bytes, limit: int = MEMO_ENTRIES):
        scores = piece_scores(Vocabulary(tokenizer_json))
        self.trie, self.path = Trie(scores), Forward(scores)
        super().__init__(limit)

    def forget(self) -> None:
        self.pretokens, self.tokens, self.log = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def _append(self, pretokens: np.ndarray, tokens: np.ndarray, log: np.ndarray) -> None:
        self.pretokens, self.tokens, self.log = np.concatenate([self.pretokens, pretokens]), np.concatenate([self.tokens, tokens]), np.concatenate([self.log, log])

    def add_words(self, words: list[str]) -> None:
        raw = [w.encode("utf-8", "replace") for w in words]
        order = sorted(range(len(raw)), key=raw.__getitem__)
        tokens, log = np.zeros(len(raw), np.int64), np.zeros(len(raw))
        usual = [k for k in order if len(raw[k]) <= LEVELS]
        tokens[usual], log[usual] = self.trie.walk([raw[k] for k in usual])
        for k in order:  # below LEVELS a level has a node or two: paths are walked depth first, with the same scores
            if len(raw[k]) > LEVELS:
                tokens[k], log[k] = self.path.visit(raw[k])
        self._append(np.ones(len(raw), np.int64), tokens, log)

    def add_runs(self, entries: np.ndarray, lengths: np.ndarray) -> None:
        run, n = np.repeat(np.arange(len(lengths)), lengths), len(lengths)
        total = lambda x: np.bincount(run, x[entries], n)  # noqa: E731  sums of integers are exact below 2**53
        self._append(total(self.pretokens).astype(np.int64), total(self.tokens).astype(np.int64), total(self.log))

    def totals(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pre-tokens, tokens, forward log-score) of each text."""
        entries, count = self.block(texts)
        row, n = np.repeat(np.arange(len(texts)), count), len(texts)
        return tuple(np.bincount(row, x[entries], n).astype(x.dtype) for x in (self.pretokens, self.tokens, self.log))

    def terminals(self, texts: list[str]) -> Iterator[tuple[str, int, int, float]]:
        """The pre-tokens of these texts with what their terminal nodes hold: occurrences, tokens, forward log-score."""
        seen: dict[str, int] = {}
        for t in texts:
            for w in PATTERN.findall(t):
                seen[w] = seen.get(w, 0) + 1
        at_ = self.number(list(seen))
        yield from zip(seen, seen.values(), self.tokens[at_].tolist(), self.log[at_].tolist(), strict=True)


def scores_of(tokenizer_json: bytes) -> Scores:
    return held("scores", tokenizer_json, Scores)


def token_counts(spark: SparkSession, docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_pretokens, n_tokens, log_forward.

    Null and empty texts count 0 with score 0.  Repeated rows stay; other columns are ignored; an empty table
    gives none.  No shuffle; a worker holds a block of text and a bounded memo.
    """
    shared = spark.sparkContext.broadcast(tokenizer_bytes(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = scores_of(shared.value)
        for batch in batches:
            for part, texts in blocks(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, scores.totals(texts))], ["doc_id", "n_pretokens", "n_tokens", "log_forward"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def terminal_counts(spark: SparkSession, docs: DataFrame, path: str | None = None) -> DataFrame:
    """The trie's terminals as a table, one row per distinct pre-token: pretoken, occurrences, n_tokens, log_forward.

    Occurrences are counted by block before the shuffle, so a frequent pre-token is a row per block, not per place.
    Null and empty texts have none; other columns are ignored; an empty table gives none.
    """
    shared = spark.sparkContext.broadcast(tokenizer_bytes(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = scores_of(shared.value)
        for batch in batches:
            for _, texts in blocks(batch):
                if scores.size > scores.limit:
                    scores.clear()
                rows = list(scores.terminals(texts))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.float64()))], ["pretoken", "occurrences", "n_tokens", "log_forward"])

    found = docs.select("doc_id", "text").mapInArrow(run, "pretoken string, occurrences long, n_tokens long, log_forward double")
    return found.groupBy("pretoken").agg(F.sum("occurrences").alias("occurrences"), F.max("n_tokens").alias("n_tokens"), F.max("log_forward").alias("log_forward"))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
