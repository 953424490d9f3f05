"""Texts as runs of numbered entries, each of which is worked on once.

An entry is a pre-token, or a unit: what stands between two spaces, with the space before it.  A byte-level
pre-tokenizer never joins two units, except in runs of white space; a text with such a run is cut into its
pre-tokens instead.  Distinct units of a block of texts are found by Arrow, so that only they cost Python time.
What is known of entries is kept for the next block, and by a worker for its next tasks, up to a number of entries.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from itertools import compress, count, islice, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from siltstone.llm.pretokens import PATTERN, has_run, segments

#: Bytes of text in a block (a longer text is a block by itself).
BLOCK_BYTES = 4_000_000
_HELD: dict[str, tuple[bytes, object]] = {}


def held(kind: str, data: bytes, make: Callable[[bytes], object]) -> object:
    """``make(data)``, made once in each worker process: one object of a kind is held at a time."""
    key = hashlib.sha256(data).digest()
    if kind not in _HELD or _HELD[kind][0] != key:
        _HELD[kind] = key, make(data)
    return _HELD[kind][1]


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places start[0], start[0] + 1, ... of each run, one run after the other."""
    total = np.cumsum(length)
    return np.repeat(start - total + length, length) + np.arange(total[-1] if len(total) else 0)


class Entries:
    """Numbers of the pre-tokens and units met.  Subclasses say what is kept of each: ``forget``, ``add_words``, ``add_runs``.

    ``limit`` bounds the entries held when a block begins; results do not depend on it.
    """

    def __init__(self, limit: int, special: dict[str, int] | None = None):
        self.limit, self.special = limit, special or {}
        self.clear()

    def clear(self) -> None:
        self.words: defaultdict[str, int] = defaultdict()
        self.units: dict[str, int] = {}
        self.openings: dict[str, int] = {"": 0}
        self.size = 1
        self.forget()
        self.add_runs(np.zeros(0, np.int64), np.zeros(1, np.int64))  # entry 0 is empty

    def forget(self) -> None:
        """Drops what is kept of all entries."""
        raise NotImplementedError

    def add_words(self, words: list[str]) -> None:
        """Appends an entry for each of these pre-tokens (or special tokens)."""
        raise NotImplementedError

    def add_runs(self, entries: np.ndarray, lengths: np.ndarray) -> None:
        """Appends an entry for each run of entries."""
        raise NotImplementedError

    def number(self, words: Sequence[str]) -> np.ndarray:
        known = len(self.words)
        self.words.default_factory = count(self.size).__next__  # numbers new words as they are looked up
        out = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
        if new := list(islice(reversed(self.words), len(self.words) - known)):
            self.add_words(new[::-1])
            self.size += len(new)
        return out

    def _number_runs(self, table: dict[str, int], keys: list[str], words: list[str], lengths: np.ndarray) -> np.ndarray:
        """Adds and returns the entries of ``keys``, each of so many of the words; a run of one word is that word's entry."""
        entries = self.number(words)
        first = np.cumsum(lengths) - lengths
        many = lengths != 1
        out = np.zeros(len(keys), np.int64)
        out[~many] = entries[first[~many]]
        out[many] = np.arange(self.size, self.size + int(many.sum()))
        self.add_runs(entries[ragged(first[many], lengths[many])], lengths[many])
        self.size += int(many.sum())
        table.update(zip(keys, out.tolist(), strict=True))
        return out

    def learn_units(self, units: list[str]) -> np.ndarray:
        """Adds and returns the entries of units, each once, that are not known."""
        # joined by spaces, many are cut at once: a unit begins where a pre-token begins with a space
        out, full = np.zeros(len(units), np.int64), np.fromiter(map(len, units), np.int64, len(units))
        tidy = (full > 0) & (np.fromiter(map(len, map(str.strip, units)), np.int64, len(units)) == full)
        joined = list(compress(units, tidy))
        words = PATTERN.findall(" " + " ".join(joined)) if joined else []
        begins = np.flatnonzero(np.fromiter(map(str.startswith, words, repeat(" ")), bool, len(words)))
        if len(begins) != len(joined):
            tidy[:] = False
        elif joined:
            out[tidy] = self._number_runs(self.units, joined, words, np.diff(np.append(begins, len(words))))
        rest = list(compress(units, ~tidy))
        cut = [PATTERN.findall(" " + u) for u in rest]
        if rest:
            out[~tidy] = self._number_runs(self.units, rest, [w for c in cut for w in c], np.array([len(c) for c in cut], np.int64))
        return out

    def learn_openings(self, openings: list[str]) -> None:
        new = [u for u in dict.fromkeys(openings) if u not in self.openings]
        cut = [PATTERN.findall(u) for u in new]
        if new:
            self._number_runs(self.openings, new, [w for c in cut for w in c], np.array([len(c) for c in cut], np.int64))

    def block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(entries of all texts, one text after the other; how many entries each text has)."""
        if self.size > self.limit:
            self.clear()
        odd = {}
        for k, t in enumerate(texts):
            if any(s in t for s in self.special):
                odd[k] = [w for part in segments(t, self.special) for w in ([next(s for s, i in self.special.items() if i == part)] if isinstance(part, int) else PATTERN.findall(part))]
            elif has_run(t):
                odd[k] = PATTERN.findall(t)
        plain = [k for k in range(len(texts)) if k not in odd]
        each = np.zeros(len(texts), np.int64)
        entries = np.zeros(0, np.int64)
        if plain:
            lists = pc.split_pattern(pa.array([texts[k] for k in plain], pa.large_string()), " ")
            offsets = np.asarray(lists.offsets).astype(np.int64)
            coded = lists.values.dictionary_encode()
            codes = np.asarray(coded.indices)
            opening = offsets[:-1]
            inner = np.ones(len(codes), bool)
            inner[opening] = False
            names = coded.dictionary.to_numpy(zero_copy_only=False)
            place = np.fromiter(map(self.units.get, names.tolist(), repeat(-1)), np.int64, len(names))
            new = np.flatnonzero((place < 0) & (np.bincount(codes[inner], minlength=len(names)) > 0))
            place[new] = self.learn_units(names[new].tolist())
            entries = place[codes]
            first = lists.values.take(pa.array(opening)).to_pylist()
            self.learn_openings(first)
            entries[opening] = [self.openings[u] for u in first]
            each[plain] = np.diff(offsets)
        for k, words in odd.items():
            each[k] = len(words)
        start = np.cumsum(each) - each
        out = np.zeros(int(each.sum()), np.int64)
        if plain:
            out[ragged(start[plain], each[plain])] = entries
        for k, words in odd.items():
            out[start[k] : start[k] + each[k]] = self.number(words)
        return out, each


class Ids(Entries):
    """Entries with their token ids.  Subclasses encode pre-tokens: ``encode_words``."""

    def forget(self) -> None:
        self.flat, self.start, self.length = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, one word after the other; how many ids each word has)."""
        raise NotImplementedError

    def _append(self, ids: np.ndarray, length: np.ndarray) -> None:
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(length) - length])
        self.flat, self.length = np.concatenate([self.flat, ids]), np.concatenate([self.length, length])

    def add_words(self, words: list[str]) -> None:
        marks = [w for w in words if w in self.special]
        if not marks:
            self._append(*self.encode_words(words))
            return
        for w in words:
            self._append(*((np.array([self.special[w]], np.uint32), np.ones(1, np.int64)) if w in self.special else self.encode_words([w])))

    def add_runs(self, entries: np.ndarray, lengths: np.ndarray) -> None:
        each = self.length[entries]
        ends = np.concatenate([[0], np.cumsum(each)])
        last = np.cumsum(lengths)
        self._append(self.flat[ragged(self.start[entries], each)], ends[last] - ends[last - lengths])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts as uint32, one text after the other; offsets of the texts in them)."""
        entries, count = self.block(texts)
        each = self.length[entries]
        ends = np.concatenate([[0], np.cumsum(each)])
        return self.flat[ragged(self.start[entries], each)], ends[np.concatenate([[0], np.cumsum(count)])]


def blocks(batch: pa.RecordBatch, limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Runs of rows of at most ``limit`` characters of text (one row at least), with their texts; null is empty."""
    texts = [t or "" for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
    start, total = 0, 0
    for k, t in enumerate(texts):
        if total and total + len(t) > limit:
            yield batch.slice(start, k - start), texts[start:k]
            start, total = k, 0
        total += len(t)
    if start < len(texts):
        yield batch.slice(start), texts[start:]
