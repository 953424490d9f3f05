"""Arrow string columns as numpy byte buffers, and vectorised word and line hashing over them.

All helpers work on the UTF-8 bytes of whole texts.  A null text counts as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once by the numpy kernels; a longer single text is one slice by itself.
SLICE_BYTES = 1_500_000

_MULT = np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)
_ODD = 0x5851F42D4C957F2D
_U64 = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


BYTE_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * _MULT)
_INVERSE = pow(_ODD, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd multiplier and of its inverse modulo 2**64."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, SLICE_BYTES + 1024)
        for key, base in (("up", _ODD), ("down", _INVERSE)):
            out = np.empty(size, np.uint64)
            out[0] = 1
            done, factor = 1, base
            while done < size:
                take = min(done, size - done)
                out[done : done + take] = out[:take] * np.uint64(factor)
                factor = factor * factor & _U64
                done += take
            _POWERS[key] = out
    return _POWERS["up"], _POWERS["down"]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): text i is bytes[offsets[i]:offsets[i + 1]]."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """The batch in runs of rows of at most ``limit`` bytes of text (one row at least), with their buffers."""
    data, offsets = buffers(batch.column(batch.schema.get_field_index(column)))
    start, n = 0, batch.num_rows
    while start < n:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        stop = min(max(stop, start + 1), n)
        yield batch.slice(start, stop - start), data[offsets[start] : offsets[stop]], offsets[start : stop + 1] - offsets[start]
        start = stop


def is_space(data: np.ndarray) -> np.ndarray:
    """The six ASCII characters space, \\t, \\n, \\v, \\f, \\r."""
    return (data == 32) | ((data >= 9) & (data <= 13))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running sums from which span_hash gets the hash of any span."""
    up, _ = _powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_TABLE[data] * up[: len(data)], out=out[1:])
    return out


def span_hash(running: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:stop], equal for equal bytes wherever they stand."""
    _, down = _powers(len(running))
    return mix((running[stop] - running[start]) * down[start] + (stop - start).astype(np.uint64) * _MULT)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, stop, row) of each maximal run of bytes that are no ASCII white space; none crosses a text's end."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~(is_space(data) if space is None else space)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    stop = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return start, stop, np.searchsorted(offsets, start, side="right") - 1


def count_by_row(row: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(row, minlength=n).astype(np.int64)


def sum_by_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each text the sum of the flags of its bytes."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def ngrams(hashes: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each run of n neighbouring words of one text; element i starts at word i of those returned."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = hashes[: len(hashes) - n + 1].copy()
    for k in range(1, n):
        out *= _MULT
        out += hashes[k : len(hashes) - n + 1 + k]
        out ^= out >> np.uint64(29)
    same = row[: len(out)] == row[n - 1 :]
    return np.where(same, mix(out), np.uint64(0)), np.where(same, row[: len(out)], -1)
