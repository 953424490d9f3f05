"""Baseline JPEG as a lossless container of bytes, and a decoder for baseline scans.

Encoding: 64 payload bytes make one 8x8 block of quantised luminance coefficients in zigzag order, byte b as
the value b + 256, so every coefficient has size category 9.  Each block is a restart interval of its own, so
blocks decode independently.  A comment segment holds the payload's length; blocks that only fill the last row
hold zero bytes.

Decoding parses the markers and Huffman-decodes all restart intervals in step with numpy; the thumbnail takes
each block's DC coefficient as its mean luminance.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from siltstone.llm import arrowtext as at

UNIT = 64
MOST_COLUMNS = 1024
OFFSET, CATEGORY = 256, 9
BLOCK_BYTES = UNIT * 10 // 8
SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width long, height long"


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, symbols: list[int]) -> bytes:
    """A Huffman table with one symbol of each length from 1 on."""
    return bytes([kind]) + bytes([1] * len(symbols) + [0] * (16 - len(symbols))) + bytes(symbols)


#: Code 0 is category 9 (DC) or run 0 with category 9 (AC); code 10 is no difference, or end of block.
_TABLES = _segment(0xDB, bytes([0]) + bytes([1] * 64)) + _segment(0xC4, _table(0x00, [CATEGORY, 0])) + _segment(0xC4, _table(0x10, [CATEGORY, 0]))


def shape(n_blocks: int) -> tuple[int, int]:
    """(columns, rows) of blocks."""
    columns = min(n_blocks, MOST_COLUMNS)
    return columns, -(-n_blocks // columns)


def _header(columns: int, rows: int, payload: int) -> bytes:
    return (
        b"\xff\xd8" + _segment(0xE0, b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0") + _segment(0xFE, struct.pack(">Q", payload)) + _TABLES
        + _segment(0xC0, struct.pack(">BHHB", 8, 8 * rows, 8 * columns, 1) + b"\x01\x11\x00") + _segment(0xDD, struct.pack(">H", 1))
        + _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")
    )


def encode_batch(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """One JPEG for each padded payload; offsets are multiples of 64."""
    blocks = np.diff(offsets) // UNIT
    shapes = [shape(int(b)) for b in blocks]
    padded = np.array([c * r for c, r in shapes], np.int64)
    total = int(padded.sum())
    first = np.concatenate([[0], np.cumsum(padded)])
    owner = np.repeat(np.arange(len(blocks)), padded)
    inner = np.arange(total) - first[owner]
    values = np.full((total, UNIT), OFFSET, np.uint64)
    real = inner < blocks[owner]
    values[real] += data.reshape(-1, UNIT)
    # code 0 and the nine bits of the value are the value as ten bits; four of them fill five bytes
    quad = values.reshape(total, 16, 4)
    word = quad[..., 0] << np.uint64(30) | quad[..., 1] << np.uint64(20) | quad[..., 2] << np.uint64(10) | quad[..., 3]
    scan = word.astype(">u8").view(np.uint8).reshape(total, 16, 8)[..., 3:].reshape(total, BLOCK_BYTES)
    stuffed = scan == 255
    size = BLOCK_BYTES + stuffed.sum(1) + 2  # with the restart marker, or the end of the image
    block_at = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(int(block_at[-1]), np.uint8)
    before = np.cumsum(stuffed, axis=1) - stuffed
    out[block_at[:-1, None] + np.arange(BLOCK_BYTES) + before] = scan
    out[block_at[1:] - 2] = 0xFF
    out[block_at[1:] - 1] = np.where(inner == padded[owner] - 1, 0xD9, 0xD0 + inner % 8)
    raw = out.tobytes()
    ends = block_at[first]
    return [_header(*shapes[k], int(blocks[k]) * UNIT) + raw[ends[k] : ends[k + 1]] for k in range(len(blocks))]


class Frame:
    """What the markers of a one-component baseline JPEG say, and where its scan stands."""

    def __init__(self, raw: bytes):
        if raw[:2] != b"\xff\xd8":
            raise ValueError("no JPEG")
        self.comment, self.restart, self.quant, self.huffman = b"", 0, {}, {}
        at_, self.tables_key = 2, b""
        while True:
            if raw[at_] != 0xFF:
                raise ValueError("marker expected")
            marker, length = raw[at_ + 1], struct.unpack_from(">H", raw, at_ + 2)[0]
            body = raw[at_ + 4 : at_ + 2 + length]
            at_ += 2 + length
            if marker == 0xFE:
                self.comment = body
            elif marker == 0xDB:
                while body:
                    if body[0] >> 4:
                        raise ValueError("16-bit quantisation is not baseline")
                    self.quant[body[0] & 15] = np.frombuffer(body[1:65], np.uint8).astype(np.int64)
                    body = body[65:]
            elif marker == 0xC4:
                self.tables_key += body
                while body:
                    n = sum(body[1:17])
                    self.huffman[body[0]] = (body[1:17], body[17 : 17 + n])
                    body = body[17 + n :]
            elif marker == 0xC0:
                bits, self.height, self.width, parts = struct.unpack_from(">BHHB", body)
                if bits != 8 or parts != 1:
                    raise ValueError("one 8-bit component expected")
                self.table = body[8]
            elif 0xC1 <= marker <= 0xCF:
                raise ValueError("not baseline")
            elif marker == 0xDD:
                self.restart = struct.unpack(">H", body)[0]
            elif marker == 0xDA:
                self.dc, self.ac = body[2] >> 4, body[2] & 15
                self.scan = at_
                return

    @property
    def grid(self) -> tuple[int, int]:
        return -(-self.width // 8), -(-self.height // 8)


def _lookup(counts: bytes, symbols: bytes) -> np.ndarray:
    """For each 16 bits: code length << 8 | symbol; 0 where no code stands."""
    out, code, k = np.zeros(1 << 16, np.int64), 0, 0
    for length in range(1, 17):
        for _ in range(counts[length - 1]):
            low = code << (16 - length)
            out[low : low + (1 << (16 - length))] = length << 8 | symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


def decode_batch(files: list[bytes]) -> list[tuple[Frame, np.ndarray]]:
    """(frame, quantised coefficients in zigzag order, one row for each block) of each file."""
    frames = [Frame(f) for f in files]
    if len({(f.tables_key, f.dc, f.ac, f.restart == 1) for f in frames}) > 1:
        return [decode_batch([f])[0] for f in files]
    if not frames:
        return []
    dc, ac = _lookup(*frames[0].huffman[frames[0].dc]), _lookup(*frames[0].huffman[0x10 | frames[0].ac])
    # the scans, end to end: markers end the intervals, stuffed zeros go
    scans = [f[fr.scan :] for f, fr in zip(files, frames, strict=True)]
    raw = np.frombuffer(b"".join(scans), np.uint8)
    mark = np.flatnonzero(raw[:-1] == 255)
    follow = raw[mark + 1]
    keep = np.ones(len(raw), bool)
    keep[mark[follow == 0] + 1] = False
    end = mark[(follow >= 0xD0) & (follow <= 0xD9)]
    keep[end] = keep[end + 1] = False
    place = np.cumsum(keep) - keep
    stop = place[end]
    start = np.concatenate([[0], stop[:-1]])
    plain = np.concatenate([raw[keep], np.zeros(8, np.uint8)])
    blocks = [c * r for c, r in (f.grid for f in frames)]
    per = [f.restart or b for f, b in zip(frames, blocks, strict=True)]
    rounds = np.concatenate([np.minimum(p, b - np.arange(0, b, p)) for p, b in zip(per, blocks, strict=True)])
    if len(rounds) != len(start):
        raise ValueError("restart intervals are missing")
    out = np.zeros((int(rounds.sum()), UNIT), np.int64)
    row0 = np.concatenate([[0], np.cumsum(rounds)[:-1]])
    bit = start * 8
    previous = np.zeros(len(start), np.int64)
    big = plain.astype(np.uint64)
    word = sum(big[k : len(big) - 7 + k] << np.uint64(56 - 8 * k) for k in range(8))  # the 64 bits from each byte on

    def peek(at_bit: np.ndarray, n: int) -> np.ndarray:
        return (word[np.minimum(at_bit >> 3, len(word) - 1)] << (at_bit & 7).astype(np.uint64) >> np.uint64(64 - n)).astype(np.int64)

    def value(at_bit: np.ndarray, size: np.ndarray) -> np.ndarray:
        v = peek(at_bit, 16) >> (16 - size)
        return np.where((size > 0) & (v < (1 << np.maximum(size, 1) - 1)), v - (1 << size) + 1, v)

    for m in range(int(rounds.max())):
        live = np.flatnonzero(rounds > m)
        row, b = row0[live] + m, bit[live]
        code = dc[peek(b, 16)]
        if (code == 0).any():
            raise ValueError("no such code")
        b = b + (code >> 8)
        size = code & 255
        previous[live] += value(b, size)
        out[row, 0] = previous[live]
        b += size
        k = np.ones(len(live), np.int64)
        on = np.arange(len(live))
        while len(on):
            if len(on) == len(live):
                code = ac[peek(b, 16)]
            else:
                code = ac[peek(b[on], 16)]
            if (code == 0).any():
                raise ValueError("no such code")
            length, run, size = code >> 8, code >> 4 & 15, code & 15
            whole = len(on) == len(live)
            at_bit = (b if whole else b[on]) + length
            k_on = (k if whole else k[on]) + run
            put = size > 0
            v = value(at_bit, size)
            if put.all():
                out[row if whole else row[on], k_on] = v
            else:
                out[row[on[put]], k_on[put]] = v[put]
            stop_here = (size == 0) & (run < 15)
            k_on = np.where(stop_here, UNIT, k_on + 1)
            if whole:
                b, k = at_bit + size, k_on
            else:
                b[on], k[on] = at_bit + size, k_on
            on = np.flatnonzero(k < UNIT)
        bit[live] = b
    cut = np.concatenate([[0], np.cumsum(blocks)])
    return [(f, out[cut[i] : cut[i + 1]]) for i, f in enumerate(frames)]


def thumbnail(frame: Frame, coefficients: np.ndarray) -> np.ndarray:
    """Mean luminance of each block, from the DC coefficients."""
    columns, rows = frame.grid
    mean = (coefficients[:, 0] * int(frame.quant[frame.table][0]) + 4 >> 3) + 128
    return np.clip(mean, 0, 255).astype(np.uint8).reshape(rows, columns)


def payload_of(frame: Frame, coefficients: np.ndarray) -> bytes:
    return (coefficients - OFFSET).astype(np.uint8).tobytes()[: struct.unpack(">Q", frame.comment)[0]]


def pad(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text with zero bytes up to a positive multiple of 64."""
    n = np.diff(offsets)
    size = np.maximum(-(-n // UNIT), 1) * UNIT
    out_at = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(int(out_at[-1]), np.uint8)
    out[np.arange(len(data)) + np.repeat(out_at[:-1] - offsets[:-1], n)] = data
    return out, out_at


def media_columns(docs: DataFrame, keep_media: bool = False) -> DataFrame:
    """One row per document: the digests of SCHEMA, all from the decoded file; with ``keep_media`` the file and the thumbnail too.

    Null texts count as empty (one block of zeros).  Equal texts give equal values; repeated rows stay;
    other columns are ignored; an empty table gives none.  Map only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in at.slices(batch, limit=400_000):
                files = encode_batch(*pad(data, offsets))
                rows = []
                for raw, n, (frame, coefficients) in zip(files, np.diff(offsets).tolist(), decode_batch(files), strict=True):
                    payload, thumb = payload_of(frame, coefficients), thumbnail(frame, coefficients)
                    feature = f"{frame.width}x{frame.height}:{hashlib.sha256(thumb.tobytes()).hexdigest()[:32]}"
                    row = (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(raw), hashlib.sha256(raw).hexdigest(), feature, frame.width, frame.height)
                    rows.append(row + (raw, thumb.tobytes()) if keep_media else row)
                names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "media", "thumbnail"]
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=False))], ["doc_id", *names[: len(cols)]])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA + (", media binary, thumbnail binary" if keep_media else ""))


def op10_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(spark.read.parquet(f"{sf_dir}/documents.parquet"))
