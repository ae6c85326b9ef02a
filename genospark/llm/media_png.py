"""Texts as PNG images, with hashes of their low frequencies.

A payload becomes the rows of an 8-bit grey image, each row filtered by the one of None, Sub
and Up with the least sum of absolute differences, deflated into IDAT chunks and framed with
checksums. Reading tests the signature and every checksum and undoes all five filters with
numpy, for 8-bit images of 1 to 4 channels. The hash takes the image down to 32 x 32 by
mean areas, and of its cosine transform the 8 x 8 lowest frequencies but the first: a bit
for each above their median, as 8 bytes.

Defined results: a null text counts as empty; an empty text is one row of spaces; a chunk
whose checksum is wrong, a missing chunk or an unknown filter raises ValueError; repeated rows
give equal values; a long text takes about eight times its own memory; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from genospark.llm.common import small_batches

#: The format's signature, channels by colour type, and the row width here.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}
WIDTH = 192
IDAT = 1 << 20
#: Rows that are filtered or averaged at once, so that a long text takes a few times its own memory.
BAND = 4096


def padded(text: str | None, width: int = WIDTH) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + b" " * (-len(raw) % width or (0 if raw else width))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode(pixels: np.ndarray, level: int = 3) -> bytes:
    """PNG of a (height, width) or (height, width, channels) array of uint8. Rows are filtered and deflated BAND at a time."""
    h, w = pixels.shape[:2]
    c = 1 if pixels.ndim == 2 else pixels.shape[2]
    flat, packer, data = np.ascontiguousarray(pixels).reshape(h, w * c), zlib.compressobj(level), []
    for y in range(0, h, BAND):
        rows = flat[y : y + BAND]
        left, up = np.zeros_like(rows), np.zeros_like(rows)
        left[:, c:], up[1:] = rows[:, :-c], rows[:-1]
        if y:
            up[0] = flat[y - 1]
        tries = np.stack([rows, rows - left, rows - up])
        best = np.abs(tries.view(np.int8)).view(np.uint8).sum(axis=2, dtype=np.int64).argmin(axis=0)
        lines = np.empty((len(rows), w * c + 1), np.uint8)
        lines[:, 0], lines[:, 1:] = best, tries[best, np.arange(len(rows))]
        data.append(packer.compress(lines.tobytes()))
    data = b"".join([*data, packer.flush()])
    kind = next(k for k, n in CHANNELS.items() if n == c)
    parts = [data[i : i + IDAT] for i in range(0, len(data), IDAT)]
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + b"".join(_chunk(b"IDAT", p) for p in parts) + _chunk(b"IEND", b"")


def _chunks(png: bytes) -> Iterator[tuple[bytes, bytes]]:
    if png[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at = 8
    while at < len(png):
        if at + 12 > len(png):
            raise ValueError("cut short")
        (n,), kind = struct.unpack_from(">I", png, at), png[at + 4 : at + 8]
        body, crc = png[at + 8 : at + 8 + n], png[at + 8 + n : at + 12 + n]
        if len(crc) < 4 or struct.unpack(">I", crc)[0] != zlib.crc32(kind + body):
            raise ValueError(f"wrong checksum in {kind!r}")
        yield kind, body
        at += 12 + n


def _diagonals(rows: np.ndarray, kinds: np.ndarray, above: np.ndarray, c: int) -> None:
    """Undoes Average and Paeth in place: pixels on an anti-diagonal depend on earlier ones only."""
    h, w = rows.shape[0], rows.shape[1] // c
    grid = np.zeros((h + 1, w + 1, c), np.int16)
    grid[0, 1:] = above.reshape(w, c)
    grid[1:, 1:] = rows.reshape(h, w, c)
    mean = (kinds == 3)[:, None]
    for d in range(h + w - 1):
        y = np.arange(max(0, d - w + 1), min(h, d + 1))
        x = d - y
        a, b, e = grid[y + 1, x], grid[y, x + 1], grid[y, x]
        p = a + b - e
        da, db, de = abs(p - a), abs(p - b), abs(p - e)
        paeth = np.where((da <= db) & (da <= de), a, np.where(db <= de, b, e))
        grid[y + 1, x + 1] = (grid[y + 1, x + 1] + np.where(mean[y], (a + b) >> 1, paeth)) & 255
    rows[:] = grid[1:, 1:].reshape(h, w * c)


def unfiltered(lines: np.ndarray, c: int) -> np.ndarray:
    """(height, row bytes) from lines with a filter byte each; runs of rows with like filters go at once."""
    kinds, rows = lines[:, 0], lines[:, 1:].copy()
    if kinds.max(initial=0) > 4:
        raise ValueError("unknown filter")
    group = np.where(kinds >= 3, 3, kinds)
    cuts = np.flatnonzero(np.diff(group)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(group)], strict=True):
        above = rows[a - 1] if a else np.zeros(rows.shape[1], np.uint8)
        if group[a] == 1:
            part = rows[a:b].reshape(b - a, -1, c)
            np.cumsum(part, axis=1, dtype=np.uint8, out=part)
        elif group[a] == 2:
            rows[a] += above
            np.cumsum(rows[a:b], axis=0, dtype=np.uint8, out=rows[a:b])
        elif group[a] == 3:
            _diagonals(rows[a:b], kinds[a:b], above, c)
    return rows


def decode(png: bytes) -> np.ndarray:
    """The pixels of an 8-bit PNG that is not interlaced: (height, width, channels)."""
    head, data, ended = None, [], False
    for kind, body in _chunks(png):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        ended |= kind == b"IEND"
    if head is None or not data or not ended:
        raise ValueError("a chunk is missing")
    w, h, depth, colour, _, _, laced = head
    if depth != 8 or colour not in CHANNELS or laced:
        raise ValueError("only 8-bit images without a palette and not interlaced")
    c = CHANNELS[colour]
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(h, w * c + 1)
    return unfiltered(lines, c).reshape(h, w, c)


def _areas(grid: np.ndarray, n: int) -> np.ndarray:
    """Axis 0 down (or up) to n by mean areas."""
    h = len(grid)
    sums = np.zeros((h + 1, *grid.shape[1:]))
    np.cumsum(grid, axis=0, out=sums[1:])
    edges = np.arange(n + 1) * (h / n)
    low = np.minimum(edges.astype(int), h - 1)
    at = sums[low] + (edges - low)[:, None] * (sums[low + 1] - sums[low])
    return np.diff(at, axis=0) * (n / h)


def cosine_basis(n: int = 32, k: int = 8) -> np.ndarray:
    return np.cos(np.pi * np.outer(np.arange(k), np.arange(n) + 0.5) / n)


def low_frequency_hash(pixels: np.ndarray, basis: np.ndarray) -> bytes:
    """8 bytes; the first bit, of the mean, is 0."""
    narrow = []
    for y in range(0, len(pixels), BAND):
        rows = pixels[y : y + BAND]
        narrow.append(_areas((rows.astype(float) if pixels.ndim == 2 else rows.mean(axis=2)).T, 32).T)
    low = np.round(basis @ _areas(np.concatenate(narrow), 32) @ basis.T, 6).ravel()
    bits = low > np.median(low[1:])
    bits[0] = False
    return np.packbits(bits).tobytes()


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, media binary, phash binary"
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary()]


def stored(docs: DataFrame, keep_media: bool = True) -> DataFrame:
    """The PNG of each text (media), figures of the payload as read back from it, and its hash."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        basis = cosine_basis()
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part, out = batch.slice(at, 200), [[] for _ in _TYPES]
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    n, payload = padded(text)
                    png = encode(np.frombuffer(payload, np.uint8).reshape(-1, WIDTH))
                    pixels = decode(png)[:, :, 0]
                    back = pixels.tobytes()
                    row = (doc_id, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(png), hashlib.sha256(png).hexdigest(), png if keep_media else None, low_frequency_hash(pixels, basis))
                    for column, x in zip(out, row, strict=True):
                        column.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, _TYPES, strict=True)], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
