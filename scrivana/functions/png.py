"""PNG files from and to raw RGB bytes, with zlib and numpy alone.

Read: 8 bits a sample, grey, grey with opacity, palette, RGB or RGBA, not interlaced; opacity is dropped. Anything else
fails with what it is. Written: RGB, one filter for the whole page (each line against the one above).
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf

# Fixed values of the format: its first bytes, and samples a pixel by colour type.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


class PngError(ValueError):
    pass


def chunks(raw: bytes):
    """(type, content) of each chunk; a wrong checksum or a cut file fails."""
    if not raw.startswith(SIGNATURE):
        raise PngError("not a PNG file")
    at = len(SIGNATURE)
    while at < len(raw):
        if at + 12 > len(raw):
            raise PngError("the file is cut")
        size, kind = struct.unpack(">I4s", raw[at : at + 8])
        content, check = raw[at + 8 : at + 8 + size], raw[at + 8 + size : at + 12 + size]
        if len(check) < 4 or zlib.crc32(kind + content) != struct.unpack(">I", check)[0]:
            raise PngError(f"chunk {kind!r} is damaged or cut")
        yield kind, content
        at += 12 + size


def unfiltered(lines: np.ndarray, width: int, step: int) -> np.ndarray:
    """Lines of filter byte and samples to samples. ``step``: bytes from a sample to the one before it of its kind."""
    out = np.zeros((len(lines), width), dtype=np.uint8)
    above = np.zeros(width, dtype=np.uint8)
    for y, line in enumerate(lines):
        kind, now = line[0], line[1:].copy()
        if kind == 1:
            for k in range(step):
                now[k::step] = np.cumsum(now[k::step], dtype=np.uint8)
        elif kind == 2:
            now += above
        elif kind in (3, 4):
            left = [0] * step
            corner = [0] * step
            for x, (value, up) in enumerate(zip(now.tolist(), above.tolist())):
                k = x % step
                a, c = left[k], corner[k]
                if kind == 3:
                    guess = (a + up) >> 1
                else:
                    pa_, pb, pc = abs(up - c), abs(a - c), abs(a + up - 2 * c)
                    guess = a if pa_ <= pb and pa_ <= pc else up if pb <= pc else c
                left[k], corner[k] = (value + guess) & 255, up
                now[x] = left[k]
        elif kind:
            raise PngError(f"line filter {kind}")
        out[y] = above = now
    return out


def decode(raw: bytes) -> np.ndarray:
    """height x width x 3 bytes."""
    head, palette, packed = None, None, []
    for kind, content in chunks(raw):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", content)
        elif kind == b"PLTE":
            palette = np.frombuffer(content, dtype=np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(content)
    if head is None:
        raise PngError("no header")
    width, height, depth, colour, _, _, interlaced = head
    if depth != 8 or colour not in SAMPLES or interlaced or (colour == 3 and palette is None):
        raise PngError(f"depth {depth}, colour type {colour}, interlaced {interlaced}; expected 8 bits a sample, not interlaced")
    step = SAMPLES[colour]
    flat = np.frombuffer(zlib.decompress(b"".join(packed)), dtype=np.uint8)
    if len(flat) != height * (width * step + 1):
        raise PngError("the pixels don't fill the page")
    samples = unfiltered(flat.reshape(height, -1), width * step, step).reshape(height, width, step)
    if colour == 3:
        return palette[samples[:, :, 0]]
    return samples[:, :, :3].copy() if step >= 3 else np.repeat(samples[:, :, :1], 3, axis=2)


def encode(page: np.ndarray) -> bytes:
    height, width = page.shape[:2]
    lines = page.reshape(height, -1).astype(np.uint8)
    against = lines.copy()
    against[1:] -= lines[:-1]
    body = np.concatenate([np.full((height, 1), 2, dtype=np.uint8), against], axis=1).tobytes()

    def chunk(kind: bytes, content: bytes) -> bytes:
        return struct.pack(">I", len(content)) + kind + content + struct.pack(">I", zlib.crc32(kind + content))

    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(body, 6)) + chunk(b"IEND", b"")


def read_png(content: Column) -> Column:
    """(height, width, page as raw RGB bytes) of PNG files; null for null."""

    @arrow_udf("struct<height:int,width:int,page:binary>")
    def run(files: pa.Array) -> pa.Array:
        pages = [None if f.as_py() is None else decode(f.as_py()) for f in files]
        rows = [None if p is None else {"height": p.shape[0], "width": p.shape[1], "page": p.tobytes()} for p in pages]
        return pa.array(rows, pa.struct([("height", pa.int32()), ("width", pa.int32()), ("page", pa.binary())]))

    return run(content)


def write_png(page: Column, height: Column, width: Column) -> Column:
    """The PNG file of raw RGB bytes; null for null."""

    @arrow_udf("binary")
    def run(pages: pa.Array, heights: pa.Array, widths: pa.Array) -> pa.Array:
        rows = ((p.as_py(), h.as_py(), w.as_py()) for p, h, w in zip(pages, heights, widths))
        return pa.array([None if p is None else encode(np.frombuffer(p, dtype=np.uint8).reshape(h, w, 3)) for p, h, w in rows], pa.binary())

    return run(page, height, width)
