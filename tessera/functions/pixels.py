"""Images as arrays of pixels: reading and writing of PPM and PNG, and stacking, in numpy over Arrow batches."""

from __future__ import annotations

import io
import re
import struct
import zlib
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

#: Width, height and the pixels, row by row, a byte for each of red, green and blue.
IMAGE = StructType([StructField("width", IntegerType()), StructField("height", IntegerType()), StructField("pixels", BinaryType())])
PNG = b"\x89PNG\r\n\x1a\n"
#: Fixed values of the format: samples a pixel by kind of colour (grey, red-green-blue, palette, grey and alpha, all and alpha).
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
_HEADER = re.compile(rb"P([56])(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)\s")


def ppm_header(data: bytes) -> tuple[int, int, int, int] | None:
    """(length of the header, samples a pixel, width, height) of a binary PPM or PGM image with samples of a byte; None if it is none."""
    m = _HEADER.match(data)
    if m is None or not 0 < int(m[4]) < 256:
        return None
    return m.end(), 3 if m[1] == b"6" else 1, int(m[2]), int(m[3])


def pages_of(f: BinaryIO) -> list[tuple[int, int]]:
    """(place, size) of the images that follow each other in a file; only their headers are read."""
    out, at = [], 0
    while True:
        f.seek(at)
        head = f.read(512)
        found = ppm_header(head)
        if found is None:
            if head.strip():
                raise ValueError(f"no image at byte {at}")
            return out
        size = found[0] + found[1] * found[2] * found[3]
        out.append((at, size))
        at += size


def from_ppm(data: bytes) -> np.ndarray:
    head, samples, width, height = ppm_header(data) or (0, 0, 0, 0)
    if not samples or len(data) < head + samples * width * height:
        raise ValueError("no whole PPM image")
    flat = np.frombuffer(data, np.uint8, samples * width * height, head).reshape(height, width, samples)
    return np.repeat(flat, 3, 2) if samples == 1 else flat


def from_png(data: bytes) -> np.ndarray:
    """Red, green and blue of a PNG image with samples of a byte, not interlaced; what is transparent keeps its colour."""
    if data[:8] != PNG:
        raise ValueError("no PNG image")
    at, body, palette, head = 8, [], None, None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        chunk = data[at + 8 : at + 8 + size]
        at += 12 + size
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"PLTE":
            palette = np.frombuffer(chunk, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body.append(chunk)
    if head is None or head[2] != 8 or head[3] not in SAMPLES or head[6]:
        raise ValueError("a kind of PNG that is not read")
    width, height, colour = head[0], head[1], head[3]
    n = SAMPLES[colour]
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, 1 + n * width)
    out = np.zeros((height, width, n), np.uint8)
    above = np.zeros((width, n), np.uint8)
    for y in range(height):
        out[y] = above = unfiltered(int(rows[y, 0]), rows[y, 1:].reshape(width, n), above)
    if colour == 3:
        return palette[out[:, :, 0]]
    return np.repeat(out[:, :, :1], 3, 2) if n < 3 else out[:, :, :3]


def unfiltered(kind: int, row: np.ndarray, above: np.ndarray) -> np.ndarray:
    """A row of pixels from what was stored of it and the row above (the format's filters 0 to 4); bytes wrap around."""
    if kind == 0:
        return row
    if kind == 1:
        return np.cumsum(row, axis=0, dtype=np.uint8)
    if kind == 2:
        return row + above
    if kind not in (3, 4):
        raise ValueError("unknown filter of a PNG row")
    out, left, corner = np.empty_like(row), np.zeros(row.shape[1], np.int16), np.zeros(row.shape[1], np.int16)
    for x in range(len(row)):
        up = above[x].astype(np.int16)
        if kind == 3:
            guess = (left + up) // 2
        else:
            toward = left + up - corner
            a, b, c = abs(toward - left), abs(toward - up), abs(toward - corner)
            guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
        out[x] = (row[x] + guess).astype(np.uint8)
        left, corner = out[x].astype(np.int16), up
    return out


def read(data: bytes) -> np.ndarray:
    """Pixels (height, width, 3) of a PPM, PGM or PNG image; ValueError if it is none."""
    try:
        return from_png(data) if data[:8] == PNG else from_ppm(data)
    except (zlib.error, struct.error, TypeError) as e:
        raise ValueError("a broken image") from e


def to_ppm(pixels: np.ndarray) -> bytes:
    return b"P6 %d %d 255\n" % (pixels.shape[1], pixels.shape[0]) + np.ascontiguousarray(pixels).tobytes()


def to_png(pixels: np.ndarray) -> bytes:
    height, width, _ = pixels.shape
    rows = np.concatenate([np.zeros((height, 1), np.uint8), pixels.reshape(height, -1)], axis=1)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def stack(images: list[np.ndarray]) -> np.ndarray:
    """Images below each other in the first one's width, each in as many rows as the first one has: what is larger is cut, what is smaller leaves black."""
    height, width, _ = images[0].shape
    out = np.zeros((height * len(images), width, 3), np.uint8)
    for i, image in enumerate(images):
        # a later image may reach into the rows of the next one, which is put over it
        part = image[: len(out) - i * height, :width]
        out[i * height : i * height + len(part), : part.shape[1]] = part
    return out


@F.arrow_udf(IMAGE)
def _decoded(contents: pa.Array) -> pa.Array:
    out = []
    for data in contents.to_pylist():
        try:
            pixels = read(data) if data is not None else None
        except ValueError:
            pixels = None
        out.append(None if pixels is None else {"width": pixels.shape[1], "height": pixels.shape[0], "pixels": np.ascontiguousarray(pixels).tobytes()})
    return pa.array(out, pa.struct([("width", pa.int32()), ("height", pa.int32()), ("pixels", pa.binary())]))


def decoded(content: Column) -> Column:
    """(width, height, pixels) of an image file's bytes; null where they are no image that is read."""
    return _decoded(content)


def stacked(images: DataFrame, group: str, order: str, content: str) -> DataFrame:
    """(group, n, width, height, png): the images of a group below each other, in order.

    The images of one group meet in a task, as they become one image. Those
    that can't be read are left out; a group without any has no row.
    """

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by(order)
        found = []
        for data in t.column(content).to_pylist():
            try:
                if data is not None:
                    found.append(read(data))
            except ValueError:
                continue
        schema = pa.schema([t.schema.field(group), ("n", pa.int64()), ("width", pa.int32()), ("height", pa.int32()), ("png", pa.binary())])
        if not found:
            return schema.empty_table()
        whole = stack(found)
        return pa.table([t.column(group).slice(0, 1), [len(found)], [whole.shape[1]], [whole.shape[0]], [to_png(whole)]], schema=schema)

    kind = images.schema[group].dataType.simpleString()
    return images.select(group, order, content).groupBy(group).applyInArrow(run, f"`{group}` {kind}, n long, width int, height int, png binary")


def ppm(f: bytes) -> list[bytes]:
    """The images of a file as files of their own."""
    return [f[at : at + size] for at, size in pages_of(io.BytesIO(f))]
