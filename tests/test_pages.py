"""Pages, pixels and stacked images against numpy."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import pixels
from tessera.operators import layout
from tessera.sources import pages


def image(seed, height, width):
    return np.random.default_rng(seed).integers(0, 256, (height, width, 3), dtype=np.uint8)


def filtered(x, colour, palette=None):
    """A PNG whose rows take all five filters in turn, written by the format's own rules."""
    height, width, n = x.shape
    raw, flat = b"", x.reshape(height, width * n).astype(int)
    for y in range(height):
        row, up = flat[y], flat[y - 1] if y else np.zeros(width * n, int)
        left, corner = np.concatenate([np.zeros(n, int), row[:-n]]), np.concatenate([np.zeros(n, int), up[:-n]])
        p = left + up - corner
        a, b, c = abs(p - left), abs(p - up), abs(p - corner)
        paeth = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
        guess = [0, left, up, (left + up) // 2, paeth][y % 5]
        raw += bytes([y % 5]) + ((row - guess) % 256).astype(np.uint8).tobytes()
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    packed = zlib.compress(raw)
    return pixels.PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)) + (chunk(b"PLTE", palette.tobytes()) if palette is not None else b"") + chunk(b"IDAT", packed[:7]) + chunk(b"IDAT", packed[7:]) + chunk(b"IEND", b"")


def test_png_of_all_kinds():
    rng = np.random.default_rng(1)
    for colour, n in pixels.SAMPLES.items():
        palette = rng.integers(0, 256, (256, 3), dtype=np.uint8) if colour == 3 else None
        x = rng.integers(0, 256, (11, 7, n), dtype=np.uint8)
        want = palette[x[:, :, 0]] if colour == 3 else np.repeat(x[:, :, :1], 3, 2) if n < 3 else x[:, :, :3]
        assert (pixels.read(filtered(x, colour, palette)) == want).all()
    assert (pixels.read(pixels.to_png(want)) == want).all() and (pixels.read(pixels.to_ppm(want)) == want).all()


def test_decoded_column(spark):
    x = image(1, 3, 2)
    grey = b"P5\n# note\n2 3\n255\n" + bytes(range(6))
    rows = [(0, pixels.to_ppm(x)), (1, pixels.to_png(x)), (2, grey), (3, b"P6 9 9 255\nxx"), (4, b""), (5, None), (6, pixels.PNG + b"zzzz"), (7, pixels.to_png(x)[:-30])]
    got = {r["i"]: r["x"] for r in spark.createDataFrame(rows, "i int, c binary").select("i", pixels.decoded(F.col("c")).alias("x")).collect()}
    assert all(got[i] is None for i in range(3, 8))
    for i, want in ((0, x), (1, x), (2, np.repeat(np.arange(6, dtype=np.uint8).reshape(3, 2, 1), 3, 2))):
        assert (got[i]["width"], got[i]["height"], bytes(got[i]["pixels"])) == (2, 3, want.tobytes())


@pytest.fixture
def documents(spark, tmp_path):
    """Two documents of 10 and 3 pages of different sizes."""
    every = {}
    for name, n in (("Science 4.ppm", 10), ("Maths 5.ppm", 3)):
        images = [image(100 * n + k, 2 + k % 2, 3) for k in range(n)]
        (tmp_path / name).write_bytes(b"".join(map(pixels.to_ppm, images)))
        every |= {(name, k): x for k, x in enumerate(images)}
    (tmp_path / "none.ppm").write_bytes(b"")
    (tmp_path / "other.txt").write_bytes(b"no image")
    pages.register(spark)
    return every, str(tmp_path)


def test_pages_and_filters(spark, documents):
    every, path = documents
    load = lambda: spark.read.format("pages").option("pagesPerPartition", 2).load(path)
    got = {(r["file"], r["page"]): (r["file_no"], bytes(r["content"])) for r in load().collect()}
    assert got == {(f, k): (1 if f.startswith("Science") else 0, pixels.to_ppm(x)) for (f, k), x in every.items()}
    assert load().rdd.getNumPartitions() == 5 + 2
    some = load().where("page >= 3 AND page < 6")  # pages 2 to 5 of one file, page 3 on of none in the other
    assert some.rdd.getNumPartitions() == 2
    assert sorted((r["file"], r["page"]) for r in some.collect()) == [("Science 4.ppm", k) for k in (3, 4, 5)]
    one = load().where("file = 'Maths 5.ppm' AND page IN (0, 2) AND length(content) > 0")
    assert one.rdd.getNumPartitions() == 2 and sorted(r["page"] for r in one.collect()) == [0, 2]
    assert load().where("file_no = 7").count() == 0


def test_images_of_page_ranges(spark, documents):
    """Pages of the ranges of a document, stacked: as numpy stacks them."""
    every, path = documents
    ranges = spark.createDataFrame([(0, 1, 3), (1, 5, 5), (2, 50, 60)], "range_id int, start int, stop int")
    read = spark.read.format("pages").load(path).where("file = 'Science 4.ppm'")
    found = layout.pages_in_ranges(read, ranges, "page", offset=1)
    got = {r["range_id"]: r for r in pixels.stacked(found, "range_id", "page", "content").collect()}
    for i, numbers in ((0, [2, 3, 4]), (1, [6])):
        images = [every["Science 4.ppm", k] for k in numbers]
        height = images[0].shape[0]
        want = np.zeros((height * len(images), 3, 3), np.uint8)
        for k, x in enumerate(images):
            end = min(len(want), k * height + len(x))
            want[k * height : end] = x[: end - k * height]
        assert (got[i]["n"], got[i]["width"], got[i]["height"]) == (len(images), 3, len(want))
        assert (pixels.read(bytes(got[i]["png"])) == want).all()
    assert set(got) == {0, 1}
    broken = spark.createDataFrame([("a", 1, b"?"), ("a", 2, None), ("b", 1, pixels.to_ppm(image(1, 1, 1)))], "g string, i int, c binary")
    assert [(r["g"], r["n"]) for r in pixels.stacked(broken, "g", "i", "c").collect()] == [("b", 1)]
