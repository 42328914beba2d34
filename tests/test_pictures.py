"""Decoding and conversion of pictures, held against files written by hand and filters undone byte by byte."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelspark.functions import pictures
from reelspark.sources import frames

RNG = np.random.default_rng(11)
PASS_STARTS = [(0, 0), (4, 0), (0, 4), (2, 0), (0, 2), (1, 0), (0, 1)]
PASS_STEPS = [(8, 8), (8, 8), (4, 8), (4, 4), (2, 4), (2, 2), (1, 2)]


def predicted(kind, a, b, c):
    if kind == 4:
        p = a + b - c
        return min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
    return [0, a, b, (a + b) // 2][kind]


def filtered(lines, unit):
    """Scan lines with a filter chosen at random for each, byte by byte."""
    made, before = b"", bytes(len(lines[0]))
    for line in lines:
        kind = int(RNG.integers(0, 5))
        made += bytes([kind]) + bytes((v - predicted(kind, line[i - unit] if i >= unit else 0, before[i], before[i - unit] if i >= unit else 0)) % 256 for i, v in enumerate(line))
        before = line
    return made


def lines_of(part, depth):
    """Bytes of each row of height x width x channels samples."""
    if depth == 16:
        return [row.astype(">u2").tobytes() for row in part]
    if depth == 8:
        return [row.astype(np.uint8).tobytes() for row in part]
    bits = ["".join(f"{int(v):0{depth}b}" for v in row.ravel()) for row in part]
    return [bytes(int(b[k : k + 8].ljust(8, "0"), 2) for k in range(0, len(b), 8)) for b in bits]


def chunk(name, body):
    return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))


def png_file(own, depth, colour, laced=0, extra=b"", pieces=1):
    height, width, channels = own.shape
    parts = [own[y::dy, x::dx] for (x, y), (dx, dy) in zip(PASS_STARTS, PASS_STEPS)] if laced else [own]
    data = zlib.compress(b"".join(filtered(lines_of(p, depth), max(1, depth * channels // 8)) for p in parts if p.size))
    cut = [len(data) * k // pieces for k in range(pieces + 1)]
    body = b"".join(chunk(b"IDAT", data[a:b]) for a, b in zip(cut, cut[1:]))
    return pictures.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, laced)) + extra + body + chunk(b"IEND", b"")


@pytest.mark.parametrize("laced", (0, 1))
@pytest.mark.parametrize("colour,channels,depths", [(0, 1, (1, 2, 4, 8, 16)), (2, 3, (8, 16)), (4, 2, (8, 16)), (6, 4, (8, 16))])
def test_png_of_any_kind(colour, channels, depths, laced):
    for depth in depths:
        for height, width in ((1, 1), (1, 9), (9, 1), (3, 2), (11, 13)):
            own = RNG.integers(0, 2**depth, (height, width, channels))
            got = pictures.pixels(png_file(own, depth, colour, laced, pieces=3))
            want = own if depth >= 8 else own * 255 // (2**depth - 1)
            assert got.dtype == (np.uint16 if depth == 16 else np.uint8) and (got == want).all()


def test_palettes_and_transparent_colours():
    table = RNG.integers(0, 256, (4, 3), dtype=np.uint8)
    own = RNG.integers(0, 4, (7, 5, 1))
    plain = chunk(b"PLTE", table.tobytes())
    assert (pictures.pixels(png_file(own, 2, 3, extra=plain)) == table[own[..., 0]]).all()
    seen = pictures.pixels(png_file(own, 8, 3, extra=plain + chunk(b"tRNS", bytes([0, 100]))))
    assert (seen[..., :3] == table[own[..., 0]]).all() and (seen[..., 3] == np.array([0, 100, 255, 255])[own[..., 0]]).all()
    assert pictures.pixels(png_file(own + 3, 8, 3, extra=plain)) is None and pictures.pixels(png_file(own, 8, 3)) is None
    gray = pictures.pixels(png_file(own, 2, 0, extra=chunk(b"tRNS", struct.pack(">H", 2))))
    assert (gray[..., 0] == own[..., 0] * 85).all() and (gray[..., 1] == np.where(own[..., 0] == 2, 0, 255)).all()
    wide = RNG.integers(0, 2, (6, 6, 3)) * 65535
    clear = pictures.pixels(png_file(wide, 16, 2, extra=chunk(b"tRNS", struct.pack(">HHH", 65535, 0, 65535))))
    assert (clear[..., 3] == np.where((wide == [65535, 0, 65535]).all(axis=2), 0, 65535)).all()


def bmp_file(own, depth, upside=True, table=None, masks=()):
    height, width = own.shape[:2]
    rows = [own[y].astype(np.uint8).tobytes() for y in range(height)]
    rows = [r + bytes(-len(r) % 4) for r in (rows[::-1] if upside else rows)]
    extra = b"".join(struct.pack("<I", m) for m in masks) + (b"" if table is None else np.hstack([table[:, ::-1], table[:, :1] * 0]).tobytes())
    size = 40 + 4 * len(masks)
    start = 14 + 40 + len(extra)
    head = struct.pack("<IiiHHIIiiII", size, width, height if upside else -height, 1, depth, 3 if masks else 0, 0, 0, 0, 0 if table is None else len(table), 0)
    return b"BM" + struct.pack("<IHHI", start + sum(map(len, rows)), 0, 0, start) + head + extra + b"".join(rows)


def test_bmp():
    own = RNG.integers(0, 256, (5, 7, 4), dtype=np.uint8)
    for upside in (True, False):
        assert (pictures.pixels(bmp_file(own[..., :3], 24, upside)) == own[..., 2::-1]).all()
        assert (pictures.pixels(bmp_file(own, 32, upside)) == own[..., 2::-1]).all()
    masks = (0xFF0000, 0xFF00, 0xFF, 0xFF000000)
    assert (pictures.pixels(bmp_file(own, 32, masks=masks)) == own[..., [2, 1, 0, 3]]).all()
    table = RNG.integers(0, 256, (9, 3), dtype=np.uint8)
    held = RNG.integers(0, 9, (4, 6), dtype=np.uint8)
    assert (pictures.pixels(bmp_file(held, 8, table=table)) == table[held]).all()
    assert pictures.pixels(bmp_file(held + 5, 8, table=table)) is None
    whole = bmp_file(own, 32)
    assert pictures.pixels(whole[:-1]) is None and pictures.pixels(whole[:20]) is None


def test_torn_and_changed_files_are_no_pictures():
    whole = png_file(RNG.integers(0, 256, (9, 8, 3)), 8, 2)
    assert pictures.pixels(whole) is not None
    assert all(pictures.pixels(whole[:n]) is None for n in range(len(whole)))
    for n in range(8, len(whole)):
        assert pictures.pixels(whole[:n] + bytes([whole[n] ^ 1]) + whole[n + 1 :]) is None
    giant = pictures.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 2**31 - 1, 2**31 - 1, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(bytes(99))) + chunk(b"IEND", b"")
    assert pictures.pixels(giant) is None and pictures.pixels(b"") is None and pictures.pixels(None) is None


def test_conversion_and_writer():
    wide = RNG.integers(0, 65536, (6, 5, 4), dtype=np.uint16)
    got = pictures.flattened(wide)
    eight = [[[int(v) // 257 for v in p] for p in row] for row in wide]
    for y in range(6):
        for x in range(5):
            *colour, a = eight[y][x]
            assert all(abs(int(g) - (a / 255 * c + (1 - a / 255) * 240)) < 1.001 for g, c in zip(got[y, x], colour))
    assert (pictures.flattened(np.array([[[7, 255]], [[7, 0]]], np.uint8)) == [[[7] * 3], [[240] * 3]]).all()
    for kind in (np.uint8, np.uint16):
        for channels in (1, 2, 3, 4):
            own = RNG.integers(0, np.iinfo(kind).max + 1, (4, 9, channels), dtype=kind)
            back = pictures.pixels(pictures.png(own))
            assert back.dtype == kind and (back == own).all()


def test_decoded_tables(spark):
    own = RNG.integers(0, 256, (4, 6, 3), dtype=np.uint8)
    files = {1: png_file(own, 8, 2), 2: bmp_file(own[..., ::-1], 24), 3: None, 4: b"", 5: b"\xff\xd8\xffjpeg", 6: png_file(own, 8, 2)[:-3], 7: png_file(own[..., :1].astype(int) * 257, 16, 0), 8: b"RIFF0000WEBPx"}
    rows = spark.createDataFrame([(k, None if v is None else bytearray(v), 1) for k, v in files.items()], "id long, content binary, w int")
    got = {r.id: r for r in pictures.decoded(rows.drop("w"), ["id"]).collect()}
    assert sorted(got) == list(files) and all(bytes(got[k].pixels) == own.tobytes() for k in (1, 2))
    assert all(got[k].pixels is None and got[k].w is None for k in (3, 4, 5, 6, 8))
    assert (got[7].bits, got[7].channels, bytes(got[7].pixels)) == (16, 1, np.repeat(own[..., :1], 3, axis=2).tobytes())
    kinds = {r.id: r.k for r in rows.select("id", pictures.kind(F.col("content")).alias("k")).collect()}
    assert kinds == {1: "png", 2: "bmp", 3: None, 4: "other", 5: "jpeg", 6: "png", 7: "png", 8: "webp"}
    back = pictures.decoded(pictures.encoded(pictures.decoded(rows.select("id", "content"), ["id"]), ["id"]), ["id"])
    assert {r.id: r.pixels for r in back.collect()} == {k: r.pixels for k, r in got.items()}
    assert pictures.decoded(rows.drop("w").where("false"), ["id"]).count() == 0


def test_set_is_numbered_over_readable_files(spark, tmp_path):
    own = RNG.integers(0, 256, (3, 3, 4), dtype=np.uint8)
    files = [b"torn", png_file(own, 8, 6), b"\xff\xd8\xffas it is", None, bmp_file(own, 32), png_file(own, 8, 6)[:-1], b"\xff\xd8\xff2"]
    rows = spark.createDataFrame([(f"p{k}", k * 10, None if v is None else bytearray(v)) for k, v in enumerate(files)], "path string, turn long, content binary")
    made = pictures.numbered_set(rows.repartition(3), "path", ["turn"])
    got = {r.path: r for r in made.collect()}
    assert {p: (r.rank, r.name) for p, r in got.items()} == {"p0": (None, None), "p1": (1, "0001.png"), "p2": (2, "0002.jpg"), "p3": (None, None), "p4": (3, "0003.png"), "p5": (None, None), "p6": (4, "0004.jpg")}
    assert bytes(got["p2"].content) == files[2] and (pictures.pixels(bytes(got["p1"].content)) == pictures.flattened(own)).all()
    frames.write_pictures(made, str(tmp_path / "set"))
    assert sorted(p.name for p in (tmp_path / "set").iterdir()) == ["0001.png", "0002.jpg", "0003.png", "0004.jpg"]
    assert pictures.numbered_set(rows.where("false"), "path", ["turn"]).count() == 0
