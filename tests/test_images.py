import struct
import zlib

import numpy as np
import pytest

from proofgrid.functions import vision
from proofgrid.sources import images as im


def chunk(name, body):
    return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))


def png(pixels, exif=b"", size=None):
    h, w, _ = pixels.shape
    rows = b"".join(b"\0" + r.tobytes() for r in pixels)
    head = struct.pack(">IIBBBBB", *(size or (w, h)), 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + (chunk(b"eXIf", exif) if exif else b"") + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def tags(order, entries, exif_entries=()):
    """A TIFF block with ASCII and short tags."""
    def block(start, items, extra):
        at, out, data = start + 2 + 12 * (len(items) + bool(extra)) + 4, struct.pack(order + "H", len(items) + bool(extra)), b""
        for tag, v in items:
            if isinstance(v, int):
                out += struct.pack(order + "HHIHH", tag, 3, 1, v, 0)
            else:
                v = v.encode() + b"\0"
                out += struct.pack(order + "HHI", tag, 2, len(v)) + (v.ljust(4, b"\0") if len(v) <= 4 else struct.pack(order + "I", at + len(data)))
                data += v if len(v) > 4 else b""
        if extra:
            out += struct.pack(order + "HHII", im.EXIF_DIRECTORY, 4, 1, at + len(data))
        return out + struct.pack(order + "I", 0) + data

    first = block(8, entries, exif_entries)
    return {"<": b"II", ">": b"MM"}[order] + struct.pack(order + "HI", 42, 8) + first + (block(8 + len(first), exif_entries, ()) if exif_entries else b"")


@pytest.mark.parametrize("order", ["<", ">"])
def test_tag_directories(order):
    block = tags(order, [(271, "Acme"), (305, "abc"), (256, 7), (257, 9)], [(36867, "2024:01:01 00:00:00"), (42036, "Lens\x01 one ")])
    assert im._texts(block) == {"Make": "Acme", "Software": "abc", "DateTimeOriginal": "2024:01:01 00:00:00", "LensModel": "Lens one"}
    assert im.facts(block)[:3] == ("TIFF", 7, 9)
    for n in range(len(block)):
        im._texts(block[:n])  # a cut block may lose tags and never fails
    loop = bytearray(block)
    loop[-20:] = b"\0" * 20
    im._texts(bytes(loop))


def test_every_file_has_its_row(spark, tmp_path):
    rng = np.random.default_rng(0)
    pixels = rng.integers(0, 256, (6, 5, 3), np.uint8)
    good = png(pixels, tags("<", [(305, "GIMP 2.10")]))
    files = {"a.png": good, "cut.png": good[:-20], "b/flip.png": good.replace(b"IDAT", b"IDAU"), "short.png": png(pixels[:3], size=(5, 6)), "wide.png": png(pixels, size=(20_000, 6)), "zero.png": png(pixels, size=(0, 6)), "x.svg": b"<?xml version='1.0'?><svg/>", "g.gif": b"GIF89a....", "t.txt": b"hello", "e.bin": b"", "big.png": good + b"\0" * 5_000, "w.webp": b"RIFF" + struct.pack("<I", 22) + b"WEBPVP8X" + struct.pack("<I", 10) + b"\0\0\0\0" + b"\x09\0\0\x04\0\0"}
    for name, data in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    names = [*files, "gone.png", "../out.png"]
    samples = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "file string, id int")
    got = {r.file: r for r in im.index(spark, samples, str(tmp_path), 2_000).collect()}
    kinds = {n: r.error_kind for n, r in got.items()}
    assert kinds == {"a.png": None, "cut.png": "unreadable", "b/flip.png": "unreadable", "short.png": "unreadable", "wide.png": "unsafe", "zero.png": "unreadable", "x.svg": "unsafe", "g.gif": "unsafe", "t.txt": "unreadable", "e.bin": "missing", "big.png": "unsafe", "w.webp": None, "gone.png": "missing", "../out.png": "unsafe"}
    assert (got["a.png"].width, got["a.png"].height, got["a.png"].exif) == (5, 6, {"Software": "GIMP 2.10"}) and got["a.png"].digest.startswith("sha256:")
    assert (got["w.webp"].width, got["w.webp"].height) == (10, 5) and "exceeds" in got["wide.png"].error and got["big.png"].digest is None and "larger" in got["big.png"].error
    assert [r.file for r in im.edited(im.index(spark, samples, str(tmp_path), 2_000)).collect()] == ["a.png"]
    with pytest.raises(ValueError, match="big.png|wide.png"):
        im.pixels(spark, str(tmp_path), im.index(spark, samples, str(tmp_path), 2_000))


def test_pixels_and_measures(spark, tmp_path):
    rng = np.random.default_rng(1)
    sources = {f"{i}.png": rng.integers(0, 256, (9 + i, 12, 3), np.uint8) for i in range(3)}
    for name, x in sources.items():
        (tmp_path / name).write_bytes(png(x))
    (tmp_path / "bad.png").write_bytes(b"nothing")
    indexed = im.index(spark, spark.createDataFrame([(n,) for n in [*sources, "bad.png"]], "file string"), str(tmp_path))
    got = {r.file: r for r in im.pixels(spark, f"file://{tmp_path}", indexed).collect()}
    assert {n: np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, 3).tolist() for n, r in got.items()} == {n: x.tolist() for n, x in sources.items()}
    measured = {r.file: r.phash for r in vision.measure(im.pixels(spark, str(tmp_path), indexed), "file").collect()}
    assert measured == {n: vision.frequency_hash(x) for n, x in sources.items()}
