"""Image files: what their headers say, within limits, with a row for every file that can't be used.

`probe` reads format, size, EXIF texts and JPEG quality from the bytes of a file and checks that it is complete, without
decoding its pixels; sizes are checked before anything is unpacked. `index` applies it to the files of a dataset, reading no
file beyond the limit of bytes; `pixels` decodes a folder with Spark's image source, once no header in it is beyond the
limits.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofgrid.functions.columns import is_unsafe_path
from proofgrid.functions.vision import jpeg_quality

# Limits, formats, and the EXIF tags that are kept.
MAX_BYTES, MAX_PIXELS, MAX_SIDE = 64 << 20, 40_000_000, 16_384
FORMATS = ("PNG", "JPEG", "BMP", "TIFF", "WEBP")
TAGS = {271: "Make", 272: "Model", 305: "Software", 306: "DateTime", 36867: "DateTimeOriginal", 42036: "LensModel", 42033: "BodySerialNumber"}
EXIF_DIRECTORY = 34665
EDITING_SOFTWARE = ("photoshop", "gimp", "lightroom", "snapseed", "pixelmator", "paint.net", "affinity", "facetune", "picsart", "photopea")

FACTS = "format string, width long, height long, jpeg_quality int, quant_digest string, exif map<string,string>, error_kind string, error string"
_TYPES = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string(), pa.string())


class Unreadable(ValueError):
    kind = "unreadable"


class Unsafe(Unreadable):
    """Refused: a format that isn't allowed, or a size beyond the limits."""

    kind = "unsafe"


def directory(data: bytes) -> dict[int, list[int] | bytes]:
    """The tags of a TIFF block's first directory and of its EXIF directory; what points outside the block is left out."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if not order or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise Unreadable("no tag directory")
    out: dict[int, list[int] | bytes] = {}
    waiting, seen = [struct.unpack(order + "I", data[4:8])[0]], set()
    while waiting:
        at = waiting.pop()
        if at in seen or at + 2 > len(data):
            continue
        seen.add(at)
        for k in range(struct.unpack_from(order + "H", data, at)[0]):
            entry = at + 2 + 12 * k
            if entry + 12 > len(data):
                break
            tag, kind, n = struct.unpack_from(order + "HHI", data, entry)
            size = {1: 1, 2: 1, 3: 2, 4: 4, 7: 1}.get(kind, 0) * n
            start = entry + 8 if size <= 4 else struct.unpack_from(order + "I", data, entry + 8)[0]
            if not size or start + size > len(data):
                continue
            if kind in (2, 7, 1):
                out.setdefault(tag, data[start : start + size])
            elif n <= 64:
                out.setdefault(tag, list(struct.unpack_from(f"{order}{n}{'H' if kind == 3 else 'I'}", data, start)))
        waiting += out.pop(EXIF_DIRECTORY, []) if isinstance(out.get(EXIF_DIRECTORY), list) else []
    return out


def _texts(block: bytes) -> dict[str, str]:
    """The kept EXIF texts, printable and of 128 characters at most; a malformed block has none."""
    try:
        found = directory(block)
    except (Unreadable, struct.error):
        return {}
    texts = {name: found[tag].split(b"\0")[0].decode("utf-8", "replace") for tag, name in TAGS.items() if isinstance(found.get(tag), bytes)}
    clean = {k: "".join(c for c in v if c.isprintable()).strip()[:128] for k, v in texts.items()}
    return {k: v for k, v in clean.items() if v}


def _within(width: int, height: int) -> tuple[int, int]:
    if width <= 0 or height <= 0:
        raise Unreadable(f"invalid dimensions {width}x{height}")
    if width > MAX_SIDE or height > MAX_SIDE or width * height > MAX_PIXELS:
        raise Unsafe(f"{width}x{height} exceeds the limits")
    return width, height


def _png(data: bytes) -> tuple[int, int, bytes]:
    at, exif, size, packed, rows = 8, b"", None, zlib.decompressobj(), 0
    while at + 12 <= len(data):
        n, name = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + n]
        if len(data) < at + 12 + n or zlib.crc32(name + body) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            break
        if name == b"IHDR" and n == 13:
            size = _within(*struct.unpack_from(">II", body))
            depth, colour, interlaced = body[8], body[9], body[12]
            need = size[1] * (1 + -(-size[0] * depth * {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(colour, 1) // 8))
        elif size is None:
            break
        elif name == b"eXIf":
            exif = body
        elif name == b"IDAT":
            try:
                while body:
                    rows += len(packed.decompress(body, 1 << 20))
                    body = packed.unconsumed_tail
            except zlib.error:
                break
        elif name == b"IEND":
            if interlaced or rows == need:
                return *size, exif
            break
        at += 12 + n
    raise Unreadable("corrupt or truncated PNG")


def _jpeg(data: bytes) -> tuple[int, int, bytes]:
    at, exif, size = 2, b"", None
    while at + 4 <= len(data) and data[at] == 0xFF:
        mark, n = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC) and at + 9 <= len(data):
            height, width = struct.unpack_from(">HH", data, at + 5)
            size = _within(width, height)
        elif mark == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0" and not exif:
            exif = data[at + 10 : at + 2 + n]
        elif mark == 0xDA:
            if size and data.rfind(b"\xff\xd9", at) > 0:
                return *size, exif
            break
        at += 2 + n
    raise Unreadable("corrupt or truncated JPEG")


def _tiff(data: bytes) -> tuple[int, int, bytes]:
    tags = directory(data)
    try:
        return *_within(tags[256][0], tags[257][0]), data
    except (KeyError, TypeError):
        raise Unreadable("TIFF without dimensions") from None


def _bmp(data: bytes) -> tuple[int, int, bytes]:
    if len(data) < 26 or struct.unpack_from("<I", data, 2)[0] > len(data):
        raise Unreadable("corrupt or truncated BMP")
    width, height = struct.unpack_from("<ii", data, 18)
    return *_within(width, abs(height)), b""


def _webp(data: bytes) -> tuple[int, int, bytes]:
    if struct.unpack_from("<I", data, 4)[0] + 8 > len(data) or len(data) < 30:
        raise Unreadable("corrupt or truncated WEBP")
    kind = data[12:16]
    if kind == b"VP8X":
        size = 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little")
    elif kind == b"VP8L":
        bits = int.from_bytes(data[21:25], "little")
        size = 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
    else:
        size = tuple(x & 0x3FFF for x in struct.unpack_from("<HH", data, 26))
    at = data.find(b"EXIF", 12)
    return *_within(*size), data[at + 8 : at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")] if at > 0 else b""


def _format(data: bytes) -> str | None:
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return "PNG"
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return "WEBP"
    return {b"\xff\xd8": "JPEG", b"BM": "BMP", b"II": "TIFF", b"MM": "TIFF", b"GI": "GIF"}.get(data[:2])


READERS = {"PNG": _png, "JPEG": _jpeg, "BMP": _bmp, "TIFF": _tiff, "WEBP": _webp}


def facts(data: bytes | None) -> tuple:
    """The columns of ``FACTS`` for a file's bytes; null bytes have none."""
    if data is None:
        return (None,) * 8
    kind = None
    try:
        if data[:5].lower() == b"<?xml" or b"<svg" in data[:512].lower():
            raise Unsafe("SVG and XML documents are not accepted as images")
        kind = _format(data)
        if kind is None:
            raise Unreadable("not an image")
        if kind not in FORMATS:
            raise Unsafe(f"image format {kind} is not on the allow-list")
        width, height, exif = READERS[kind](data)
        quality, quant = jpeg_quality(data) if kind == "JPEG" else (None, None)
        return kind, width, height, quality, quant, list(_texts(exif[6:] if exif[:6] == b"Exif\0\0" else exif).items()), None, None
    except Unreadable as e:
        return kind, None, None, None, None, None, e.kind, str(e)
    except (struct.error, IndexError):
        return kind, None, None, None, None, None, "unreadable", "corrupt or truncated file"


def probe(files: DataFrame, content: str = "content") -> DataFrame:
    """``files`` without their bytes but with the columns of ``FACTS``."""
    rest = [c for c in files.columns if c != content]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [facts(x.as_py()) for x in batch.column(len(rest))]
            found = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)] if rows else [pa.array([], t) for t in _TYPES]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], *found], [*rest, *(x.split()[0] for x in FACTS.split(", "))])

    kept = files.select(*rest, content)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]), FACTS])
    return kept.mapInArrow(run, schema)


def index(spark: SparkSession, samples: DataFrame, root: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``samples`` (file) with digest, size_bytes and the columns of ``FACTS``: one row each, whatever the file is like.

    error_kind: unsafe (a path outside the root, a format that isn't allowed, or a size beyond a limit), missing, or
    unreadable (corrupt or truncated). Files beyond ``max_bytes`` are listed and never read. Spark's sources don't list
    files of no bytes: these count as missing.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))  # files differ much in size
    base = root.split("://", 1)[-1].removeprefix("file:").rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    name = F.substring_index("path", f"{base}/", -1).alias("file")
    listed = files.select(name, F.col("length").alias("size_bytes"))
    read = probe(files.filter(F.col("length") <= max_bytes).select(name, F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("digest"), "content"))
    out = samples.join(listed, "file", "left").join(read, "file", "left")
    kind = F.when(is_unsafe_path(F.col("file")), "unsafe").when(F.col("size_bytes").isNull(), "missing").when(F.col("size_bytes") > max_bytes, "unsafe").otherwise(F.col("error_kind"))
    error = F.when(F.col("size_bytes") > max_bytes, F.lit(f"larger than {max_bytes} bytes")).otherwise(F.col("error"))
    return out.withColumn("error_kind", kind).withColumn("error", error)


def pixels(spark: SparkSession, root: str, indexed: DataFrame) -> DataFrame:
    """(file, data, height, width) of the files that Spark's image source decodes, as rows of RGB for `vision.measure`.

    ``indexed`` is the result of `index` for the same root; a header beyond the limits there is an error here, since the
    source unpacks every file. Grey images and those with alpha come as RGB too; files that it can't decode have no row.
    """
    beyond = indexed.filter("error LIKE '%exceeds the limits%' OR error LIKE 'larger than%'").select("file").limit(5).collect()
    if beyond:
        raise ValueError(f"beyond the limits: {', '.join(r.file for r in beyond)}")
    base = root.split("://", 1)[-1].removeprefix("file:").rstrip("/")
    source = spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", "true").load(root).select("image.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                x = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], r["nChannels"])
                x = np.repeat(x, 3, 2) if r["nChannels"] == 1 else x[..., 2::-1]  # stored as BGR(A)
                rows.append((r["file"], x.tobytes(), r["height"], r["width"]))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.binary(), pa.int32(), pa.int32()), strict=True)], ["file", "data", "height", "width"])

    named = source.select(F.substring_index("origin", f"{base}/", -1).alias("file"), "data", "height", "width", "nChannels")
    return named.mapInArrow(run, "file string, data binary, height int, width int")


def edited(indexed: DataFrame) -> DataFrame:
    """Rows whose EXIF names editing software."""
    software = F.lower(F.element_at("exif", "Software"))
    found = [F.contains(software, F.lit(t)) for t in EDITING_SOFTWARE]
    any_ = found[0]
    for f in found[1:]:
        any_ = any_ | f
    return indexed.filter(any_)
