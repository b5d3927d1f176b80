"""Token ids in sharded files, each a wavelet matrix that answers from its compressed form.

Documents are range-partitioned by id; each task encodes its texts in order, appends the end id to each, and writes shards
of about ``shard_tokens`` ids (a document is never split) to the shared folder. Shards are numbered by (part, place), in
the order of ids. A shard is one file:

    b"PGWM0001" | u64 length of the header | header (JSON) | sections

* alphabet: the shard's distinct ids, most frequent first; ids are held as places in it, in as many bits as it needs.
* documents: an Arrow stream of (id, n_tokens).
* planes: for every bit from the highest, the bits of all ids in the matrix's order (at each level those with a 0 go
  before those with a 1, each in the order they had), in blocks of 2^16 bits that are compressed one by one, with each
  block's offset and the number of ones before it.

``Shard`` reads single ids, counts an id in a range and finds its occurrences by rank and select, and opens only the
blocks that it meets; ``tokens`` inverts the whole matrix.

Texts are encoded with the tokenizers library. A word (between white space) depends on its own characters alone, so equal
words are encoded once and remembered, up to ``KEPT`` of them. Texts of ASCII and U+00C0 to U+00FF, where lower case and
pieces need no tables, have their new words cut by the file's own pattern and go to the library's model together; other
texts, and files with another normaliser, go to the library whole. A null text is empty: it has the end id alone. Null
ids come first; rows of equal id are ordered by a hash of the text. Rows that repeat count each; ids may have any type
that sorts. Other columns are ignored. An empty table writes no file.
"""

from __future__ import annotations

import io
import json
import re
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from proofgrid.llm.common import bounded, chunks, columns, cut, shared_dir

MAGIC = b"PGWM0001"
BLOCK = 1 << 16
#: Words, and pieces of words, that a task remembers (some 200 bytes each).
KEPT = 800_000
END = 2
SHARD_TOKENS = 1 << 24

#: The pieces that the file's pattern cuts from words of ASCII and U+00C0 to U+00FF in lower case.
PIECES = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ÿ]+|[0-9]|\n|[^\na-zß-öø-ÿ0-9]+")
#: The normaliser and cutting that this holds for.
NORMALISER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, str]:
    """How byte-level tokenizers write the bytes that aren't printable Latin-1: from U+0100 on. White space cuts words and
    stays."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(256 + i) for i, b in enumerate(hidden) if b != 32}


class Encoder:
    """Texts to ids, as the library's ``encode`` with ``add_special_tokens=False`` gives them."""

    #: Bytes of texts whose words are cut here; "<|" may begin a special token.
    PLAIN = bytes(range(0x80)) + b"\xc3" + bytes(range(0x80, 0xC0))

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            about = json.load(f)
        self.whole = Tokenizer.from_file(path)
        vocabulary = self.whole.get_vocab()
        self.kind = np.dtype(np.uint16 if max(vocabulary.values()) < (1 << 16) - 1 else np.uint32)  # the last number is no id
        cutting = about["pre_tokenizer"] or {}
        steps = cutting.get("pretokenizers", [{}])
        self.cuts = about["normalizer"] == NORMALISER and [s.get("type") for s in steps] == ["Split", "ByteLevel"] and steps[0]["pattern"].get("Regex") == PATTERN and about["model"].get("end_of_word_suffix") == "</w>"
        self.model = Tokenizer(self.whole.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.letters = _byte_letters()
        self.words: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _learn(self, words: list[bytes]) -> None:
        cuts = PIECES.findall(b"\n".join(words).decode().lower())
        if new := list(set(cuts).difference(self.pieces, "\n")):
            new.sort(key=str.isascii)
            wide = sum(not p.isascii() for p in new)
            text = [" ".join(new[:wide]).encode().decode("latin-1").translate(self.letters), " ".join(new[wide:]).translate(self.letters)]
            ids = np.array(self.model.encode_batch_fast([" ".join(text)], add_special_tokens=False)[0].ids, self.kind)
            edges = [0, *((np.flatnonzero(self.ends[ids]) + 1) * self.kind.itemsize).tolist()]
            if len(edges) != len(new) + 1:
                raise ValueError("a piece of a word isn't one word of the model")
            raw = ids.tobytes()
            self.pieces.update(zip(new, (raw[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)), strict=True))
        mark = np.array(-1).astype(self.kind).tobytes()
        self.pieces["\n"] = mark
        raw = b"".join(map(self.pieces.__getitem__, cuts)) + mark
        edges = ((np.flatnonzero(np.frombuffer(raw, self.kind) == np.frombuffer(mark, self.kind)) + 1) * self.kind.itemsize).tolist()
        self.words.update(zip(words, (raw[a : b - len(mark)] for a, b in zip([0, *edges[:-1]], edges, strict=True)), strict=True))
        if len(self.pieces) > KEPT:
            self.pieces.clear()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text, as little-endian numbers of ``kind``."""
        plain = [self.cuts and not t.translate(None, self.PLAIN) and b"<|" not in t for t in texts]
        split = [t.lower().split() if p else [] for t, p in zip(texts, plain, strict=True)]
        if len(self.words) > KEPT:
            self.words.clear()
        if missing := list(set().union(*split).difference(self.words)):
            self._learn(missing)
        whole = iter([np.array(e.ids, self.kind).tobytes() for e in self.whole.encode_batch_fast([t.decode() for t, p in zip(texts, plain, strict=True) if not p], add_special_tokens=False)])
        get = self.words.__getitem__
        return [b"".join(map(get, s)) if p else next(whole) for s, p in zip(split, plain, strict=True)]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def shard_bytes(ids: np.ndarray, documents: pa.Table) -> bytes:
    """The file of a shard."""
    squeeze = zstandard.ZstdCompressor(level=1)
    seen = np.bincount(ids, minlength=1)  # ids are below a vocabulary's size
    found = np.flatnonzero(seen)
    seen = seen[found]
    alphabet = found[np.lexsort((found, -seen))].astype("<u4")
    levels = max(1, int(len(alphabet) - 1).bit_length())
    place = np.zeros(int(found.max(initial=0)) + 1, np.uint16 if levels <= 16 else np.uint32)
    place[alphabet] = np.arange(len(alphabet))
    now = place[ids]
    sections, blob, at = {}, [], 0

    def put(name: str, data: bytes) -> None:
        nonlocal at
        sections[name] = (at, len(data))
        blob.append(data)
        at += len(data)

    put("alphabet", squeeze.compress(alphabet.tobytes()))
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, documents.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(documents)
    put("documents", sink.getvalue())
    zeros = []
    for level in range(levels - 1, -1, -1):
        ones = ((now >> level) & 1).astype(bool)
        packed = np.packbits(ones, bitorder="little")
        parts = [squeeze.compress(packed[i : i + BLOCK // 8].tobytes()) for i in range(0, len(packed), BLOCK // 8)]
        before = np.cumsum([0, *(np.add.reduceat(np.bitwise_count(packed), range(0, len(packed), BLOCK // 8), dtype=np.int64) if len(packed) else [])], dtype=np.int64)
        offsets = np.cumsum([0, *map(len, parts)])
        put(f"plane{level}", np.concatenate([offsets, before]).astype("<u8").tobytes())
        put(f"bits{level}", b"".join(parts))
        zeros.append(len(ones) - int(before[-1]))
        now = np.concatenate([now[~ones], now[ones]])
    header = json.dumps({"n_tokens": len(ids), "n_docs": documents.num_rows, "levels": levels, "zeros": zeros, "sections": sections}).encode()
    return b"".join([MAGIC, len(header).to_bytes(8, "little"), header, *blob])


class Shard:
    """A shard's file (anything with ``seek`` and ``read``), opened block by block."""

    def __init__(self, file, kept_blocks: int = 256):
        self.file, self.kept, self.cache = file, kept_blocks, OrderedDict()
        file.seek(0)
        if file.read(8) != MAGIC:
            raise ValueError("not a shard of token ids")
        size = int.from_bytes(file.read(8), "little")
        about = json.loads(file.read(size))
        self.base = 16 + size
        self.n_tokens, self.n_docs, self.levels, self.zeros, self.sections = (about[k] for k in ("n_tokens", "n_docs", "levels", "zeros", "sections"))
        self.open = zstandard.ZstdDecompressor()
        self.alphabet = np.frombuffer(self.open.decompress(self._section("alphabet")), "<u4")
        self.planes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.blocks_read = 0

    def _read(self, start: int, size: int) -> bytes:
        self.file.seek(self.base + start)
        return self.file.read(size)

    def _section(self, name: str) -> bytes:
        return self._read(*self.sections[name])

    def documents(self) -> pa.Table:
        return pa.ipc.open_stream(self._section("documents")).read_all()

    def _plane(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        if level not in self.planes:
            both = np.frombuffer(self._section(f"plane{level}"), "<u8").astype(np.int64)
            self.planes[level] = both[: len(both) // 2], both[len(both) // 2 :]
        return self.planes[level]

    def _block(self, level: int, b: int) -> np.ndarray:
        """The bits of a block, one a byte."""
        key = level, b
        if key not in self.cache:
            offsets, _ = self._plane(level)
            raw = self.open.decompress(self._read(self.sections[f"bits{level}"][0] + int(offsets[b]), int(offsets[b + 1] - offsets[b])))
            self.cache[key] = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")
            self.blocks_read += 1
            if len(self.cache) > self.kept:
                self.cache.popitem(last=False)
        self.cache.move_to_end(key)
        return self.cache[key]

    def _ones(self, level: int, at: int) -> int:
        """Ones before a place of a plane."""
        _, before = self._plane(level)
        b, rest = divmod(at, BLOCK)
        return int(before[b]) + (int(np.count_nonzero(self._block(level, b)[:rest])) if rest else 0)

    def _find(self, level: int, bit: int, k: int) -> int:
        """The place of the k-th (from 0) one or zero of a plane."""
        _, before = self._plane(level)
        known = before if bit else np.minimum(np.arange(len(before)) * BLOCK, self.n_tokens) - before
        b = int(np.searchsorted(known, k, side="right")) - 1
        return b * BLOCK + int(np.flatnonzero(self._block(level, b) == bit)[k - int(known[b])])

    def token(self, at: int) -> int:
        """The id at a place."""
        if not 0 <= at < self.n_tokens:
            raise IndexError(at)
        value = 0
        for i, level in enumerate(range(self.levels - 1, -1, -1)):
            bit = int(self._block(level, at // BLOCK)[at % BLOCK])
            ones = self._ones(level, at)
            at = self.zeros[i] + ones if bit else at - ones
            value = value << 1 | bit
        return int(self.alphabet[value])

    def _place(self, token: int) -> int | None:
        found = np.flatnonzero(self.alphabet == token)
        return int(found[0]) if len(found) else None

    def _range(self, value: int, start: int, end: int) -> tuple[int, int]:
        """Where the occurrences of a value in a range stand below the last plane."""
        for i, level in enumerate(range(self.levels - 1, -1, -1)):
            a, b = self._ones(level, start), self._ones(level, end)
            start, end = (self.zeros[i] + a, self.zeros[i] + b) if value >> level & 1 else (start - a, end - b)
        return start, end

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """How often an id occurs in a range of places."""
        value = self._place(token)
        if value is None:
            return 0
        a, b = self._range(value, start, self.n_tokens if end is None else end)
        return b - a

    def find(self, token: int, start: int = 0, end: int | None = None) -> list[int]:
        """The places of an id in a range, ascending."""
        value = self._place(token)
        if value is None:
            return []
        a, b = self._range(value, start, self.n_tokens if end is None else end)
        return [self._up(value, k) for k in range(a, b)]

    def _up(self, value: int, at: int) -> int:
        """The place of what stands at ``at`` below the last plane."""
        for level in range(self.levels):
            bit, zeros = value >> level & 1, self.zeros[self.levels - 1 - level]
            at = self._find(level, bit, at - zeros if bit else at)
        return at

    def tokens(self) -> np.ndarray:
        """All ids, by inverting the planes from the lowest."""
        now = np.zeros(self.n_tokens, np.uint16 if self.levels <= 16 else np.uint32)
        for level in range(self.levels):
            offsets, _ = self._plane(level)
            raw = self._section(f"bits{level}")
            packed = b"".join(self.open.decompress(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True))
            ones = np.unpackbits(np.frombuffer(packed, np.uint8), count=self.n_tokens, bitorder="little").astype(bool)
            zeros, up = self.zeros[self.levels - 1 - level], np.empty_like(now)
            up[~ones] = now[:zeros]
            up[ones] = now[zeros:] | now.dtype.type(1 << level)
            now = up
        return self.alphabet[now] if self.n_tokens else np.zeros(0, np.uint32)


def _store(folder: str):
    store, path = fs.FileSystem.from_uri(folder)
    return store, path.rstrip("/")


def _writer(folder: str, model: str, end: int, shard_tokens: int, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, enc = TaskContext.get(), encoder(model)
        part, mark = context.partitionId(), np.array([end], enc.kind).tobytes()
        store, path = _store(folder)
        held: list[bytes] = []
        ids: list[pa.Array] = []
        n = place = 0

        def flush() -> pa.RecordBatch:
            sizes = np.array([len(h) // enc.kind.itemsize for h in held], np.int64)
            documents = pa.table({"id": pa.chunked_array(ids), "n_tokens": pa.array(sizes)})
            data = shard_bytes(np.frombuffer(b"".join(held), enc.kind), documents)
            name = f"{path}/shard-{part:06d}-{place:06d}.wvm"
            own = f"{name}.{context.taskAttemptId()}"
            store.create_dir(path, recursive=True)
            with store.open_output_stream(own) as f:
                f.write(data)
            store.move(own, name)  # a repeated task writes the same bytes
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([place], pa.int32()), pa.array([name]), pa.array([len(held)], pa.int64()), pa.array([int(sizes.sum())], pa.int64()), pa.array([len(data)], pa.int64())], ["part", "place", "name", "n_docs", "n_tokens", "n_bytes"])

        for piece, texts in chunks(batches):
            coded = [c + mark for c in enc.encode([t or b"" for t in texts])]
            own_ids, first = columns(piece, "id").cast(id_type), 0
            for i, c in enumerate(coded):
                held.append(c)
                n += len(c) // enc.kind.itemsize
                if n >= shard_tokens:
                    ids.append(own_ids.slice(first, i + 1 - first))
                    yield flush()
                    held, ids, n, place, first = [], [], 0, place + 1, i + 1
            if first < len(coded):
                ids.append(own_ids.slice(first))
        if held:
            yield flush()

    return run


def write_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, end: int = END, shard_tokens: int = SHARD_TOKENS, folder: str | None = None) -> DataFrame:
    """Writes the shards to ``folder`` (a new one in the shared folder) and returns one row a shard: (folder, part, place,
    name, n_docs, n_tokens, n_bytes, start), start being the number of ids in all shards before it."""
    spark = bounded(docs.sparkSession)
    folder = folder or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).select("*", F.xxhash64("text").alias("_mark"), F.monotonically_increasing_id().alias("_row"))
    ranged = rows.repartitionByRange("id", "_mark", "_row").sortWithinPartitions("id", "_mark", "_row").select("id", "text")
    id_type = to_arrow_type(ranged.schema["id"].dataType)
    made = cut(ranged.mapInArrow(_writer(folder, model or tokenizer_file(), end, shard_tokens, id_type), "part int, place int, name string, n_docs bigint, n_tokens bigint, n_bytes bigint"), "shards")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    parts = made.groupBy("part").agg(F.sum("n_tokens").alias("own")).select("part", F.coalesce(F.sum("own").over(earlier), F.lit(0)).alias("before"))
    inside = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return made.withColumn("inside", inside).join(parts, "part").select(F.lit(folder).alias("folder"), *made.columns, (F.col("before") + F.col("inside")).alias("start"))


def _each_shard(read):
    """``read`` (shard, start) -> batch over the files of a table of shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                store, _ = _store(r["folder"])
                with store.open_input_file(r["name"]) as f:
                    yield from read(Shard(f), r["start"])

    return run


def _spread(shards: DataFrame) -> DataFrame:
    """The shards, dealt over tasks (by number, as their rows are too small to be dealt by size)."""
    tasks = int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return shards.repartition(tasks, "part", "place").select("folder", "name", "start")


def _checked(shard: Shard, start: int) -> Iterator[pa.RecordBatch]:
    docs, ids = shard.documents(), shard.tokens().astype("<u4")
    sizes = docs.column("n_tokens").to_numpy()
    ends = np.cumsum(sizes)
    raw = memoryview(ids).cast("B")
    crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
    yield from pa.table({"doc_id": docs.column("id"), "start": pa.array(start + ends - sizes), "n_tokens": pa.array(sizes), "ids_crc32": pa.array(crc, pa.int64())}).to_batches(10_000)


def _id_kind(docs: DataFrame, id_col: str) -> str:
    return docs.schema[id_col].dataType.simpleString()


def documents(shards: DataFrame, id_kind: str = "bigint") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""
    return _spread(shards).mapInArrow(_each_shard(_checked), f"doc_id {id_kind}, start bigint, n_tokens bigint, ids_crc32 bigint")


def occurrences(shards: DataFrame, token: int, id_kind: str = "bigint") -> DataFrame:
    """(doc_id, start, place): where an id occurs; start is its document's, place counts from there. By rank and select."""

    def read(shard: Shard, start: int) -> Iterator[pa.RecordBatch]:
        docs = shard.documents()
        begins = np.cumsum(docs.column("n_tokens").to_numpy()) - docs.column("n_tokens").to_numpy()
        found = np.array(shard.find(token), np.int64)
        own = np.searchsorted(begins, found, side="right") - 1
        yield from pa.table({"doc_id": docs.column("id").take(pa.array(own)), "start": pa.array(start + begins[own]), "place": pa.array(found - begins[own])}).to_batches(10_000)

    return _spread(shards).mapInArrow(_each_shard(read), f"doc_id {id_kind}, start bigint, place bigint")


def counts(shards: DataFrame, tokens: list[int]) -> DataFrame:
    """(token, n): how often each of a few ids occurs in all shards, by rank."""

    def read(shard: Shard, start: int) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.int64()), pa.array([shard.count(t) for t in tokens], pa.int64())], ["token", "n"])

    return _spread(shards).mapInArrow(_each_shard(read), "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Writes the shards of ``docs`` and reads every document back."""
    return documents(write_shards(docs, id_col, text_col, **options), _id_kind(docs, id_col))
