"""Token ids as binary files: independent zstandard frames, a trailing seek table, a checksum for each frame.

`TokenFiles` is a Spark data source. A file holds the ids of consecutive
documents as little-endian unsigned 32-bit integers in zstandard frames that
know nothing of each other, then a skippable frame with the documents' index
(doc_ids and numbers of ids), then the seek table, a skippable frame too, in the
public seekable layout: compressed size, decompressed size and the low 32 bits of the
data's XXH64 for each frame. Plain zstandard tools read the ids of a whole file.
A frame ends before a document that would overfill it; a document longer than a
frame is cut over frames of its own.

Documents are dealt to ranges of doc_id, sorted there and encoded by the task
that writes them, a batch at a time. Files are written under names of their own;
the commit puts them in order, adds up their ids and writes a manifest, which alone
makes them part of the output, so lost executors and repeated tasks leave
nothing that a reader would see. The manifest has one line a file.

Reading plans ranges of ids within files. Filters on doc_id are pushed down
where spark.sql.python.filterPushdown.enabled says so: they rule out files by the manifest and documents by the index, and only frames of
documents that are asked for are read, decompressed and checked.

Encoding: white space never belongs to a token of this vocabulary, so stretches
between white space are encoded on their own. Texts of Latin letters, digits and
ASCII signs are cut into the pre-tokenizer's pieces here, and the library's model
merges a piece that a bounded table doesn't know; of other texts the words with
anything else, or with a special token's opening, go through the whole library as
they are.

Edge cases: null text is empty and has the end id alone; null doc_ids come
last; rows of one doc_id are documents of their own, in the order of their texts' hashes and texts;
long texts are encoded whole; an empty table gives no file and no rows; extra
columns are not read.
"""

from __future__ import annotations

import json
import posixpath
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from factorlake.llm import session
from factorlake.llm.media import open_fs

TOKENIZER = "word_bpe_49k.json"
END = 2
FRAME_BYTES = 128 << 10
FILE_BYTES = 256 << 20
RANGE_BYTES = 16 << 20
BATCH_BYTES = 4 << 20
PIECES_KEPT = 300_000
SCHEMA = "doc_id long, start long, n_tokens long, ids binary"
MANIFEST = "manifest.jsonl"
# Fixed values of the public seekable format, and the index's magic number, one of those left to users.
SEEK_MAGIC, FOOTER_MAGIC, CHECKSUMS, INDEX_MAGIC = 0x184D2A5E, 0x8F92EAB1, 0x80, 0x184D2A53
# Letters that normalise to themselves and whose small letters are single characters: what words in Latin script are made of.
_LATIN = "a-z\u00df-\u00f6\u00f8-\u00ff\u0101-\u012f\u0131-\u0148\u014a-\u017e"
# The tokenizer's own pre-tokenizer pattern, for small letters of these, digits and ASCII signs.
_PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LATIN}]+|[0-9]|[!-/:-@\[-`{{-~]+")
_PLAIN = re.compile(rf"[\t-\r -~{_LATIN}\u00c0-\u00d6\u00d8-\u00de\u0100-\u012f]*")
_SPACE = re.compile(rb"[\t-\r ]")


def _byte_signs() -> dict[int, str]:
    """The public byte-level alphabet: printable Latin-1 stands for itself, other bytes for the code points from 256 on."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in own)}


class PieceIds(dict):
    """A text's piece -> its ids as little-endian 32-bit bytes, by the library's model; of two generations the older is given up when the newer is full."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.model = self.tokenizer.model
        self.signs = _byte_signs()
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        found = self.older.get(piece)
        if found is None:
            signs = piece if piece.isascii() else "".join(self.signs[b] for b in piece.encode())
            found = struct.pack(f"<{len(ids := [t.id for t in self.model.tokenize(signs)])}I", *ids)
        if len(piece) <= 64:
            if len(self) >= PIECES_KEPT:
                self.older = dict(self)
                self.clear()
            self[piece] = found
        return found

    def _encoded(self, text: str) -> bytes:
        if _PLAIN.fullmatch(text) and "<|" not in text and "\u0130" not in text:
            return b"".join(map(self.__getitem__, _PIECE.findall(text.lower())))
        words = [w.decode() for w in text.encode().split()]
        if len(words) > 1:
            return b"".join(map(self._encoded, words))
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def text(self, raw: bytes, step: int = 1 << 20) -> bytes:
        """The ids of a whole text, in stretches that end before white space."""
        out, at = [], 0
        while len(raw) - at > step and (m := _SPACE.search(raw, at + step)):
            out.append(self._encoded(raw[at : m.start()].decode()))
            at = m.start()
        out.append(self._encoded(raw[at:].decode()))
        return b"".join(out)


@lru_cache(maxsize=1)
def piece_ids(path: str) -> PieceIds:
    """One table for each Python worker."""
    return PieceIds(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def _low64(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


class FileWriter:
    """One file of frames, index and seek table."""

    def __init__(self, out: pa.NativeFile, frame_bytes: int):
        self.out, self.frame_bytes = out, frame_bytes
        self.pack = zstandard.ZstdCompressor(level=3, write_content_size=True, write_checksum=False)
        self.held: list[bytes] = []
        self.size = self.written = 0
        self.entries: list[tuple[int, int, int]] = []
        self.doc_ids: list[int | None] = []
        self.counts: list[int] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.doc_ids.append(doc_id)
        self.counts.append(len(ids) // 4)
        if self.size + len(ids) > self.frame_bytes:
            self._flush()
        for at in range(0, len(ids), self.frame_bytes):
            self.held.append(ids[at : at + self.frame_bytes])
            self.size += len(self.held[-1])
            if self.size >= self.frame_bytes:
                self._flush()

    def _flush(self) -> None:
        if self.size:
            data = b"".join(self.held)
            packed = self.pack.compress(data)
            self.out.write(packed)
            self.entries.append((len(packed), len(data), _low64(data)))
            self.written += len(data)
            self.held, self.size = [], 0

    def close(self) -> dict:
        """Ends the file; what the manifest says of it."""
        self._flush()
        known = np.array([d is not None for d in self.doc_ids], np.uint8)
        ids = np.array([0 if d is None else d for d in self.doc_ids], "<i8")
        index = struct.pack("<Q", len(ids)) + self.pack.compress(ids.tobytes() + np.array(self.counts, "<i8").tobytes() + known.tobytes())
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        self.entries.append((8 + len(index), 0, _low64(index)))
        table = b"".join(struct.pack("<III", *e) for e in self.entries) + struct.pack("<IBI", len(self.entries), CHECKSUMS, FOOTER_MAGIC)
        self.out.write(struct.pack("<II", SEEK_MAGIC, len(table)) + table)
        self.out.close()
        named = [d for d in self.doc_ids if d is not None]
        return {"docs": len(self.doc_ids), "ids": self.written // 4, "least": min(named, default=None), "most": max(named, default=None)}


class FileReader:
    """Random access to one file's documents by its seek table and index."""

    def __init__(self, f: pa.NativeFile):
        self.f, size = f, f.size()
        f.seek(size - 9)
        frames, descriptor, magic = struct.unpack("<IBI", f.read(9))
        if magic != FOOTER_MAGIC or descriptor != CHECKSUMS:
            raise ValueError("no seek table at the file's end")
        f.seek(size - 17 - 12 * frames)
        if struct.unpack("<II", f.read(8)) != (SEEK_MAGIC, 12 * frames + 9):
            raise ValueError("the seek table has another size")
        packed, plain, self.sums = np.frombuffer(f.read(12 * frames), "<u4").reshape(-1, 3).T
        self.at = np.append(0, np.cumsum(packed.astype(np.int64)))
        self.starts = np.append(0, np.cumsum(plain.astype(np.int64)))[:-1]  # of the frames' data; the last is the index
        self.unpack = zstandard.ZstdDecompressor()
        self.frames_read = 0
        f.seek(int(self.at[-2]))
        head, index = f.read(8), f.read(int(packed[-1]) - 8)
        if struct.unpack("<II", head)[0] != INDEX_MAGIC or _low64(index) != self.sums[-1]:
            raise ValueError("the index's checksum differs")
        (n,) = struct.unpack_from("<Q", index)
        data = self.unpack.decompress(index[8:])
        self.doc_ids, self.counts = np.frombuffer(data, "<i8", n), np.frombuffer(data, "<i8", n, 8 * n)
        self.known = np.frombuffer(data, np.uint8, n, 16 * n).astype(bool)
        self.first = np.cumsum(self.counts) - self.counts  # each document's start, in ids
        self._held: tuple[int, bytes] = (-1, b"")

    def _frame(self, k: int) -> bytes:
        if self._held[0] != k:
            self.f.seek(int(self.at[k]))
            try:
                data = self.unpack.decompress(self.f.read(int(self.at[k + 1] - self.at[k])))
            except zstandard.ZstdError as e:
                raise ValueError(f"frame {k}: {e}") from None
            if _low64(data) != self.sums[k]:
                raise ValueError(f"frame {k}: the checksum differs")
            self.frames_read += 1
            self._held = (k, data)
        return self._held[1]

    def ids(self, doc: int) -> bytes:
        """The doc-th document's ids, from its own frames only."""
        a = 4 * int(self.first[doc])
        b = a + 4 * int(self.counts[doc])
        last = len(self.starts) - 1
        k = int(np.searchsorted(self.starts[:last], a, side="right")) - 1
        parts = []
        while a < b:
            data, base = self._frame(k), int(self.starts[k])
            parts.append(data[a - base : b - base])
            a, k = base + len(data), k + 1
        return b"".join(parts)


@dataclass
class Written(WriterCommitMessage):
    files: list[dict]


@dataclass
class Span(InputPartition):
    """Documents of one file whose first id is in [start, end) of it; base: ids before the file."""

    name: str
    base: int
    start: int
    end: int


class TokenWriter(DataSourceArrowWriter):
    """Takes (doc_id, text) in order within a task; tasks are in order of their partitions."""

    def __init__(self, path: str, tokenizer: str, end: int, frame_bytes: int, file_bytes: int):
        self.path, self.tokenizer, self.end, self.frame_bytes, self.file_bytes = path, tokenizer, end, frame_bytes, file_bytes

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        fs, root = open_fs(self.path)
        fs.create_dir(root, recursive=True)
        ids, end, pid = piece_ids(self.tokenizer), struct.pack("<I", self.end), TaskContext.get().partitionId()
        files: list[dict] = []
        now: FileWriter | None = None
        for batch in batches:
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary())):
                if now is None:
                    files.append({"name": f"{uuid.uuid4().hex}.tok.zst", "task": pid})
                    now = FileWriter(fs.open_output_stream(posixpath.join(root, files[-1]["name"]), compression=None), self.frame_bytes)
                now.add(doc_id, ids.text(raw.as_py() or b"") + end)
                if now.written >= self.file_bytes:
                    files[-1] |= now.close()
                    now = None
        if now is not None:
            files[-1] |= now.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = open_fs(self.path)
        fs.create_dir(root, recursive=True)
        base, lines = 0, []
        for f in sorted((f for m in messages if m for f in m.files), key=lambda f: f["task"]):  # a task's files stay in order
            lines.append(json.dumps(f | {"base": base}))
            base += f["ids"]
        with fs.open_output_stream(posixpath.join(root, "_" + MANIFEST)) as out:
            out.write("\n".join(lines).encode())
        fs.move(posixpath.join(root, "_" + MANIFEST), posixpath.join(root, MANIFEST))

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = open_fs(self.path)
        for m in messages:
            for f in m.files if m else ():
                path = posixpath.join(root, f["name"])
                if fs.get_file_info(path).type == pafs.FileType.File:
                    fs.delete_file(path)


class TokenReader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int):
        self.path, self.range_ids = path, max(1, range_bytes // 4)
        self.wanted: set[int] | None = None
        self.low, self.high = -(2**63), 2**63 - 1
        self.asked = False

    def partitions(self) -> list[Span]:
        fs, root = open_fs(self.path)
        with fs.open_input_file(posixpath.join(root, MANIFEST)) as f:
            files = [json.loads(line) for line in f.read().decode().split("\n") if line]
        if self.asked:
            files = [f for f in files if f["least"] is not None and f["least"] <= self.high and f["most"] >= self.low and (self.wanted is None or any(f["least"] <= w <= f["most"] for w in self.wanted))]
        spans = [Span(f["name"], f["base"], a, a + self.range_ids) for f in files for a in range(0, max(1, f["ids"]), self.range_ids)]
        return spans or [Span("", 0, 0, 0)]

    def _chosen(self, f: FileReader, span: Span) -> np.ndarray:
        take = (f.first >= span.start) & (f.first < span.end)
        if self.asked:
            take &= f.known & (f.doc_ids >= self.low) & (f.doc_ids <= self.high)
            if self.wanted is not None:
                take &= np.isin(f.doc_ids, np.fromiter(self.wanted, np.int64, len(self.wanted)))
        return np.flatnonzero(take)

    def read(self, span: Span) -> Iterator[pa.RecordBatch]:
        if not span.name:
            return
        fs, root = open_fs(self.path)
        with fs.open_input_file(posixpath.join(root, span.name)) as handle:
            f = FileReader(handle)
            rows: list[tuple] = []
            held = 0
            for k in self._chosen(f, span).tolist():
                ids = f.ids(k)
                rows.append((int(f.doc_ids[k]) if f.known[k] else None, span.base + int(f.first[k]), int(f.counts[k]), ids))
                held += len(ids) + 64
                if held >= BATCH_BYTES:
                    yield self._batch(rows)
                    rows, held = [], 0
            if rows:
                yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "start", "n_tokens", "ids"])


class PushedTokenReader(TokenReader):
    """For sessions that push filters down to Python sources."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes comparisons of doc_id; the others stay with Spark."""
        for f in filters:
            if getattr(f, "attribute", None) != ("doc_id",) or not isinstance(f, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                yield f
                continue
            self.asked = True
            if isinstance(f, EqualTo):
                self._only({f.value})
            elif isinstance(f, In):
                self._only({v for v in f.value if v is not None})
            elif isinstance(f, GreaterThan):
                self.low = max(self.low, f.value + 1)
            elif isinstance(f, GreaterThanOrEqual):
                self.low = max(self.low, f.value)
            elif isinstance(f, LessThan):
                self.high = min(self.high, f.value - 1)
            else:
                self.high = min(self.high, f.value)

    def _only(self, ids: set[int]) -> None:
        self.wanted = ids if self.wanted is None else self.wanted & ids


class TokenFiles(DataSource):
    """spark.read/write.format("token_files"); options path, tokenizer, end_id, frame_bytes, file_bytes, range_bytes, pushdown. Writing takes (doc_id, text)."""

    @classmethod
    def name(cls) -> str:
        return "token_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TokenReader:
        kind = PushedTokenReader if self.options.get("pushdown") == "true" else TokenReader
        return kind(self.options["path"], int(self.options.get("range_bytes", RANGE_BYTES)))

    def writer(self, schema, overwrite: bool) -> TokenWriter:
        size = lambda key, least, default: max(least, int(self.options.get(key, default)) // 4 * 4)
        return TokenWriter(self.options["path"], self.options.get("tokenizer") or default_tokenizer(), int(self.options.get("end_id", END)), size("frame_bytes", 4, FRAME_BYTES), size("file_bytes", 4, FILE_BYTES))


def store(docs: DataFrame, path: str, **options) -> None:
    """Writes the ids of (doc_id, text) in ascending order of doc_id into a new folder."""
    docs.sparkSession.dataSource.register(TokenFiles)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # The row's number splits rows that agree in all else, whose order is open.
    rows = rows.withColumns({"__none": F.col("doc_id").isNull(), "__hash": F.xxhash64("text"), "__row": F.monotonically_increasing_id()})
    keys = ["__none", "doc_id", "__hash", "__row"]
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions("__none", "doc_id", "__hash", "text")
    ordered.select("doc_id", "text").write.format("token_files").mode("append").options(**options).option("path", path).save()


def load(spark: SparkSession, path: str, **options) -> DataFrame:
    """(doc_id, start, n_tokens, ids): start counts the ids of all documents before; ids are little-endian unsigned 32-bit integers."""
    spark.dataSource.register(TokenFiles)
    # A reader that takes filters is refused where the session doesn't push any.
    pushdown = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("token_files").options(pushdown=pushdown, **options).option("path", path).load()


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = session.fresh_dir(spark, "tokens")
    store(session.table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return load(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
