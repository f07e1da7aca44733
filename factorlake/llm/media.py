"""Media columns: payloads stored as PNG members of archives, read back by byte range.

`MediaArchive` is a Spark data source of its own. Writing puts one PNG per row
into ZIP archives of about 32 MB in one folder; a task writes under a name of
its own and the commit renames what succeeded, so lost executors and repeated
tasks leave nothing behind. Reading plans partitions as (archive, first byte,
end byte); a partition serves the members whose header starts in its range,
finds them in the archive's directory, and streams them in Arrow batches. A
member that fails is read again on its own, by its offset, with a new handle;
after the last attempt its row says what failed and the other members go on.

A payload is 8-bit grey samples, 192 to a row, so the PNG is lossless for any
bytes; the unpadded size is kept in a text chunk. Equal texts give equal files.

Edge cases: null text is empty (one row of blanks); a null doc_id stays null;
repeated rows are members of their own; an empty table gives an empty folder
and no rows.
"""

from __future__ import annotations

import posixpath
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from factorlake.llm import session

WIDTH = 192
ARCHIVE_BYTES = 32 << 20
RANGE_BYTES = 8 << 20
ATTEMPTS = 3
BATCH_BYTES = 4 << 20
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
SCHEMA = "doc_id long, n_bytes long, payload binary, media binary, error string"


def padded(raw: bytes) -> bytes:
    return raw + b" " * ((-len(raw)) % WIDTH if raw else WIDTH)


def to_png(raw: bytes) -> bytes:
    """The padded bytes as an 8-bit greyscale image, with the unpadded size in a text chunk."""
    body = np.frombuffer(padded(raw), np.uint8).reshape(-1, WIDTH)
    rows = np.zeros((len(body), WIDTH + 1), np.uint8)  # filter 0 before each row
    rows[:, 1:] = body

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", WIDTH, len(body), 8, 0, 0, 0, 0)
    return _SIGNATURE + chunk(b"IHDR", head) + chunk(b"tEXt", b"Size\0%d" % len(raw)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + chunk(b"IEND", b"")


def from_png(data: bytes) -> tuple[bytes, int]:
    """(samples, unpadded size) of what to_png makes; raises ValueError for anything else."""
    if data[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at, size, packed, width = 8, None, b"", 0
    while at < len(data):
        (n,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise ValueError("a chunk's checksum differs")
        if kind == b"IHDR":
            width = struct.unpack_from(">I", body)[0]
        elif kind == b"tEXt" and body.startswith(b"Size\0"):
            size = int(body[5:])
        elif kind == b"IDAT":
            packed += body
        at += 12 + n
    if size is None or width != WIDTH:
        raise ValueError("not an image of this source")
    rows = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(-1, WIDTH + 1)
    if rows[:, 0].any():
        raise ValueError("a row is filtered")
    return rows[:, 1:].tobytes(), size


def feature(payload: bytes) -> str:
    """mean, standard deviation, zero-run share and a 16-bin histogram of the samples, in fixed digits."""
    x = np.frombuffer(payload, np.uint8)
    bins = np.bincount(x >> 4, minlength=16)
    mean = int(x.sum(dtype=np.int64)) / len(x)
    var = int((x.astype(np.int64) ** 2).sum()) / len(x) - mean * mean
    same = int((x[1:] == x[:-1]).sum()) / (len(x) - 1)
    return f"{mean:.4f};{max(var, 0.0) ** 0.5:.4f};{same:.4f};" + ",".join(map(str, bins.tolist()))


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


@dataclass
class Range(InputPartition):
    archive: str
    start: int
    end: int


class ArchiveWriter(DataSourceArrowWriter):
    """Writes (doc_id, text) rows; each task its own archives, made visible by the commit."""

    def __init__(self, path: str, limit: int):
        self.path, self.limit = path, limit

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        fs, root = open_fs(self.path)
        fs.create_dir(posixpath.join(root, "_open"), recursive=True)
        names: list[str] = []
        out = archive = None
        held = count = 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                if archive is None:
                    names.append(f"{uuid.uuid4().hex}.zip")
                    out = fs.open_output_stream(posixpath.join(root, "_open", names[-1]))
                    archive, held, count = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED), 0, 0
                media = to_png((text.as_py() or "").encode())
                archive.writestr(zipfile.ZipInfo(f"{count:08d}_{'' if doc_id is None else doc_id}.png"), media)
                held, count = held + len(media), count + 1
                if held >= self.limit:
                    archive.close()
                    out.close()
                    archive = None
        if archive is not None:
            archive.close()
            out.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = open_fs(self.path)
        fs.create_dir(root, recursive=True)
        for m in messages:
            for name in m.names if m else ():
                fs.move(posixpath.join(root, "_open", name), posixpath.join(root, name))
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = open_fs(self.path)
        part = posixpath.join(root, "_open")
        if fs.get_file_info(part).type == pafs.FileType.Directory:
            fs.delete_dir(part)


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, size: int, attempts: int):
        self.path, self.size, self.attempts = path, size, attempts

    def partitions(self) -> list[Range]:
        fs, root = open_fs(self.path)
        found = [f for f in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)) if f.path.endswith(".zip")]
        ranges = [Range(f.path, a, min(a + self.size, f.size)) for f in sorted(found, key=lambda f: f.path) for a in range(0, f.size, self.size)]
        return ranges or [Range("", 0, 0)]

    def _member(self, fs: pafs.FileSystem, archive: str, info: zipfile.ZipInfo) -> bytes:
        """One member's stored bytes by its offset, checked."""
        with fs.open_input_file(archive) as f:
            return self._at(f, info)

    @staticmethod
    def _at(f: pa.NativeFile, info: zipfile.ZipInfo) -> bytes:
        f.seek(info.header_offset)
        head = f.read(30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError("no member starts there")
        name, extra = struct.unpack_from("<HH", head, 26)
        f.seek(info.header_offset + 30 + name + extra)
        data = f.read(info.compress_size)
        if len(data) != info.compress_size or zlib.crc32(data) != info.CRC:
            raise ValueError("a member's checksum differs")
        return data

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        fs, _ = open_fs(self.path)
        rows: list[tuple] = []
        held = 0
        with fs.open_input_file(partition.archive) as f:
            members = [m for m in zipfile.ZipFile(f).infolist() if partition.start <= m.header_offset < partition.end]
            for m in members:
                error = None
                for attempt in range(self.attempts):
                    try:
                        media = self._at(f, m) if attempt == 0 else self._member(fs, partition.archive, m)
                        payload, size = from_png(media)
                        error = None
                        break
                    except (OSError, ValueError, zlib.error, struct.error) as e:
                        error, media, payload, size = f"{type(e).__name__}: {e}", None, None, None
                label = m.filename.rpartition("_")[2].removesuffix(".png")
                rows.append((int(label) if label else None, size, payload, media, error))
                held += len(payload or b"") + len(media or b"")
                if held >= BATCH_BYTES:
                    yield self._batch(rows)
                    rows, held = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "n_bytes", "payload", "media", "error"])


class MediaArchive(DataSource):
    """spark.read/write.format("media_archive"); options path, archive_bytes, range_bytes, attempts."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"], int(self.options.get("range_bytes", RANGE_BYTES)), int(self.options.get("attempts", ATTEMPTS)))

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"], int(self.options.get("archive_bytes", ARCHIVE_BYTES)))


def store(docs: DataFrame, path: str, **options) -> None:
    """Writes doc_id and text of docs as an archive folder."""
    docs.sparkSession.dataSource.register(MediaArchive)
    docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").write.format("media_archive").mode("append").options(**options).option("path", path).save()


def load(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").options(**options).option("path", path).load()


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [feature(p.as_buffer().to_pybytes()) if p.is_valid else None for p in batch.column("payload")]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], names=[*batch.schema.names, "feature"])


def with_features(media: DataFrame) -> DataFrame:
    return media.mapInArrow(_features, f"{SCHEMA}, feature string")


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = session.fresh_dir(spark, "media")
    store(session.table(spark, sf_dir, "documents"), path)
    p = F.col("payload")
    return with_features(load(spark, path)).select(
        "doc_id", "n_bytes", F.octet_length(p).cast("long").alias("payload_bytes"), F.sha2(p, 256).alias("payload_sha256"),
        F.crc32(F.substring(p, -16, 16)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature", "error",
    )
