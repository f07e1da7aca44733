import hashlib
import zlib

from factorlake.llm import media


def test_png_holds_any_bytes():
    for raw in (b"", b"x", bytes(range(256)) * 5, b" " * 192, b"a" * 193):
        payload, size = media.from_png(media.to_png(raw))
        assert size == len(raw) and payload == raw + b" " * (len(payload) - size)
        assert len(payload) % 192 == 0 and 0 < len(payload) < len(raw) + 193


def rows():
    return [(1, "abc", 5), (2, None, 5), (3, "", 5), (None, "日本" * 300, 5), (5, "x" * 192, 5), (1, "abc", 6), *((100 + k, f"text {k} " * k, 0) for k in range(60))]


def test_query_equals_brute_force(spark, tmp_path):
    spark.createDataFrame(rows(), "doc_id long, text string, payload int").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r)[:5] for r in media.op2_media_columns(spark, str(tmp_path)).collect()), key=str)
    want = []
    for d, t, _ in rows():
        raw = (t or "").encode()
        p = raw + b" " * ((-len(raw)) % 192 if raw else 192)
        want.append((d, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])))
    assert got == sorted(want, key=str)


def test_ranges_cover_each_member_once(spark, tmp_path):
    df = spark.createDataFrame(rows(), "doc_id long, text string, payload int")
    media.store(df.coalesce(2), str(tmp_path / "m"), archive_bytes=4000)
    got = media.load(spark, str(tmp_path / "m"), range_bytes=700)
    assert got.count() == len(rows()) and got.filter("error is not null").count() == 0


def test_a_damaged_member_fails_alone(spark, tmp_path):
    df = spark.createDataFrame(rows(), "doc_id long, text string, payload int")
    media.store(df.coalesce(1), str(tmp_path / "m"))
    (archive,) = (tmp_path / "m").glob("*.zip")
    raw = bytearray(archive.read_bytes())
    at = raw.find(b"IDAT", len(raw) // 2)
    raw[at + 8] ^= 255
    archive.write_bytes(bytes(raw))
    got = media.load(spark, str(tmp_path / "m")).collect()
    assert len(got) == len(rows()) and sum(r.error is not None for r in got) == 1


def test_empty_table(spark, tmp_path):
    media.store(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "m"))
    assert media.with_features(media.load(spark, str(tmp_path / "m"))).count() == 0


class Flaky(media.ArchiveReader):
    """Each member's first attempt fails."""

    def __init__(self, *args):
        super().__init__(*args)
        self.seen = set()

    def _at(self, f, info):
        if info.filename not in self.seen:
            self.seen.add(info.filename)
            raise OSError("the connection was lost")
        return media.ArchiveReader._at(f, info)


def test_a_member_that_fails_once_is_read_again(spark, tmp_path):
    media.store(spark.createDataFrame(rows(), "doc_id long, text string, payload int").coalesce(1), str(tmp_path / "m"))
    reader = Flaky(str(tmp_path / "m"), 1 << 20, 3)
    got = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert len(got) == len(rows()) and all(r["error"] is None for r in got)
    once = Flaky(str(tmp_path / "m"), 1 << 20, 1)
    lost = [r for p in once.partitions() for b in once.read(p) for r in b.to_pylist()]
    assert all("connection was lost" in r["error"] for r in lost)


def test_every_column_of_the_query(spark, tmp_path):
    spark.createDataFrame(rows(), "doc_id long, text string, payload int").write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for _, t, _ in rows():
        png = media.to_png((t or "").encode())
        payload, _ = media.from_png(png)
        want[hashlib.sha256(payload).hexdigest()] = (len(png), hashlib.sha256(png).hexdigest(), media.feature(payload), None)
    for r in media.op2_media_columns(spark, str(tmp_path)).collect():
        assert want[r.payload_sha256] == (r.media_bytes, r.media_sha256, r.feature, r.error)
