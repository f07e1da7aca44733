import json
import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from tokenizers import Tokenizer

from factorlake.llm import token_files

FIELDS = "doc_id long, text string"


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(token_files.default_tokenizer())
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 2]


def rows():
    r = random.Random(3)
    made = [(k, " ".join(r.choice(["alpha", "Beta's", "x1y2", "über", "日本語", "don't", "--"]) for _ in range(k % 40))) for k in range(150)]
    r.shuffle(made)
    return [*made, (500, None), (501, ""), (502, " \n\t"), (503, "long Text 42 " * 30_000), (504, "<|endoftext|>a<|STARTOFTEXT|>b<|startoftext|>"), (3, "again"), (3, "again"), (None, "no id"), (-5, "below zero")]


def ordered(given):
    return sorted(given, key=lambda x: (x[0] is None, x[0] or 0))


def test_words_make_the_ids_of_whole_texts(library):
    r = random.Random(5)
    signs = [*"abcXYZ019'#$<|>_-. \t\n\r\x0b\x0c\x00\x1c\x1f\x7f", "'s", "'LL", "'re", "<|endoftext|>", "<|", "é", "É", "H̱", "́", "İ", "Σ", "ς", " ", "\u0085", " ", "　", "ß", "日", "本", "​", "😀", "ﬁ", "½", "٣", *"ÀÖ×ØÞßàö÷øÿĀĭĮįıĲŉĿŸžſ", "Straße", "ÉCOLE", "naïve", "\u0307"]
    words = token_files.piece_ids(token_files.default_tokenizer())
    for _ in range(20000):
        text = "".join(r.choices(signs, k=r.randrange(24)))
        assert np.frombuffer(words.text(text.encode(), r.choice([3, 1000])), "<u4").tolist() == library(text)[:-1], repr(text)


def test_query_equals_the_library(spark, tmp_path, library):
    given = rows()
    spark.createDataFrame([(*r, "x", 1) for r in given], FIELDS + ", ids string, start int").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, token_files.op13_token_files(spark, str(tmp_path)).collect()), key=lambda x: x[1])
    assert [g[0] for g in got] == [d for d, _ in ordered(given)]
    want = {}
    for d, t in given:
        ids = library(t)
        want.setdefault(d, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    at = 0
    for doc_id, start, n, crc in got:
        assert start == at
        want[doc_id].remove((n, crc))
        at += n


def test_one_document_reads_its_own_frames_only(spark, tmp_path, library):
    given = [(k, f"text {k} " * 50) for k in range(400)]
    folder = str(tmp_path / "t")
    token_files.store(spark.createDataFrame(given, FIELDS), folder, frame_bytes=4000, file_bytes=30_000)
    names = [json.loads(x) for x in (tmp_path / "t" / token_files.MANIFEST).read_text().split("\n")]
    assert len(names) > 4 and sum(n["docs"] for n in names) == 400
    some = names[1]
    with pa.OSFile(f"{folder}/{some['name']}") as f:
        r = token_files.FileReader(f)
        assert len(r.starts) > 5
        k = len(r.doc_ids) // 2
        assert np.frombuffer(r.ids(k), "<u4").tolist() == library(given[int(r.doc_ids[k])][1])
        assert r.frames_read == 1
    # Any reader of the format gets all ids of a file.
    with open(f"{folder}/{some['name']}", "rb") as f:
        whole = zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read()
    assert len(whole) == 4 * some["ids"]


def test_filters_are_pushed_down(spark, tmp_path, library):
    given = rows()
    folder = str(tmp_path / "t")
    token_files.store(spark.createDataFrame(given, FIELDS), folder, frame_bytes=2000, file_bytes=20_000)
    key = "spark.sql.python.filterPushdown.enabled"
    before = spark.conf.get(key)
    try:
        for on in ("true", "false"):
            spark.conf.set(key, on)
            all_ = token_files.load(spark, folder, range_bytes=5000)
            for test, want in (("doc_id = 17", [17]), ("doc_id in (3, 900, 149, null)", [3, 3, 3, 149]), ("doc_id > 148 and doc_id <= 501", [149, 500, 501]), ("doc_id is null", [None]), ("doc_id < 1", [-5, 0]), ("doc_id >= 503 and n_tokens > 5", [503, 504]), ("doc_id = 17 and doc_id = 18", [])):
                assert sorted((r.doc_id for r in all_.filter(test).collect()), key=str) == sorted(want, key=str), (on, test)
    finally:
        spark.conf.set(key, before)
    pushed = token_files.PushedTokenReader(folder, 5000)
    left = list(pushed.pushFilters([token_files.EqualTo(("doc_id",), 503), token_files.EqualTo(("n_tokens",), 1)]))
    assert [f.attribute for f in left] == [("n_tokens",)]
    assert len({p.name for p in pushed.partitions()}) < len(list((tmp_path / "t").glob("*.tok.zst")))


def test_a_damaged_frame_is_noticed(spark, tmp_path):
    given = [(k, f"text {k} " * 50) for k in range(40)]
    folder = tmp_path / "t"
    token_files.store(spark.createDataFrame(given, FIELDS).coalesce(1), str(folder), frame_bytes=2000)
    (path,) = folder.glob("*.tok.zst")
    raw = bytearray(path.read_bytes())
    raw[10] ^= 255
    path.write_bytes(bytes(raw))
    with pa.OSFile(str(path)) as f:
        r = token_files.FileReader(f)
        with pytest.raises(ValueError, match="frame 0"):
            r.ids(0)
        assert r.ids(len(given) - 1)  # the others don't suffer
    raw[-3] ^= 255
    path.write_bytes(bytes(raw))
    with pa.OSFile(str(path)) as f, pytest.raises(ValueError, match="seek table"):
        token_files.FileReader(f)


def test_what_is_not_committed_is_not_read(spark, tmp_path):
    folder = tmp_path / "t"
    token_files.store(spark.createDataFrame([(1, "a b"), (2, "c")], FIELDS), str(folder))
    (folder / "stray.tok.zst").write_bytes(b"left by a lost task")
    assert token_files.load(spark, str(folder)).count() == 2


def test_empty_table(spark, tmp_path):
    token_files.store(spark.createDataFrame([], FIELDS), str(tmp_path / "t"))
    assert token_files.load(spark, str(tmp_path / "t")).count() == 0


def test_frames_hold_long_documents_in_pieces(tmp_path):
    out = token_files.FileWriter(pa.OSFile(str(tmp_path / "f"), "wb"), 16)
    docs = [(1, [7]), (2, list(range(11))), (3, [1, 2, 3]), (4, []), (5, [9])]
    for d, ids in docs:
        out.add(d, struct.pack(f"<{len(ids)}I", *ids))
    assert out.close() == {"docs": 5, "ids": 16, "least": 1, "most": 5}
    with pa.OSFile(str(tmp_path / "f")) as f:
        r = token_files.FileReader(f)
        assert [np.frombuffer(r.ids(k), "<u4").tolist() for k in range(5)] == [ids for _, ids in docs]
