import hashlib
import random

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from factorlake.llm import bpe


def texts():
    rnd = random.Random(11)
    bits = ["a", "don't", "we'll", " ", "  ", "\n", "\t ", "\r\n", " ", " ", "　", "é", "日本", "🙂", "123", "4", "...", "!!", "<|endoftext|>", "<|endof", "'s", "\u0085", "\x1c", "ß", "Ω", "​", "_", "x1y2"]
    out = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 60))) for _ in range(600)]
    return [*out, "", "a" * 5000, " " * 3000, "日" * 700, "<|endoftext|>" * 3, "<|endoftext|", "|>x", "   a   b  "]


def test_ids_and_text_equal_the_library():
    lib = Tokenizer.from_file(bpe.model_path())
    many = texts()
    body, offs = bpe.utf8(pa.array(many))
    enc, table = bpe.ChunkEncoder(bpe.model_path(), mean=4, table_bytes=20_000), bpe.TokenBytes(bpe.model_path())
    for i, j, b, o in bpe.blocks(body, offs, 4000):
        ids, sizes = enc.block(b, o)
        for text, own in zip(many[i:j], np.split(ids, np.cumsum(sizes)[:-1])):
            want = lib.encode(text, add_special_tokens=False).ids
            assert own.tolist() == want, text
            assert table.decode(pa.array([want], pa.list_(pa.int32())))[0].as_py() == lib.decode(want, skip_special_tokens=False)


def test_runs_of_white_space_beyond_ascii():
    lib, many = Tokenizer.from_file(bpe.model_path()), []
    for char in ("\u00a0", "\u3000", "\u2003", "\u2028", "\u0085", "\u200b", "\u180e", "é"):
        for unit in (f" {char}", f"{char} ", f" {char}{char}", f"\n{char}"):
            for n in (1, 2, 3, 4, 8, 33):
                many += [unit * n + "y", "x" + unit * n + " y", "x " + unit * n, unit * n, f"é{unit * n}é"]
    many.append("x \u00a0 \u00a0 y")
    enc = bpe.ChunkEncoder(bpe.model_path())
    ids, sizes = enc.block(*bpe.utf8(pa.array(many)))
    for text, own in zip(many, np.split(ids, np.cumsum(sizes)[:-1])):
        assert own.tolist() == lib.encode(text, add_special_tokens=False).ids, ascii(text)


def test_joins_at_any_boundary():
    lib, rnd = Tokenizer.from_file(bpe.model_path()), random.Random(21)
    passage = " ".join(rnd.choice(["the", "unbelievable", "café", "naïve", "日本語", "x1y2", "don't", "...", "  "]) + rnd.choice(["", ",", "\n", "\u00a0"]) for _ in range(120))
    many = ["".join(rnd.choice(["é", "word", " ", "\n", "1", "日", "'s"]) for _ in range(rnd.randint(0, 90))) + passage[rnd.randint(0, 200) :] for _ in range(150)]
    want = [lib.encode(t, add_special_tokens=False).ids for t in many]
    body, offs = bpe.utf8(pa.array(many))
    for mean in (1, 2, 3, 16, 64, 1000):
        enc = bpe.ChunkEncoder(bpe.model_path(), mean=mean)
        for _ in range(2):  # the second time out of the table
            ids, sizes = enc.block(body, offs)
            assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == want


def test_shared_passages_are_encoded_once():
    rnd = random.Random(22)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    passage = " ".join(word() for _ in range(2000))
    enc = bpe.ChunkEncoder(bpe.model_path())
    enc.block(*bpe.utf8(pa.array([f"{word()} {passage}"])))
    seen = []
    enc.encode_new = lambda chunks, real=enc.encode_new: seen.extend(chunks) or real(chunks)
    enc.block(*bpe.utf8(pa.array([f"other {word()} {word()} start {passage} and end"])))
    assert 0 < sum(map(len, seen)) < 1000


def latin():
    rnd = random.Random(31)
    bits = ["word", " the", "Ünïcode", "ſtraße", "naïve", " Éa", "×", "÷", "ª", "ʰ", "đ", "'s", "'S", "'ll", "' re", " '", "12", " 3", "²", "...", " !!", "<|", "<|endoftext|>", " ", "  ", "\n", "\r\n", "\t", "\x0b", "\x1c", "\x7f", "\x00", "\u0085", "\u00a0", "_", "~", "`a"]
    return ["".join(rnd.choice(bits) for _ in range(rnd.randint(1, 40))) for _ in range(3000)] + ["x" * 70 + " " + "y" * 70]


def test_pieces_equal_the_library():
    lib, many = Tokenizer.from_file(bpe.model_path()), latin()
    enc = bpe.ChunkEncoder(bpe.model_path(), table_bytes=2000)
    enc.pieces.kept = 20
    body, offs = bpe.utf8(pa.array(many))
    for i, j, b, o in bpe.blocks(body, offs, 4000):
        ids, sizes = enc.block(b, o)
        for text, own in zip(many[i:j], np.split(ids, np.cumsum(sizes)[:-1])):
            assert own.tolist() == lib.encode(text, add_special_tokens=False).ids, ascii(text)
    assert len(enc.pieces) <= 20 and len(enc.pieces.older) == 20


def test_words_met_before_are_not_encoded_again():
    rnd = random.Random(32)
    known = ["".join(rnd.choice("abcdefghé") for _ in range(rnd.randint(2, 9))) for _ in range(300)]
    enc = bpe.ChunkEncoder(bpe.model_path())
    enc.block(*bpe.utf8(pa.array([" " + " ".join(known)])))
    seen = []
    enc.encode = lambda texts, real=enc.encode: seen.extend(texts) or real(texts)
    size = len(enc.pieces)
    rnd.shuffle(known)
    enc.block(*bpe.utf8(pa.array([" " + " ".join(known)])))
    assert not seen and len(enc.pieces) == size


def test_a_task_of_the_query_has_one_python_worker(spark):
    docs = spark.createDataFrame([(1, "Hello  world")], "doc_id long, text string")
    assert bpe.digests(docs)._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_a_pipeline_task_leaves_no_tables_behind(spark):
    docs = spark.createDataFrame([(1, "Hello  world")], "doc_id long, text string").coalesce(1)

    def held(batches):
        list(batches)
        yield pa.RecordBatch.from_arrays([pa.array([bpe._encoder.cache_info().currsize, bpe._token_bytes.cache_info().currsize], pa.int64())], names=["n"])

    assert bpe.stage(spark, docs, "").first().n_tokens == 3
    assert {r.n for r in docs.mapInArrow(held, "n long").collect()} == {0}


def test_very_long_text(spark):
    text = "long words and more " * 200_000
    got = bpe.digests(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert got.n_tokens == len(Tokenizer.from_file(bpe.model_path()).encode(text, add_special_tokens=False).ids)
    assert got.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_query_columns(spark):
    rows = [(1, "Hello  world", 1), (2, None, 2), (3, "", 3), (1, "Hello  world", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    lib = Tokenizer.from_file(bpe.model_path())
    for r in bpe.digests(df).collect():
        text = next(t for d, t, _ in rows if d == r.doc_id) or ""
        ids = lib.encode(text, add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.digests(df.limit(0)).count() == 0
