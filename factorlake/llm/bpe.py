"""Byte-level BPE encoding and decoding with content-defined chunk reuse.

Chunks end where a rolling hash of the last WINDOW bytes says so, every MEAN bytes
on average, so passages that documents share fall into the same chunks wherever
they stand. Such a cut mostly falls within a word, so its join is repaired: what lies
between the nearest places on either side where the pre-tokenizer surely ends a
piece is re-encoded from the two neighbours' real bytes; a chunk without such a
place is glued to the next one, until there is one. From there on the ids agree with those of the whole
text. Such places are the starts of ASCII white space after another character,
unless that is white space beyond ASCII, after which the pre-tokenizer goes on;
which characters those are is asked of the pre-tokenizer itself. Special tokens'
strings cut a text before all else and have their own id, as in the library.

A chunk not met before, if of Latin letters, digits and ASCII signs, is cut into the
pre-tokenizer's pieces here, and the library's model merges a piece that a bounded
table doesn't know; other chunks go through the whole library.

Chunks and joins are known by their bytes, so a hit is exact. The table lives in a
worker, in two generations of bounded bytes: what has not been met since the last change of
generation leaves. Sharing it between workers would shuffle more ids than the texts have bytes.

Edge cases: null text is empty and has no ids; rows are independent, so order,
ties and repeated rows do not matter; texts of any length are encoded whole, in a
block of their own; an empty table gives no rows; other columns are kept as they
are, also one named like a column of this module's own.
"""

from __future__ import annotations

import functools
import os
import re
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorlake.llm import session
from factorlake.llm.bytesblock import Rolling, blocks, spread, utf8

MODEL = "byte_bpe_50k.json"
WINDOW = 16  # bytes that decide on a cut
MEAN = 64  # bytes between cuts, on average
TABLE_BYTES = 6 << 20  # of one generation: chunks and ids
PIECES_KEPT = 200_000  # of one generation
_BLANKS = frozenset(b"\t\n\v\f\r ")
_GAP = np.zeros(256, bool)
_GAP[list(_BLANKS)] = True
# White space, signs, digits and letters of ASCII, and the letters from U+00C0 to U+017F.
_LATIN = re.compile(rb"[\t-\r -~]*(?:(?:\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xc4\xc5][\x80-\xbf])[\t-\r -~]*)*")
# The tokenizer's own pre-tokenizer pattern for these, where a byte beyond ASCII is part of a letter.
_PIECE = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z\x80-\xff]+| ?[0-9]+| ?[!-/:-@\[-`{-~]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_signs() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the rest for characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in plain)}


class PieceIds(dict):
    """A piece's bytes -> its ids as 32-bit numbers, by the library's model; of two generations the older leaves when the newer is full."""

    def __init__(self, tokenizer, kept: int = PIECES_KEPT):
        self.tokenizer, self.kept = tokenizer, kept
        self.model, self.signs = tokenizer.model, _byte_signs()
        self.older: dict[bytes, bytes] = {}

    def __missing__(self, piece: bytes) -> bytes:
        found = self.older.get(piece)
        if found is None:
            ids = [t.id for t in self.model.tokenize(piece.decode("latin-1").translate(self.signs))]
            found = struct.pack(f"={len(ids)}i", *ids)
        if len(piece) <= 64:
            if len(self) >= self.kept:
                self.older = dict(self)
                self.clear()
            self[piece] = found
        return found


class ChunkEncoder:
    """Encodes blocks of texts; holds the ids of the chunks seen so far."""

    def __init__(self, path: str, mean: int = MEAN, table_bytes: int = TABLE_BYTES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = {t.content.encode(): i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.sizes = TokenBytes(path).size
        self.mean, self.limit = mean, table_bytes
        self.pieces = PieceIds(self.tokenizer)
        self.spaces: dict[str, bool] = {}  # character -> whether it is white space
        self.young: dict[bytes, bytes] = {}  # chunk -> ids, as 32-bit numbers
        self.old: dict[bytes, bytes] = {}
        self.held = 0

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_new(self, chunks: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """(chunk, ids). Latin chunks by their pieces. Of the others, those that begin with ASCII white space and end in a character that is none are
        encoded end to end, as the joins between them are pieces' ends, and their ids dealt back by size."""
        of, other = self.pieces.__getitem__, []
        for c in chunks:
            # A special token's opening is left to the library.
            if _LATIN.fullmatch(c) and b"<|" not in c:
                yield c, b"".join(map(of, _PIECE.findall(c)))
            else:
                other.append(c)
        chunks = other
        plain = [c[0] in _BLANKS and c[-1] not in _BLANKS and (c[-1] < 0x80 or not self._is_space(c[-4:].decode("utf-8", "ignore")[-1])) for c in chunks]
        run = [c for c, p in zip(chunks, plain) if p]
        for i in range(0, len(run), 1000):
            some = run[i : i + 1000]
            # The library is fastest on strings of about a thousand characters.
            ids = np.array(list(chain.from_iterable(self.encode([b"".join(some[k : k + 20]).decode() for k in range(0, len(some), 20)]))), np.int32)
            ends = np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum([len(c) for c in some])) + 1
            raw = ids.tobytes()
            yield from ((c, raw[4 * a : 4 * b]) for c, a, b in zip(some, [0, *ends[:-1].tolist()], ends.tolist()))
        rest = [c for c, p in zip(chunks, plain) if not p]
        if rest:
            yield from zip(rest, (np.array(ids, np.int32).tobytes() for ids in self.encode([c.decode() for c in rest])))

    def ids_of(self, chunks: list[bytes]) -> list[bytes]:
        """The ids of each chunk, each new one encoded once."""
        found = [self.young.get(c) for c in chunks]
        missing = dict.fromkeys(c for c, ids in zip(chunks, found) if ids is None)
        if not missing:
            return found
        kept = {c: self.old[c] for c in missing if c in self.old}
        kept.update(self.encode_new([c for c in missing if c not in kept]))
        self.held += sum(len(c) + len(ids) for c, ids in kept.items())
        self.young.update(kept)
        found = [kept[c] if ids is None else ids for c, ids in zip(chunks, found)]
        if self.held > self.limit:
            self.old, self.young, self.held = self.young, {}, 0
        return found

    def cuts(self, body: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Ascending places where chunks and joins begin: of all pieces' ends, those next to a cut by hash, and texts' and special strings' own."""
        sure, locked = self.ends(body, offs)
        if len(body) < WINDOW:
            return np.flatnonzero(locked[:-1])
        at = np.arange(WINDOW, len(body) + 1)
        by_hash = Rolling(body)(at - WINDOW, at) % np.uint64(self.mean) == 0
        early = spread(offs[:-1], np.minimum(np.diff(offs), WINDOW))  # where the window would reach into the text before
        by_hash[early[early >= WINDOW] - WINDOW] = False
        cut = at[by_hash]
        place = np.flatnonzero(sure)
        before = place[np.searchsorted(place, cut, side="right") - 1]
        after = place[np.minimum(np.searchsorted(place, cut), len(place) - 1)]
        locked[before] = True
        locked[after] = True
        return np.flatnonzero(locked[:-1])

    def ends(self, body: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the pre-tokenizer surely begins a new piece: at texts, at white space after another character, at special strings
        and at what follows them; and which of these are texts or special strings."""
        first = np.zeros(len(body) + 1, bool)
        gap = _GAP[body]
        first[1:-1] = gap[1:] & ~gap[:-1]
        raw = body.tobytes()
        locked = np.zeros(len(body) + 1, bool)
        locked[offs] = True
        for text in self.special:
            at = raw.find(text)
            while at >= 0:
                end = at + len(text)
                if np.searchsorted(offs, at, side="right") == np.searchsorted(offs, end - 1, side="right"):
                    first[at + 1 : end] = False
                    locked[[at, end]] = True
                at = raw.find(text, end)
        first |= locked
        # After white space beyond ASCII the pre-tokenizer goes on: no cut there.
        doubt = np.flatnonzero(first[1:-1] & ~locked[1:-1] & (body[:-1] >= 0x80)) + 1
        for d in doubt.tolist():
            k = next(k for k in range(1, 5) if raw[d - k] & 0xC0 != 0x80)
            if self._is_space(raw[d - k : d].decode()):
                first[d] = False
        return first, locked

    def _is_space(self, char: str) -> bool:
        """Whether the pre-tokenizer takes char as white space: it then does not end a piece between char and two blanks."""
        if char not in self.spaces:
            pieces = self.tokenizer.pre_tokenizer.pre_tokenize_str(f"a{char}  b")
            self.spaces[char] = all(end != 2 for _, (_, end) in pieces)
        return self.spaces[char]

    def block(self, body: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a block end to end, and how many each has."""
        if not len(body):
            return np.zeros(0, np.int32), np.zeros(len(offs) - 1, np.int64)
        starts = self.cuts(body, offs)
        raw, at = body.tobytes(), starts.tolist()
        found = self.ids_of([raw[a:b] for a, b in zip(at, [*at[1:], len(raw)])])
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        so_far = np.append(0, np.cumsum(sizes))
        return np.frombuffer(b"".join(found), np.int32), np.diff(so_far[np.append(np.searchsorted(starts, offs[:-1]), len(starts))])


@functools.cache
def _encoder(path: str) -> ChunkEncoder:
    """One for each worker process, which serves many tasks."""
    return ChunkEncoder(path)


@functools.cache
def _token_bytes(path: str) -> TokenBytes:
    return TokenBytes(path)


def _encode_kernel(path: str, name: str, out: str):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            body, offs = utf8(batch.column(name))
            for i, j, b, o in blocks(body, offs):
                ids, sizes = encoder.block(b, o)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(ids))
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*part.schema.names, out])

    return kernel


def _decode_kernel(path: str, name: str, out: str):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _token_bytes(path)
        for batch in batches:
            step = 256
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                texts = table.decode(part.column(name))
                yield pa.RecordBatch.from_arrays([*part.columns, texts], names=[*part.schema.names, out])

    return kernel


class TokenBytes:
    """The bytes of every token, end to end."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        symbol = {c: b for b, c in _byte_signs().items()}
        special = {i: x.content.encode() for i, x in t.get_added_tokens_decoder().items()}
        tokens = [special.get(i) or bytes(symbol[c] for c in t.id_to_token(i) or "") for i in range(t.get_vocab_size())]
        self.size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.start = np.cumsum(self.size) - self.size
        self.body = np.frombuffer(b"".join(tokens), np.uint8)

    def decode(self, column: pa.ListArray) -> pa.Array:
        """Texts; bytes that are not UTF-8 become replacement characters, as in the library."""
        ids = column.flatten().to_numpy(zero_copy_only=False)
        counts = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, np.int64)
        size = self.size[ids]
        raw = self.body[spread(self.start[ids], size)].tobytes()
        ends = np.append(0, np.cumsum(size))[np.append(0, np.cumsum(counts))].tolist()
        return pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:])], pa.string())


def _simple(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def encode(docs: DataFrame, text_col: str = "text", out: str = "ids", path: str | None = None) -> DataFrame:
    """docs with the ids of text_col as an array of ints."""
    schema = ", ".join(x for x in (_simple(docs), f"`{out}` array<int>") if x)
    return docs.mapInArrow(_encode_kernel(path or model_path(), text_col, out), schema)


def decode(rows: DataFrame, ids_col: str = "ids", out: str = "decoded", path: str | None = None) -> DataFrame:
    """rows with the text of ids_col; ids_col holds no null."""
    return rows.mapInArrow(_decode_kernel(path or model_path(), ids_col, out), f"{_simple(rows)}, `{out}` string")


def round_trip(docs: DataFrame, text_col: str = "text", ids: str = "ids", out: str = "decoded", path: str | None = None, lasting: bool = True) -> DataFrame:
    """docs but text_col, with its ids and the text decoded from them. One kernel: as two, each task has two Python workers, and the executor's memory counts both.

    Unless lasting, a task leaves model and tables behind it, as its worker goes on to serve other stages.
    """
    path = path or model_path()
    there, back = _encode_kernel(path, text_col, ids), _decode_kernel(path, ids, out)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from back(batch.drop_columns([text_col]) for batch in there(batches))
        if not lasting:
            _encoder.cache_clear()
            _token_bytes.cache_clear()

    schema = ", ".join(x for x in (_simple(docs.drop(text_col)), f"`{ids}` array<int>, `{out}` string") if x)
    return docs.mapInArrow(kernel if lasting else session.tidy(kernel), schema)


def digests(docs: DataFrame, lasting: bool = True) -> DataFrame:
    out = round_trip(docs.select("doc_id", "text"), lasting=lasting)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(session.table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: the tokens of each document, as digests and counts. Null texts are empty; repeated rows give repeated results."""
    session.bounded_batches(spark)
    return digests(docs, lasting=False)
