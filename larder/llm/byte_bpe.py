"""Byte-level BPE encoding and decoding on a sentencepiece model made directly
from a rank vocabulary.

The model is written field by field (public protocol-buffer layout): every
token of the vocabulary is a normal piece, its bytes mapped one to one to
printable characters, its score the negative rank, its id the rank; type BPE;
identity normalisation, no dummy prefix, no space escaping.  sentencepiece then
merges the neighbouring pair of best score, the lowest rank, first.  A text is
cut into pre-tokens by the pattern, each is byte-mapped and encoded alone;
decoding maps ids back to bytes through the inverse table.

Nothing is shuffled: a text is encoded where it is read.  Pieces between spaces
are remembered within a Python worker, up to a fixed number.

Defined cases: a null text is empty and gives no ids; repeated rows give equal
results; any Unicode text round-trips; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import keyed, utf8
from larder.llm.pretokens import PieceCache

RESULT = "doc_id long, n_tokens long, ids binary, decoded binary"


def read_ranks(path: str) -> list[bytes]:
    """Tokens of a rank file (base64 token, space, rank on each line), by rank."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, f.read().splitlines()))}
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return tokens


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is printable
    Latin-1, else the next free one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


CHARS = byte_characters()
_TABLE = {b: c for b, c in enumerate(CHARS)}


def mapped(token: bytes) -> str:
    return token.decode("latin-1").translate(_TABLE)


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _bytes(field: int, value: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(value)) + value


def serialise_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model whose ids are the ranks; the id after the last is <unk>."""
    normal, unknown, bpe = 1, 2, 2
    model = bytearray()
    for rank, token in enumerate(tokens):
        piece = _bytes(1, mapped(token).encode() or f"<unused{rank}>".encode()) + b"\x15" + struct.pack("<f", -float(rank))
        model += _bytes(1, piece + _number(3, normal))
    model += _bytes(1, _bytes(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0) + _number(3, unknown))
    trainer = _number(3, bpe) + _number(4, len(tokens) + 1) + _number(40, len(tokens))
    trainer += b"".join(_number(f, -1) for f in (41, 42, 43))
    normaliser = _bytes(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return bytes(model + _bytes(2, trainer) + _bytes(3, normaliser))


class Codec:
    """Encoder and decoder of one vocabulary; made once in each Python worker."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens, self.split = tokens, regex.compile(pattern).findall
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(tokens))
        self.cache = PieceCache(self.encode_strings)

    def encode_strings(self, strings: list[str]) -> list[bytes]:
        pre = [self.split(s) for s in strings]
        flat = list(dict.fromkeys(t for p in pre for t in p))
        ids = self.model.encode([mapped(t.encode()) for t in flat], num_threads=1) if flat else []
        known = {t: np.array(i, "<u4").tobytes() for t, i in zip(flat, ids)}
        return [b"".join([known[t] for t in p]) for p in pre]

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.cache.texts(texts)

    def decode(self, ids: bytes) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist()])


_codecs: dict[tuple, Codec] = {}


def codec(key: tuple, tokens: list[bytes], pattern: str) -> Codec:
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(tokens, pattern)
    return _codecs[key]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, n_tokens, ids, decoded``;
    ``ids`` are little-endian unsigned 32-bit integers, ``decoded`` the bytes
    that the ids decode to.  The rank file is read on the driver and
    broadcast: a vocabulary has a fixed size, whatever the documents."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    key = (ranks_path, pattern)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(key, vocabulary.value, pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                data, offs = utf8(part.column(1))
                raw = data.tobytes()
                ids = own.encode([raw[a:b].decode() for a, b in zip(offs[:-1], offs[1:])])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary()),
                     pa.array([own.decode(i) for i in ids], pa.binary())], names=["doc_id", "n_tokens", "ids", "decoded"])

    rows = keyed(docs, id_col, text_col, [F.col(f"`{id_col}`").cast("long").alias("doc_id")])
    return rows.select("doc_id", "text").mapInArrow(scan, RESULT)
