"""Token-id output in bit planes.

Documents are put in ascending id order by one range exchange of their texts;
each partition encodes its texts, appends the end id to each document and
writes one file:

    chunk* index doc-table trailer

A chunk holds ``BLOCK`` ids (the last one of a file fewer).  Its ids, as 32-bit
integers, are transposed into bit planes (plane k holds bit k of every id);
planes above the highest bit in use are left out and each other plane is
compressed with zstandard.  The index lists for each chunk its offset, its
number of ids and the length of each plane; the doc table lists ids and token
counts; the trailer gives the sizes of both.  Every section is followed by one
line feed, which Spark's text writer puts there: files are written by Spark's
own committer, so a lost or repeated task leaves no half or double file, in any
store that Spark writes.

``read_ids`` reads the files back with the binaryFile source.  The start of a
document needs the ids in all files before: one row a file, summed in order.

Defined cases: a null text is empty (its document holds the end id alone); a
null id is last and returned as null; rows that share an id are ordered by
text hash; equal rows stay separate documents; other columns are ignored; an
empty table writes no ids and reads back empty.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from larder.llm.common import NULL_ID, checkpoint_dir, chunks, column, cut, keyed, text_bytes, utf8
from larder.llm.pretokens import POOL_BATCH_BYTES, PiecePool

BLOCK = 1 << 16
FILE_TEXT_BYTES, MAX_BROADCAST_FILES = 16 << 20, 100_000
MAGIC = b"BPID"
TRAILER = struct.Struct("<4sQQQ")  # magic, bytes of index, bytes of doc table, ids in the file


# ------------------------------------------------------------------ blocks
def _transposed(rows: np.ndarray) -> np.ndarray:
    """The 8x8 bits of each row of 8 bytes, transposed in 64-bit words (the first byte highest)."""
    x = np.ascontiguousarray(rows).view(">u8").ravel().astype(np.uint64)
    for by, mask in ((7, 0x00AA00AA00AA00AA), (14, 0x0000CCCC0000CCCC), (28, 0x00000000F0F0F0F0)):
        t = (x ^ (x >> np.uint64(by))) & np.uint64(mask)
        x = x ^ t ^ (t << np.uint64(by))
    return x.astype(">u8").view(np.uint8).reshape(-1, 8)


def shuffle_block(ids: np.ndarray) -> tuple[list[bytes], int]:
    """Compressed bit planes of a block of unsigned 32-bit ids."""
    width = int(ids.max()).bit_length() if len(ids) else 0
    octets = np.zeros((-(-len(ids) // 8) * 8, 4), np.uint8)
    octets[:len(ids)] = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    packer = zstandard.ZstdCompressor(level=1)
    out = []
    for k in range(0, width, 8):
        planes = np.ascontiguousarray(_transposed(octets[:, k // 8].reshape(-1, 8))[:, ::-1].T)
        out += [packer.compress(p.tobytes()) for p in planes[:width - k]]
    return out, len(ids)


def unshuffle_block(planes: list[bytes], n: int) -> np.ndarray:
    unpacker = zstandard.ZstdDecompressor()
    octets = np.zeros((-(-n // 8) * 8, 4), np.uint8)
    for k in range(0, len(planes), 8):
        part = np.zeros((8, len(octets) // 8), np.uint8)
        for i, plane in enumerate(planes[k:k + 8]):
            part[i] = np.frombuffer(unpacker.decompress(plane), np.uint8)
        octets[:, k // 8] = _transposed(part[::-1].T).ravel()
    return octets.view("<u4").ravel()[:n]


# ------------------------------------------------------------------ files
class FileWriter:
    """Sections of one file, in order; ``add`` and ``finish`` return the bytes to write."""

    def __init__(self):
        self.left, self.held, self.at, self.total, self.index, self.docs = [], 0, 0, 0, [], []

    def add(self, did: int, ids: bytes) -> list[bytes]:
        self.docs.append((did, len(ids) // 4))
        self.total += len(ids) // 4
        self.left.append(ids)
        self.held += len(ids)
        if self.held < 4 * BLOCK:
            return []
        held, full = b"".join(self.left), self.held // (4 * BLOCK) * 4 * BLOCK
        self.left, self.held = [held[full:]], self.held - full
        return [self._chunk(held[i:i + 4 * BLOCK]) for i in range(0, full, 4 * BLOCK)]

    def _chunk(self, ids: bytes) -> bytes:
        planes, n = shuffle_block(np.frombuffer(ids, "<u4"))
        self.index.append(struct.pack(f"<QIH{len(planes)}I", self.at, n, len(planes), *map(len, planes)))
        body = b"".join(planes)
        self.at += len(body) + 1
        return body

    def finish(self) -> list[bytes]:
        out = [self._chunk(b"".join(self.left))] if self.held else []
        index = b"".join(self.index)
        docs = zstandard.ZstdCompressor(level=1).compress(
            np.array([d for d, _ in self.docs], "<i8").tobytes() + np.array([n for _, n in self.docs], "<u8").tobytes())
        return [*out, index, docs, TRAILER.pack(MAGIC, len(index), len(docs), self.total)]


def parse(content: bytes) -> tuple[np.ndarray, np.ndarray, bytes, int]:
    """Document ids, token counts, chunk index and ids in all of one file's bytes."""
    magic, n_index, n_docs, total = TRAILER.unpack(content[-1 - TRAILER.size:-1])
    if magic != MAGIC:
        raise ValueError("not a token-id file")
    end = len(content) - TRAILER.size - 2
    table = zstandard.ZstdDecompressor().decompress(content[end - n_docs:end])
    half = len(table) // 2
    index = content[end - n_docs - 1 - n_index:end - n_docs - 1]
    return np.frombuffer(table[:half], "<i8"), np.frombuffer(table[half:], "<u8").astype(np.int64), index, total


def chunk_ids(content: bytes, index: bytes) -> Iterator[np.ndarray]:
    at = 0
    while at < len(index):
        offset, n, width = struct.unpack_from("<QIH", index, at)
        sizes = struct.unpack_from(f"<{width}I", index, at + 14)
        at += 14 + 4 * width
        planes = []
        for size in sizes:
            planes.append(content[offset:offset + size])
            offset += size
        yield unshuffle_block(planes, n)


# ------------------------------------------------------------------ Spark
_encoders: dict[int, PiecePool] = {}


def _encoder(definition: str) -> PiecePool:
    key = zlib.crc32(definition.encode())
    if key not in _encoders:
        own = Tokenizer.from_str(definition)
        special = [t.content for t in own.get_added_tokens_decoder().values()]
        vocab = own.get_vocab()
        n_bytes = np.zeros(max(vocab.values(), default=0) + 1, np.int64)
        n_bytes[list(vocab.values())] = [len(t) for t in vocab]  # a byte-level token has a character for each byte

        def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
            ids = [e.ids for e in own.encode_batch_fast(texts, add_special_tokens=False)]
            n = np.fromiter(map(len, ids), np.int64, len(ids))
            return np.fromiter(chain.from_iterable(ids), np.uint32, int(n.sum())), n

        _encoders.clear()
        _encoders[key] = PiecePool(encode, n_bytes, lambda text: any(t in text for t in special))
    return _encoders[key]


def write_ids(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id",
              text_col: str = "text", file_bytes: int = FILE_TEXT_BYTES) -> None:
    """Writes the ids of all documents to new files in the folder ``path``.
    The tokenizer must cut text as a byte-level one does (see ``pretokens``);
    its definition is read on the driver and sent with the task."""
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = keyed(docs, id_col, text_col)
    files = max(1, -(-text_bytes(rows) // file_bytes))
    end = np.array([end_id], "<u4").tobytes()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer = _encoder(definition.value), FileWriter()
        for batch in batches:
            did = column(batch, "did")
            data, offs = utf8(batch.column(1))
            for lo, hi in chunks(offs, POOL_BATCH_BYTES):
                raw = data[offs[lo]:offs[hi]].tobytes()
                at = (offs[lo:hi + 1] - offs[lo]).tolist()
                done = encoder.texts([raw[a:b].decode() for a, b in zip(at, at[1:])])
                out = [s for d, ids in zip(did[lo:hi].tolist(), done) for s in writer.add(d, ids + end)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["section"])
        if writer.docs:
            yield pa.RecordBatch.from_arrays([pa.array(writer.finish(), pa.binary())], names=["section"])

    sections = (rows.repartitionByRange(files, "did", "th").sortWithinPartitions("did", "th").select("did", "text")
                .mapInArrow(scan, "section binary"))
    sections.select(F.col("section").cast("string")).write.option("lineSep", "\n").text(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, ids`` of every document in the files of a folder;
    ``start`` counts the ids of all documents before it."""
    def rows(batches, of_file):
        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                content = value.as_py()
                if len(content):
                    yield from of_file(name, content)

    def totals(batches):
        def of_file(name, content):
            did, counts, _, total = parse(content)
            yield pa.RecordBatch.from_pydict({"path": [name], "first": [int(did[0])], "total": [total]})
        yield from rows(batches, of_file)

    def documents(batches):
        def of_file(name, content):
            did, counts, index, _ = parse(content)
            start = np.cumsum(counts) - counts
            left, i = np.empty(0, "<u4"), 0
            for block in chunk_ids(content, index):
                left, j, used = np.concatenate([left, block]), i, 0
                out = []
                while j < len(did) and used + counts[j] <= len(left):
                    out.append(left[used:used + counts[j]].tobytes())
                    used += counts[j]
                    j += 1
                if out:
                    yield pa.RecordBatch.from_pydict({
                        "path": [name] * (j - i), "did": pa.array(did[i:j]), "start": pa.array(start[i:j]),
                        "ids": pa.array(out, pa.binary())})
                left, i = left[used:], j
        yield from rows(batches, of_file)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    order = Window.orderBy("first", "path").rowsBetween(Window.unboundedPreceding, -1)
    before = cut(files.mapInArrow(totals, "path string, first long, total long")
                 .select("path", F.coalesce(F.sum("total").over(order), F.lit(0)).alias("before")))
    if before.count() <= MAX_BROADCAST_FILES:  # else the ids are shuffled by file
        before = F.broadcast(before)
    return (files.mapInArrow(documents, "path string, did long, start long, ids binary").join(before, "path")
            .select(F.nullif("did", F.lit(NULL_ID)).alias("doc_id"), (F.col("before") + F.col("start")).alias("start"), "ids"))


def token_folder(spark: SparkSession) -> str:
    """A new folder name in the shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/token-ids-{uuid.uuid4().hex}"
