"""Spelling variants of a corpus, found by Bloom-guided neighbourhoods.

Words are counted per task and added up by Spark; those that are long and
frequent enough are the vocabulary.  It is put into blocked Bloom filters, one
shard for each word length (one for all lengths from ``LONG``), and broadcast.
Every word then generates its edits and probes the shard of the edit's length:
each deletion, and each replacement by a later letter of the alphabet that the
vocabulary uses.  An insertion is a deletion seen from the longer word, and a
replacement by an earlier letter is one by a later letter seen from the other
word, so every near pair is generated once.  Only positives are written out and
shuffled; an exact join with the vocabulary removes the false ones.

The filters have ``BITS`` bits a word and ``MAX_BLOCKS`` blocks of 64 bytes (128
MB) at most, whatever the vocabulary; beyond that more positives are false and
are shuffled, and the result is the same.

The form of a word is its near word with the largest count (ties: smallest in
code-point order), if that is at least ``RATIO`` times the word's own.  Counts
grow by that ratio along forms, so chains are short; their ends, the roots,
are found by doubling.

Defined cases: a null text has no words; a null id is written as nothing before
the colon of the hashed text; rows count each by itself, so repeated rows count
again; other columns are ignored; an empty table, or one without frequent
words, gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import BYTE_VALUES, CHUNK_BYTES, chunks, cut, fmix, ink_runs, ranges, utf8
from larder.llm.merkle import CRC_TABLE, crc_sql

MIN_LENGTH, MIN_COUNT, RATIO, DAMAGE = 6, 5, 5, 199
LONG, BITS, MAX_BLOCKS, PROBES = 64, 32, 1 << 21, 1 << 21
WORDS_HELD = 1 << 20
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LEAD = 0xC3  # of U+00C0 to U+00FF in UTF-8
_SALT = fmix(np.arange(11, 19, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


# ------------------------------------------------------------------ words
def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


_CRC = _crc_table()


def crc_each(data: np.ndarray, start: np.ndarray, size: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """CRC-32 of ``data[start:start + size]``, each going on from its ``seed``."""
    order = np.argsort(-size, kind="stable")
    at, state = start[order], ~seed[order].astype(np.uint32)
    longer = np.searchsorted(-size[order], -np.arange(LONG), "left")  # of more than j bytes
    for j in range(LONG):
        n = longer[j]
        if not n:
            break
        state[:n] = (state[:n] >> 8) ^ _CRC[(state[:n] ^ data[at[:n] + j]) & 255]
    for i in np.flatnonzero(size[order] > LONG):  # long ones one by one
        k = order[i]
        state[i] = ~np.uint32(zlib.crc32(data[start[k] + LONG:start[k] + size[k]].tobytes(), int(~state[i])))
    out = np.empty(len(order), np.uint32)
    out[order] = ~state
    return out


def words_of(ids: list, data: np.ndarray, offs: np.ndarray, min_length: int, damage: int) -> pa.Array:
    """The words of a chunk's rows, damaged ones without the code point that they lose."""
    lead = data == _LEAD
    ink = _LETTER[data] | lead
    ink[1:] |= lead[:-1]
    s, e, woff = ink_runs(ink, offs)
    wide = np.zeros(len(data) + 1, np.int64)
    np.cumsum(lead, out=wide[1:])
    length = e - s - (wide[e] - wide[s])
    keep = length >= min_length
    row = np.repeat(np.arange(len(ids)), np.diff(woff))[keep]
    s, e, length, low = s[keep], e[keep], length[keep], _LOWER[data]
    seed = np.array([zlib.crc32(f"{'' if d is None else d}:".encode()) for d in ids], np.uint32)
    h = crc_each(low, s, e - s, seed[row]).astype(np.int64)
    hurt = h % damage == 0
    more = []
    for a, b, k in zip(s[hurt].tolist(), e[hurt].tolist(), (h[hurt] % length[hurt]).tolist()):
        word = low[a:b].tobytes().decode()
        more.append(word[:k] + word[k + 1:])
    s, n = s[~hurt], (e - s)[~hurt]
    ends = np.zeros(len(s) + 1, np.int64)
    np.cumsum(n, out=ends[1:])
    whole = pa.LargeStringArray.from_buffers(len(s), pa.py_buffer(ends), pa.py_buffer(low[ranges(s, n)]))
    return pa.concat_arrays([whole, pa.array([w for w in more if len(w) >= min_length], pa.large_string())])


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
                min_count: int = MIN_COUNT, damage: int = DAMAGE) -> DataFrame:
    """``word, n`` of all words with at least ``min_length`` code points and ``min_count`` occurrences."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def merged() -> pa.Table:
            return pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])

        rows = 0
        for batch in batches:
            ids = batch.column(0).to_pylist()
            data, offs = utf8(batch.column(1))
            for lo, hi in chunks(offs, CHUNK_BYTES):
                found = pc.value_counts(words_of(ids[lo:hi], data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo], min_length, damage))
                held.append(pa.table({"word": found.field("values"), "n": found.field("counts")}))
                rows += len(found)
                if rows > WORDS_HELD:
                    held = [merged()]
                    rows = held[0].num_rows
                    if rows > WORDS_HELD // 2:
                        yield from held.pop().cast(schema).to_batches(max_chunksize=100_000)
                        rows = 0
        if held:
            yield from merged().cast(schema).to_batches(max_chunksize=100_000)

    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])
    text = docs.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string"))
    return text.mapInArrow(scan, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


# ------------------------------------------------------------------ filters
def _matrix(words: list[str]) -> np.ndarray:
    """Code points of words of one length (all below 256), a row each."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(n, _STEP)], dtype=np.uint64)


def _by_length(words: list[str]) -> Iterator[tuple[int, list[str]]]:
    for length, some in groupby(sorted(words, key=len), len):
        yield length, list(some)


class Filters:
    """Blocked Bloom filters: a shard for each length from ``low``, the last for all longer ones."""

    def __init__(self, counts: dict[int, int], bits: int = BITS, max_blocks: int = MAX_BLOCKS):
        share = min(1.0, max_blocks * 512 / max(1, bits * sum(counts.values())))
        self.size = {k: max(1, int(n * bits * share / 512)) for k, n in sorted(counts.items())}
        self.first, at = {}, 0
        for k, n in self.size.items():
            self.first[k], at = at, at + n
        self.blocks = np.zeros((at, 8), np.uint64)

    def block(self, length: int, key: np.ndarray) -> np.ndarray:
        k = min(length, LONG)
        return (key >> np.uint64(32)) * np.uint64(self.size[k]) // np.uint64(1 << 32) + np.uint64(self.first[k])

    @staticmethod
    def bit(key: np.ndarray, i: int) -> np.ndarray:
        return np.uint64(1) << (key * _SALT[i] >> np.uint64(58))

    def holds(self, length: int, key: np.ndarray) -> np.ndarray:
        """Places of the keys that may be in the shard."""
        if min(length, LONG) not in self.size:
            return np.empty(0, np.int64)
        at, block = np.arange(len(key)), self.block(length, key).astype(np.int64)
        for i in range(8):  # most fail at the first word of their block
            ok = self.blocks[block, i] & self.bit(key, i) != 0
            at, key, block = at[ok], key[ok], block[ok]
        return at


def build_filters(vocabulary: DataFrame, bits: int = BITS, max_blocks: int = MAX_BLOCKS) -> Filters:
    """Filters of ``word``: the bits of a block are joined in Spark, and at most ``max_blocks`` blocks (a few
    more, as each of at most ``LONG`` shards has one) come to the driver."""
    shard = F.least(F.char_length("word"), F.lit(LONG))
    out = Filters({r["shard"]: r["n"] for r in vocabulary.groupBy(shard.alias("shard")).agg(F.count("*").alias("n")).collect()},
                  bits, max_blocks)
    empty = Filters.__new__(Filters)
    empty.size, empty.first = out.size, out.first

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, words in _by_length(batch.column(0).to_pylist()):
                key = fmix((BYTE_VALUES[_matrix(words)] * _powers(length)[:-1]).sum(axis=1, dtype=np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(empty.block(length, key).astype(np.int64)), *(pa.array(empty.bit(key, i).view(np.int64)) for i in range(8))],
                    names=["block", *(f"b{i}" for i in range(8))])

    found = vocabulary.select("word").mapInArrow(blocks, "block long, " + ", ".join(f"b{i} long" for i in range(8)))
    found = found.groupBy("block").agg(*[F.bit_or(f"b{i}").alias(f"b{i}") for i in range(8)]).toArrow()
    at = found.column("block").to_numpy()
    for i in range(8):
        out.blocks[at, i] = found.column(f"b{i}").to_numpy().view(np.uint64)
    return out


# ------------------------------------------------------------------ neighbourhoods
def _positives(words: list[str], length: int, letters: np.ndarray, filters: Filters) -> Iterator[tuple[list[int], list[str]]]:
    """``(word numbers, edits)`` whose edit may be in the vocabulary; ``letters`` ascend."""
    m = _matrix(words)
    up = _powers(length)
    down = np.uint64(pow(int(_STEP), -1, 1 << 64))
    term = BYTE_VALUES[m] * up[:-1]
    sums = np.zeros((len(words), length + 1), np.uint64)
    np.cumsum(term, axis=1, out=sums[:, 1:], dtype=np.uint64)
    whole = sums[:, -1:]
    # a deletion: in a run of one letter only the first is deleted, as all give the same word
    fresh = np.ones(m.shape, bool)
    fresh[:, 1:] = m[:, 1:] != m[:, :-1]
    w, p = np.nonzero(fresh)
    hit = filters.holds(length - 1, fmix((sums[:, :-1] + (whole - sums[:, 1:]) * down)[fresh]))
    yield w[hit].tolist(), [words[a][:b] + words[a][b + 1:] for a, b in zip(w[hit].tolist(), p[hit].tolist())]
    # replacements by a later letter, for some words and places at a time
    step = max(1, PROBES // max(1, len(letters)))
    flat, key = m.ravel(), np.broadcast_to(whole, m.shape).ravel()
    for lo in range(0, len(flat), step):
        was, place = flat[lo:lo + step], np.arange(lo, min(lo + step, len(flat))) % length
        more = letters[None, :] > was[:, None]
        x, c = np.nonzero(more)
        diff = (BYTE_VALUES[letters][None, :] - BYTE_VALUES[was][:, None]) * up[place][:, None]
        hit = filters.holds(length, fmix((key[lo:lo + step][:, None] + diff)[more]))
        x, c = x[hit], c[hit]
        at = ((lo + x) // length).tolist()
        yield at, [words[a][:b] + chr(z) + words[a][b + 1:] for a, b, z in zip(at, place[x].tolist(), letters[c].tolist())]


def positives(vocabulary: DataFrame, filters: Filters, letters: list[int]) -> DataFrame:
    """``word, n, near``: edits of each word that the filters don't rule out."""
    sent = vocabulary.sparkSession.sparkContext.broadcast((filters.size, filters.first, filters.blocks))
    alphabet = np.array(sorted(letters), np.uint8)
    per_task = 1 << 14

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Filters.__new__(Filters)
        own.size, own.first, own.blocks = sent.value
        for batch in batches:
            for i in range(0, batch.num_rows, per_task):
                some = batch.slice(i, per_task)
                count = dict(zip(some.column(0).to_pylist(), some.column(1).to_pylist()))
                for length, words in _by_length(list(count)):
                    for at, near in _positives(words, length, alphabet, own):
                        if near:
                            yield pa.RecordBatch.from_arrays(
                                [pa.array([words[k] for k in at]), pa.array([count[words[k]] for k in at], pa.int64()), pa.array(near)],
                                names=["word", "n", "near"])

    return vocabulary.select("word", "n").mapInArrow(probe, "word string, n long, near string")


def near_words(vocabulary: DataFrame, bits: int = BITS, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """``word, n, near, near_n`` in both directions for every pair of ``vocabulary`` (``word, n``) that differs in
    one inserted, deleted or replaced code point; words hold no code point above 255."""
    letters = [ord(r["c"]) for r in vocabulary.select(F.explode(F.split("word", "")).alias("c")).distinct().collect() if r["c"]]
    found = positives(vocabulary, build_filters(vocabulary, bits, max_blocks), letters)
    pairs = found.join(vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    return pairs.select(F.explode(F.array(
        F.struct("word", "n", "near", "near_n"),
        F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))).alias("p")
    ).select("p.*")


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of ``word, form``: the last word that is met by following forms."""
    now = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        now = cut(now.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if not now.agg(F.max("moved")).first()[0]:
            return now.drop("moved")
        now = now.drop("moved")


def group_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
                   min_count: int = MIN_COUNT, ratio: int = RATIO, damage: int = DAMAGE, bits: int = BITS,
                   max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for each word of the vocabulary."""
    vocabulary = cut(count_words(docs, id_col, text_col, min_length, min_count, damage))
    best = near_words(vocabulary, bits, max_blocks).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    rows = vocabulary.join(best, "word", "left")
    large = -F.col("best.less") >= F.col("n") * ratio
    rows = cut(rows.select("word", F.when(large, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                           F.when(large, -F.col("best.less")).alias("form_n")))
    ends = roots(rows.where("form IS NOT NULL"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def oracle_sql() -> str:
    return f"""WITH RECURSIVE t AS ({CRC_TABLE}),
r AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
g AS (SELECT doc_id, run, count(*) AS n FROM r WHERE length(run) >= {MIN_LENGTH} GROUP BY ALL),
h AS (SELECT run, n, {crc_sql("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM g, t),
w AS (SELECT CASE WHEN h % {DAMAGE} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
v AS (SELECT word, sum(n)::BIGINT AS n FROM w WHERE length(word) >= {MIN_LENGTH} GROUP BY word HAVING sum(n) >= {MIN_COUNT}),
p AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM v),
d AS (SELECT word, n, p, substr(word, 1, p - 1) AS a, substr(word, p + 1) AS b FROM p),
l AS (SELECT x.word, y.word AS near, y.n FROM d x JOIN d y USING (p, a, b) WHERE x.word <> y.word
      UNION SELECT d.word, v.word, v.n FROM d JOIN v ON v.word = a || b
      UNION SELECT v.word, d.word, d.n FROM d JOIN v ON v.word = a || b),
m AS (SELECT word, count(*) AS n_near, min({{'less': -n, 'near': near}}) AS best FROM l GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -best.less >= {RATIO} * n THEN best.near END AS form,
             CASE WHEN -best.less >= {RATIO} * n THEN (-best.less)::BIGINT END AS form_n FROM v LEFT JOIN m USING (word)),
c AS (SELECT word, word AS root, form FROM f UNION ALL SELECT c.word, f.word, f.form FROM c JOIN f ON f.word = c.form)
SELECT word, f.form, c.root, n, n_near, form_n FROM f JOIN c USING (word) WHERE c.form IS NULL
"""
