"""Substring dedup: Rabin-Karp hashes of token windows, counted in Spark.

A word is a maximal run of bytes other than space and 0x09-0x0D.  Every window
of ``width`` consecutive words of one row is hashed (polynomial hash modulo
2**64 from prefix sums, so each window costs constant time).  A window is
removed when the same word sequence also starts in a row with a smaller id;
overlapping removed windows merge into maximal removal intervals, and windows
are judged on the input.

Plan: ``repeats.shared_runs`` drops the windows that hold a word-gram found
nowhere else; the hashes of the others are shuffled, grouped by bucket, and
each hash keeps its smallest id.  Windows are combined in each chunk before the
shuffle (only those of the smallest id travel), and the windows of a hot key
are dealt by their own hash, so no bucket follows a hot passage.  Two different
windows are taken as equal only if their 64-bit hashes and their buckets agree.

Defined cases: a null or empty text has no words; a row of fewer words than
``width`` keeps all; a null id is larger than all others; rows that share an id
don't remove each other's words; equal rows get equal results; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import CHUNK_BYTES, NULL_ID, chunks, utf8, join_runs, keyed, ranges, span_hash, token_hash, tokens
from larder.llm.repeats import (BUCKET_BYTES, HOT_RUNS, RUN_KINDS, pack, removed_mask, repeated_windows, rows_of,
                                runs_table, unpack)

WIDTH = 50
RESULT = "doc_id long, n_words long, spans array<struct<start:int,end:int>>, kept string"


def word_units(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s, e, woff = tokens(data, offs)
    return token_hash(data, s, e), woff


def _by_hash(h, did, removed_from):
    """Marks entries whose id is larger than the smallest id with their hash."""
    order = np.lexsort((did, h))
    hs, ds = h[order], did[order]
    at = np.flatnonzero(np.r_[True, hs[1:] != hs[:-1]])
    low = np.repeat(ds[at], np.diff(np.append(at, len(hs))))
    removed_from[order] = ds > low
    return removed_from


def compare_map(data, sums, uoff, did, th, key, row, start, n, hot, buckets, width):
    run = np.repeat(np.arange(len(key)), n)
    pos = ranges(start, n)
    unit = uoff[row][run] + pos
    h = span_hash(sums, unit, unit + width)
    wdid, wth = did[row][run], th[row][run]
    gone = _by_hash(h, wdid, np.zeros(len(h), bool))
    if gone.any():
        d, t, s, m = join_runs(wdid[gone], wth[gone], pos[gone])
        yield pack((d % buckets).astype(np.int32), True, did=d, th=t, start=s.astype(np.int32), n=m.astype(np.int32))
    keep = np.flatnonzero(~gone)
    of_key = np.where(np.isin(key, hot)[run][keep], h[keep], key[run][keep])
    yield pack((of_key % np.uint64(buckets)).astype(np.int32), False, keys=h[keep], did=wdid[keep], th=wth[keep],
               start=pos[keep].astype(np.int32))


def compare_reduce(table: pa.Table) -> pa.Table:
    seen = unpack(table, True, **RUN_KINDS)
    new = unpack(table, False, keys=np.uint64, did=np.int64, th=np.int64, start=np.int32)
    gone = _by_hash(new["keys"], new["did"], np.zeros(len(new["did"]), bool)) if len(new["did"]) else np.zeros(0, bool)
    return runs_table(tuple(seen.values()), join_runs(new["did"][gone], new["th"][gone], new["start"][gone]))


def _marked(rows: DataFrame, width: int, bucket_bytes: int, hot_runs: int) -> DataFrame:
    return repeated_windows(rows, word_units, width, -(-width // 2), lambda *a: compare_map(*a, width), compare_reduce,
                            bucket_bytes, hot_runs)


def _cut_rows(data: np.ndarray, offs: np.ndarray, gone, width: int):
    """Word count, removed word intervals and kept text of each row of a chunk."""
    s, e, woff = tokens(data, offs)
    for i in range(len(offs) - 1):
        a, b = woff[i], woff[i + 1]
        mask = removed_mask(b - a, gone[i].as_py(), width)
        edge = np.flatnonzero(np.diff(np.r_[False, mask, False].astype(np.int8)))
        left = np.flatnonzero(~mask) + a
        yield (int(b - a), [{"start": int(p), "end": int(z)} for p, z in zip(edge[::2], edge[1::2])],
               _joined(data, s[left], e[left]))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
                    bucket_bytes: int = BUCKET_BYTES, hot_runs: int = HOT_RUNS) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, n_words, spans, kept``.
    ``spans`` are the maximal removed word intervals [start, end); ``kept`` is
    the remaining words joined by one space."""
    marked = _marked(keyed(docs, id_col, text_col), width, bucket_bytes, hot_runs)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in rows_of(batch):
                counts, spans, kept = zip(*_cut_rows(data, offs, batch.column(2).slice(lo, hi - lo), width))
                ids = pa.array([None if d == NULL_ID else d for d in batch.column(0)[lo:hi].to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(counts, pa.int64()),
                     pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                     pa.array(kept, pa.string())], names=["doc_id", "n_words", "spans", "kept"])

    return marked.select("did", "text", "gone").mapInArrow(finish, RESULT)


def remove_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None,
                      width: int = WIDTH, bucket_bytes: int = BUCKET_BYTES, hot_runs: int = HOT_RUNS) -> DataFrame:
    """``docs``, all rows and columns, with the repeated words taken out of the
    text (a row that loses none is unchanged) and, where named, its length in
    characters put in ``length_col``."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rows = keyed(docs.select(row).select("_row", F.col(f"_row.`{id_col}`").alias("_id"), F.col(f"_row.`{text_col}`").alias("_text")),
                 "_id", "_text", ["_row"])

    @F.pandas_udf("string")
    def kept_text(text: pd.Series, gone: pd.Series) -> pd.Series:
        data, offs = utf8(pa.array(text, pa.string()))
        runs = [pa.scalar([dict(g) for g in v] if v is not None else None,
                          pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32())]))) for v in gone]
        return pd.Series([k.decode() for lo, hi in chunks(offs, CHUNK_BYTES)
                          for _, _, k in _cut_rows(data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo], runs[lo:hi], width)], dtype=object)

    marked = _marked(rows, width, bucket_bytes, hot_runs)
    new = marked.select("_row", F.col("gone").isNotNull().alias("cut"),
                        F.when(F.col("gone").isNotNull(), kept_text(F.when(F.col("gone").isNotNull(), F.col("text")).otherwise(""), "gone"))
                        .alias("kept"))
    out = []
    for c in docs.columns:
        own = F.col(f"_row.`{c}`")
        if c == text_col:
            own = F.when(F.col("cut"), F.col("kept")).otherwise(own)
        elif c == length_col:
            own = F.when(F.col("cut"), F.length("kept").cast(docs.schema[c].dataType)).otherwise(own)
        out.append(own.alias(c))
    return new.select(*out)


def _joined(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> bytes:
    """Words joined by one space: each is copied with the byte after it, which becomes the space."""
    if not len(s):
        return b""
    size = e - s + 1
    out = np.full(int(size.sum()), 32, np.uint8)
    ends = np.cumsum(size) - 1
    fill = np.ones(len(out), bool)
    fill[ends] = False
    out[fill] = data[ranges(s, e - s)]
    return out[:-1].tobytes()
