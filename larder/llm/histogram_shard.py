"""Sharding by histogram sort.

Documents are sorted by (hash of the text, id) and cut into shards of near
equal bytes.  Where to cut is found by probing: each round counts the exact
bytes and rows below a sorted list of probe keys in every partition (one small
row for each probe and task), and each cut keeps the bracket between the two
probes around its target.  Brackets shrink to the least and largest key in
them, so a run of equal keys is isolated at once.  A cut is settled when the
bytes below it are within ``tolerance`` of a shard of the target, or when its
bracket holds one key.  Only keys and sizes are probed.  Then the rows, with
all their columns, are exchanged once, by their piece.

Equal texts share a hash, so they lie together in the order; a group is cut
only where keeping it whole would miss the tolerance, and then between ids.

Each shard is cut into pieces of about ``piece_bytes``, so a task sorts one
piece, not one shard; the rows below a piece are known from the histogram and
make its first slot.

Defined cases: a null text has no bytes (size 16); a null id sorts last and is
returned as null; rows with one key (equal id and text) stay together; other
columns go along; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import NULL_ID, column, cut

SHARDS, OVERHEAD = 40, 16
TOLERANCE, PROBES, PIECE_BYTES, MAX_ROUNDS = 0.002, 32, 256 << 20, 80
_BIAS = 1 << 63


def _key(h: int, did: int) -> int:
    """(h, did) as one unsigned 128-bit integer in the same order."""
    return (h + _BIAS) << 64 | (did + _BIAS)


def _halves(keys: list[int]) -> tuple[np.ndarray, np.ndarray]:
    return (np.array([(k >> 64) - _BIAS for k in keys], np.int64),
            np.array([(k & ((1 << 64) - 1)) - _BIAS for k in keys], np.int64))


def _below(h: np.ndarray, did: np.ndarray, ph: np.ndarray, pdid: np.ndarray) -> np.ndarray:
    """Number of probes at or below each row's key."""
    order = np.lexsort((np.r_[np.zeros(len(ph)), np.ones(len(h))], np.r_[pdid, did], np.r_[ph, h]))
    seen = np.cumsum(order < len(ph))
    out = np.empty(len(order), np.int64)
    out[order] = seen
    return out[len(ph):]


def _histogram(rows: DataFrame, probes: list[int]) -> dict[int, tuple]:
    """For each gap between probes that has rows: bytes, rows, least key, largest key."""
    ph, pdid = _halves(probes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, did, size = column(batch, "h"), column(batch, "did"), column(batch, "size")
            gap = _below(h, did, ph, pdid)
            order = np.lexsort((did, h))
            g = gap[order]
            at = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.empty(0, np.int64)
            end = np.append(at[1:], len(g)) - 1 if len(g) else at
            if len(at):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(g[at]), pa.array(np.add.reduceat(size[order], at)), pa.array(end - at + 1),
                     *(pa.array(v[order][i]) for i in (at, end) for v in (h, did))],
                    names=["gap", "bytes", "rows", "low_h", "low_did", "high_h", "high_did"])

    found = (rows.select("h", "did", "size").mapInArrow(
        count, "gap long, bytes long, rows long, low_h long, low_did long, high_h long, high_did long")
        .groupBy("gap").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"),
                            F.min(F.struct("low_h", "low_did")).alias("low"), F.max(F.struct("high_h", "high_did")).alias("high")))
    return {r["gap"]: (r["bytes"], r["rows"], _key(*r["low"]), _key(*r["high"])) for r in found.collect()}


def find_cuts(rows: DataFrame, parts: int, tolerance: float = TOLERANCE, probes_each: int = PROBES) -> list[tuple[int, int, int]]:
    """``(key, bytes below, rows below)`` for each of the ``parts - 1`` cuts
    of the table ``(h, did, size)``; ``tolerance`` is a share of one part."""
    whole = _histogram(rows, [])
    if not whole:
        return []
    total, n, low, high = whole[0]
    slack = tolerance * total / parts
    goal = [total * (i + 1) / parts for i in range(parts - 1)]
    # a mark is (key, bytes below, rows below); a bracket is two marks around the goal
    bracket = [((low, 0, 0), (high + 1, total, n))] * (parts - 1)
    done: list = [None] * (parts - 1)
    for _ in range(MAX_ROUNDS):
        for i, (lo, hi) in enumerate(bracket):
            near = min(lo, hi, key=lambda m: abs(m[1] - goal[i]))
            if abs(near[1] - goal[i]) <= slack or hi[0] - lo[0] == 1:
                done[i] = near
        sought = Counter((bracket[i][0][0], bracket[i][1][0]) for i in range(parts - 1) if done[i] is None)
        if not sought:
            return done
        probes: set[int] = set()
        for (lo, hi), cuts in sought.items():
            # the ends set the first and the last key apart
            probes.update((lo + 1, hi - 1), (lo + (hi - lo) * k // (probes_each * cuts) for k in range(1, probes_each * cuts)))
            first, last = (lo >> 64) + 1, hi >> 64
            probes.update(first + (last - first) * k // 8 << 64 for k in range(8) if first < last)  # between two texts
        gaps = _histogram(rows, sorted(probes))
        marks, below, count = [], 0, 0
        for gap in sorted(gaps):
            more, rows_in, least, largest = gaps[gap]
            marks += [(least, below, count), (largest + 1, below + more, count + rows_in)]
            below, count = below + more, count + rows_in
        at = [m[1] for m in marks]
        for i in range(parts - 1):
            if done[i] is None:
                j = bisect_right(at, goal[i])
                bracket[i] = (max([bracket[i][0], *marks[max(j - 1, 0):j]], key=itemgetter(0)),
                              min([bracket[i][1], *marks[j:j + 1]], key=itemgetter(0)))
    raise RuntimeError("cuts did not settle")


def shard_rows(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", overhead: int = OVERHEAD,
               tolerance: float = TOLERANCE, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """``docs``, all columns, and ``shard, slot``: the rows of a piece of a
    shard lie in one partition in their order; ``slot`` is the row's place in its
    shard, from 0 without gaps.  Columns of ``docs`` with these names are replaced."""
    names = [c for c in docs.columns if c not in ("shard", "slot")]
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    h, did = F.xxhash64(text).alias("h"), F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_ID)).alias("did")
    rows = cut(docs.select(h, did, (F.octet_length(text) + overhead).cast("long").alias("size")))
    total = rows.agg(F.sum("size")).first()[0] or 0
    each = max(1, -(-total // (shards * piece_bytes)))
    cuts = find_cuts(rows, shards * each, tolerance)
    ph, pdid = _halves([c[0] for c in cuts])
    first = [0] + [c[2] for c in cuts]
    base = np.array([first[p] - first[p - p % each] for p in range(len(first))], np.int64)

    @F.pandas_udf("piece int, base long")
    def place(h: pd.Series, did: pd.Series) -> pd.DataFrame:
        piece = _below(h.to_numpy(), did.to_numpy(), ph, pdid)
        return pd.DataFrame({"piece": piece.astype(np.int32), "base": base[piece]})

    # only the key goes to Python; the whole row goes through the exchange of the window
    whole = docs.select(*[F.col(f"`{c}`").alias(f"_row{i}") for i, c in enumerate(names)], h, did)
    placed = whole.withColumn("at", place("h", "did")).select(
        *[f"_row{i}" for i in range(len(names))], "h", "did", "at.piece", "at.base")
    order = Window.partitionBy("piece").orderBy("h", "did", f"_row{names.index(text_col)}")
    return placed.select(
        *[F.col(f"_row{i}").alias(c) for i, c in enumerate(names)], F.floor(F.col("piece") / each).cast("int").alias("shard"),
        (F.col("base") + F.row_number().over(order) - 1).alias("slot"))


def digests(sharded: DataFrame, id_col: str = "doc_id", text_col: str = "text", overhead: int = OVERHEAD) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` of sharded rows; ``size`` is the text's bytes and ``overhead``."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return sharded.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), (F.octet_length(text) + overhead).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), "shard", "slot")


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", overhead: int = OVERHEAD,
          tolerance: float = TOLERANCE, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """``digests`` of ``shard_rows``: one row for each row of ``docs``."""
    return digests(shard_rows(docs, shards, id_col, text_col, overhead, tolerance, piece_bytes), id_col, text_col, overhead)
