"""Where a table may hold repeated windows, found without moving every window.

A window is ``length`` consecutive units (words or bytes) of one row.  Its
*key* is the least hash among its ``q``-grams, so equal windows have equal
keys, and neighbouring windows mostly share one: a row falls into runs of
consecutive windows with one key.  ``shared_runs`` counts the runs of each key
over the whole table; windows of a key that occurs in one run only repeat
nothing, unless the run repeats itself (its key recurs within a window, or it
is longer than a gram can be seen for).  This drops the runs that need no
comparison and keeps all others.

Volume: one entry for about (length - q) / 2 windows is shuffled, in binary
columns, one row for each chunk of text and bucket.  The number of buckets
follows the bytes of text.  Runs of one key in a chunk are combined first, so
the hottest key costs one entry for each chunk of ``CHUNK_BYTES``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import (CHUNK_BYTES, chunks, column, cut, gram_hash, id_back, join_runs, prefix, ranges,
                               sliding_min, text_bytes, utf8)

#: Bytes of text for each bucket.
BUCKET_BYTES = 16 << 20
#: A key with more runs than this (and than a millionth of the bytes) is split by window.
HOT_RUNS = 20_000

Units = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]

RUN_SCHEMA = "did long, th long, start int, n int"
PACKED = pa.schema([("bucket", pa.int32()), ("known", pa.bool_()), ("keys", pa.binary()), ("counts", pa.binary()),
                    ("did", pa.binary()), ("th", pa.binary()), ("start", pa.binary()), ("n", pa.binary())])
PACKED_DDL = ("bucket int, known boolean, keys binary, counts binary, did binary, th binary, start binary, n binary")


def key_runs(x: np.ndarray, uoff: np.ndarray, sums: np.ndarray, length: int, q: int, within: bool = False):
    """Runs of windows with one key: ``(key, row, first window, windows)`` and,
    if ``within``, whether a run may repeat a window of its own (else None)."""
    grams, width = gram_hash(sums, q), length - q + 1
    low = sliding_min(grams, width)
    size = np.diff(uoff)
    long = np.flatnonzero(size >= length)
    if not len(long):
        none = np.empty(0, np.int64)
        return np.empty(0, np.uint64), none, none, none, np.empty(0, bool)
    mark = np.zeros(len(low) + 1, np.int8)
    mark[uoff[long]] += 1
    mark[uoff[long + 1] - length + 1] -= 1
    inside = np.cumsum(mark[:-1], dtype=np.int8) > 0
    change = np.ones(len(low), bool)
    change[1:] = low[1:] != low[:-1]
    change[uoff[long]] = True
    s = np.flatnonzero(inside & change)
    row = np.searchsorted(uoff, s, "right") - 1
    stop = np.minimum(np.append(s[1:], np.iinfo(np.int64).max), uoff[row + 1] - length + 1)
    again = None
    if within:
        # places where a gram is the least of some window; two equal neighbours of them share windows
        edge = np.zeros(width - 1, np.uint64)
        at = np.flatnonzero(sliding_min(np.concatenate([edge, low, edge]), width, np.maximum) == grams)
        twice = np.flatnonzero((grams[at[1:]] == grams[at[:-1]]) & (at[1:] - at[:-1] < width))
        mark = np.zeros(len(low) + 1, np.int64)
        np.add.at(mark, np.maximum(at[twice + 1] - width + 1, 0), 1)
        np.add.at(mark, np.minimum(at[twice] + 1, len(low)), -1)
        marked = np.r_[0, np.cumsum(np.cumsum(mark[:-1]) > 0)]
        again = (stop - s > width) | (marked[stop] > marked[s])
    return low[s], row, s - uoff[row], stop - s, again


def rows_of(batch, size: int = CHUNK_BYTES) -> Iterator[tuple]:
    """Chunks ``(lo, hi, data, offs)`` of a batch's text."""
    data, offs = utf8(batch.column(batch.schema.get_field_index("text")))
    for lo, hi in chunks(offs, size):
        yield lo, hi, data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo]


def pack(bucket: np.ndarray, known: bool, n_entries: np.ndarray | None = None, **cols: np.ndarray) -> pa.RecordBatch | None:
    """One row for each bucket with the entries' columns as bytes."""
    if not len(bucket):
        return None
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    at = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
    ends = np.append(at[1:], len(b))
    out: dict[str, list] = {"bucket": b[at].astype(np.int32).tolist(), "known": [known] * len(at)}
    sorted_cols = {k: v[order] for k, v in cols.items()}
    for f in PACKED.names[2:]:
        v = sorted_cols.get(f)
        out[f] = [v[i:j].tobytes() if v is not None else b"" for i, j in zip(at, ends)]
    return pa.RecordBatch.from_pydict(out, schema=PACKED)


def unpack(table: pa.Table, known: bool, **kinds) -> dict[str, np.ndarray]:
    rows = table.filter(pc.equal(table["known"], known))
    return {k: np.frombuffer(b"".join(rows[k].to_pylist()), t) for k, t in kinds.items()}


RUN_KINDS = {"did": np.int64, "th": np.int64, "start": np.int32, "n": np.int32}


def shared_runs(docs: DataFrame, units: Units, length: int, q: int, buckets: int, hot: int, within: bool) -> DataFrame:
    """Runs whose key occurs in more than one run, or that may repeat
    themselves where ``within`` is set (columns of ``RUN_SCHEMA``, ``hot_key``
    null), and one row for each key with more than ``hot`` runs
    (``hot_key`` set)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            did, th = column(batch, "did"), column(batch, "th")
            for lo, hi, data, offs in rows_of(batch):
                x, uoff = units(data, offs)
                key, row, start, n, again = key_runs(x, uoff, prefix(x), length, q, within)
                if not len(key):
                    continue
                _, first, inverse, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
                cols = {"did": did[lo + row], "th": th[lo + row],
                        "start": start.astype(np.int32), "n": n.astype(np.int32)}
                first.sort()
                entry = pack((key[first] % np.uint64(buckets)).astype(np.int32), False, keys=key[first],
                             counts=count[inverse[first]].astype(np.int32), **{k: v[first] for k, v in cols.items()})
                yield entry
                many = np.flatnonzero((count[inverse] > 1) | (again if within else False))
                known = pack((cols["did"][many] % buckets).astype(np.int32), True, **{k: v[many] for k, v in cols.items()})
                if known is not None:
                    yield known

    out_schema = pa.schema([("hot_key", pa.int64()), ("did", pa.int64()), ("th", pa.int64()), ("start", pa.int32()),
                            ("n", pa.int32())])

    def count_keys(table: pa.Table) -> pa.Table:
        seen = unpack(table, True, **RUN_KINDS)
        new = unpack(table, False, keys=np.uint64, counts=np.int32, **RUN_KINDS)
        keys, inverse, entries = np.unique(new["keys"], return_inverse=True, return_counts=True)
        total = np.bincount(inverse, weights=new["counts"], minlength=len(keys))
        # an entry that stands for one run is returned here; the others are in ``seen`` already
        back = np.flatnonzero((new["counts"] == 1) & (entries[inverse] > 1)) if len(keys) else np.empty(0, np.int64)
        hot_keys = keys[total > hot].astype(np.int64)
        none, zeros = pa.nulls(len(back) + len(seen["did"]), pa.int64()), np.zeros(len(hot_keys), np.int64)
        cols = [pa.chunked_array([none, pa.array(hot_keys)], pa.int64())]
        for k, t in (("did", np.int64), ("th", np.int64), ("start", np.int32), ("n", np.int32)):
            cols.append(pa.array(np.concatenate([new[k][back], seen[k], zeros.astype(t)])))
        return pa.table(cols, schema=out_schema)

    packed = docs.mapInArrow(scan, PACKED_DDL)
    return packed.groupBy("bucket").applyInArrow(count_keys, "hot_key long, " + RUN_SCHEMA)


def repeated_windows(docs: DataFrame, units: Units, length: int, q: int, compare_map, compare_reduce,
                     bucket_bytes: int = BUCKET_BYTES, hot_runs: int = HOT_RUNS, within: bool = False) -> DataFrame:
    """Every row of ``docs`` (columns did, th, text and any others) with a
    column ``gone``, which lists the runs of removed windows as structs ``(start, n)``, null where there are none.

    ``compare_map(rows, row ids, chosen runs, hot keys, buckets)`` packs the
    chosen windows of a chunk; ``compare_reduce`` settles a bucket and returns
    runs of windows to remove."""
    texts = docs.select("did", "th", "text")
    total = text_bytes(texts)
    buckets = max(8, -(-total // bucket_bytes))
    found = cut(shared_runs(texts, units, length, q, buckets, max(hot_runs, total // 1_000_000), within))
    # at most a million keys: each has more runs than a millionth of the bytes
    hot = np.sort(np.array([r[0] for r in found.where("hot_key IS NOT NULL").select("hot_key").collect()],
                           np.int64).astype(np.uint64))
    hot_keys = docs.sparkSession.sparkContext.broadcast(hot)
    lists = (found.where("hot_key IS NULL").groupBy("did", "th")
             .agg(F.sort_array(F.collect_set("start")).alias("starts")))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            did, th = column(batch, "did"), column(batch, "th")
            starts = batch.column(batch.schema.get_field_index("starts"))
            chosen, coff = starts.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(starts.value_lengths().to_numpy())]
            for lo, hi, data, offs in rows_of(batch):
                x, uoff = units(data, offs)
                sums = prefix(x)
                key, row, start, n, _ = key_runs(x, uoff, sums, length, q)
                want = (np.repeat(np.arange(hi - lo, dtype=np.int64), np.diff(coff[lo:hi + 1])) << 32) | chosen[coff[lo]:coff[hi]]
                pick = np.isin((row << 32) | start, want)
                if pick.any():
                    yield from compare_map(data, sums, uoff, did[lo:hi], th[lo:hi], key[pick], row[pick],
                                           start[pick], n[pick], hot_keys.value, buckets)

    gone = (texts.join(lists, ["did", "th"]).select("did", "th", "text", "starts").mapInArrow(scan, PACKED_DDL)
            .groupBy("bucket").applyInArrow(compare_reduce, RUN_SCHEMA)
            .groupBy("did", "th").agg(F.collect_set(F.struct("start", "n")).alias("gone")))
    return docs.join(gone, ["did", "th"], "left").select(*docs.columns, "gone")


def removed_mask(size: int, gone, length: int) -> np.ndarray:
    """Which of ``size`` units are covered by removed windows."""
    mark = np.zeros(size + 1, np.int32)
    if gone:
        start = np.fromiter((g["start"] for g in gone), np.int64, len(gone))
        n = np.fromiter((g["n"] for g in gone), np.int64, len(gone))
        np.add.at(mark, start, 1)
        np.add.at(mark, start + n + length - 1, -1)
    return np.cumsum(mark[:-1]) > 0


def runs_table(*parts: tuple[np.ndarray, ...]) -> pa.Table:
    """Runs ``(did, th, start, n)`` as a table of ``RUN_SCHEMA``."""
    cols = [np.concatenate([p[i] for p in parts]).astype(t) for i, t in enumerate(RUN_KINDS.values())]
    return pa.table([pa.array(c) for c in cols], names=list(RUN_KINDS))


__all__ = ["repeated_windows", "removed_mask", "runs_table", "pack", "unpack", "join_runs", "ranges", "id_back"]
