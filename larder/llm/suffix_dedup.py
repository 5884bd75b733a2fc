"""Suffix-array dedup on bytes by bucket-pointer refinement.

A byte is removed when it lies in a string of ``length`` bytes of its row that
also starts earlier: in a row with a smaller id, or earlier in the same row.
Matches don't cross rows, overlaps count, and strings are judged on the input.

The suffixes that can share ``length`` bytes with another are found by q-gram
buckets over the whole table (``repeats.shared_runs``).  The bytes of their
runs are dealt out by bucket.  In a bucket, suffixes start with the identifier
of their q-gram; each round sorts those that still share a bucket on (bucket,
bucket of the suffix a few bytes on), numbers the groups anew and reuses the
new numbers in the next round, which doubles the compared depth until it is
``length``.  A suffix alone in its bucket needs no further round.  The depth-8
buckets are the bytes themselves and every later bucket is a pair of exact
buckets, so the comparison is exact.

Equal runs are combined in each chunk before the shuffle; the suffixes of a hot
key are dealt by a hash of their ``length`` bytes, so no bucket follows a hot
passage.

Defined cases: a null text is empty; a row shorter than ``length`` loses
nothing; a null id is larger than all others; different texts under one id
don't remove each other's bytes; equal rows get equal results; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame

from larder.llm.common import BYTE_VALUES, NULL_ID, bytes_hash, fmix, gram_hash, keyed, prefix, ranges
from larder.llm.repeats import (BUCKET_BYTES, HOT_RUNS, RUN_KINDS, join_runs, pack, removed_mask, repeated_windows,
                                rows_of, runs_table, unpack)

LENGTH = 100
Q = 32
#: Bytes of run text refined at a time.
BATCH_BYTES = 1 << 20
RESULT = "doc_id long, n_bytes long, spans array<struct<start:int,end:int>>, kept binary"


def byte_units(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return BYTE_VALUES[data], offs


def _earlier_known(h, did, th, pos):
    """Marks strings (hash or bucket ``h``) that also start earlier: under a
    smaller id, or earlier in the same row.  Repeated rows are one row."""
    out = np.zeros(len(h), bool)
    if not len(h):
        return out
    order = np.lexsort((pos, th, did, h))
    h, did, th, pos = h[order], did[order], th[order], pos[order]
    new = np.r_[True, h[1:] != h[:-1]]
    own = new | np.r_[True, (did[1:] != did[:-1]) | (th[1:] != th[:-1])]
    first = lambda flag, v: np.repeat(v[flag], np.diff(np.append(np.flatnonzero(flag), len(v))))
    out[order] = (did > first(new, did)) | (pos > first(own, pos))
    return out


def compare_map(data, sums, uoff, did, th, key, row, start, n, hot, buckets, length):
    is_hot = np.isin(key, hot)
    if is_hot.any():  # one entry for each suffix
        cold = ~is_hot
        row = np.concatenate([row[cold], np.repeat(row[is_hot], n[is_hot])])
        flat = ranges(start[is_hot], n[is_hot])
        heat = np.r_[np.zeros(cold.sum(), bool), np.ones(len(flat), bool)]
        key = np.concatenate([key[cold], np.zeros(len(flat), np.uint64)])
        start, n = np.concatenate([start[cold], flat]), np.concatenate([n[cold], np.ones(len(flat), np.int64)])
    else:
        heat = is_hot
    unit = uoff[row] + start
    h = bytes_hash(data, unit, unit + n + length - 1)
    rdid, rth = did[row], th[row]
    gone = _earlier_known(h, rdid, rth, start)
    if gone.any():
        d = rdid[gone]
        yield pack((d % buckets).astype(np.int32), True, did=d, th=rth[gone], start=start[gone].astype(np.int32),
                   n=n[gone].astype(np.int32))
    keep = np.flatnonzero(~gone)
    bucket = (np.where(heat[keep], h[keep], key[keep]) % np.uint64(buckets)).astype(np.int32)
    keep = keep[np.argsort(bucket, kind="stable")]
    bucket.sort()
    at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    packer = zstandard.ZstdCompressor(level=1)
    for i, j in zip(at, np.append(at[1:], len(keep))):
        k = keep[i:j]
        text = packer.compress(data[ranges(unit[k], n[k] + length - 1)].tobytes())
        part = pack(bucket[i:j], False, counts=np.where(heat[k], h[k], key[k]), did=rdid[k], th=rth[k], start=start[k].astype(np.int32), n=n[k].astype(np.int32))
        yield part.set_column(2, part.schema.field(2), pa.array([text], pa.binary()))


def _number(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dense bucket identifiers of values, and whether each bucket has several members."""
    order = np.argsort(pairs, kind="stable")
    v = pairs[order]
    new = np.ones(len(v), bool)
    new[1:] = v[1:] != v[:-1]
    out = np.empty(len(v), np.int64)
    out[order] = np.cumsum(new) - 1
    many = np.empty(len(v), bool)
    alone = new & np.r_[new[1:], True]
    many[order] = ~alone
    return out, many


def refine(text: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the suffixes at positions ``at`` to the depth ``length``, and
    whether a suffix shares its bucket.  Each suffix has ``length`` bytes in ``text``."""
    depth = min(8, length)
    packed = np.zeros(len(text), np.uint64)
    for k in range(depth):  # a gram that runs over the end is padded; no suffix in ``at`` reads it
        packed[:len(text) - k] |= text[k:].astype(np.uint64) << np.uint64(8 * k)
    ids, many = _number(packed)
    while depth < length:
        step = min(depth, length - depth)
        # the ends of the remaining depth, at any position a later round may read
        live = np.flatnonzero(many[:len(text) - step])
        fresh = np.zeros(len(text), np.int64)
        shared = np.zeros(len(text), bool)
        fresh[live], shared[live] = _number((ids[live] << 32) | ids[live + step])
        # suffixes alone in their bucket keep an identifier of their own
        single = np.ones(len(text), bool)
        single[live] = False
        fresh[single] = len(live) + np.arange(int(single.sum()))
        ids, many, depth = fresh, shared, depth + step
    return ids[at], many[at]


def compare_reduce(table: pa.Table, length: int, q: int) -> pa.Table:
    """Settles a bucket in batches of whole keys: only runs of one key can share suffixes."""
    seen = unpack(table, True, **RUN_KINDS)
    new = unpack(table, False, counts=np.uint64, **RUN_KINDS)
    packed = table.filter(pc.invert(table["known"]))["keys"].to_pylist()
    text = np.frombuffer(b"".join(map(zstandard.ZstdDecompressor().decompress, packed)), np.uint8)
    out = [tuple(seen.values())]
    if len(new["did"]):
        size = new["n"].astype(np.int64) + length - 1
        base = np.cumsum(size) - size
        order = np.argsort(new["counts"], kind="stable")
        key = new["counts"][order]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        before = np.r_[0, np.cumsum(size[order])][starts]
        cuts = starts[np.flatnonzero(np.r_[True, before[1:] // BATCH_BYTES != before[:-1] // BATCH_BYTES])]
        for i, j in zip(cuts, np.append(cuts[1:], len(order))):
            k = order[i:j]
            out += _settle(text[ranges(base[k], size[k])], key[i:j], *(new[c][k] for c in RUN_KINDS), length, q)
    return runs_table(*out)


def _settle(text, key, did, th, start, n, length, q):
    """Removed runs among runs ``(did, th, start, n)`` whose bytes follow each other in ``text``."""
    n = n.astype(np.int64)
    base = np.r_[0, np.cumsum(n + length - 1)]
    # runs whose whole text starts earlier are settled; a run that is then alone
    # under its key repeats nothing, unless its own q-gram recurs in it
    sums = prefix(BYTE_VALUES[text])
    later = _earlier_known(fmix(key) + bytes_hash(text, base[:-1], base[1:]), did, th, start)
    yield did[later], th[later], start[later], n[later]
    _, inverse = np.unique(key, return_inverse=True)
    alone = np.bincount(inverse[~later], minlength=len(key))[inverse] == 1
    own = np.zeros(len(text), np.int32)
    grams = gram_hash(sums, q)
    own[:len(grams)] = grams == np.repeat(key, n + length - 1)[:len(grams)]
    recurs = np.add.reduceat(own, base[:-1]) > 1
    todo = np.flatnonzero(~later & (~alone | recurs))
    if not len(todo):
        return
    text, did, th, start = text[ranges(base[todo], n[todo] + length - 1)], did[todo], th[todo], start[todo]
    n = n[todo]
    run = np.repeat(np.arange(len(n)), n)
    ids, many = refine(text, ranges(np.cumsum(n + length - 1) - (n + length - 1), n), length)
    pos, run = ranges(start, n)[many], run[many]
    gone = _earlier_known(ids[many], did[run], th[run], pos)
    yield join_runs(did[run][gone], th[run][gone], pos[gone])


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, q: int = Q,
                 bucket_bytes: int = BUCKET_BYTES, hot_runs: int = HOT_RUNS) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, n_bytes, spans, kept``.
    ``spans`` are the maximal removed byte intervals [start, end); ``kept`` is
    the remaining bytes (they may split a character, hence binary)."""
    rows = keyed(docs, id_col, text_col)
    marked = repeated_windows(rows, byte_units, length, min(q, length), lambda *a: compare_map(*a, length),
                              lambda t: compare_reduce(t, length, min(q, length)), bucket_bytes, hot_runs, within=True)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            did, gone = batch.column(0), batch.column(2)
            for lo, hi, data, offs in rows_of(batch):
                spans, kept = [], []
                for i in range(hi - lo):
                    own = data[offs[i]:offs[i + 1]]
                    runs = gone[lo + i].as_py()
                    mask = removed_mask(len(own), runs, length)
                    edge = np.flatnonzero(np.diff(np.r_[False, mask, False].astype(np.int8)))
                    spans.append([{"start": int(p), "end": int(z)} for p, z in zip(edge[::2], edge[1::2])])
                    kept.append(own[~mask].tobytes() if runs else own.tobytes())
                ids = pa.array([None if d == NULL_ID else d for d in did[lo:hi].to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(np.diff(offs)),
                     pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                     pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    return marked.select("did", "text", "gone").mapInArrow(finish, RESULT)
