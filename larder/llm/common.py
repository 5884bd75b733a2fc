"""Helpers shared by the operators of this subpackage.

Rows are addressed by ``(did, th)``: ``did`` is the id with null mapped to the
largest 64-bit integer (a null id sorts after all others) and ``th`` is a
64-bit hash of the text, so rows that repeat an id with another text stay
apart and equal rows share one result.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NULL_ID = (1 << 63) - 1
CHUNK_BYTES = 2 << 20
LONG_TOKEN = 64
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


# ------------------------------------------------------------------ Spark side
def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one is
    set only for a local session that names none (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="larder-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def keyed(docs: DataFrame, id_col: str, text_col: str, also: list[str] | None = None) -> DataFrame:
    """``(did, th, text)`` of a table and the columns ``also``; others,
    whatever their names, are left out.  A null text is empty."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return docs.select(
        F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_ID)).alias("did"),
        F.xxhash64(text).alias("th"), text.alias("text"), *(also or []))


def id_back(name: str = "did"):
    return F.nullif(F.col(name), F.lit(NULL_ID))


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


# ------------------------------------------------------------------ Arrow side
def utf8(col) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string or binary Arrow array (null: empty)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    if not len(col):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offs[0]:offs[-1]], offs - offs[0]


def chunks(offs: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes, a longer row alone."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + size, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def column(batch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


# ------------------------------------------------------------------ hashing
def fmix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the word."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


BYTE_VALUES = fmix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse, modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        m = max(n, CHUNK_BYTES + (1 << 16))
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(m, base & _MASK, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def prefix(x: np.ndarray) -> np.ndarray:
    """Rabin-Karp prefix sums: entry i is the sum of x[j] * base**j over j < i."""
    out = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x * powers(len(x))[0], out=out[1:], dtype=np.uint64)
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the values in [start, end): equal sequences have equal hashes."""
    return fmix((sums[end] - sums[start]) * powers(len(sums))[1][start] + (end - start).astype(np.uint64))


def bytes_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """XXH3 of the bytes in [start, end).  Powers modulo 2**64 tell sequences apart that are short; some of 1,024
    values and more (Thue-Morse words) have one sum under every base."""
    view = memoryview(data.tobytes())
    return np.fromiter((xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(start.tolist(), end.tolist())), np.uint64, len(start))


def token_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each token: of short ones from prefix sums, of long ones from their bytes."""
    out = span_hash(prefix(BYTE_VALUES[data]), start, end)
    long = np.flatnonzero(end - start > LONG_TOKEN)
    if len(long):
        out[long] = bytes_hash(data, start[long], end[long])
    return out


def gram_hash(sums: np.ndarray, q: int) -> np.ndarray:
    """Hash of every run of q values."""
    n = len(sums) - q
    if n <= 0:
        return np.empty(0, np.uint64)
    return fmix((sums[q:] - sums[:-q]) * powers(len(sums))[1][:n])


def sliding_min(a: np.ndarray, width: int, least=np.minimum) -> np.ndarray:
    """Least of every ``width`` neighbours (``least=np.maximum``: largest)."""
    if len(a) < width:
        return np.empty(0, a.dtype)
    span = 1
    while span * 2 <= width:
        a = least(a[:-span], a[span:])
        span *= 2
    rest = width - span
    return least(a[:-rest], a[rest:]) if rest else a


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def tokens(data: np.ndarray, offs: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every maximal run of bytes outside ``gap`` (a token
    never crosses a row) and the token offsets of the rows."""
    return ink_runs(~gap[data], offs)


def ink_runs(ink: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``tokens`` of the bytes that are marked in ``ink``."""
    if not len(ink):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offs), np.int64)
    first = offs[:-1][offs[1:] > offs[:-1]]
    begin = ink.copy()
    begin[1:] &= ~ink[:-1]
    begin[first] = ink[first]
    end = ink.copy()
    end[:-1] &= ~ink[1:]
    last = offs[1:][offs[1:] > offs[:-1]] - 1
    end[last] = ink[last]
    s, e = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(s, offs, "left")


def ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... n[0] of them, then those of start[1], ..."""
    n = np.asarray(n, np.int64)
    total = int(n.sum())
    if not total:
        return np.empty(0, np.int64)
    return np.repeat(np.asarray(start, np.int64) - (np.cumsum(n) - n), n) + np.arange(total)


def join_runs(did: np.ndarray, th: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, ...]:
    """Single positions of rows as maximal runs ``(did, th, start, n)``."""
    if not len(did):
        return did, th, pos, pos
    order = np.lexsort((pos, th, did))
    did, th, pos = did[order], th[order], pos[order]
    new = np.ones(len(did), bool)
    new[1:] = (did[1:] != did[:-1]) | (th[1:] != th[:-1]) | (pos[1:] > pos[:-1] + 1)
    at = np.flatnonzero(new)
    stop = np.append(at[1:], len(did)) - 1
    return did[at], th[at], pos[at], pos[stop] - pos[at] + 1


# ------------------------------------------------------------------ package
def ship_package(spark: SparkSession) -> None:
    """Sends this package to the Python workers, unless they find it already.

    A job submitted with ``--py-files`` or with the repository on PYTHONPATH
    needs nothing; a session made elsewhere gets a zip through ``addPyFile``."""
    import os
    import shutil

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    if root in os.environ.get("PYTHONPATH", "").split(":") or any("larder" in os.path.basename(f) for f in
                                                                   spark.sparkContext.listFiles):
        return
    where = tempfile.mkdtemp(prefix="larder-package-")
    spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(where, "larder"), "zip", root, "larder"))
