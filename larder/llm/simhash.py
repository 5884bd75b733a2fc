"""SimHash near-dedup with deletion-variant signatures.

Fingerprint: A-Z are lower-cased, words are maximal runs outside space and
0x09-0x0D, shingles are ``shingle`` consecutive words joined by one space
(repeats count; fewer words: the whole sequence; none: fingerprint zero).  A
bit is 1 if it is set in over half the shingles' XXH64 (seed 42).

Links: with at most ``max_bits`` differing bits cut over ``max_bits // 2 + 1``
segments, some segment differs in one bit at most.  Each distinct fingerprint
is indexed under every segment as it is and under every segment with one bit
left open.  An exact variant joins equal segments; an open variant joins only
rows whose open bit differs, so segments that are equal meet in one variant,
not in all.  A pair is taken in the first segment that can find it and verified
by the full bit count, so each link comes out once.  Equal fingerprints are
one node, so copies make no pairs, and components are found by star
contraction.

Defined cases: null and empty texts have fingerprint zero and are linked like
any other; a null id is larger than all others (a group of null ids has a null
component); rows that share an id count by their own text; other columns are
ignored by ``near_duplicates`` and kept by ``keep_one``; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import NULL_ID, column, cut, id_back, keyed, tokens
from larder.llm.components import components
from larder.llm.repeats import rows_of
from larder.llm.substring_dedup import _joined

SHINGLE, MAX_BITS, SEED = 4, 4, 42
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def fingerprint_rows(data: np.ndarray, offs: np.ndarray, shingle: int) -> np.ndarray:
    """Fingerprints (unsigned) of the rows of a chunk."""
    data = LOWER[data]
    s, e, woff = tokens(data, offs)
    text = _joined(data, s, e)
    n_words = np.diff(woff)
    out = np.zeros(len(offs) - 1, np.uint64)
    rows = np.flatnonzero(n_words)
    if not len(rows):
        return out
    stop = np.cumsum(e - s + 1) - 1
    start = stop - (e - s)
    size = np.minimum(n_words[rows], shingle)
    count = n_words[rows] - size + 1
    first = np.repeat(woff[rows], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    digest, ends = xxhash.xxh64_intdigest, stop[first + np.repeat(size, count) - 1]
    h = np.fromiter((digest(text[a:b], SEED) for a, b in zip(start[first].tolist(), ends.tolist())), np.uint64, len(first))
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.add.reduceat(bits, np.cumsum(count) - count, axis=0, dtype=np.int32)
    out[rows] = np.packbits(ones * 2 > count[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``(did, th, fp)`` for each row; ``fp`` is the fingerprint as a signed long."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = [fingerprint_rows(data, offs, shingle) for _, _, data, offs in rows_of(batch)]
            fp = np.concatenate(fp).view(np.int64) if fp else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp)], names=["did", "th", "fp"])

    return keyed(docs, id_col, text_col).mapInArrow(scan, "did long, th long, fp long")


def _signed(v: int) -> int:
    return v - (1 << 64) if v >> 63 else v


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Pairs ``(u, v)`` of distinct fingerprints (column ``fp``) that differ in 1 to ``max_bits`` bits."""
    parts = max_bits // 2 + 1
    edges = [64 * i // parts for i in range(parts + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    fp = F.col("fp")
    variant = lambda no, seg, mask: F.struct(F.lit(no).alias("no"), F.lit(seg).alias("seg"),
                                             fp.bitwiseAND(F.lit(_signed(mask))).alias("part"))
    exact = [variant(64 + i, i, m) for i, m in enumerate(masks)]

    def open_bits(value: int):
        rows = []
        for i, m in enumerate(masks):
            for bit in range(edges[i], edges[i + 1]):
                own = fp.bitwiseAND(F.lit(_signed(1 << bit)))
                rows.append(F.when((own != 0) == F.lit(bool(value)), variant(bit, i, m & ~(1 << bit))))
        return F.filter(F.array(*rows), lambda r: r.isNotNull())

    side = lambda value, name: fps.select(
        F.explode(F.concat(F.array(*exact), open_bits(value))).alias("k"), fp.alias(name)).select("k.no", "k.seg", "k.part", name)
    left, right = side(0, "a"), side(1, "b")
    differ = F.col("a").bitwiseXOR(F.col("b"))
    first = F.lit(True)
    for i in range(parts - 1):  # found in the first segment that differs in one bit at most
        first = first & ((F.col("seg") <= i) | (F.bit_count(differ.bitwiseAND(F.lit(_signed(masks[i])))) > 1))
    return (left.join(right, ["no", "seg", "part"])
            .where((F.bit_count(differ) <= max_bits) & ((F.col("no") < 64) | (F.col("a") < F.col("b"))) & first)
            .select(F.col("a").alias("u"), F.col("b").alias("v")))


def _classes(rows: DataFrame, max_bits: int) -> tuple[DataFrame, DataFrame]:
    """``(fp, low)``: the smallest ``(did, th)`` of each fingerprint's component."""
    fps = cut(rows.groupBy("fp").agg(F.min(F.struct("did", "th")).alias("low")))
    roots = cut(components(links(fps.select("fp"), max_bits)))
    nodes = roots.join(fps, F.col("node") == F.col("fp")).select("fp", "root", "low")
    least = nodes.groupBy("root").agg(F.min("low").alias("low"))
    linked = nodes.select("fp", "root").join(least, "root").select("fp", "low")
    return fps.join(linked.withColumnRenamed("low", "group_low"), "fp", "left").select(
        "fp", F.coalesce("group_low", "low").alias("low"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    max_bits: int = MAX_BITS) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, fp, component_id``."""
    rows = cut(fingerprints(docs, id_col, text_col, shingle))
    return rows.join(_classes(rows, max_bits), "fp").select(
        id_back().alias("doc_id"), "fp", F.nullif(F.col("low.did"), F.lit(NULL_ID)).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
             max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id, of
    several under this id that with the smallest text hash."""
    rows = cut(fingerprints(docs, id_col, text_col, shingle))
    low = _classes(rows, max_bits).select(F.col("low.did").alias("_keep_did"), F.col("low.th").alias("_keep_th")).distinct()
    key = keyed(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")).select(
        "_row", F.col(f"_row.`{id_col}`").alias("_id"), F.col(f"_row.`{text_col}`").alias("_text")), "_id", "_text", ["_row"])
    return (key.join(low, (F.col("did") == F.col("_keep_did")) & (F.col("th") == F.col("_keep_th")), "left_semi")
            .dropDuplicates(["did", "th"]).select("_row.*"))
