"""Document fingerprints by SpotSigs.

A token is a run of letters or digits (A-Z lower-cased).  Wherever an anchor, a
common word, stands, a spot signature chains it with the next ``chain`` content
words (words that aren't anchors).  The start of a text counts as one anchor,
and a chain may end with the text, so every text with a token has a signature.
A fingerprint is the sorted set of signature hashes in hexadecimal; likeness is
the Jaccard coefficient of two sets.

``similar_classes`` links all texts of a table at ``threshold`` or more.  Equal
fingerprints are one node, told by a 64-bit hash.  Signatures have one order,
by counts in a histogram of fixed size (rare ones first); of each set only the
first ones travel, so many that two similar sets share ``SHARED`` of them.  Sets
meet by signature, partners being bounded by set length, and pairs that meet
often enough are verified exactly on the whole sets.  Where a signature has
more than ``HOT`` sets, pairs aren't written out: its sets are compared in blocks
that give the number of links of each set and edges to one of those it reaches.
Sets are saved once, as binary, and only those of nodes that met another are
exchanged; texts travel compressed, once, and the classes of the rows with them.

Defined cases: a null or empty text, or one without tokens, has an empty
fingerprint, which is like an empty one (1.0) and unlike any other (0.0); rows
with one id are ordered by text hash; a null id counts as the largest; the only row of a table is its own next; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import (CHUNK_BYTES, NULL_ID, chunks, column, cut, fmix, id_back, keyed, ranges, text_bytes, token_hash,
                               tokens, utf8)
from larder.llm.components import components

CHAIN, THRESHOLD = 3, 0.8
PART_BYTES = 4 << 20
SLOTS, PIECE = 1 << 18, 1 << 12  # counters of the signatures' order; a piece of them is summed in one task
SHARED, HOT, BLOCK = 3, 32, 1024
BLOCK_SPOTS = 1 << 20
MEET_SPOTS = 500_000  # signatures of the table for each task where sets meet

# Frequent function words of English, French, German and Spanish.
ANCHORS = """
a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their there they
this to was we were which will with you
au aux ce ces dans des du elle en est et il la le les leur mais ne ou par pas pour qu que qui sa se ses son sur un une
aber als am auch auf aus bei das dem den der die ein eine einen er es ich im ist mit nach nicht sich sie sind so und
von war werden wie wir zu
al como con de del el ella en era ha hay las lo los más no o para pero por se si sin su sus y
""".split()

GAP = np.ones(256, bool)
GAP[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def anchor_hashes(words: list[str]) -> np.ndarray:
    out = []
    for w in sorted(set(words)):
        b = LOWER[np.frombuffer(w.encode(), np.uint8)]
        out.append(token_hash(b, np.array([0]), np.array([len(b)]))[0])
    return np.sort(np.array(out, np.uint64))


def signatures(data: np.ndarray, offs: np.ndarray, anchors: np.ndarray, chain: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 32-bit signatures of each row, and the rows' offsets into them."""
    s, e, toff = tokens(data, offs, GAP)
    rows = len(offs) - 1
    if not len(s):
        return np.empty(0, np.uint32), np.zeros(rows + 1, np.int64)
    h = token_hash(LOWER[data], s, e)
    row = np.repeat(np.arange(rows), np.diff(toff))
    common = anchors[np.minimum(np.searchsorted(anchors, h), len(anchors) - 1)] == h
    content = np.flatnonzero(~common)
    words, word_row = np.append(h[content], np.uint64(0)), np.append(row[content], -1)
    # where each anchor's chain starts among the content words
    spots = np.flatnonzero(common)
    first_rows = np.flatnonzero(np.diff(toff))
    anchor = np.concatenate([h[spots], np.full(len(first_rows), 1, np.uint64)])
    at = np.searchsorted(content, np.concatenate([spots, toff[first_rows]]), "left")
    own = np.concatenate([row[spots], first_rows])
    sig = fmix(anchor)
    for k in range(chain):
        j = np.minimum(at + k, len(content))
        sig = fmix(sig * np.uint64(0x9E3779B97F4A7C15) + np.where(word_row[j] == own, words[j], np.uint64(7)))
    pair = np.unique((own.astype(np.uint64) << np.uint64(32)) | (sig >> np.uint64(32)))
    return (pair & np.uint64(0xFFFFFFFF)).astype(np.uint32), np.searchsorted(pair >> np.uint64(32), np.arange(rows + 1), "left")


def jaccard(a: np.ndarray, b: np.ndarray, threshold: float = 0.0) -> float:
    """Jaccard coefficient of two sorted sets; 0 where their lengths alone bound it below ``threshold``."""
    if not len(a) and not len(b):
        return 1.0
    if min(len(a), len(b)) < threshold * max(len(a), len(b)):
        return 0.0
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared)


def _texts(texts: list[str], anchors, chain) -> Iterator[np.ndarray]:
    raw = [t.encode() for t in texts]
    offs = np.r_[0, np.cumsum([len(r) for r in raw])].astype(np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    for lo, hi in chunks(offs, CHUNK_BYTES):
        sig, at = signatures(data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo], anchors, chain)
        for i in range(hi - lo):
            yield sig[at[i]:at[i + 1]]


def _signed(col, anchors, chain) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of a text column, their signatures and the rows' offsets into them."""
    data, offs = utf8(col)
    for lo, hi in chunks(offs, CHUNK_BYTES):
        yield lo, hi, *signatures(data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo], anchors, chain)


def _nodes(sig: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row's set."""
    view = memoryview(sig.tobytes())
    return np.array([xxhash.xxh3_64_intdigest(view[4 * a:4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())],
                    np.uint64).view(np.int64)


def _hex(sig: np.ndarray) -> str:
    return sig.astype(">u4").tobytes().hex()


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", anchors: list[str] = ANCHORS,
                chain: int = CHAIN) -> DataFrame:
    """``did, th, length, fingerprint`` of every row."""
    known = anchor_hashes(anchors)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, sig, at in _signed(batch.column(2), known, chain):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(np.diff(at)),
                     pa.array([_hex(sig[a:b]) for a, b in zip(at[:-1], at[1:])])], names=["did", "th", "length", "fingerprint"])

    return keyed(docs, id_col, text_col).mapInArrow(scan, "did long, th long, length long, fingerprint string")


def in_order_with_next(docs: DataFrame, part_bytes: int = PART_BYTES, classes: DataFrame | None = None) -> tuple[DataFrame, int]:
    """``part, extra, did, th, z, class_low, n_links`` of ``docs`` (did, th, text); ``z``
    is the text, compressed.  ``part``: slices of the order by (did, th) descending.
    The last row of a slice is followed in it by a copy of the next slice's first
    row (``extra``); after the last slice comes the first.  Rows of ``classes`` (did,
    th, class_low, n_links) go to the slice of their id and have no ``z``."""
    parts = max(1, -(-text_bytes(docs) // part_bytes))
    bounds = []
    if parts > 1:
        found = docs.select(F.percentile_approx("did", [i / parts for i in range(1, parts)], 100 * parts).alias("q")).first()["q"]
        bounds = sorted(set(found or []))
    edges = np.array(bounds, np.int64)

    @F.pandas_udf("int")
    def slice_of(did: pd.Series) -> pd.Series:
        """Number of bounds above the id: later slices hold smaller ids."""
        return pd.Series(len(edges) - np.searchsorted(edges, did.to_numpy(), "right"), dtype="int32")

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                some = batch.slice(lo, 512)
                z = [pack.compress(t.encode()) for t in some.column(4).to_pylist()]
                yield pa.RecordBatch.from_arrays([*some.columns[:4], pa.array(z, pa.binary())], names=["part", "extra", "did", "th", "z"])

    rows = docs.withColumn("part", slice_of("did"))
    firsts = (rows.groupBy("part").agg(F.max(F.struct("did", "th")).alias("f")).collect())  # one row a slice
    order = sorted(firsts, key=lambda r: r["part"])
    heads = rows.sparkSession.createDataFrame(
        [(order[i - 1]["part"], r["f"]["did"], r["f"]["th"]) for i, r in enumerate(order)], "into int, did long, th long")
    extra = (rows.drop("part").join(F.broadcast(heads), ["did", "th"]).dropDuplicates(["into"])
             .select(F.col("into").alias("part"), F.lit(True).alias("extra"), "did", "th", "text"))
    packed = (rows.select("part", F.lit(False).alias("extra"), "did", "th", "text").unionByName(extra)
              .mapInArrow(squeeze, "part int, extra boolean, did long, th long, z binary"))
    if classes is None:
        return packed.withColumns({c: F.lit(None).cast("long") for c in ("class_low", "n_links")}), len(order)
    beside = classes.select(slice_of("did").alias("part"), F.lit(False).alias("extra"), "did", "th", "class_low", "n_links")
    return packed.unionByName(beside, allowMissingColumns=True), len(order)


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", anchors: list[str] = ANCHORS,
                        chain: int = CHAIN, part_bytes: int = PART_BYTES, classes: DataFrame | None = None) -> DataFrame:
    """One row for each row of ``docs``, next to the following document in
    descending id order (after the last: the first): ``doc_id, n_chars, edited,
    fingerprint, edited_fingerprint, near_edited, near_next, length,
    edited_length``.  The edited text is the text with its last floor(n / 2)
    code points replaced by as many first ones of the next text (or all).
    ``classes`` (one row for each did and th): also ``class_low, n_links``."""
    known = anchor_hashes(anchors)
    sliced, parts = in_order_with_next(keyed(docs, id_col, text_col), part_bytes, classes)

    def rows_out(dids, texts, nexts, sig, sig_next, low, links):
        edited = [t[:len(t) - len(t) // 2] + n[:len(t) // 2] for t, n in zip(texts, nexts)]
        sig_edited = list(_texts(edited, known, chain))
        return pa.RecordBatch.from_arrays(
            [pa.array(dids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(edited, pa.string()),
             pa.array([_hex(s) for s in sig], pa.string()), pa.array([_hex(s) for s in sig_edited], pa.string()),
             pa.array([jaccard(a, b) for a, b in zip(sig, sig_edited)], pa.float64()),
             pa.array([jaccard(a, b) for a, b in zip(sig, sig_next)], pa.float64()),
             pa.array([len(s) for s in sig], pa.int64()), pa.array([len(s) for s in sig_edited], pa.int64()),
             pa.array(low, pa.int64()), pa.array(links, pa.int64())],
            names=["did", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "length",
                   "edited_length", "class_low", "n_links"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        held, mark = None, (None, None, None, None)  # the row before: (part, extra, did, text, low, links, signatures); the class row
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                rows = []
                for part, extra, did, th, z, low, links in zip(*(c.to_pylist() for c in batch.slice(lo, 512).columns)):
                    if z is None:
                        mark = (did, th, low, links)
                    else:
                        rows.append((part, extra, did, unpack.decompress(z).decode(), *(mark[2:] if mark[:2] == (did, th) else (None, None))))
                if not rows:
                    continue
                seen = [*([held] if held else []), *((*r, s) for r, s in zip(rows, _texts([r[3] for r in rows], known, chain)))]
                held = seen[-1]
                pairs = [(a, b) for a, b in zip(seen, seen[1:]) if a[0] == b[0] and not a[1]]
                if pairs:
                    now, after = zip(*pairs)
                    yield rows_out([r[2] for r in now], [r[3] for r in now], [r[3] for r in after], [r[6] for r in now],
                                   [r[6] for r in after], [r[4] for r in now], [r[5] for r in now])

    ordered = (sliced.select("part", "extra", "did", "th", "z", "class_low", "n_links").repartition(max(1, parts), "part")
               .sortWithinPartitions("part", "extra", F.col("did").desc(), F.col("th").desc(), F.col("z").isNotNull()))
    done = ordered.mapInArrow(
        scan, "did long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, "
              "near_next double, length long, edited_length long, class_low long, n_links long")
    return (done.drop("class_low", "n_links") if classes is None else done).withColumn("doc_id", id_back()).drop("did")


def similar_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
                    anchors: list[str] = ANCHORS, chain: int = CHAIN) -> DataFrame:
    """``doc_id, class_id, n_links``: the smallest id reachable over links of
    likeness ``threshold`` or more, and the links of the row's fingerprint to
    other fingerprints."""
    rows, classes = _classes(keyed(docs, id_col, text_col), threshold, anchors, chain)
    return rows.join(classes, "node").select(
        id_back().alias("doc_id"), F.nullif(F.col("class_low"), F.lit(NULL_ID)).alias("class_id"), "n_links")


def with_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
                 anchors: list[str] = ANCHORS, chain: int = CHAIN) -> DataFrame:
    """``edited_fingerprints`` with ``class_id, n_links`` of ``similar_classes`` over all rows."""
    rows, classes = _classes(keyed(docs, id_col, text_col), threshold, anchors, chain)
    of_rows = rows.dropDuplicates(["did", "th"]).join(classes, "node").select("did", "th", "class_low", "n_links")
    return edited_fingerprints(docs, id_col, text_col, anchors, chain, classes=of_rows).withColumn(
        "class_id", F.nullif(F.col("class_low"), F.lit(NULL_ID))).drop("class_low")


# ------------------------------------------------------------------ classes
def _pieces(values: np.ndarray) -> pa.RecordBatch:
    """``piece, packed`` of an array, pieces of zeros left out."""
    some = [(i // PIECE, zstandard.compress(values[i:i + PIECE].tobytes())) for i in range(0, len(values), PIECE) if values[i:i + PIECE].any()]
    return pa.RecordBatch.from_arrays([pa.array([p for p, _ in some], pa.int32()), pa.array([z for _, z in some], pa.binary())],
                                      names=["piece", "packed"])


def _merged(pieces: DataFrame, like: np.ndarray, merge) -> np.ndarray:
    """Arrays of the size of ``like``, written by ``_pieces`` in many tasks, as one; it has a fixed size."""
    kind = like.dtype

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for p, z in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = np.frombuffer(zstandard.decompress(z), kind)
                sums[p] = merge(sums[p], x) if p in sums else x
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([zstandard.compress(x.tobytes()) for x in sums.values()], pa.binary())],
                                         names=["piece", "packed"])

    out = like.copy()
    for r in pieces.repartition(max(1, min(12, len(like) // PIECE)), "piece").mapInArrow(add, "piece int, packed binary").collect():
        x = np.frombuffer(zstandard.decompress(bytes(r["packed"])), kind)
        out[r["piece"] * PIECE:r["piece"] * PIECE + len(x)] = x
    return out


def _counted(docs: DataFrame, known: np.ndarray, chain: int) -> tuple[DataFrame, np.ndarray]:
    """``did, th, node, spots`` of every row, and how many signatures fall on each counter.  ``spots`` is the set's
    signatures; null where the task has had this set."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, had = np.zeros(SLOTS, np.int64), set()
        for batch in batches:
            for lo, hi, sig, at in _signed(batch.column(2), known, chain):
                nodes, raw, spots = _nodes(sig, at), memoryview(sig.tobytes()), []
                for x, a, b in zip(nodes.tolist(), at[:-1].tolist(), at[1:].tolist()):
                    spots.append(None if x in had else bytes(raw[4 * a:4 * b]))
                    had.add(x)
                counts += np.bincount(sig & np.uint32(SLOTS - 1), minlength=SLOTS)
                n = hi - lo
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, n), batch.column(1).slice(lo, n), pa.array(nodes), pa.array(spots, pa.binary()),
                     pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
        sums = _pieces(counts)
        yield pa.RecordBatch.from_arrays(
            [*[pa.nulls(sums.num_rows, pa.int64())] * 3, pa.nulls(sums.num_rows, pa.binary()), *sums.columns], names=names)

    names = ["did", "th", "node", "spots", "piece", "packed"]
    both = cut(docs.mapInArrow(scan, "did long, th long, node long, spots binary, piece int, packed binary"))
    counts = _merged(both.where("piece IS NOT NULL").select("piece", "packed"), np.zeros(SLOTS, np.int64), np.add)
    return both.where("piece IS NULL").select("did", "th", "node", "spots"), counts


def _sets(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes of a batch ``node, spots``, their signatures and the offsets into these."""
    data, offs = utf8(batch.column(1))
    return column(batch, "node"), np.frombuffer(data.tobytes(), np.uint32), offs // 4


def _kept(n: np.ndarray, threshold: float, shared: int) -> np.ndarray:
    """So many first signatures that two similar sets have ``shared`` of them in common."""
    return np.minimum(n, n - np.ceil(n * threshold - 1e-9).astype(np.int64) + shared)


def _first_spots(sets: DataFrame, counts: np.ndarray, threshold: float, shared: int, buckets: int) -> DataFrame:
    """``bucket, sig, node, n``: arrays of the first signatures of ``sets`` (node, spots), each with its set and the
    set's length.  Left out: sets too small to be similar to another."""
    least = threshold / (1 - threshold) - 1e-9 if threshold < 1 else math.inf

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            sig, node, n = (np.concatenate(x) for x in zip(*held))
            bucket = (((sig.astype(np.uint64) * np.uint64(0x9E3779B1)) & np.uint64(0xFFFFFFFF)) * np.uint64(buckets)) >> np.uint64(32)
            order = np.lexsort((sig, bucket))
            names, at = np.unique(bucket[order], return_index=True)
            offs = pa.array(np.append(at, len(sig)), pa.int32())
            return pa.RecordBatch.from_arrays(
                [pa.array(names.astype(np.int32)), *(pa.ListArray.from_arrays(offs, pa.array(x[order])) for x in (sig.view(np.int32), node, n))],
                names=["bucket", "sig", "node", "n"])

        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                nodes, sig, at = _sets(batch.slice(lo, 2048))
                n = np.diff(at)
                row = np.repeat(np.arange(len(n)), n)
                order = np.lexsort((sig, counts[sig & np.uint32(SLOTS - 1)], row))
                first = (np.arange(len(sig)) - at[row] < _kept(n, threshold, shared)[row]) & (n >= least)[row]
                held.append((sig[order][first], nodes[row[first]], n[row[first]].astype(np.int32)))
                size += int(first.sum())
                if size > 2_000_000:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return sets.mapInArrow(scan, "bucket int, sig array<int>, node array<long>, n array<int>")


def _meet(spots: DataFrame, threshold: float, tasks: int) -> DataFrame:
    """``a, b, met, hot``: pairs of nodes and how many first signatures they have in common; of a signature with
    more than ``HOT`` sets the nodes ``a`` and the signature ``b`` (``hot``)."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = [[batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in (1, 2, 3)] for batch in batches]
        if not lists:
            return
        sig, node, n = (np.concatenate(x) for x in zip(*lists))
        order = np.lexsort((node, n, sig))
        sig, node, n = sig[order], node[order], n[order].astype(np.int64)
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
        sig, node, n = sig[new], node[new], n[new]
        begin = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
        many = np.diff(np.r_[begin, len(sig)])
        end, many = np.repeat(begin + many, many), np.repeat(many, many)
        hot = many > HOT
        names = ["a", "b", "met", "hot"]
        for lo in range(0, len(sig), 1_000_000):
            h = np.flatnonzero(hot[lo:lo + 1_000_000]) + lo
            yield pa.RecordBatch.from_arrays([pa.array(node[h]), pa.array(sig[h].view(np.uint32).astype(np.int64)),
                                              pa.array(np.zeros(len(h), np.int64)), pa.array(np.ones(len(h), bool))], names=names)
            i = np.flatnonzero(~hot[lo:lo + 1_000_000] & (many[lo:lo + 1_000_000] > 1)) + lo
            later = end[i] - i - 1
            a, b = np.repeat(i, later), ranges(i + 1, later)
            near = n[a] >= n[b] * threshold - 1e-9
            x, y = node[a[near]], node[b[near]]
            x, y = np.minimum(x, y), np.maximum(x, y)
            order = np.lexsort((y, x))
            x, y = x[order], y[order]
            at = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])]) if len(x) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x[at]), pa.array(y[at]), pa.array(np.diff(np.r_[at, len(x)]).astype(np.int64)),
                                              pa.array(np.zeros(len(at), bool))], names=names)

    return (spots.repartition(tasks, "bucket").mapInArrow(meet, "a long, b long, met long, hot boolean")
            .groupBy("a", "b", "hot").agg(F.sum("met").alias("met")))


def _sets_of(sets: DataFrame, found: DataFrame) -> DataFrame:
    """``sets`` (node, spots) of (at least) the nodes in ``found``, each once: a bitmap of hashes says which may be left out."""
    size = 1 << min(27, max(15, (16 * found.count()).bit_length()))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size, bool)
        for batch in batches:
            bits[column(batch, "node").view(np.uint64) % np.uint64(size)] = True
        yield _pieces(np.packbits(bits))

    ends = found.select(F.explode(F.when(F.col("hot"), F.array("a")).otherwise(F.array("a", "b"))).alias("node"))
    bits = _merged(ends.mapInArrow(mark, "piece int, packed binary"), np.zeros(size // 8, np.uint8), np.bitwise_or)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = column(batch, "node").view(np.uint64) % np.uint64(size)
            ok = (bits[h >> np.uint64(3)] >> (7 - (h & np.uint64(7)).astype(np.uint8))) & 1
            yield batch.filter(pa.array(ok.astype(bool)))

    return sets.mapInArrow(scan, "node long, spots binary").dropDuplicates(["node"])


def _spots(x: bytes | None) -> np.ndarray:
    return np.frombuffer(x or b"", np.uint32)


def _table(lists: list[np.ndarray], names: np.ndarray) -> np.ndarray:
    """Which of the sorted ``names`` each list has, as 0 or 1."""
    out = np.zeros((len(lists), len(names)), np.float32)
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    flat = np.concatenate([*lists, np.empty(0, names.dtype)])
    at = np.minimum(np.searchsorted(names, flat), len(names) - 1)
    ok = names[at] == flat if len(names) else np.zeros(len(flat), bool)
    out[row[ok], at[ok]] = 1
    return out


def _shared(left: list[np.ndarray], right: list[np.ndarray], width: int = 2048) -> np.ndarray:
    """How many entries each list of ``left`` shares with each of ``right``."""
    out = np.zeros((len(left), len(right)), np.float32)
    empty = np.empty(0, np.uint32)
    both = np.intersect1d(np.concatenate([*left, empty]), np.concatenate([*right, empty]))
    for lo in range(0, len(both), width):
        out += _table(left, both[lo:lo + width]) @ _table(right, both[lo:lo + width]).T
    return out


def _block_links(group: pa.Table, threshold: float) -> pa.Table:
    """``u, v, n`` of a pair of blocks (or one) of a hot signature's sets: links of u, and a node that u reaches.
    A pair counts at the least hot signature that it shares."""
    sig, i, j = (group.column(c)[0].as_py() for c in ("sig", "i", "j"))
    block, node = column(group, "block"), column(group, "node")
    sets = [_spots(x) for x in group.column("spots").to_pylist()]
    before = [np.array([y for y in x if y < sig], np.uint32) for x in group.column("hots").to_pylist()]
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    n = np.array([len(x) for x in sets], np.float64)
    pick = lambda lists, at: [lists[k] for k in at]
    shared = _shared(pick(sets, left), pick(sets, right)).astype(np.float64)
    na, nb = n[left][:, None], n[right][None]
    linked = (shared / np.maximum(na + nb - shared, 1) >= threshold) & (np.minimum(na, nb) >= threshold * np.maximum(na, nb))
    linked &= _shared(pick(before, left), pick(before, right)) == 0
    linked &= node[left][:, None] != node[right][None]
    links = np.zeros(len(node), np.int64)
    links[left] = linked.sum(1)
    if i != j:
        links[right] = linked.sum(0)
    at = np.flatnonzero(links)
    low = node.copy()  # the least node reached within the blocks
    while len(at):
        was = low.copy()
        biggest = np.int64((1 << 63) - 1)
        for lo in range(0, len(left), 256):
            some, part = linked[lo:lo + 256], left[lo:lo + 256]
            low[part] = np.minimum(low[part], np.where(some, low[right][None], biggest).min(1, initial=biggest))
            low[right] = np.minimum(low[right], np.where(some, low[part][:, None], biggest).min(0, initial=biggest))
        if (low == was).all():
            break
    return pa.table({"u": pa.array(node[at], pa.int64()), "v": pa.array(low[at], pa.int64()), "n": pa.array(links[at], pa.int64())})


def _hot_links(hots: DataFrame, full: DataFrame, threshold: float) -> DataFrame:
    """``u, v, n`` of all blocks of the sets of each signature in ``hots`` (node, sig)."""
    sizes = (hots.join(full.select("node", (F.octet_length("spots") / 4).alias("n")), "node").groupBy("sig")
             .agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SPOTS)).cast("long").alias("blocks")))
    block, other = F.pmod(F.xxhash64("node"), F.col("blocks")), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    dealt = (hots.join(sizes, "sig").select("sig", "node", block.alias("block"), other.alias("x"))
             .select("sig", "node", "block", F.least("block", "x").alias("i"), F.greatest("block", "x").alias("j")))
    return dealt.join(full, "node").groupBy("sig", "i", "j").applyInArrow(
        lambda group: _block_links(group, threshold), "u long, v long, n long")


def _classes(docs: DataFrame, threshold: float, anchors: list[str] = ANCHORS, chain: int = CHAIN) -> tuple[DataFrame, DataFrame]:
    """``did, th, node`` of the rows of ``docs`` (did, th, text), and ``node, class_low, n_links`` of their fingerprints."""
    known = anchor_hashes(anchors)
    saved, counts = _counted(docs, known, chain)
    rows, saved = saved.select("did", "th", "node"), saved.where("spots IS NOT NULL").select("node", "spots")
    # similar sets that differ have threshold / (1 - threshold) signatures or more, and share threshold of those
    shared = max(1, min(SHARED, math.ceil(threshold * threshold / (1 - threshold) - 1e-9))) if threshold < 1 else 1
    tasks = 1 + int(counts.sum()) // MEET_SPOTS
    spots = _first_spots(saved, counts, threshold, shared, 4 * tasks)
    found = cut(_meet(spots, threshold, tasks).where(F.col("hot") | (F.col("met") >= shared)))
    hots = found.where("hot").select(F.col("a").alias("node"), F.col("b").alias("sig"))
    of_node = hots.groupBy("node").agg(F.sort_array(F.collect_list("sig")).alias("hots"))
    full = cut(_sets_of(saved, found).join(of_node, "node", "left")
               .select("node", "spots", F.coalesce("hots", F.array().cast("array<long>")).alias("hots")))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [jaccard(_spots(x), _spots(y), threshold) >= threshold for x, y in
                  zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(ok, pa.bool_()))

    # pairs that share a hot signature are counted there
    side = lambda s: full.select(F.col("node").alias(s), F.col("spots").alias("f" + s), F.col("hots").alias("h" + s))
    pairs = (found.where("NOT hot").select("a", "b").join(side("a"), "a").join(side("b"), "b")
             .where(~F.arrays_overlap("ha", "hb")).select("a", "b", "fa", "fb").mapInArrow(verify, "u long, v long"))
    both = F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")
    links = cut(pairs.select(both).select("e.u", "e.v", F.lit(1).cast("long").alias("n"))
                .unionByName(_hot_links(hots, full, threshold)))
    degree = links.groupBy("u").agg(F.sum("n").alias("n_links")).withColumnRenamed("u", "node")
    sets = rows.groupBy("node").agg(F.min("did").alias("low"))
    roots = components(links.select("u", "v"))
    low = roots.join(sets, "node").groupBy("root").agg(F.min("low").alias("class_low"))
    return rows, (sets.join(roots.join(low, "root").select("node", "class_low"), "node", "left").join(degree, "node", "left")
                  .select("node", F.coalesce("class_low", "low").alias("class_low"), F.coalesce("n_links", F.lit(0)).alias("n_links")))
