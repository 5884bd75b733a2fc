"""Merkle manifest of a dataset as a persistent, path-copying tree.

Leaves of one source ascend by id; every ``FAN`` consecutive nodes become their
hash until one remains, the subroot; subroots in order of their source become
the root in the same way.  A digest is hex text, a hash takes the concatenation.

Rows are ordered by one range exchange of digests (texts stay where they are);
each partition reports its first and last source and their counts, so the place
of a row in its source needs no window.  A source is cut in aligned blocks of
``FAN ** LEVELS`` leaves, whole subtrees, and a block is folded in
one task.  The roots of the blocks are the leaves of the next round, which is
the same job over far fewer rows, until each source has one node and
then until one is left.  On the way back each block hands its leaves the
siblings of their path above, so a row can be proved in the task of its block.

A tampered leaf makes a version of the tree: its ancestors are copied, first
inside its aligned block, then from the siblings handed down, the upper nodes
of the rounds above; all other nodes are those of the first version.  Versions
are independent and are made where their leaf lies, so their number never
meets in one task, though all of them end in a root of their own.

Defined cases: null values are hashed as ``-``; the null source is one source,
before all others; null ids come first in their source; rows with an equal id
are ordered by their leaf, and equal rows are a leaf each; a lone leaf is its
own subroot and a lone subroot the root, with a proof of no siblings; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.common import cut

FAN, LEVELS = 16, 3
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<before: binary, after: binary>>"


def leaf(values: list[Column]) -> Column:
    """Hash of a row: each value as its byte count, ``:`` and the value, null as ``-``."""
    part = lambda v: F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))
    return F.sha2(F.concat(*[part(v.cast("string")) for v in values]).cast("binary"), 256)


def leaves(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, tamper: tuple[Column, str, Column] | None = None) -> DataFrame:
    """``id, tree, leaf, changed`` for each row: the first two of ``columns`` and the digests.
    ``tamper`` is (which rows, a column, its new value); other rows have null in ``changed``."""
    own = [F.col(f"`{c}`") for c in columns]
    changed = F.lit(None).cast("string")
    if tamper:
        where, name, value = tamper
        changed = F.when(where, leaf([value if c == name else v for c, v in zip(columns, own)]))
    return docs.select(own[0].cast("long").alias("id"), own[1].cast("string").alias("tree"), leaf(own).alias("leaf"), changed.alias("changed"))


def _placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``pos``, the place in their ``tree``, from 0."""
    ranged = cut(rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange("tree", *order, "tie")
                 .sortWithinPartitions("tree", *order, "tie").withColumn("part", F.spark_partition_id()))
    # the first and the last tree of each partition, with their rows: two rows a partition at most
    ends = ranged.groupBy("part").agg(F.min(F.struct("tree")).alias("low"), F.max(F.struct("tree")).alias("high"))
    end = F.explode(F.array_distinct(F.array("low", "high"))).alias("end")
    counts = (ranged.join(F.broadcast(ends.select("part", end)), "part").where(F.col("tree").eqNullSafe(F.col("end.tree")))
              .groupBy("part", "tree").agg(F.count("*").alias("n")))
    before: dict[int, tuple] = {}
    last, count = None, 0
    for part, tree, n in sorted(counts.collect(), key=lambda r: (r[0], r[1] is not None, (r[1] or "").encode())):
        if (tree,) != last:
            last, count = (tree,), 0
        before.setdefault(part, (tree, count))  # sorted: the first of a partition is its least tree
        count += n
    table = ranged.sparkSession.createDataFrame([(p, n) for p, (t, n) in before.items()] or [(-1, 0)], "part int, before long")
    names = [c for c in rows.columns if c != "tree"]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, at = None, None
        for batch in batches:
            places = []
            for now, first in zip(batch.column("tree").to_pylist(), batch.column("before").to_pylist()):
                if at is None:  # the partition's first tree goes on from the partitions before
                    tree, at = now, first
                elif now != tree:
                    tree, at = now, 0
                places.append(at)
                at += 1
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("tree", *names)), pa.array(places, pa.int64())],
                                             names=["tree", *names, "pos"])

    kinds = ", ".join(f"{c} {dict(rows.dtypes)[c]}" for c in ("tree", *names))
    return ranged.join(F.broadcast(table), "part").mapInArrow(number, f"{kinds}, pos long")


# ------------------------------------------------------------------ one block
def _hash(data: bytes) -> bytes:
    return sha256(data).hexdigest().encode()


def _fold(nodes: bytes, whole: bool, height: int) -> list[bytes]:
    """The levels over a block's nodes (64 letters each): ``height`` of them, or until one node remains."""
    levels = [nodes]
    while len(levels) <= height if whole else len(levels[-1]) > 64:
        levels.append(b"".join(_hash(levels[-1][i:i + 64 * FAN]) for i in range(0, len(levels[-1]), 64 * FAN)))
    return levels


def _siblings(levels: list[bytes], at: int) -> list[tuple[bytes, bytes]]:
    """What stands before and after a node's path in its run, level by level."""
    path = []
    for nodes in levels[:-1]:
        first = at // FAN * FAN
        path.append((nodes[64 * first:64 * at], nodes[64 * at + 64:64 * (first + FAN)]))
        at //= FAN
    return path


def copied(node: bytes, path: list[tuple[bytes, bytes]]) -> list[bytes]:
    """The ancestors that a version with another ``node`` copies, up to its root."""
    out = []
    for before, after in path:
        node = _hash(before + node + after)
        out.append(node)
    return out


def _blocks(rows: DataFrame) -> DataFrame:
    """Rows of a block together, in their order."""
    return rows.repartition("tree", "block").sortWithinPartitions(F.col("tree").asc_nulls_first(), "block", "pos")


def _in_block(rows: DataFrame, height: int) -> DataFrame:
    return rows.withColumn("block", F.floor(F.col("pos") / FAN ** height))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """``(tree, block, rows)`` for each block of a sorted partition; rows of a block lie together."""
    key, held = None, []
    for batch in batches:
        trees, numbers = batch.column("tree").to_pylist(), batch.column("block").to_pylist()
        for i, now in enumerate(zip(trees, numbers)):
            if now != key:
                if held:
                    yield *key, held
                key, held = now, []
            held.append((batch, i))
    if held:
        yield *key, held


def _values(held: list, name: str) -> list:
    """A column of a block's rows; rows of one batch lie together."""
    out, i = [], 0
    while i < len(held):
        batch, first = held[i]
        n = next((j for j in range(i, len(held)) if held[j][0] is not batch), len(held)) - i
        out += batch.column(name).slice(first, n).to_pylist()
        i += n
    return out


def _levels(number: int, digests: list[str], height: int) -> list[bytes]:
    return _fold("".join(digests).encode(), number > 0 or len(digests) == FAN ** height, height)


def _roots(rows: DataFrame, height: int) -> DataFrame:
    """``tree, pos, leaf``: the root of each block, a leaf of the next round."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = [(tree, number, _levels(number, _values(held, "leaf"), height)[-1].decode()) for tree, number, held in _runs(batches)]
        for i in range(0, len(out), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[i:i + 10_000]), (
                pa.string(), pa.int64(), pa.string()))], names=["tree", "pos", "leaf"])

    return _blocks(_in_block(rows.select("tree", "pos", "leaf"), height)).mapInArrow(fold, "tree string, pos long, leaf string")


def _with_path(rows: DataFrame, above: DataFrame, height: int) -> DataFrame:
    """Rows in their blocks; before those of a block comes one row with its ``up``, ``subroot`` and ``top``: they
    are those of the node that the block is in the next round (``above``)."""
    return _blocks(_in_block(rows, height).unionByName(above.withColumnRenamed("pos", "block").withColumn("pos", F.lit(-1).cast("long")),
                                               allowMissingColumns=True))


def _above(head: tuple[pa.RecordBatch, int]) -> tuple[list[tuple[bytes, bytes]], str, str]:
    batch, i = head
    up, subroot, top = (batch.column(c)[i].as_py() for c in ("up", "subroot", "top"))
    return [(p["before"], p["after"]) for p in up], subroot, top


def _paths(rows: DataFrame, above: DataFrame, tops: bool, height: int) -> DataFrame:
    """``tree, pos, up, subroot, top`` for each node of a round; ``tops``: these nodes are the subroots."""
    size = FAN ** height
    struct = pa.list_(pa.struct([("before", pa.binary()), ("after", pa.binary())]))

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tree, number, (head, *held) in _runs(batches):
            digests = _values(held, "leaf")
            levels = _levels(number, digests, height)
            up, subroot, top = _above(head)
            n = len(held)
            for a in range(0, n, 64):  # a path has some KB
                b = min(a + 64, n)
                paths = [[{"before": x, "after": y} for x, y in _siblings(levels, k) + up] for k in range(a, b)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_values(held[a:b], "name"), pa.string()) if tops else pa.array([tree] * (b - a), pa.string()),
                     pa.array([0] * (b - a) if tops else range(number * size + a, number * size + b), pa.int64()),
                     pa.array(paths, struct), pa.array(digests[a:b] if tops else [subroot] * (b - a), pa.string()),
                     pa.array([top] * (b - a), pa.string())], names=["tree", "pos", "up", "subroot", "top"])

    return _with_path(rows, above, height).mapInArrow(extend, f"tree string, pos long, up {_PATH}, subroot string, top string")


def _rounds(rows: DataFrame, height: int) -> list[DataFrame]:
    """``rows`` and the rounds over them, until each tree has one node; the last has these nodes."""
    rounds = [rows]
    while (rounds[-1].agg(F.max("pos")).first()[0] or 0) > 0:
        rounds.append(cut(_roots(rounds[-1], height)))
    return rounds


def _top(nodes: DataFrame) -> DataFrame:
    """The one node that is left, as what stands above its block."""
    return nodes.select("tree", "pos", F.array().cast(_PATH).alias("up"), F.col("leaf").alias("subroot"), F.col("leaf").alias("top"))


def manifest(rows: DataFrame, height: int = LEVELS) -> DataFrame:
    """For each row of ``leaves``: ``id, tree, leaf, subroot, root, proof, folded`` (the root recomputed from
    ``changed``, or else ``leaf``, and the siblings) and ``copies``, the nodes that the row's version copies.
    A block is a subtree of ``height`` levels."""
    per_tree = _rounds(cut(_placed(rows, ["id", "leaf"])), height)
    subroots = per_tree[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "leaf")
    named = cut(_placed(subroots, ["name"]))
    over = _rounds(named, height)
    above = _top(over[-1])
    for nodes in reversed(over[:-1] or over):
        above = cut(_paths(nodes, above, nodes is named, height))
    for nodes in reversed(per_tree[1:-1]):
        above = cut(_paths(nodes, above, False, height))

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tree, number, (head, *held) in _runs(batches):
            digests, changed = _values(held, "leaf"), _values(held, "changed")
            levels = _levels(number, digests, height)
            up, subroot, top = _above(head)
            tail = b"".join(x + y for x, y in up)
            proofs, folded, copies = [], [], []
            for k, own in enumerate(digests):
                path = _siblings(levels, k)
                proofs.append(sha256(b"".join(x + y for x, y in path) + tail).hexdigest())
                nodes = copied((changed[k] or own).encode(), path + up)
                folded.append((nodes[-1].decode() if nodes else changed[k] or own))
                copies.append(len(nodes) if changed[k] else 0)
            n = len(held)
            yield pa.RecordBatch.from_arrays(
                [pa.array(_values(held, "id"), pa.int64()), pa.array([tree] * n, pa.string()), pa.array(digests), pa.array([subroot] * n),
                 pa.array([top] * n), pa.array(proofs), pa.array(folded), pa.array(copies, pa.int64())],
                names=["id", "tree", "leaf", "subroot", "root", "proof", "folded", "copies"])

    return _with_path(per_tree[0], above, height).mapInArrow(
        prove, "id long, tree string, leaf string, subroot string, root string, proof string, folded string, copies long")


# ------------------------------------------------------------------ SQL
CRC_TABLE = """SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)
       ORDER BY i) AS crc FROM range(256) r(i)"""


def crc_sql(text: str) -> str:
    """Unsigned CRC-32 of the UTF-8 bytes of the SQL text ``text``, beside a column ``crc`` of ``CRC_TABLE``."""
    octets = f"list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), 2 * i::BIGINT + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295, {octets}), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295)"


def oracle_sql(depth: int = 5) -> str:
    """The tree level by level; for at most ``FAN ** depth`` rows a source and as many sources."""
    part = lambda v: f"coalesce(octet_length(encode({v}::VARCHAR)) || ':' || {v}::VARCHAR, '-')"
    whole = lambda text: "sha256(" + " || ".join(part(text if c == "text" else c) for c in COLUMNS) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    sql = [f"""WITH t AS ({CRC_TABLE}),
s AS (SELECT source AS name, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM (SELECT DISTINCT source FROM documents)),
h AS (SELECT doc_id, tree, {whole("text")} AS leaf, CASE WHEN {crc_sql("doc_id::VARCHAR")} % 5 = 0 THEN {whole(lower)} END AS changed
      FROM documents JOIN s ON source IS NOT DISTINCT FROM name, t),
l AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM h),
a0 AS (SELECT tree, i, leaf AS d FROM l)"""]

    def level(x: str, k: int) -> str:
        return f"""{x}{k}s AS (SELECT *, count(*) OVER (PARTITION BY tree) AS n,
       coalesce(string_agg(d, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
       coalesce(string_agg(d, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
       FROM {x}{k} WINDOW w AS (PARTITION BY tree, i // {FAN} ORDER BY i)),
{x}{k + 1} AS (SELECT tree, i // {FAN} AS i, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(d, '' ORDER BY i)) ELSE any_value(d) END AS d
       FROM {x}{k}s GROUP BY tree, i // {FAN})"""

    sql += [level("a", k) for k in range(depth)]
    sql.append(f"b0 AS (SELECT 0 AS tree, tree AS i, d FROM a{depth})")
    sql += [level("b", k) for k in range(depth)]
    steps = [(x, k) for x in "ab" for k in range(depth)]
    sql.append("f0 AS (SELECT doc_id, tree, i, leaf, coalesce(changed, leaf) AS f, '' AS p FROM l)")
    for j, (x, k) in enumerate(steps):
        on = f"f{j}.tree = {x}{k}s.tree AND f{j}.i // {FAN ** k} = {x}{k}s.i" if x == "a" else f"f{j}.tree // {FAN ** k} = {x}{k}s.i"
        sql.append(f"f{j + 1} AS (SELECT doc_id, f{j}.tree, f{j}.i, leaf, CASE WHEN n > 1 THEN sha256(before || f || after) ELSE f END AS f, "
                   f"p || before || after AS p FROM f{j} JOIN {x}{k}s ON {on})")
    return ",\n".join(sql) + f"""
SELECT doc_id, leaf, a{depth}.d AS subroot, b{depth}.d AS root, sha256(p) AS proof_sha256, f AS folded_root, f = b{depth}.d AS verified
FROM f{len(steps)} JOIN a{depth} USING (tree), b{depth}
"""
