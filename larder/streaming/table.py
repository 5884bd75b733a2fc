"""A table that takes small batches of changes (S-10): change folders with
versions, merged on read, compacted when they outgrow the base.

``base-<v>`` holds the state after version v, ``changes-<w>`` the rows that
version w wrote.  A folder counts once Spark's writer has set its ``_SUCCESS``
mark, so a batch that fails leaves the table as it was, and a batch that is
replayed replaces its own folder.  A batch writes only its rows.  Of each key
the rows of the newest version count, all of them: a key may have one row (a
document) or many (the postings of a document).

The base is sorted by key in as many files as its rows ask for, so look-ups by
key skip files by their statistics, and the files split as the table grows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_PER_FILE = 1_000_000
#: Changes are merged into the base when they have more than this share of its rows.
COMPACT_SHARE = 0.2
VERSION = "_version"


def _folder(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def complete(spark: SparkSession, path: str) -> dict[str, dict[int, str]]:
    """Complete ``base`` and ``changes`` folders under ``path`` by version."""
    fs, where = _folder(spark, path)
    out: dict[str, dict[int, str]] = {"base": {}, "changes": {}}
    if not fs.exists(where):
        return out
    for status in fs.listStatus(where):
        name = status.getPath().getName()
        m = re.fullmatch(r"(base|changes)-(\d+)(-.*)?", name)
        if m and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            out[m[1]][int(m[2])] = f"{path}/{name}"
    return {k: dict(sorted(v.items())) for k, v in out.items()}


def snapshot(spark: SparkSession, path: str) -> tuple[int | None, str | None, dict[int, str]]:
    """The newest base, its folder, and the folders of the changes after it."""
    found = complete(spark, path)
    base = max(found["base"], default=None)
    return base, found["base"].get(base), {v: f for v, f in found["changes"].items() if base is None or v > base}


def write_changes(rows: DataFrame, path: str, tag: str | None = None) -> int | None:
    """Writes ``rows`` as the next version.  A ``tag`` names a batch that may be replayed: if one with it is complete,
    nothing is written and None returned.  One writer at a time."""
    spark = rows.sparkSession
    found = complete(spark, path)
    if tag and any(f.endswith(f"-{tag}") for f in found["changes"].values()):
        return None
    version = max([-1, *found["base"], *found["changes"]]) + 1
    rows.write.mode("overwrite").parquet(f"{path}/changes-{version:012d}" + (f"-{tag}" if tag else ""))
    return version


def _changed(spark: SparkSession, folders: dict[int, str], key: str) -> DataFrame | None:
    """The rows of the newest version of each key."""
    out = None
    for v, folder in folders.items():
        rows = spark.read.parquet(folder).withColumn(VERSION, F.lit(v).cast("long"))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    if out is None or len(folders) == 1:
        return None if out is None else out.drop(VERSION)
    newest = out.groupBy(key).agg(F.max(VERSION).alias(VERSION))
    return out.join(newest, [key, VERSION], "left_semi").drop(VERSION)


def read_table(spark: SparkSession, path: str, key: str = "id") -> DataFrame:
    """The table as of its newest complete version."""
    _, base, folders = snapshot(spark, path)
    changes = _changed(spark, folders, key)
    if base is None:
        if changes is None:
            raise FileNotFoundError(f"no complete version under {path}")
        return changes
    rows = spark.read.parquet(base)
    if changes is None:
        return rows
    return rows.join(changes.select(key).distinct(), key, "left_anti").unionByName(changes, allowMissingColumns=True)


def compact(spark: SparkSession, path: str, key: str = "id", rows_per_file: int = ROWS_PER_FILE) -> int | None:
    """Writes a base of all versions; the base before it and its changes stay for readers that hold them, older ones go."""
    if not snapshot(spark, path)[2]:
        return None
    rows = read_table(spark, path, key)
    files = max(1, -(-rows.count() // rows_per_file))
    return write_base(rows.repartitionByRange(files, key).sortWithinPartitions(key), path)


def write_base(rows: DataFrame, path: str) -> int | None:
    """Makes ``rows`` the state after all complete versions; None, and nothing written, if there are none since the base."""
    spark = rows.sparkSession
    before, _, folders = snapshot(spark, path)
    if not folders:
        return None
    newest = max(folders)
    rows.write.mode("overwrite").parquet(f"{path}/base-{newest:012d}")
    fs, _ = _folder(spark, path)
    for kind, found in complete(spark, path).items():
        for v, folder in found.items():
            if before is not None and (v < before if kind == "base" else v <= before):
                fs.delete(_folder(spark, folder)[1], True)
    return newest


def compact_if_due(spark: SparkSession, path: str, key: str = "id", share: float = COMPACT_SHARE,
                   rows_per_file: int = ROWS_PER_FILE) -> int | None:
    _, base, folders = snapshot(spark, path)
    held = spark.read.parquet(base).count() if base else 0  # from the files' footers
    if folders and spark.read.parquet(*folders.values()).count() > share * held:
        return compact(spark, path, key, rows_per_file)
    return None


def table_exists(spark: SparkSession, path: str) -> bool:
    fs, where = _folder(spark, path)
    return bool(fs.exists(where))


def drop_table(spark: SparkSession, path: str) -> bool:
    """S-13: removes the table; False if there was none."""
    fs, where = _folder(spark, path)
    return bool(fs.exists(where) and fs.delete(where, True))
