"""Exact dedup of a stream of files with disk-backed keyed state.

A first stream reads files as they arrive and logs one narrow row for each
document: SHA-256 of the normalised text (every space and 0x09-0x0D deleted),
id, code points and the content locator, which is the file and the row in it.
A second stream keeps state by digest in RocksDB, without expiry: how many rows
had the digest, and the stable identifier and locator of the one that stays
(most code points, then smallest id, then smallest locator).  Rows of one
digest are combined in each task before they travel, so a text that a third of
all rows share costs one row a task.  Both streams end when all files present
are in, and go on from their checkpoints when ``absorb`` is called again.

A digest met twice is a hit, and hits are checked on full bytes: the texts whose
digest is in a bitmap of the hits are grouped by digest and whole text, again
combined in each task first.  A digest with several texts is split into a group
for each of them; its rows are found by their locators.

The bitmap has ``FILTER_BITS`` bits (16 MB) whatever the input; a full one lets
more texts through to the check and changes no result.

Defined cases: a null text is empty, and texts that normalise to nothing are
equal; a null id sorts after all others and is returned as null; rows that
repeat an id count by themselves, and of rows that tie in all else the one with
the smaller locator stays; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm.common import NULL_ID, checkpoint_dir, cut, id_back

GAPS = " \t\n\x0b\x0c\r"
FILTER_BITS, PAGE_BITS, HOT_SHARE = 1 << 27, 1 << 15, 1000
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # space for logs is taken as it is written
}


def _located(docs: DataFrame, id_col: str, text_col: str, key_bytes: int) -> DataFrame:
    """``sha, key, did, n_chars, file, row, body`` of a table read from files; ``body`` is the normalised text."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    at = docs.metadataColumn("_metadata")
    rows = docs.select(
        F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_ID)).alias("did"), F.char_length(text).cast("long").alias("n_chars"),
        at["file_path"].alias("file"), at["row_index"].alias("row"), F.translate(text, GAPS, "").alias("body"))
    rows = rows.select("*", F.unhex(F.sha2(F.col("body").cast("binary"), 256)).alias("sha"))
    return rows.select("*", F.substring("sha", 1, key_bytes).alias("key"))


def _best():
    return F.min(F.struct((-F.col("n_chars")).alias("less"), "did", "file", "row"))


def _pattern(path: str) -> str:
    """``path`` as a pattern of itself: a stream takes a folder or a pattern, not the name of one file."""
    path = path.rstrip("/")
    return path if set(path) & set("*?[{") else f"{path[:-1]}[{path[-1]}]"


def absorb(spark: SparkSession, path: str, folder: str, id_col: str = "doc_id", text_col: str = "text", key_bytes: int = 32,
           files_each: int = 1000) -> None:
    """Takes in the Parquet files under ``path`` that ``folder`` has not seen, ``files_each`` in a micro-batch.
    The state is keyed by the first ``key_bytes`` bytes of the digest."""
    schema = spark.read.parquet(path).schema
    docs = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).parquet(_pattern(path))
    log = _located(docs, id_col, text_col, key_bytes).drop("body")
    (log.writeStream.format("parquet").option("path", f"{folder}/log").option("checkpointLocation", f"{folder}/log-progress")
     .trigger(availableNow=True).start().awaitTermination())
    kept = {k: spark.conf.get(k, None) for k in _STATE}
    try:
        for k, v in _STATE.items():
            spark.conf.set(k, v)
        rows = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", files_each).parquet(f"{folder}/log")
        (rows.groupBy("key").agg(F.count("*").alias("n"), _best().alias("best"))
         .writeStream.format("noop").outputMode("update").option("checkpointLocation", f"{folder}/state")
         .trigger(availableNow=True).start().awaitTermination())
    finally:
        for k, v in kept.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def hits(spark: SparkSession, folder: str) -> DataFrame:
    """``key, n, best`` of every digest that the state has met more than once."""
    state = spark.read.format("statestore").load(f"{folder}/state")
    n, best = (F.col(f"value.`{f.name}`") for f in state.schema["value"].dataType.fields)
    return state.where(n > 1).select(F.col("key.key").alias("key"), n.alias("n"), best.alias("best"))


def _slot(key):
    return F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))


def _hit_bodies(texts: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of ``texts`` whose digest is in the bitmap of ``found``: all hits, and few others."""
    pages = found.select(_slot(F.col("key")).alias("slot")).groupBy(F.floor(F.col("slot") / PAGE_BITS).alias("page")).agg(
        F.bitmap_construct_agg(F.col("slot") % PAGE_BITS).alias("bits"))
    slot = texts.withColumn("slot", _slot(F.col("key"))).withColumn("page", F.floor(F.col("slot") / PAGE_BITS))
    bit = (F.col("slot") % PAGE_BITS).cast("int")
    byte = F.conv(F.hex(F.substring("bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    # FILTER_BITS / PAGE_BITS pages of 4 KB at most
    return slot.join(F.broadcast(pages), "page").where(F.call_function("getbit", byte, bit % 8) == 1).drop("page", "slot", "bits")


def resolve(spark: SparkSession, path: str, folder: str, id_col: str = "doc_id", text_col: str = "text",
            key_bytes: int = 32) -> DataFrame:
    """One row for each row taken in: ``doc_id, keep_id, group_size, kept, sha`` and its locator ``file, row``."""
    log = spark.read.parquet(f"{folder}/log")
    found = cut(hits(spark, folder))
    texts = _hit_bodies(_located(spark.read.parquet(path), id_col, text_col, key_bytes), found)
    several = cut(texts.groupBy("key", "body").agg(F.count("*").alias("n")).groupBy("key").agg(F.count("*").alias("texts"))
                  .where("texts > 1").select("key"))
    # a digest of more than a HOT_SHARE-th of all rows is joined by broadcast: there are at most HOT_SHARE of them
    total = log.count()
    hot = found.where(F.col("n") * HOT_SHARE > total)
    rows = log.join(F.broadcast(hot), "key", "left")
    settled = rows.where("n IS NOT NULL")
    rest = rows.where("n IS NULL").drop("n", "best").join(found.where(F.col("n") * HOT_SHARE <= total), "key", "left")
    rows = settled.unionByName(rest)
    if not several.isEmpty():
        apart = cut(texts.join(several, "key"))
        groups = apart.groupBy("key", "body").agg(F.count("*").alias("own_n"), _best().alias("own_best"))
        own = apart.select("key", "body", "file", "row").join(groups, ["key", "body"]).drop("key", "body")
        rows = rows.join(own, ["file", "row"], "left").withColumns(
            {"n": F.coalesce("own_n", "n"), "best": F.coalesce("own_best", "best")})
    alone = F.col("n").isNull()
    return rows.select(
        id_back().alias("doc_id"), F.nullif(F.when(alone, F.col("did")).otherwise(F.col("best.did")), F.lit(NULL_ID)).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | ((F.col("best.file") == F.col("file")) & (F.col("best.row") == F.col("row")))).alias("kept"), "sha", "file", "row")


def stream_dedup(spark: SparkSession, path: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text",
                 key_bytes: int = 32, files_each: int = 1000) -> DataFrame:
    """``absorb`` and ``resolve``; without ``folder`` a new one in the shared checkpoint folder is used."""
    folder = folder or f"{checkpoint_dir(spark).rstrip('/')}/stream-dedup-{uuid.uuid4().hex}"
    absorb(spark, path, folder, id_col, text_col, key_bytes, files_each)
    return resolve(spark, path, folder, id_col, text_col, key_bytes)
