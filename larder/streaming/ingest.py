"""Incremental ingest, upsert and rejects (S-9 .. S-12).

A stream of raw product files runs through exactly the batch transform
(``raw_products`` -> ``build_documents``) inside ``foreachBatch``; each
micro-batch is appended to the target table as changes by id and rows
that cannot be indexed go to a reject sink.  The streaming checkpoint lives
under the shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.operators.enrich import build_documents
from larder.session import ensure_checkpoint_dir
from larder.sources.products import raw_products
from larder.streaming import table


def keep_latest(df: DataFrame, key: str, order_cols: list[str]) -> DataFrame:
    """S-10 keep-latest per key.  ``max_by`` over a struct is a partial
    aggregate, so a key holding a large share of the rows is reduced on the
    map side instead of being gathered into one task."""
    cols = [c for c in df.columns if c != key]
    order = F.struct(*[F.col(c) for c in order_cols])
    latest = df.groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("_row"))
    return latest.select(key, *[F.col(f"_row.{c}").alias(c) for c in cols])


def upsert(target: DataFrame | None, incoming: DataFrame, key: str = "id",
           version_col: str = "_version") -> DataFrame:
    """Rows of ``incoming`` replace rows of ``target`` with the same key; within
    ``incoming`` a higher ``version_col`` wins."""
    inc = keep_latest(incoming, key, [version_col]) if version_col in incoming.columns else incoming
    inc = inc.drop(version_col) if version_col in inc.columns else inc
    if target is None:
        return inc
    return target.join(inc.select(key), key, "left_anti").unionByName(inc)


REJECT_RULES = [
    # a product without a name is indexed all the same
    ("missing_id", lambda: (F.col("id").isNull()) | (F.col("id") == "")),
]


def with_reject_reason(docs: DataFrame) -> DataFrame:
    """S-11: first failing rule per document, NULL when the document is fine."""
    reason = F.lit(None).cast("string")
    for name, rule in reversed(REJECT_RULES):
        reason = F.when(rule(), F.lit(name)).otherwise(reason)
    return docs.withColumn("reject_reason", reason)


def split_rejects(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    tagged = with_reject_reason(docs)
    good = tagged.where(F.col("reject_reason").isNull()).drop("reject_reason")
    bad = tagged.where(F.col("reject_reason").isNotNull()).select(
        F.col("id").alias("_id"), F.col("reject_reason").alias("error"))
    return good, bad


def rebuild_metrics(raw: DataFrame, written: DataFrame, seconds: float | None = None) -> DataFrame:
    """S-12: attempted, written, with-nutrition counts; the attempted count is
    one scalar action, the rest one aggregate pass over the written table."""
    attempted = raw.count()
    out = written.agg(F.lit(attempted).alias("attempted"), F.count(F.lit(1)).alias("written"),
                      F.count_if(F.size("attributes.nutrition") > 0).alias("with_nutrition"))
    if seconds:
        out = out.withColumn("docs_per_sec", F.col("written") / F.lit(seconds))
    return out


def ingest_batch(batch: DataFrame, target_path: str, reject_path: str, batch_id: int | None = None,
                 key: str = "id", name: str = "ingest") -> None:
    """One micro-batch (or one batch job): parse, build, upsert, reject.

    The batch is appended to the target as one version (``streaming.table``), so it
    writes its own rows only, whatever ids they have; the target is compacted when its changes outgrow
    its base.  Read it with ``table.read_table``."""
    # parsed once; rows keep the order of the files, so of several rows of an id the last one wins
    docs = build_documents(raw_products(batch)).withColumn("_version", F.monotonically_increasing_id())
    spark = batch.sparkSession
    ensure_checkpoint_dir(spark)
    good, bad = split_rejects(docs.checkpoint(eager=True))
    table.write_changes(upsert(None, good, key), target_path, None if batch_id is None else f"{name}.{batch_id}")
    table.compact_if_due(spark, target_path, key)
    # a replayed batch replaces its own rejects
    if batch_id is None:
        bad.write.mode("append").json(reject_path)
    else:
        bad.write.mode("overwrite").json(f"{reject_path}/batch={batch_id}")


def start_incremental_ingest(spark: SparkSession, source_dir: str, schema: T.StructType, target_path: str,
                             reject_path: str, max_files_per_trigger: int = 1, name: str = "ingest"):
    """S-9: stream raw product files into the document table."""
    ckpt = os.path.join(ensure_checkpoint_dir(spark), f"stream-{name}")
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
              .parquet(source_dir))
    return (stream.writeStream.option("checkpointLocation", ckpt)
            .foreachBatch(lambda df, bid: ingest_batch(df, target_path, reject_path, bid, name=name))
            .trigger(availableNow=True).start())
