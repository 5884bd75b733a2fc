"""Annotation of a stream of phrases (Q-20).

Phrases arrive in files with the time they were asked at.  Keyed state keeps
each phrase for ``keep``: a phrase that is asked again within it is
not annotated again.  State older than the watermark is dropped, so it is bounded by the
phrases of that time.  A micro-batch joins the dictionary as it stands and is
appended to a table of changes under its batch number, so a replayed batch adds nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.operators.annotate import annotate
from larder.streaming import table

KEY = "query_id"


def annotate_stream(spark: SparkSession, source: str, target: str, progress: str, dictionary: DataFrame | str, keep: str = "1 hour",
                    files_each: int = 100, name: str = "phrases", **options):
    """Starts the query over ``source`` (Parquet: query_id, phrase, asked_at); it ends when all files are in.
    ``dictionary`` is a table, or the path of one that is read anew in each batch.  Further options go to ``annotate``."""
    schema = spark.read.parquet(source).schema
    asked = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).parquet(source)
    once = asked.withWatermark("asked_at", keep).dropDuplicatesWithinWatermark(["phrase"])

    def answer(batch: DataFrame, batch_id: int) -> None:
        words = batch.sparkSession.read.parquet(dictionary) if isinstance(dictionary, str) else dictionary
        table.write_changes(annotate(batch.select(KEY, "phrase").checkpoint(eager=True), words, **options), target, f"{name}.{batch_id}")

    return (once.writeStream.foreachBatch(answer).option("checkpointLocation", progress).trigger(availableNow=True).start())


def read_annotations(spark: SparkSession, target: str) -> DataFrame:
    """The newest annotation of each query id."""
    return table.read_table(spark, target, KEY)
