"""Judgment and synonym-file sources (S-15, S-17)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.operators.evaluate import CLASSIC_SCHEMA, STRUCTURED_SCHEMA

# File layouts (without the query_id we add: the phrase is its own id).
CLASSIC_FILE_SCHEMA = CLASSIC_SCHEMA.replace("query_id string, ", "")
STRUCTURED_FILE_SCHEMA = STRUCTURED_SCHEMA.replace("query_id string, ", "")


def read_judgments(spark: SparkSession, path: str, structured: bool = False) -> DataFrame:
    """S-15: a JSON array file of judgments, read with an explicit nested
    schema (never inferred); the query text doubles as query_id."""
    schema = STRUCTURED_FILE_SCHEMA if structured else CLASSIC_FILE_SCHEMA
    # an exclusion is a term, or an object with a term and a scope: both are read as text
    entry = "struct<term:string,scope:string>"
    df = spark.read.schema(schema.replace(f"excluded:array<{entry}>", "excluded:array<string>")).option("multiLine", True).json(path)
    if structured:
        df = df.withColumn("relevance", F.when(F.col("relevance").isNotNull(), F.col("relevance").withField(
            "excluded", F.transform("relevance.excluded", lambda e: F.when(
                e.startswith("{"), F.from_json(e, entry)).otherwise(
                F.struct(e.alias("term"), F.lit(None).cast("string").alias("scope")))))))
    return df.select(F.col("query").alias("query_id"), "*")


def read_synonym_pairs(spark: SparkSession, path: str) -> DataFrame:
    """S-17: one pair per line; blank and '#' lines skipped; parts trimmed and
    lower-cased; only lines with exactly two non-empty parts kept.
    Output (canonical, variant): the first part is the canonical head (Q-5)."""
    lines = spark.read.text(path).select(F.trim("value").alias("line"))
    lines = lines.where((F.col("line") != "") & ~F.col("line").startswith("#"))
    parts = lines.select(F.filter(F.transform(F.split("line", ","), lambda p: F.lower(F.trim(p))),
                                  lambda p: p != "").alias("p"))
    return parts.where(F.size("p") == 2).select(F.col("p")[0].alias("canonical"), F.col("p")[1].alias("variant"))


MAX_SYNONYM_PAIRS = 10_000


def synonym_pairs(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """S-17 for the text functions, which take the pairs as a parameter: a file of ``MAX_SYNONYM_PAIRS`` pairs at most."""
    rows = read_synonym_pairs(spark, path).distinct().limit(MAX_SYNONYM_PAIRS + 1).collect()
    if len(rows) > MAX_SYNONYM_PAIRS:
        raise ValueError(f"more than {MAX_SYNONYM_PAIRS} synonym pairs")
    return sorted(tuple(r) for r in rows)


def canonical_map(pairs: DataFrame) -> DataFrame:
    """Q-5: both members of a pair map to the pair's head."""
    return pairs.select(F.explode(F.array("canonical", "variant")).alias("term"), "canonical")
