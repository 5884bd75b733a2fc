"""A positional text index that grows by batches (I-3 with S-9, S-10).

Postings are a table of changes by document: a batch analyses its own documents
and appends their postings, and those of replaced documents no longer count.
The document counts of terms and the lengths of fields are sums: a batch adds
its own and takes away those of the documents that it replaces, read from the
postings by their ids.  The neighbourhoods of the vocabulary grow by the terms
that are new.  ``compact`` merges each part; the rows that a search returns
equal those of an index built at once.

One writer at a time.  The parts of a batch are written one after the other, the
postings last; a batch that fails is repeated under its tag and each part is
replaced or left as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.fixed_values import SYNONYM_PAIRS
from larder.operators.bm25 import TextIndex, positional_postings, vocabulary_keys
from larder.streaming import table

# A document without any term has one row of no field, so that it replaces the document of its id.
NO_FIELD = ""


def _parts(folder: str) -> dict[str, str]:
    return {name: f"{folder.rstrip('/')}/{name}" for name in ("postings", "terms", "lengths", "near")}


def _there(spark: SparkSession, path: str) -> bool:
    _, base, changes = table.snapshot(spark, path)
    return base is not None or bool(changes)


def _added(spark: SparkSession, path: str) -> DataFrame:
    """All rows of a part that is a sum over its versions."""
    _, base, changes = table.snapshot(spark, path)
    return spark.read.parquet(*([base] if base else []), *changes.values())


def _sums(post: DataFrame, sign: int) -> tuple[DataFrame, DataFrame]:
    """``(field, term, df)`` and ``(field, n_docs, dl)`` of postings, times ``sign``."""
    post = post.where(F.col("field") != NO_FIELD)
    terms = post.groupBy("field", "term").agg((F.count(F.lit(1)) * sign).alias("df"))
    lengths = post.groupBy("field", "doc_id").agg(F.max("dl").alias("dl")).groupBy("field").agg(
        (F.count(F.lit(1)) * sign).alias("n_docs"), (F.sum("dl") * sign).alias("dl"))
    return terms, lengths


def add_batch(docs: DataFrame, folder: str, tag: str | None = None, pairs=SYNONYM_PAIRS) -> None:
    """Adds ``docs``, one row for each ``id``, and replaces the documents that have these ids."""
    spark = docs.sparkSession
    at = _parts(folder)
    if tag and any(f.endswith(f"-{tag}") for f in table.complete(spark, at["postings"])["changes"].values()):
        return
    new = positional_postings(docs, pairs).checkpoint(eager=True)
    ids = docs.select(F.col("id").alias("doc_id")).distinct()
    terms, lengths = _sums(new, 1)
    fresh = terms.select("term").distinct()
    if _there(spark, at["postings"]):
        gone = table.read_table(spark, at["postings"], "doc_id").join(ids, "doc_id", "left_semi").checkpoint(eager=True)
        old_terms, old_lengths = _sums(gone, -1)
        terms, lengths = terms.unionByName(old_terms), lengths.unionByName(old_lengths)
        fresh = fresh.join(_added(spark, at["terms"]).select("term").distinct(), "term", "left_anti")
    # a repeated batch reads the same postings, as these are written last
    table.write_changes(vocabulary_keys(fresh), at["near"], tag)
    table.write_changes(terms.groupBy("field", "term").agg(F.sum("df").alias("df")), at["terms"], tag)
    table.write_changes(lengths.groupBy("field").agg(F.sum("n_docs").alias("n_docs"), F.sum("dl").alias("dl")), at["lengths"], tag)
    empty = ids.join(new.select("doc_id").distinct(), "doc_id", "left_anti").select(
        F.lit(NO_FIELD).alias("field"), F.lit("").alias("term"), "doc_id", F.lit(0).alias("dl"), F.lit(0).cast("long").alias("tf"),
        F.array().cast("array<int>").alias("positions"))
    table.write_changes(new.unionByName(empty), at["postings"], tag)


def read_index(spark: SparkSession, folder: str, pairs=SYNONYM_PAIRS) -> TextIndex:
    """The index as of its last complete batch."""
    at = _parts(folder)
    post = table.read_table(spark, at["postings"], "doc_id").where(F.col("field") != NO_FIELD)
    terms = _added(spark, at["terms"]).groupBy("field", "term").agg(F.sum("df").alias("df")).where("df > 0")
    stats = _added(spark, at["lengths"]).groupBy("field").agg(F.sum("n_docs").alias("n_docs"), F.sum("dl").alias("dl")).where("n_docs > 0")
    return TextIndex(post, terms, stats.select("field", "n_docs", (F.col("dl") / F.col("n_docs")).alias("avgdl")),
                     _added(spark, at["near"]).distinct(), pairs)


def compact(spark: SparkSession, folder: str) -> None:
    """Merges the postings, and the sums with them."""
    at = _parts(folder)
    table.compact(spark, at["postings"], "doc_id")
    sums = {"terms": (["field", "term"], {"df": "sum"}), "lengths": (["field"], {"n_docs": "sum", "dl": "sum"})}
    for part, (keys, values) in sums.items():
        rows = _added(spark, at[part]).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in values])
        table.write_base(rows.where(" OR ".join(f"{c} <> 0" for c in values)), at[part])
    table.write_base(_added(spark, at["near"]).distinct(), at["near"])
