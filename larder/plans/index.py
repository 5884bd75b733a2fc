"""Index build: products -> documents -> search table, postings, vocabulary
grams, plus the entity dictionary.  Built once, queried by many phrase batches.

Each table is materialised with a reliable ``checkpoint()`` into the shared
folder named by ``spark.checkpoint.dir``, which cuts the lineage (a lost
executor re-reads the checkpoint instead of re-parsing every product).
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.operators.bm25 import TextIndex, text_index
from larder.operators.dictionary import build_dictionary
from larder.operators.enrich import build_documents, search_table
from larder.operators.retrieve import gram_counts, postings, vocabulary_grams
from larder.session import ensure_checkpoint_dir
from larder.sources.products import raw_products


@dataclass
class CatalogIndex:
    raw: DataFrame
    docs: DataFrame
    search: DataFrame
    postings: DataFrame
    vgrams: DataFrame
    counts: DataFrame
    dictionary: DataFrame
    text: TextIndex | None = None


def build_index(spark: SparkSession, products: DataFrame, materialize: bool = True,
                partitions: int | None = None, dictionary: DataFrame | None = None) -> CatalogIndex:
    """``products`` is any drift-named raw product frame (S-1), ``dictionary``
    that of the same products, if built before.

    The search table and the postings are bucketed by ``doc_id`` into the
    same number of buckets, so the candidate ``distinct`` and the
    candidate-to-document join of every later search run without an
    exchange on the document side."""
    raw = raw_products(products)
    docs = build_documents(raw)
    st = search_table(docs)
    if materialize:
        ensure_checkpoint_dir(spark)
        docs = docs.checkpoint(eager=True)
        n = partitions or bucket_count(docs)
        st = bucketed_table(spark, search_table(docs), "doc_id", n, "search")
    # the dictionary reads the materialised documents, not a second parse
    if dictionary is None:
        dictionary = product_dictionary(docs)
        if materialize:
            dictionary = dictionary.checkpoint(eager=True)
    post = postings(st)
    if materialize:
        post = bucketed_table(spark, post, "doc_id", n, "postings")
    vg = vocabulary_grams(post)
    if materialize:
        vg = vg.checkpoint(eager=True)
    counts = gram_counts(vg)
    if materialize:
        counts = counts.checkpoint(eager=True)
    return CatalogIndex(raw, docs, st, post, vg, counts, dictionary)


def product_dictionary(docs: DataFrame) -> DataFrame:
    """The entity dictionary of the documents: it reads three of their fields."""
    return build_dictionary(docs.sparkSession, docs.select(
        F.coalesce("brand", F.lit("")).alias("brands"), F.coalesce("category", F.lit("")).alias("categories"),
        F.coalesce("ingredients", F.lit("")).alias("ingredients_text")))


# Documents of a bucket: more of them make more buckets, so that a task doesn't grow with the input.
DOCS_PER_BUCKET = 20_000


def bucket_count(docs: DataFrame) -> int:
    """Buckets of the tables by document: the shuffle partitions, more for many documents."""
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // DOCS_PER_BUCKET))


def bucketed_table(spark: SparkSession, df: DataFrame, key: str, buckets: int, name: str, dealt: bool = False) -> DataFrame:
    """Write ``df`` as an external table bucketed and sorted by ``key`` under
    the shared checkpoint folder and read it back.  Unlike a checkpoint, a
    bucketed scan tells the planner its hash partitioning, so joins and
    aggregates on ``key`` against another table bucketed the same way need no
    exchange.  ``dealt``: its rows lie by ``key`` in ``buckets`` partitions."""
    table, path = _shared_path(spark, name)
    # one task writes a bucket, so a bucket is one sorted file
    df = df if dealt else df.repartition(buckets, key)
    (df.write.mode("overwrite").option("compression", "zstd").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table))
    return spark.table(table)


def saved_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` as written under the shared checkpoint folder: compressed columns take a small part of a checkpoint's room."""
    spark = df.sparkSession
    _, path = _shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _shared_path(spark: SparkSession, name: str) -> tuple[str, str]:
    table = f"larder_{name}_{uuid.uuid4().hex[:12]}"
    return table, os.path.join(ensure_checkpoint_dir(spark), "tables", table)


_CACHE: dict = {}
_DICTIONARIES: dict = {}


def shared_index(spark: SparkSession, key: str, products_fn) -> CatalogIndex:
    """One index per (session, input) for all registered queries."""
    k = (id(spark), key)
    if k not in _CACHE:
        _CACHE[k] = build_index(spark, products_fn(), dictionary=_DICTIONARIES.get(k))
    return _CACHE[k]


def shared_dictionary(spark: SparkSession, key: str, products_fn) -> DataFrame:
    """The dictionary of ``shared_index``; for annotation alone it is built without search table and postings."""
    k = (id(spark), key)
    if k in _CACHE:
        return _CACHE[k].dictionary
    if k not in _DICTIONARIES:
        ensure_checkpoint_dir(spark)
        _DICTIONARIES[k] = product_dictionary(build_documents(raw_products(products_fn()))).checkpoint(eager=True)
    return _DICTIONARIES[k]


def shared_text_index(ix: CatalogIndex) -> TextIndex:
    """The positional index of the documents, built when first asked for and kept with ``ix``."""
    if ix.text is None:
        ix.text = text_index(ix.docs)
    return ix.text
