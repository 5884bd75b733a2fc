"""Document build (F-10 .. F-14) and the search-ready document table (R-8).

Pure projections: no shuffle between the scan and the sink.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.fixed_values import SYNONYM_PAIRS
from larder.functions.flags import dietary_flags
from larder.functions.text import canonicalize


def _nz(c: str):
    return F.when(F.col(c) != "", F.col(c))


def search_text(name="product_name", brands="brands", categories="categories", ingredients="ingredients_text"):
    """F-12: non-empty fields joined by one space."""
    return F.concat_ws(" ", *[_nz(c) for c in (name, brands, categories, ingredients)])


def semantic_document(name="product_name", brands="brands", categories="categories",
                      ingredients="ingredients_text"):
    """F-13: labelled parts joined by a blank line."""
    parts = [
        F.when(F.col(name) != "", F.concat(F.lit("Product: "), F.col(name))),
        F.when(F.col(brands) != "", F.concat(F.lit("Brand: "), F.col(brands))),
        F.when(F.col(categories) != "", F.concat(F.lit("Category: "), F.col(categories))),
        F.when(F.col(ingredients) != "", F.concat(F.lit("Ingredients:\n"), F.col(ingredients))),
    ]
    return F.concat_ws("\n\n", *parts)


def build_documents(raw: DataFrame, dataset_id: str = "default") -> DataFrame:
    """F-14: raw products -> normalised documents."""
    return raw.select(
        F.col("code").alias("id"),
        F.lit(dataset_id).alias("dataset_id"),
        F.lit(None).cast("string").alias("core_product_id"),
        F.lit(None).cast("string").alias("variant_id"),
        F.col("product_name"),
        _nz("brands").alias("brand"),
        _nz("categories").alias("category"),
        _nz("ingredients_text").alias("ingredients"),
        F.struct(
            F.col("nutriments").alias("nutrition"),
            dietary_flags("categories", "ingredients_text", "nutriments").alias("flags"),
        ).alias("attributes"),
        F.struct("nutriscore_grade", "nova_group", "ecoscore_grade", "completeness").alias("metadata"),
        search_text().alias("search_text"),
        semantic_document().alias("semantic_document"),
    )


def search_table(docs: DataFrame, pairs=SYNONYM_PAIRS) -> DataFrame:
    """Columns the tiered scorer and the filters read, computed once per
    document instead of once per (phrase, document) pair:

    * ``*_l``: lower-cased fields (candidate and filter tests),
    * ``*_c``: lower-cased and synonym-canonicalised fields (scoring, R-8).
    """
    low = {
        "name_l": F.lower(F.coalesce("product_name", F.lit(""))),
        "brand_l": F.lower(F.coalesce("brand", F.lit(""))),
        "cat_l": F.lower(F.coalesce("category", F.lit(""))),
        "ing_l": F.lower(F.coalesce("ingredients", F.lit(""))),
        "text_l": F.lower(F.coalesce("search_text", F.lit(""))),
    }
    cols = [F.col("id").alias("doc_id"), F.col("product_name"), F.col("brand"), F.col("category"),
            F.col("ingredients"), F.col("search_text")]
    cols += [v.alias(k) for k, v in low.items()]
    cols += [canonicalize(v, pairs).alias(k[:-2] + "_c") for k, v in low.items()]
    cols += [F.col("attributes.flags").alias("flags"), F.col("attributes.nutrition").alias("nutrition"),
             F.coalesce(F.col("metadata.completeness"), F.lit(0.0)).alias("completeness")]
    return docs.select(*cols)
