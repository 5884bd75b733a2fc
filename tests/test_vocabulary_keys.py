"""The neighbourhoods of the vocabulary are derived where a search joins them, and neither saved nor exchanged (F7)."""

from pyspark.sql import functions as F

from larder.operators.bm25 import fuzzy_expansions, text_index
from larder.operators.enrich import build_documents


def test_neighbourhoods_are_not_saved(spark):
    raw = spark.createDataFrame([(str(i), f"salted peanut{i} butter") for i in range(30)], "code string, product_name string")
    texts = build_documents(raw.select(
        "code", "product_name", *[F.lit(None).cast("string").alias(c) for c in (
            "brands", "categories", "ingredients_text", "nutriscore_grade", "nova_group", "ecoscore_grade")],
        F.lit(None).cast("map<string,struct<value:double,per_100g:double,unit:string>>").alias("nutriments"), F.lit(0.0).alias("completeness")))
    near = text_index(texts).near
    # before: a scan of saved rows, some dozens for each term
    assert "Generate explode" in near._jdf.queryExecution().optimizedPlan().toString()
    found = fuzzy_expansions(spark.createDataFrame([("peanut7",), ("buter",), ("none",)], "term string"), near)
    assert "hashpartitioning(key" not in found._jdf.queryExecution().executedPlan().toString()
    got = {(r.term, r.vterm) for r in found.collect()}
    assert ("buter", "butter") in got and ("peanut7", "peanut7") in got and ("peanut7", "peanut17") in got
    assert not any(t == "none" for t, _ in got)
