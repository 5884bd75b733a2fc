"""Filter derivation: annotations (+ optional explicit overrides) -> retrieval
requests (D-1 .. D-11)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.fixed_values import CONSTRAINT_TO_FLAG, FLAG_NAMES
from larder.operators.joins import broadcast_if_small

OVERRIDE_MARK = "Manual override"
ENTITY_T = "array<struct<value:string,explanation:string>>"
OVERRIDES_SCHEMA = ("query_id string, brand string, category string, ingredients string, organic boolean, "
                    "vegan boolean, vegetarian boolean, palm_oil boolean, high_protein boolean, low_sugar boolean, "
                    "low_sodium boolean, gluten_free boolean, lactose_free boolean")


def _override_entity(v):
    return F.when(v.isNotNull(), F.array(F.struct(v.alias("value"), F.lit(
        "Manual override from API parameter").alias("explanation")))).otherwise(F.array().cast(ENTITY_T))


def merge_overrides(ann: DataFrame, overrides: DataFrame | None) -> DataFrame:
    """D-1: explicit brand/category/ingredients become entities marked as
    manual overrides; other keys overwrite the extracted filters."""
    if overrides is None:
        return ann
    o = overrides.select([F.col(c).alias(f"o_{c}") if c != "query_id" else F.col(c) for c in overrides.columns])
    df = ann.join(o, "query_id", "left")
    ents = F.col("entities")
    new_entities = ents.withField("brands", F.concat(ents["brands"], _override_entity(F.col("o_brand")))) \
        .withField("categories", F.concat(ents["categories"], _override_entity(F.col("o_category")))) \
        .withField("ingredients", F.concat(ents["ingredients"], _override_entity(F.col("o_ingredients"))))
    filt = F.col("filters")
    for k in ["organic", "vegan", "vegetarian", "palm_oil", "high_protein", "low_sugar", "low_sodium",
              "gluten_free", "lactose_free"]:
        if f"o_{k}" in df.columns:
            filt = filt.withField(k, F.coalesce(F.col(f"o_{k}"), filt[k]))
    df = df.withColumn("entities", new_entities).withColumn("filters", filt)
    return df.drop(*[c for c in df.columns if c.startswith("o_")])


def strip_brand(text, brand) -> F.Column:
    """D-4: remove the brand phrase, bounded by non-[a-z0-9]."""
    pat = F.concat(F.lit(r"(?<![a-z0-9])\Q"), F.lower(brand), F.lit(r"\E(?![a-z0-9])"))
    out = F.regexp_replace(F.lower(text), pat, F.lit(" "))
    return F.trim(F.regexp_replace(out, r"(?U)\s+", " "))


def derive_requests(ann: DataFrame, dictionary: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Annotations -> one retrieval request per phrase:
    ``query_id, text, brand_f, category_f, ingredients_f, flag_filters,
    numeric_filters, modifiers, size, from_, page``.

    ``dictionary`` supplies the category/ingredient word sets for the
    brand-only test (J-3, a left join against the size-bounded dictionary)."""
    df = merge_overrides(ann, overrides)
    ci = (dictionary.where(F.col("in_categories") | F.col("in_ingredients")).select(
        F.col("term").alias("_ci_term")).withColumn("_ambiguous", F.lit(True)))
    brands = F.col("entities.brands")
    first_brand = F.get(brands, 0)["value"]
    df = df.withColumn("_b0", F.lower(first_brand))
    df = df.join(broadcast_if_small(ci), F.col("_b0") == F.col("_ci_term"), "left").drop("_ci_term")

    def override(bucket):
        return F.exists(F.col(f"entities.{bucket}"), lambda e: e["explanation"].contains(OVERRIDE_MARK))

    intent = F.col("intent")
    text = F.col("text_term")
    brand_rule = (intent == "brand_search") | override("brands")
    remaining = strip_brand(text, first_brand)
    promote = (~brand_rule & (F.size(brands) > 0) & (intent == "generic_search") & F.col("_ambiguous").isNull()
               & (text != "") & (remaining != ""))
    brand_f = F.when(brand_rule, first_brand).when(promote, first_brand)
    text_after = F.when(promote, remaining).otherwise(text)
    cat_f = F.when((intent == "category_browse") | override("categories"), F.get(F.col("entities.categories"), 0)[
        "value"])
    ing_f = F.when((intent == "ingredient_search") | override("ingredients"), F.get(F.col("entities.ingredients"), 0)[
        "value"])
    flags = {"is_palm_oil_free": ~F.col("filters.palm_oil")}
    for key, flag in CONSTRAINT_TO_FLAG.items():
        flags[flag] = F.col(f"filters.{key}")
    flag_struct = F.struct(*[flags[f].alias(f) for f in FLAG_NAMES])
    final_text = F.when(intent.isin("brand_search", "category_browse", "ingredient_search"), F.lit("")).otherwise(
        text_after)
    size = F.col("pagination.size")
    from_ = F.col("pagination.from")
    return df.select(
        "query_id", "intent", final_text.alias("text"), text_after.alias("parsed_query"),
        # an empty value is no filter
        *[F.nullif(F.trim(c), F.lit("")).alias(n)
          for c, n in ((brand_f, "brand_f"), (cat_f, "category_f"), (ing_f, "ingredients_f"))],
        flag_struct.alias("flag_filters"), "numeric_filters", "modifiers",
        size.alias("size"), from_.alias("from_"),
        F.when(size > 0, F.floor(from_ / size) + 1).otherwise(F.lit(1)).cast("int").alias("page"),
    )
