"""Dietary flags (F-1 .. F-9): substring tests on lower-cased categories and
ingredients plus per-100 g thresholds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larder.fixed_values import HIGH_PROTEIN_MIN, LOW_SODIUM_MAX, LOW_SUGAR_MAX
from larder.functions.parse import col_, nutrient_per_100g


def _any(c: Column, words) -> Column:
    out = None
    for w in words:
        t = c.contains(w)
        out = t if out is None else (out | t)
    return out


def dietary_flags(categories, ingredients, nutrition) -> Column:
    """struct of the nine is_* flags.  ``categories`` / ``ingredients`` are the
    cleaned (never NULL) texts of the raw product."""
    cat = F.lower(F.coalesce(col_(categories), F.lit("")))
    ing = F.lower(F.coalesce(col_(ingredients), F.lit("")))
    proteins = nutrient_per_100g(nutrition, "proteins")
    sugars = nutrient_per_100g(nutrition, "sugars")
    sodium = nutrient_per_100g(nutrition, "sodium")
    is_vegan = cat.contains("vegan") | ing.contains("vegan")
    return F.struct(
        _any(cat, ["organic", "bio"]) | _any(ing, ["organic", "bio"]),
        is_vegan,
        cat.contains("vegetarian") | ing.contains("vegetarian") | is_vegan,
        ~ing.contains("palm oil"),
        cat.contains("high protein") | (proteins >= HIGH_PROTEIN_MIN),
        _any(cat, ["low sugar", "sugar free", "no sugar"]) | sugars.between(0.0, LOW_SUGAR_MAX),
        _any(cat, ["low sodium", "low salt"]) | sodium.between(0.0, LOW_SODIUM_MAX),
        _any(cat, ["gluten free", "gluten-free", "sans gluten"]),
        _any(cat, ["lactose free", "dairy free", "sans lactose"]),
    ).cast("struct<is_organic:boolean,is_vegan:boolean,is_vegetarian:boolean,is_palm_oil_free:boolean,"
           "is_high_protein:boolean,is_low_sugar:boolean,is_low_sodium:boolean,is_gluten_free:boolean,"
           "is_lactose_free:boolean>")
