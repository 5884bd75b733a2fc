"""Phrase annotation golden values and filter derivation."""

import pytest

from larder.operators.annotate import annotate
from larder.operators.filters import derive_requests

DICT = [("silk almond", "brands", 1, False, False), ("compliments", "brands", 1, False, False),
        ("kroger", "brands", 1, False, False), ("chips", "brands", 1, False, True),
        ("soy", "ingredients", 3, False, True), ("almond", "ingredients", 3, False, True),
        ("milk", "ingredients", 3, False, True), ("vermont", "countries", 7, False, False),
        ("peanut butter", "ingredients", 3, False, True)]


@pytest.fixture(scope="module")
def dictionary(spark):
    return spark.createDataFrame(DICT, "term string, kind string, priority int, in_categories boolean, "
                                       "in_ingredients boolean")


def ann(spark, dictionary, phrases):
    df = spark.createDataFrame([(str(i), p) for i, p in enumerate(phrases)], "query_id string, phrase string")
    rows = annotate(df, dictionary).collect()
    return {r["original_query"]: r for r in rows}


def test_normalisation(spark, dictionary):
    a = ann(spark, dictionary, ["  Kirkland, Maple Syrup! (Organic?)  ", "Gluten-Free, Sugar-Free!",
                                "compliments soya sauce", "soybean oil", "Crème brûlée"])
    assert a["  Kirkland, Maple Syrup! (Organic?)  "]["normalized_query"] == "kirkland maple syrup organic"
    assert a["Gluten-Free, Sugar-Free!"]["normalized_query"] == "gluten-free sugar-free"
    assert a["compliments soya sauce"]["normalized_query"] == "compliments soy sauce"
    assert a["soybean oil"]["normalized_query"] == "soybean oil"
    assert a["Crème brûlée"]["normalized_query"] == "crème brûlée"


def test_entities(spark, dictionary):
    a = ann(spark, dictionary, ["silk almond milk", "maple syrup from vermont", "milk and milk"])
    e = a["silk almond milk"]["entities"]
    assert [x["value"] for x in e["brands"]] == ["silk almond"]
    assert [x["value"] for x in e["ingredients"]] == ["milk"]
    assert [x["value"] for x in a["maple syrup from vermont"]["entities"]["countries"]] == ["vermont"]
    assert [x["value"] for x in a["milk and milk"]["entities"]["ingredients"]] == ["milk", "milk"]


def test_all_nine_filters(spark, dictionary):
    p = "organic vegan vegetarian palm oil free high protein sugar free low salt gluten free lactose free"
    r = ann(spark, dictionary, [p])[p]
    f = r["filters"].asDict()
    assert f["palm_oil"] is False
    assert all(v is True for k, v in f.items() if k != "palm_oil")
    assert len(r["explanations"]) == 9


def test_constraints(spark, dictionary):
    a = ann(spark, dictionary, ["low sugar peanut butter", "palm oil free peanut butter", "sugar cookies",
                                "snacks under 200 calories", "fresh organic milk",
                                "500 mL (2 cups) frozen blueberries", "2% milk", "by brand kirkland"])
    assert a["low sugar peanut butter"]["filters"]["low_sugar"] is True
    assert a["low sugar peanut butter"]["text_term"] == "peanut butter"
    assert a["palm oil free peanut butter"]["filters"]["palm_oil"] is False
    assert all(v is None for v in a["sugar cookies"]["filters"].asDict().values())
    nf = a["snacks under 200 calories"]["numeric_filters"][0]
    assert (nf["nutrient"], nf["operator"], nf["value"], nf["unit"], nf["comparison_basis"]) == \
        ("calories", "lte", 200.0, "calories", "per_100g")
    assert a["fresh organic milk"]["modifiers"] == ["fresh"]
    assert a["fresh organic milk"]["text_term"] == "fresh milk"
    b = a["500 mL (2 cups) frozen blueberries"]
    assert b["text_term"] == "frozen blueberries"
    assert [(q["value"], q["unit"]) for q in b["recipe_quantities"]] == [(500.0, "ml"), (2.0, "cups")]
    assert a["2% milk"]["text_term"] == "2 milk" and a["2% milk"]["recipe_quantities"] == []
    k = a["by brand kirkland"]
    assert k["intent"] == "brand_search" and k["entities"]["brands"][0]["value"] == "kirkland"


def test_brand_promotion(spark, dictionary):
    phrases = ["Compliments soy sauce", "Kroger", "chips", "soy sauce"]
    df = spark.createDataFrame([(p, p) for p in phrases], "query_id string, phrase string")
    r = {x["query_id"]: x for x in derive_requests(annotate(df, dictionary), dictionary).collect()}
    assert r["Compliments soy sauce"]["brand_f"] == "compliments"
    assert r["Compliments soy sauce"]["text"] == "soy sauce"
    for p in ("Kroger", "chips", "soy sauce"):
        assert r[p]["brand_f"] is None


def test_tiered_minimum_should_match(spark):
    from pyspark.sql import functions as F

    from larder.operators.bm25 import tiered_minimum_should_match
    df = spark.createDataFrame([(n,) for n in (1, 2, 3, 4, 7)], "n int")
    got = [r[0] for r in df.select(tiered_minimum_should_match(F.col("n"))).collect()]
    assert got == [1, 2, 2, 3, 4]
