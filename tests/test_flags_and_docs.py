"""Dietary flags, document build and schema drift."""

from larder.operators.enrich import build_documents
from larder.sources.products import raw_products

COLS = "code string, product_name string, brands string, categories string, ingredients_text string, nutriments string"


def flags_of(spark, rows):
    docs = build_documents(raw_products(spark.createDataFrame(rows, COLS)))
    return {r["id"]: r["attributes"]["flags"].asDict() for r in docs.collect()}


def test_thresholds(spark):
    f = flags_of(spark, [
        ("1", "a", "", "", "", '{"sugars": 4}'),
        ("2", "b", "", "", "", '{"proteins": 25}'),
        ("3", "c", "", "", "", '{"sugars": 40}'),
        ("4", "d", "", "", "", ""),
        ("5", "e", "", "", "", '{"sugars": 0}'),
    ])
    assert f["1"]["is_low_sugar"] and not f["3"]["is_low_sugar"] and f["5"]["is_low_sugar"]
    assert f["2"]["is_high_protein"]
    assert not any(f["4"][k] for k in ("is_low_sugar", "is_high_protein", "is_low_sodium"))
    assert f["4"]["is_palm_oil_free"]


def test_organic_granola_vegan_cocoa(spark):
    f = flags_of(spark, [("1", "Organic Granola", "Acme", "Breakfast cereals, Organic", "oats, vegan cocoa", "")])
    assert f["1"]["is_organic"] and f["1"]["is_vegan"] and f["1"]["is_vegetarian"]


def test_probiotic_counts_as_organic(spark):
    assert flags_of(spark, [("1", "x", "", "", "probiotic culture", "")])["1"]["is_organic"]


def test_document_text(spark):
    docs = build_documents(raw_products(spark.createDataFrame(
        [("1", "Peanut Butter", "", "Spreads", "peanuts", "")], COLS))).first()
    assert docs["search_text"] == "Peanut Butter Spreads peanuts"
    assert docs["semantic_document"] == "Product: Peanut Butter\n\nCategory: Spreads\n\nIngredients:\npeanuts"
    assert docs["brand"] is None


def test_schema_drift(spark):
    df = spark.createDataFrame([("7", "Clean Name", "Raw Name", "B", "C", "I")],
                               "ID string, product_name_clean string, product_name string, brand string, "
                               "Category string, ingredients string")
    r = raw_products(df).first()
    assert (r["code"], r["product_name"], r["brands"], r["categories"], r["ingredients_text"]) == \
        ("7", "Clean Name", "B", "C", "I")
    assert r["nutriments"] == {} and r["completeness"] == 0.0
