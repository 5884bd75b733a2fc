"""Parser golden values (nutriment shapes, multilingual text, safe casts)."""

import json

import pytest
from pyspark.sql import functions as F

from larder.functions import parse as P

NUTRIENTS = {"energy": (300, 1250, "kcal"), "fat": (7, 7, "g"), "saturated-fat": (3, 3, "g"), "sugars": (21, 21, "g"),
             "proteins": (13, 13, "g")}
FULL_JSON = json.dumps({k: {"value": v, "per_100g": p, "unit": u} for k, (v, p, u) in NUTRIENTS.items()})


def parse_one(spark, text):
    df = spark.createDataFrame([(text,)], "s string")
    staged = P.with_nutriments(df, "s", "n").select("n").first()[0]
    direct = df.select(P.parse_nutriments(F.col("s")).alias("n")).first()[0]
    assert staged == direct
    return {k: (v["value"], v["per_100g"], v["unit"]) for k, v in (staged or {}).items()}


def test_json_object_with_energy_alias(spark):
    m = parse_one(spark, FULL_JSON)
    assert len(m) == 6
    assert m["energy-kcal"] == (300.0, 1250.0, "kcal")
    assert m["proteins"] == (13.0, 13.0, "g")


def test_null_value_and_per_100g(spark):
    m = parse_one(spark, '{"nova-group": {"value": null, "per_100g": 2.0, "unit": null}, '
                         '"sugars": {"value": 3.0, "per_100g": 3.0, "unit": "g"}}')
    assert m["nova-group"] == (None, 2.0, None)
    assert m["sugars"][1] == 3.0


def test_scalar_entries(spark):
    m = parse_one(spark, '{"sugars": 17.5, "proteins": {"value": 6.0, "per_100g": 6.0, "unit": "g"}}')
    assert m["sugars"] == (17.5, 17.5, None)
    assert m["proteins"] == (6.0, 6.0, "g")


def test_text_and_boolean_scalars_dropped_and_100g_key(spark):
    m = parse_one(spark, '{"a": "5", "b": true, "c": {"value": 1, "100g": 7}}')
    assert set(m) == {"c"}
    assert m["c"] == (1.0, 7.0, None)


def test_list_style(spark):
    m = parse_one(spark, "[{'name': 'energy', 'value': 210.0, '100g': 880.0, 'unit': 'kcal'}\n"
                         " {'name': 'fat', 'value': 0.0, '100g': 0.0, 'unit': 'g'}\n"
                         " {'name': 'sugars', 'value': nan, '100g': nan, 'unit': 'g'}]")
    assert m["energy"] == (210.0, 880.0, "kcal")
    assert "energy-kcal" not in m
    assert m["sugars"] == (None, None, "g")


def test_list_style_last_duplicate_wins(spark):
    m = parse_one(spark, "[{'name': 'fat', 'value': 1} {'name': 'fat', 'value': 2}]")
    assert m["fat"][0] == 2.0


def test_malformed_and_empty(spark):
    for raw in ["{not valid json", "", "[]", None]:
        assert parse_one(spark, raw) == {}


def test_multilingual(spark):
    rows = [("[{'lang': 'main', 'text': 'Dark Rye Crackers'}\n {'lang': 'fr', 'text': \"Pain d'epices\"}]",),
            ("[{'lang': 'de', 'text': 'Apfel'} {'lang': 'fr', 'text': 'pomme'}]",),
            ("",), ("[]",), ("plain name  ",)]
    df = spark.createDataFrame(rows, "s string")
    got = [r[0] for r in df.select(P.parse_multilingual_text(F.col("s"))).collect()]
    assert got == ["Dark Rye Crackers", "pomme", "", "[]", "plain name"]


def test_safe_casts(spark):
    df = spark.createDataFrame([("2.7", "0.95"), ("unknown", "n/a"), (None, None), ("nan", "nan")], "a string, b string")
    got = [tuple(r) for r in df.select(P.safe_int(F.col("a")), P.safe_float(F.col("b"))).collect()]
    assert got == [(2, 0.95), (None, 0.0), (None, 0.0), (None, 0.0)]


def test_repeated_keys_and_infinity_lose_no_entry(spark):
    m = parse_one(spark, '{"fat": 1, "salt": Infinity, "fat": {"value": 2, "per_100g": Infinity}, "sugars": 3}')
    assert m["fat"] == (2.0, float("inf"), None)
    assert m["sugars"] == (3.0, 3.0, None)
    assert m["salt"][0] == float("inf")
    m = parse_one(spark, '{"fat": {"unit": "g", "unit": "kg"}, "sugars": 3}')
    assert m["sugars"] == (3.0, 3.0, None)


@pytest.mark.parametrize("text, want", [("5d", None), ("1f", None), ("2.5D ", None), ("inf", float("inf")), (" 5 ", 5.0), ("1e3", 1000.0)])
def test_numeric_text(spark, text, want):
    df = spark.createDataFrame([(text,)], "s string")
    assert df.select(P.to_double(F.col("s"))).first()[0] == want


@pytest.mark.parametrize("raw", ['{"fat": {"value": "5d", "per_100g": "1f"}, "salt": {"value": "2.5", "100g": " 3 "}}',
                                 "[{'name': 'fat', 'value': 5d, '100g': '1f'} {'name': 'salt', 'value': 2.5, '100g': '3'}]"])
def test_suffixes_of_typed_literals_are_no_numbers_in_nutriments(spark, raw):
    got = parse_one(spark, raw)
    assert got["fat"][:2] == (None, None) and got["salt"][:2] == (2.5, 3.0)
