"""Annotation reads the dictionary alone."""

from larder.plans import index as I

PRODUCT = "code string, product_name string, brands string, categories string, ingredients_text string, nutriments string, completeness string"


def test_annotation_builds_no_index(spark, monkeypatch):
    raw = spark.createDataFrame([("1", "old bolt", "Acme", "Tools", "iron", "", "0.3")], PRODUCT)
    monkeypatch.setattr(I, "build_index", lambda *a, **k: 1 / 0)
    alone = I.shared_dictionary(spark, "alone", lambda: raw).collect()
    monkeypatch.undo()
    assert sorted(map(str, alone)) == sorted(map(str, I.build_index(spark, raw).dictionary.collect()))
