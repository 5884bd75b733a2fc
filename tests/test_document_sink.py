"""Documents: JSON objects are parsed once a row, and a target that is there costs no work (F24, F26)."""

import pytest
from pyspark.sql import functions as F

from larder.functions import parse as P
from larder.sources.products import read_documents, write_documents


def test_a_json_object_is_parsed_once_a_row(spark):
    rows = spark.createDataFrame([('{"a": 1, "b": {"value": 2, "100g": "3"}, "a": 4}',), ('{"a": NaN, "b": }',), ("{no",), (None,)], "s string")
    done = P.with_nutriments(rows, "s", "n").select("n")
    # the typed and the loose form; before, both once more for each look at the keys
    assert done._jdf.queryExecution().analyzed().toString().count("from_json(") == 2
    got = [r.n for r in done.collect()]
    assert {k: tuple(v) for k, v in got[0].items()} == {"a": (4.0, 4.0, None), "b": (2.0, 3.0, None)}
    assert got[2:] == [{}, {}]


def test_a_target_that_is_there_derives_no_rows(spark, scratch_dir):
    path = f"{scratch_dir}/documents"
    write_documents(spark.range(3).select(F.col("id").cast("string").alias("id")), path, mode="ignore")
    # before, the rows were derived up to the exchange
    broken = spark.range(10).select(F.raise_error(F.concat(F.lit("derived "), F.col("id"))).cast("string").alias("id")).repartition(3)
    write_documents(broken, path, mode="ignore")
    assert sorted(r.id for r in read_documents(spark, path).collect()) == ["0", "1", "2"]
    with pytest.raises(Exception, match="derived"):
        write_documents(broken, f"{scratch_dir}/other", mode="ignore")
