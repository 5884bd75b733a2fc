"""The table of changes: merged on read, replays, failures, compaction, and rows in proportion to a batch."""

import os
import random

import pytest
from pyspark.sql import functions as F

from larder.streaming import table


def files_of(path):
    return sorted(os.path.join(d, f) for d, _s, names in os.walk(path) for f in names if f.endswith(".parquet"))


def bytes_of(files):
    return sum(os.path.getsize(f) for f in files)


def rows(spark, pairs, parts=2):
    return spark.createDataFrame(pairs, "id string, v int").repartition(parts)


def held(spark, path):
    return {r["id"]: r["v"] for r in table.read_table(spark, path).collect()}


def test_random_batches_equal_a_dict(spark, scratch_dir):
    rnd = random.Random(2)
    path, want = f"{scratch_dir}/t", {}
    for step in range(6):
        batch = {str(rnd.randrange(40)): rnd.randrange(1000) for _ in range(15)}
        want |= batch
        table.write_changes(rows(spark, list(batch.items())), path)
        if step % 3 == 2:
            assert table.compact(spark, path, rows_per_file=10) == step
        assert held(spark, path) == want
    assert len(files_of(sorted(table.complete(spark, path)["base"].values())[-1])) == -(-len(want) // 10)


def test_a_small_batch_writes_few_bytes(spark, scratch_dir):
    path = f"{scratch_dir}/t"
    spark.range(200_000).select(F.col("id").cast("string").alias("id"), (F.col("id") % 7).cast("int").alias("v")).repartition(4).createOrReplaceTempView("big")
    table.write_changes(spark.table("big"), path)
    assert table.compact_if_due(spark, path) == 0
    before = files_of(path)
    ids = random.Random(1).sample(range(200_000), 100)
    table.write_changes(rows(spark, [(str(i), -1) for i in ids], 1), path)
    assert table.compact_if_due(spark, path) is None
    new = sorted(set(files_of(path)) - set(before))
    assert bytes_of(new) * 100 < bytes_of(before) and set(before) <= set(files_of(path))
    assert table.read_table(spark, path).where("v = -1").count() == 100 and table.read_table(spark, path).count() == 200_000


def test_a_failed_batch_leaves_the_table_readable(spark, scratch_dir):
    path = f"{scratch_dir}/t"
    table.write_changes(rows(spark, [("a", 1), ("b", 2)]), path)
    broken = rows(spark, [("a", 9), ("c", 3)]).withColumn("v", F.when(F.col("id") == "c", F.raise_error(F.lit("stop"))).otherwise(F.col("v")).cast("int"))
    with pytest.raises(Exception):
        table.write_changes(broken, path, "s.1")
    assert held(spark, path) == {"a": 1, "b": 2}
    table.write_changes(rows(spark, [("a", 9), ("c", 3)]), path, "s.1")
    assert held(spark, path) == {"a": 9, "b": 2, "c": 3}


def test_a_replay_adds_nothing_even_after_compaction(spark, scratch_dir):
    path = f"{scratch_dir}/t"
    table.write_changes(rows(spark, [("a", 1)]), path, "s.0")
    assert table.write_changes(rows(spark, [("a", 1)]), path, "s.0") is None
    table.compact(spark, path)
    table.write_changes(rows(spark, [("a", 2)]), path, "s.1")
    table.compact(spark, path)
    assert table.write_changes(rows(spark, [("a", 2)]), path, "s.1") is None
    table.write_changes(rows(spark, [("a", 3)]), path, "other.1")
    assert held(spark, path) == {"a": 3}


def test_keys_with_many_rows_are_replaced_whole(spark, scratch_dir):
    path = f"{scratch_dir}/t"
    table.write_changes(rows(spark, [("a", 1), ("a", 2), ("b", 3)]), path)
    table.write_changes(rows(spark, [("a", 5)]), path)
    table.write_changes(rows(spark, [("c", 6), ("c", 7)]), path)
    assert sorted((r["id"], r["v"]) for r in table.read_table(spark, path).collect()) == [("a", 5), ("b", 3), ("c", 6), ("c", 7)]


def test_no_table_and_drop(spark, scratch_dir):
    path = f"{scratch_dir}/t"
    with pytest.raises(FileNotFoundError):
        table.read_table(spark, path)
    assert not table.drop_table(spark, path)
    table.write_changes(rows(spark, [("a", 1)]), path)
    assert table.drop_table(spark, path) and not os.path.exists(path)
