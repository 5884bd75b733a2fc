"""Stream ingest equals batch ingest; keep-latest; driver contract."""

import importlib.util
import os

from pyspark.sql import functions as F

from larder.operators.enrich import build_documents
from larder.plans import fixtures as fx
from larder.sources.products import raw_products
from larder.streaming.ingest import keep_latest, start_incremental_ingest
from larder.streaming.table import read_table

from .conftest import SF

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_stream_ingest_equals_batch(spark, scratch_dir):
    src = fx.products_raw(spark, SF)
    src_dir = os.path.join(scratch_dir, "src")
    src.repartition(3).write.parquet(src_dir)
    target, rejects = os.path.join(scratch_dir, "docs"), os.path.join(scratch_dir, "rejects")
    q = start_incremental_ingest(spark, src_dir, spark.read.parquet(src_dir).schema, target, rejects, name="t1")
    q.awaitTermination(300)
    streamed = read_table(spark, target)
    batch = build_documents(raw_products(src))
    cols = ["id", "product_name", "brand", "category", "ingredients", "search_text"]
    assert streamed.count() == batch.count()
    assert streamed.select(*cols).exceptAll(batch.select(*cols)).count() == 0
    a = streamed.select("id", F.to_json("attributes").alias("a")).exceptAll(
        batch.select("id", F.to_json("attributes").alias("a")))
    assert a.count() == 0


def test_keep_latest_with_hot_key(spark):
    rows = [(1, i, float(i)) for i in range(500)] + [(2, 1, 1.0), (2, 3, 3.0)]
    df = spark.createDataFrame(rows, "k int, v int, x double")
    got = {r["k"]: r["v"] for r in keep_latest(df, "k", ["v"]).collect()}
    assert got == {1: 499, 2: 3}


def test_entry_contract(spark):
    spec = importlib.util.spec_from_file_location("entry", os.path.join(ROOT, "__spark_entry__.py"))
    m = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(m)
    df = m.entry(spark)
    assert df.count() > 0
    assert set(m.oracle_sql()) <= set(m.queries())


def test_synonym_file_and_judgments(spark, scratch_dir):
    from larder.sources.judgments import canonical_map, read_judgments, read_synonym_pairs
    p = os.path.join(scratch_dir, "syn.txt")
    with open(p, "w", encoding="utf-8") as f:
        f.write("# comment\n\nSoy, Soya\nyogurt , yoghurt\nbad line\na, b, c\n")
    pairs = sorted(tuple(r) for r in read_synonym_pairs(spark, p).collect())
    assert pairs == [("soy", "soya"), ("yogurt", "yoghurt")]
    assert {r["term"]: r["canonical"] for r in canonical_map(read_synonym_pairs(spark, p)).collect()}["soya"] == "soy"
    j = os.path.join(scratch_dir, "judg.json")
    with open(j, "w", encoding="utf-8") as f:
        f.write('[{"query": "peanut butter", "type": "product", "description": "d", '
                '"relevant_keywords": ["peanut", "butter"], "disallowed_keywords": [], '
                '"required_flags": {"is_vegan": true}}]')
    r = read_judgments(spark, j).first()
    assert r["query_id"] == "peanut butter" and r["required_flags"] == {"is_vegan": True}


def test_second_batch_replaces_and_last_row_of_a_batch_wins(spark, scratch_dir):
    from larder.streaming.ingest import ingest_batch
    target, rejects = os.path.join(scratch_dir, "t"), os.path.join(scratch_dir, "r")
    cols = "code string, product_name string"
    ingest_batch(spark.createDataFrame([("1", "old"), ("2", "two"), ("2", "two again"), ("3", None), ("", "no id")], cols).coalesce(1),
                 target, rejects, 0)
    ingest_batch(spark.createDataFrame([("1", "new")], cols), target, rejects, 1)
    got = {r["id"]: r["product_name"] for r in read_table(spark, target).collect()}
    assert got == {"1": "new", "2": "two again", "3": ""}
    assert [r["error"] for r in spark.read.json(rejects).collect()] == ["missing_id"]


def test_pages_follow_the_requests(spark):
    from larder.operators.retrieve import top_hits
    rows = [(q, f"d{i:02d}", size, start, 1.0 - i / 100) for q, size, start in (("a", 50, 0), ("b", 20, 20), ("c", 5, 40)) for i in range(60)]
    got = top_hits(spark.createDataFrame(rows, "query_id string, doc_id string, size int, from_ int, score double")).collect()
    ranks = {q: sorted(r["rank"] for r in got if r["query_id"] == q) for q in "abc"}
    assert ranks == {"a": list(range(1, 51)), "b": list(range(21, 41)), "c": list(range(41, 46))}


def test_exclusions_as_terms_and_as_objects(spark, scratch_dir):
    from larder.sources.judgments import read_judgments
    p = os.path.join(scratch_dir, "s.json")
    with open(p, "w", encoding="utf-8") as f:
        f.write('[{"query": "nut milk", "type": "t", "relevance": {"required_any": [["milk"]], '
                '"excluded": ["nut", {"term": "soy", "scope": "name"}, {"term": "oat"}]}}, {"query": "x", "type": "t"}]')
    got = {r["query"]: r["relevance"] for r in read_judgments(spark, p, structured=True).collect()}
    assert [(e["term"], e["scope"]) for e in got["nut milk"]["excluded"]] == [("nut", None), ("soy", "name"), ("oat", None)]
    assert got["x"] is None
