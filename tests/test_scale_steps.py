"""Steps whose cost must not hang on one task, or on rows of (query, document, term)."""

from pyspark.sql import functions as F

from larder.operators import bm25
from larder.operators.enrich import build_documents
from larder.operators.joins import spread
from larder.operators.lookup import autocomplete_terms
from larder.plans import fixtures as fx
from larder.plans.index import DOCS_PER_BUCKET, bucket_count
from larder.sources.products import raw_products

PRODUCT = "code string, product_name string, brands string, categories string, ingredients_text string, nutriments string, completeness string"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_products_of_one_file_are_parsed_by_many_tasks(spark, scratch_dir):
    part = spark.range(25_000).selectExpr(
        "id AS p_partkey", "'old bolt' AS p_name", "'Brand#1' AS p_brand", "'PROMO' AS p_type", "cast(id % 50 AS int) AS p_size")
    part.coalesce(1).write.parquet(f"{scratch_dir}/part.parquet")
    products = fx.products_raw(spark, scratch_dir)
    assert products.rdd.getNumPartitions() == 3 and products.count() == 25_000
    # a filter on what is derived stays above the exchange
    lines = plan(products.where("length(nutriments) > 3")).splitlines()
    at = lambda word: next(i for i, line in enumerate(lines) if word in line)
    assert "length(" not in "".join(lines[at("Exchange"):])
    assert sorted(map(str, products.collect())) == sorted(map(str, part.selectExpr(*fx.products_raw_select()).collect()))


def test_small_inputs_stay_as_they_are_and_keys_stay_together(spark):
    small = spark.range(50)
    assert spread(small) is small
    rows = spark.range(40).selectExpr("id % 7 AS k").withColumn("k", F.when(F.col("k") > 0, F.col("k")))
    places = spread(rows, "k", rows_per_task=5).select("k", F.spark_partition_id().alias("p")).distinct().collect()
    assert len(places) == 7 and len({r["p"] for r in places}) > 1


def test_buckets_grow_with_the_documents(spark):
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert bucket_count(spark.range(10)) == least
    assert bucket_count(spark.range((least + 2) * DOCS_PER_BUCKET)) == least + 2


def test_short_texts_score_a_class_of_fields_once(spark, monkeypatch):
    rows = [(str(i), "old bolt" if i % 2 else "new red bolt", "", "", "", "", "0") for i in range(300)]
    index = bm25.text_index(build_documents(raw_products(spark.createDataFrame(rows, PRODUCT))))
    req = spark.createDataFrame([("q", "old bolt"), ("r", "red bolt new")], "query_id string, text string")
    units = []
    real = bm25._field_scores
    monkeypatch.setattr(bm25, "_field_scores", lambda hits, unit, *a: (units.append((unit, hits.count())), real(hits, unit, *a))[1])
    got = bm25.clause_scores(req, index).collect()
    assert {(r["query_id"], r["doc_id"]) for r in got} == {("q" if i % 2 else "r", str(i)) for i in range(300)}
    assert len({(r["query_id"], r["phrase"], r["all_terms"], r["fuzzy"]) for r in got}) == 2
    assert dict(units)["no"] < 20 and dict(units)["doc_id"] == 0


def test_autocomplete_keeps_documents_in_place_and_ranks_by_class(spark):
    docs = spark.createDataFrame(
        [(str(i), ["old bolt", "cold bolt", "bolt of gold", "old bolt"][i % 4], ["old bolt x", "", "oldest", "new"][i % 4]) for i in range(40)]
        + [("7", "zinc", "older bolts"), (None, "old bolt", "old bolt")], "id string, product_name string, search_text string")
    queries = spark.createDataFrame([("a", "old bo"), ("b", "bolt ol"), ("c", "zi"), ("d", "bo")], "query_id string, query string")
    out = autocomplete_terms(docs, queries)
    # documents met through a broadcast when their compressed file was small
    assert "SortMergeJoin [doc_id" in plan(out)

    def score(q, names, texts):
        words = q.split()
        hit = lambda have: len({(t, i == len(words) - 1) for i, t in enumerate(words)
                                if any(w.startswith(t) and len(w) >= 2 for w in have)})
        return max(hit(" ".join(names).split()), hit(" ".join(texts).split()))

    rows = [r for r in docs.collect() if r["id"] is not None]
    want = set()
    for q in queries.collect():
        scored = []
        for r in rows:
            same = [x for x in rows if x["id"] == r["id"]]
            n = score(q["query"], [x["product_name"] for x in same], [x["search_text"] for x in same])
            if n:
                scored.append((-n, r["product_name"], r["id"]))
        want |= {(q["query_id"], i + 1, d, name, -n) for i, (n, name, d) in enumerate(sorted(scored)[:5])}
    assert {tuple(r) for r in out.collect()} == want
