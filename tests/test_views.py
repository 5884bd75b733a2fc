"""Tiered search by views of documents."""

import random

from pyspark.sql import functions as F

from larder.operators import retrieve as R
from larder.operators.enrich import build_documents, search_table
from larder.sources.products import raw_products

PRODUCT = "code string, product_name string, brands string, categories string, ingredients_text string, nutriments string, completeness string"
REQUEST = ("query_id string, text string, brand_f string, category_f string, ingredients_f string, vegan boolean, organic boolean, "
           "sugars double, modifiers array<string>, size int, from_ int")


def requests(spark, rows):
    req = spark.createDataFrame([(str(i), *r) for i, r in enumerate(rows)], REQUEST)
    flags = F.struct(*[(F.col({"is_vegan": "vegan", "is_organic": "organic"}[f]) if f in ("is_vegan", "is_organic")
                        else F.lit(None).cast("boolean")).alias(f) for f in R.FLAG_NAMES])
    bound = F.struct(F.lit("sugars").alias("nutrient"), F.lit("lte").alias("operator"), F.col("sugars").alias("value"),
                     F.lit("g").alias("unit"), F.lit("per_100g").alias("comparison_basis"))
    return req.withColumn("flag_filters", flags).withColumn("numeric_filters", F.when(
        F.col("sugars").isNotNull(), F.array(bound)).otherwise(F.array().cast("array<" + "struct<nutrient:string,operator:string,value:double,unit:string,comparison_basis:string>>")))


def table_of(spark, n=150):
    rnd = random.Random(5)
    words = ["old", "cold", "bolt", "fresh", "x", "red", "soy", "soya"]
    rows = []
    for i in range(n):
        rows.append((str(i % 130) if i % 40 else None, " ".join(rnd.choices(words, k=rnd.randint(1, 3))), rnd.choice(["Acme", "Acme Two", ""]),
                     rnd.choice(["Organic foods", "Vegan", "Dairy"]), rnd.choice(["old bolt", "bolt old", "soy", ""]),
                     rnd.choice(["", '{"sugars": 2}', '{"sugars": 5}']), rnd.choice(["0.3", "0.3000001", "0.30000004", "0.9", "n/a"])))
    st = search_table(build_documents(raw_products(spark.createDataFrame(rows, PRODUCT))))
    return st.withColumn("doc_id", F.when(F.col("doc_id") != "", F.col("doc_id"))).checkpoint(eager=True)


NONE = (None, None, None)
ROWS = [("old bolt", *NONE, None, None, None, [], 20, 0), ("old", *NONE, None, None, None, [], 3, 0), ("old", *NONE, True, None, 3.0, [], 20, 2),
        ("x old", *NONE, None, None, None, ["fresh"], 20, 0), ("x", *NONE, None, None, None, [], 20, 0), ("soya bolt", *NONE, None, True, None, [], 5, 1),
        ("bolt", "Acme Two", None, None, None, None, None, [], 20, 0), ("", "acme", None, None, None, None, 4.0, [], 20, 0),
        ("cold", None, "Organic foods", "Old Bolt", None, None, None, ["fresh", "red"], 20, 0), ("", None, None, "bolt old", None, None, None, [], 20, 0),
        ("", *NONE, True, None, None, [], 9, 0), ("", *NONE, None, False, 3.0, ["fresh"], 20, 5), ("nothing", *NONE, None, None, None, [], 20, 0)]
KEY = ("query_id", "rank", "doc_id", "score", "total")


def key(rows):
    return sorted(tuple(str(r[c]) for c in KEY) for r in rows)


def test_views_equal_scoring_every_pair(spark):
    """Repeated and null ids, scores that only rounding makes equal, phrases, filters of several words, modifiers, flags and bounds."""
    st, req = table_of(spark), requests(spark, ROWS).checkpoint(eager=True)
    want = R.top_hits(R.scored_hits(req, st)).collect()
    assert key(R.search(req, st).collect()) == key(want) and len(want) > 60


def test_a_cursor_goes_on_after_the_page(spark):
    st = table_of(spark)
    req = requests(spark, [r[:-2] + (7, 0) for r in ROWS[:4]]).checkpoint(eager=True)
    first = R.search(req, st)
    last = first.where("rank = 7").select("query_id", F.col("score").alias("after_score"), F.col("doc_id").alias("after_id"))
    assert last.count() == 4
    # an id that is repeated counts wholly as passed
    more = R.search(req.join(last, "query_id"), st).collect()
    ids = {(r["query_id"], r["doc_id"]) for r in more}
    assert ids and not ids & {(r["query_id"], r["doc_id"]) for r in last.withColumnRenamed("after_id", "doc_id").collect()}
    scored = {q: sorted(((r["score"], r["doc_id"]) for r in rows), key=lambda t: (-t[0], t[1])) for q, rows in _by_query(
        R.scored_hits(req, st).collect()).items()}
    for q, rows in _by_query(more).items():
        cut = next((r["after_score"], r["after_id"]) for r in last.collect() if r["query_id"] == q)
        rest = [h for h in scored[q] if (-h[0], h[1]) > (-cut[0], cut[1])]
        got = sorted((r["rank"], r["score"], r["doc_id"], r["total"]) for r in rows)
        assert [g[1:3] for g in got] == rest[:7] and {g[3] for g in got} == {len(scored[q])}
        assert [g[0] for g in got] == list(range(len(scored[q]) - len(rest) + 1, len(scored[q]) - len(rest) + 1 + len(got)))


def _by_query(rows):
    out = {}
    for r in rows:
        out.setdefault(r["query_id"], []).append(r)
    return out


def test_pairs_scored_follow_views_not_documents(spark):
    sizes = []
    for n in (60, 600):
        rows = [(str(i), ["old bolt", "red bolt"][i % 2] + f" no{i}", "", "", "", "", f"0.{i % 50:02d}") for i in range(n)]
        st = search_table(build_documents(raw_products(spark.createDataFrame(rows, PRODUCT)))).checkpoint(eager=True)
        own = R.with_core(R.with_cursor(requests(spark, ROWS[:2]))).checkpoint(eager=True)
        post = R.postings(st)
        sizes.append(R.core_hits(R.core_requests(own).checkpoint(eager=True), st, post, R.vocabulary_grams(post)).pairs.count())
    assert sizes[0] == sizes[1] == 3
