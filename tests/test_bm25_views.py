"""BM25 by views of documents against scores of every pair of text and document."""

from pyspark.sql import functions as F

from larder.fixed_values import COMPLETENESS_WEIGHT
from larder.operators import bm25
from larder.operators import retrieve as R
from larder.operators.enrich import build_documents, search_table
from larder.sources.products import raw_products
from tests.test_views import NONE, PRODUCT, ROWS, key, requests, table_of

LONG = ("old cold bolt red fresh soy", *NONE, None, None, None, ["red"], 20, 0)
MORE = [("red bolt", "two acme", "organic", "soya", None, None, None, ["red", "Fresh"], 20, 0), ("old", None, "foods", None, None, None, None, [], 20, 0),
        ("bolt", "acme", None, "bolt old", None, True, 4.0, [], 20, 3), LONG]


def index_of(st):
    docs = st.select(F.col("doc_id").alias("id"), "product_name", "brand", "category", "ingredients", "search_text")
    return bm25.text_index(docs)


def every_pair(req, index, st):
    h = bm25.clause_scores(req, index).where(F.coalesce(*bm25.CLAUSES).isNotNull())
    rows = h.join(req, "query_id").join(st, "doc_id").where(bm25.term_filters_ok(index.pairs))
    score = bm25._base_score() + F.col("completeness") * COMPLETENESS_WEIGHT
    return R.top_hits(rows.select("query_id", "doc_id", "size", "from_", F.round(score, 6).alias("score")))


def test_views_equal_scoring_every_pair(spark):
    st = table_of(spark)
    index = index_of(st)
    req = requests(spark, [r for r in ROWS if r[0]] + MORE).select(*R.REQUEST_COLS).checkpoint(eager=True)
    want = every_pair(req, index, st).collect()
    assert key(bm25.bm25_search(req, index, st).collect()) == key(want) and len(want) > 60
    assert {r["query_id"] for r in want} >= {"10", "11", "12"}


def test_pairs_scored_follow_views_not_documents(spark):
    sizes = []
    for n in (60, 600):
        rows = [(str(i), ["old bolt", "red bolt"][i % 2] + f" no{i}", "", "", "", "", f"0.{i % 50:02d}") for i in range(n)]
        st = search_table(build_documents(raw_products(spark.createDataFrame(rows, PRODUCT)))).checkpoint(eager=True)
        index = index_of(st)
        req = requests(spark, [("old bolt", *NONE, None, None, None, [], 20, 0)]).select(*R.REQUEST_COLS).checkpoint(eager=True)
        few = bm25._planned_terms(req, index).where("reach IS NULL")
        sizes.append(bm25._view_hits(req, few, index, st, F.coalesce(*bm25.CLAUSES).isNotNull()).pairs.count())
    assert sizes == [1, 1]
