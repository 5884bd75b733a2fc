"""End-to-end retrieval properties and the four-product fixture."""

from larder.operators.annotate import annotate
from larder.operators.enrich import build_documents, search_table
from larder.operators.filters import derive_requests
from larder.operators.retrieve import search
from larder.sources.products import raw_products

COLS = ("code string, product_name string, brands string, categories string, ingredients_text string, "
        "nutriments string, completeness string")
PRODUCTS = [
    ("1", "Smooth Peanut Butter", "Acme", "Spreads", "peanuts, salt", '{"sugars": 3}', "0.9"),
    ("2", "Chocolate Spread", "Acme", "Spreads", "sugar, cocoa", '{"sugars": 50}', "0.9"),
    ("3", "Sweet Peanut Butter", "Acme", "Spreads", "peanuts, sugar", '{"sugars": 30}', "0.9"),
    ("4", "Crunchy Peanut Butter", "Acme", "Spreads, No sugar added", "peanuts", "", "0.5"),
]


def run(spark, phrases, dictionary=None):
    st = search_table(build_documents(raw_products(spark.createDataFrame(PRODUCTS, COLS))))
    d = dictionary or spark.createDataFrame([], "term string, kind string, priority int, in_categories boolean, "
                                                "in_ingredients boolean")
    ph = spark.createDataFrame([(p, p) for p in phrases], "query_id string, phrase string")
    return search(derive_requests(annotate(ph, d), d), st, 10)


def test_low_sugar_peanut_butter(spark):
    hits = run(spark, ["low sugar peanut butter"]).collect()
    assert {h["doc_id"] for h in hits} == {"1", "4"}
    assert [h["rank"] for h in sorted(hits, key=lambda h: h["rank"])] == [1, 2]
    assert all(h["total"] == 2 for h in hits)


def test_properties(spark):
    hits = run(spark, ["peanut butter", "spread", "organic cocoa", "butter under 10 g sugars"])
    rows = hits.collect()
    by_q = {}
    for r in rows:
        by_q.setdefault(r["query_id"], []).append(r)
    for q, rs in by_q.items():
        ranks = sorted(r["rank"] for r in rs)
        assert ranks == list(range(1, len(rs) + 1))
        assert all(r["total"] >= len(rs) for r in rs)
        scores = [r["score"] for r in sorted(rs, key=lambda r: r["rank"])]
        assert scores == sorted(scores, reverse=True)
    assert "organic cocoa" not in by_q  # no organic product
    assert {r["doc_id"] for r in by_q["butter under 10 g sugars"]} == {"1"}


def test_plan_has_partial_topk_and_no_cartesian(spark):
    from larder.operators import retrieve as R
    st = search_table(build_documents(raw_products(spark.createDataFrame(PRODUCTS, COLS))))
    d = spark.createDataFrame([], "term string, kind string, priority int, in_categories boolean, in_ingredients boolean")
    req = derive_requests(annotate(spark.createDataFrame([("q", "peanut butter")], "query_id string, phrase string"), d), d)
    post = R.postings(st)
    cores = R.core_requests(R.with_core(req.select(*R.REQUEST_COLS)).checkpoint(eager=True)).checkpoint(eager=True)
    heads = R.class_heads(R.core_hits(cores, st, post, R.vocabulary_grams(post)), 10)
    plan = heads._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "WindowGroupLimit" in heads._jdf.queryExecution().optimizedPlan().toString()


def test_shuffle_fallback_equals_broadcast(spark, monkeypatch):
    import larder.operators.retrieve as R
    phrases = ["peanut butter", "spread", "butter under 10 g sugars", "low sugar peanut butter"]
    want = sorted(tuple(r) for r in run(spark, phrases).collect())
    monkeypatch.setattr(R, "MATCH_BROADCAST_ROWS", 0)  # force the shuffle join
    got = sorted(tuple(r) for r in run(spark, phrases).collect())
    assert got == want


def test_text_of_many_tokens_counts_each_of_them(spark):
    """More tokens than a block holds, one of them twice, one missing from the second product."""
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}q" for i in range(130)]
    text = " ".join(words + words[:1])
    rows = [("1", text, "", "", "", "", "0.5"), ("2", "", "", "", text.replace(words[70], "zz"), "", "0.5"), ("3", "zz", "", "", "", "", "0.5")]
    st = search_table(build_documents(raw_products(spark.createDataFrame(rows, COLS))))
    d = spark.createDataFrame([], "term string, kind string, priority int, in_categories boolean, in_ingredients boolean")
    req = derive_requests(annotate(spark.createDataFrame([("q", text), ("same", text)], "query_id string, phrase string"), d), d)
    got = {(h["query_id"], h["doc_id"]): h["score"] for h in search(req, st).collect()}
    first, second = 30 + 131 * 6 + 5 + 0.075, round(130 * 2.4 + 0.075, 6)
    assert got == {(q, i): s for q in ("q", "same") for i, s in (("1", first), ("2", second))}
