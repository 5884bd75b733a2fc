"""Cores and classes of the tiered search, rarest grams, pruned BM25, the growing text index, the stream of phrases."""

import random

import pytest
from pyspark.sql import functions as F

from larder.operators import bm25
from larder.operators import retrieve as R
from larder.operators.annotate import annotate, extract_constraints
from larder.operators.enrich import build_documents, search_table
from larder.operators.filters import derive_requests
from larder.sources.products import raw_products
from larder.streaming import table, text_index
from larder.streaming.phrases import annotate_stream, read_annotations

PRODUCT = "code string, product_name string, brands string, categories string, ingredients_text string, nutriments string, completeness string"
WORDS = ["peanut", "butter", "milk", "soy", "soya", "oat", "bread", "rye", "sweet", "dark", "milky", "buttermilk"]
NO_DICTIONARY = "term string, kind string, priority int, in_categories boolean, in_ingredients boolean"


def products(spark, seed, n=120):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        nut = rnd.choice(["", "[]", '{"sugars": %d}' % rnd.randint(0, 9), '{"sugars": {"value": 3, "per_100g": %s}, "proteins": %d}' % (
            rnd.choice(["4.5", "null", "6"]), rnd.randint(0, 9))])
        rows.append((str(i), " ".join(rnd.choices(WORDS, k=rnd.randint(1, 5))), rnd.choice(["Acme", "Best", ""]),
                     rnd.choice(["Spreads", "Organic foods", "Vegan", "Dairy"]), " ".join(rnd.choices(WORDS, k=3)), nut, str(rnd.randint(0, 9) / 10)))
    return build_documents(raw_products(spark.createDataFrame(rows, PRODUCT).repartition(3)))


def make_requests(spark, phrases, pages=((20, 0),)):
    ph = spark.createDataFrame([(f"{p}#{s}#{f}", p, s, f) for p in phrases for s, f in pages], "query_id string, phrase string, s int, f int")
    d = spark.createDataFrame([], NO_DICTIONARY)
    return derive_requests(annotate(ph, d), d).drop("size", "from_").join(
        ph.select("query_id", F.col("s").alias("size"), F.col("f").alias("from_")), "query_id")


PHRASES = ["milk", "organic milk", "vegan milk", "milk under 5 g sugars", "milk under 3 g sugars", "milk at least 2 g sugars", "soya bread",
           "milk at least 2 g sugars under 6 g sugars", "milk at least 4 g protein under 6 g sugars", "organic", "vegan", "under 4 g sugars",
           "", "nothingofthekind", "peanut butter milk", "milk under 5 g salt", "organic milk under 5 g sugars"]


def test_classes_equal_scoring_every_pair(spark):
    """Heads and counts of classes against ranking every (request, document) pair."""
    st = search_table(products(spark, 1)).checkpoint(eager=True)
    req = make_requests(spark, PHRASES, ((20, 0), (3, 2), (50, 100))).checkpoint(eager=True)
    got = R.search(req, st)
    want = R.top_hits(R.scored_hits(req, st))
    key = lambda rows: sorted((r["query_id"], r["rank"], r["doc_id"], r["score"], r["total"]) for r in rows.collect())
    assert key(got) == key(want) and got.count() > 100


def test_every_request_has_its_total(spark):
    st = search_table(products(spark, 2)).checkpoint(eager=True)
    req = make_requests(spark, PHRASES, ((20, 0), (20, 10_000))).checkpoint(eager=True)
    totals = {r["query_id"]: r["total"] for r in R.search(req, st, empty_pages=True).collect()}
    scored = {r["query_id"]: r["count"] for r in R.scored_hits(req, st).groupBy("query_id").count().collect()}
    assert totals == {q["query_id"]: scored.get(q["query_id"], 0) for q in req.select("query_id").collect()}
    past = [r for r in R.search(req, st, empty_pages=True).collect() if r["query_id"].endswith("#10000")]
    assert len(past) == len(PHRASES) and all(r["rank"] is None for r in past) and any(r["total"] > 0 for r in past)


def test_a_core_is_scored_once(spark):
    req = make_requests(spark, ["milk", "organic milk", "vegan milk", "milk under 5 g sugars", "milk under 3 g sugars", "bread"])
    cores = {r["text"]: r for r in R.core_requests(R.with_core(req.select(*R.REQUEST_COLS))).collect()}
    assert len(cores) < 6 and [k["bounds"] for k in cores["milk"]["keys"]] == [[3.0, 5.0]]
    assert cores["milk"]["keys"][0]["needed"] is False and cores["milk"]["must"] == 0


def test_rarest_gram_reads_fewer_words(spark):
    """Every word starts with the same letters; the keys' other grams are rare."""
    vocab = spark.createDataFrame([(f"pre{i:04d}x",) for i in range(1500)] + [("prefix",), ("unprefixed",)], "word string")
    vgrams = R.vocabulary_grams(vocab).checkpoint(eager=True)
    keys = spark.createDataFrame([("prefix",), ("pre0007",), ("fix",), ("ix",), ("prezzz",), ("é",)], "key string")
    counts = R.gram_counts(vgrams)
    got = {(r["key"], r["word"]) for r in R.matching_words(keys, vgrams, counts).collect()}
    words = [r["word"] for r in vocab.collect()]
    assert got == {(k["key"], w) for k in keys.collect() for w in words if k["key"] in w}
    read = {r["gram"]: r["n"] for r in counts.collect()}
    assert read["pre"] > 1500 and min(read[g] for g in ("pre", "ref", "efi", "fix")) == 2


# ------------------------------------------------------------------ BM25
def direct(req, index):
    """Rows of ``matching_postings`` without pruning."""
    limit, bm25.PRUNE_NEED = bm25.PRUNE_NEED, 1 << 30
    try:
        return bm25.clause_scores(req, index).checkpoint(eager=True)
    finally:
        bm25.PRUNE_NEED = limit


def same_scores(a, b):
    """Equal rows; those in which no clause matches are no hits."""
    clauses = ("phrase", "all_terms", "fuzzy")
    key = lambda rows: sorted((r["query_id"], r["doc_id"], *(None if r[c] is None else round(r[c], 9) for c in clauses))
                              for r in rows.collect() if any(r[c] is not None for c in clauses))
    a, b = key(a), key(b)
    assert a == b and a


@pytest.mark.parametrize("seed", [1, 2])
def test_pruned_texts_score_as_all_postings(spark, seed):
    rnd = random.Random(seed)
    vocabulary = [f"{rnd.choice('abcd')}{rnd.choice('aeiou')}{rnd.choice('klmn')}{rnd.choice(['', 's', 'en', 'ation'])}" for _ in range(60)] + ["the", "then", "of"] * 30
    text = lambda n: " ".join(rnd.choices(vocabulary, k=n))
    docs = [(str(i), text(rnd.randint(1, 60))) for i in range(150)]
    frame = spark.createDataFrame([(i, t, "", "", "", "", "0") for i, t in docs], PRODUCT)
    index = bm25.text_index(build_documents(raw_products(frame)))
    asked = [text(n) for n in (1, 2, 3, 5, 6, 7, 8, 12, 20, 70)] + [d[1] for d in docs[:8]] + [docs[9][1] + " - ! - " + docs[9][1]]
    req = spark.createDataFrame([(str(i), t) for i, t in enumerate(asked)], "query_id string, text string")
    same_scores(bm25.clause_scores(req, index), direct(req, index))


def test_long_texts_join_few_postings(spark):
    """Every document holds the common words, too few to match; only those of the passage's own document are joined."""
    rnd = random.Random(5)
    common = ["the", "of", "and", "to", "in", "was"]
    rare = lambda: "".join(rnd.choices("bcdfghjklmnpqrstvwxz", k=9))
    docs = [(str(i), " ".join(common * 2 + [rare() for _ in range(24)])) for i in range(300)]
    index = bm25.text_index(build_documents(raw_products(spark.createDataFrame([(i, t, "", "", "", "", "0") for i, t in docs], PRODUCT))))
    req = spark.createDataFrame([("q", docs[7][1])], "query_id string, text string")
    pruned = bm25.matching_postings(req, index).count()
    limit, bm25.PRUNE_NEED = bm25.PRUNE_NEED, 1 << 30
    try:
        every = bm25.matching_postings(req, index).count()
    finally:
        bm25.PRUNE_NEED = limit
    assert pruned * 5 < every
    same_scores(bm25.clause_scores(req, index), direct(req, index))


def test_an_index_of_three_batches_equals_a_rebuild(spark, scratch_dir):
    first, second, third = (products(spark, s, 40).checkpoint(eager=True) for s in (1, 2, 3))
    change = lambda df, where: df.where(where)
    folder = f"{scratch_dir}/index"
    text_index.add_batch(first, folder, "b.0")
    text_index.add_batch(change(second, "id % 3 = 0"), folder, "b.1")
    gone = change(third, "id % 4 = 0").withColumn("product_name", F.lit("")).withColumn("search_text", F.lit("")).withColumn(
        "brand", F.lit("")).withColumn("category", F.lit("")).withColumn("ingredients", F.lit(""))
    text_index.add_batch(gone, folder, "b.2")
    text_index.add_batch(gone, folder, "b.2")
    now = first.where("id % 3 <> 0 AND id % 4 <> 0").unionByName(second.where("id % 3 = 0 AND id % 4 <> 0")).unionByName(gone)
    whole = bm25.text_index(now)
    req = make_requests(spark, ["milk butter", "rye bread dark", "soya milky oat peanut butter sweet"]).checkpoint(eager=True)
    plain = lambda df: sorted(map(tuple, df.collect()))
    for _ in range(2):
        grown = text_index.read_index(spark, folder)
        assert plain(grown.terms.select("field", "term", "df")) == plain(whole.terms.select("field", "term", "df"))
        assert plain(grown.stats.select("field", "n_docs", "avgdl")) == plain(whole.stats.select("field", "n_docs", "avgdl"))
        same_scores(bm25.clause_scores(req, grown), bm25.clause_scores(req, whole))
        text_index.compact(spark, folder)


# ------------------------------------------------------------------ phrases
def test_stream_answers_a_phrase_once_and_a_replay_adds_nothing(spark, scratch_dir):
    d = spark.createDataFrame([], NO_DICTIONARY)
    said = [("1", "organic milk"), ("2", "rye under 5 g sugars"), ("3", "organic milk"), ("4", "Organic milk")]
    frame = spark.createDataFrame(said, "query_id string, phrase string").withColumn("asked_at", F.timestamp_seconds(F.lit(1_700_000_000)))
    frame.repartition(3).write.parquet(f"{scratch_dir}/in")
    run = lambda: annotate_stream(spark, f"{scratch_dir}/in", f"{scratch_dir}/out", f"{scratch_dir}/progress", d, files_each=1).awaitTermination()
    run()
    run()
    got = read_annotations(spark, f"{scratch_dir}/out")
    assert sorted(r["original_query"] for r in got.collect()) == ["Organic milk", "organic milk", "rye under 5 g sugars"]
    whole = {r["query_id"]: r for r in annotate(frame.select("query_id", "phrase"), d).collect()}
    assert all(r == whole[r["query_id"]] for r in got.collect())
    before = table.complete(spark, f"{scratch_dir}/out")
    frame.limit(1).write.mode("append").parquet(f"{scratch_dir}/in")
    run()
    assert read_annotations(spark, f"{scratch_dir}/out").count() == 3
    assert set(before["changes"]) <= set(table.complete(spark, f"{scratch_dir}/out")["changes"])


@pytest.mark.parametrize("text, numeric, recipe", [
    ("rye < 2.5g sugars", [("sugars", "lte", 2.5)], []), ("rye <= 3 g", [("g", "lte", 3.0)], []), ("rye>=4 g fat", [("fat", "gte", 4.0)], []),
    ("> 10 mg salt rye", [("salt", "gte", 10.0)], []), ("1/2 cup milk", [], [("1/2 cup", 0.5)]), ("1/0 cup milk", [], [("1/0 cup", 0.0)]),
    ("2.25 kg rye", [], [("2.25 kg", 2.25)]), ("rye under 5 g", [("g", "lte", 5.0)], []), ("a/b < c rye.", [], [])])
def test_numeric_punctuation(spark, text, numeric, recipe):
    from larder.operators.annotate import normalized_query
    df = spark.createDataFrame([(text,)], "phrase string").withColumn("normalized_query", normalized_query("phrase", True))
    r = extract_constraints(df, keep_numeric_punct=True).first()
    assert [(n["nutrient"], n["operator"], n["value"]) for n in r["numeric_filters"]] == numeric
    assert [(q["raw"], q["value"]) for q in r["recipe_quantities"]] == recipe


def test_synonym_file_takes_effect(spark, scratch_dir):
    from larder.sources.judgments import synonym_pairs
    with open(f"{scratch_dir}/syn.txt", "w", encoding="utf-8") as f:
        f.write("crisps, chips\n# none\n")
    pairs = synonym_pairs(spark, f"{scratch_dir}/syn.txt")
    docs = build_documents(raw_products(spark.createDataFrame(
        [("1", "salted chips", "", "", "", "", "0.1"), ("2", "salted crisps", "", "", "", "", "0.1"), ("3", "soya milk", "", "", "", "", "0.1")], PRODUCT)))
    d = spark.createDataFrame([], NO_DICTIONARY)
    ask = lambda own: derive_requests(annotate(spark.createDataFrame([("q", "crisps")], "query_id string, phrase string"), d, pairs=own), d)
    found = lambda own: {r["doc_id"] for r in R.search(ask(own), search_table(docs, own), pairs=own).collect()}
    assert found(pairs) == {"1", "2"} and found([]) == {"2"}
    both = {r["doc_id"] for r in bm25.bm25_search(ask(pairs), bm25.text_index(docs, pairs=pairs), search_table(docs, pairs)).collect()}
    assert both == {"1", "2"}


def test_pages_by_cursor_equal_pages_by_offset(spark):
    st = search_table(products(spark, 4)).checkpoint(eager=True)
    req = make_requests(spark, PHRASES, ((7, 0),)).checkpoint(eager=True)
    key = lambda rows: sorted((r["query_id"], r["rank"], r["doc_id"], r["score"], r["total"]) for r in rows.collect())
    page = R.search(req, st)
    for n in (7, 14):
        last = page.where(F.col("rank") == n).select("query_id", F.col("score").alias("after_score"), F.col("doc_id").alias("after_id"))
        page = R.search(req.join(last, "query_id"), st)
        want = R.search(req.join(last.select("query_id"), "query_id").withColumn("from_", F.lit(n)), st)
        assert key(page) == key(want) and page.count() > 7
