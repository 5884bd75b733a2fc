"""Long texts: lists of terms take little room, and scores over them equal those by joins (F1)."""

import os
import random

import pytest
from pyspark.sql import functions as F

from larder.operators import bm25, long_texts, near_terms
from larder.operators import retrieve as R
from larder.operators.enrich import build_documents, search_table
from larder.operators.lookup import browse_requests
from larder.sources.products import raw_products
from tests.test_bm25_views import every_pair

PRODUCT = "code string, product_name string, brands string, categories string, ingredients_text string, nutriments string, completeness string"


def folder_bytes(at):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(at) for f in files)


def asked(spark, texts):
    req = browse_requests(spark.createDataFrame([(i, "") for i, _ in texts], "query_id string, value string").distinct())
    return req.drop("text").join(spark.createDataFrame(texts, "query_id string, text string"), "query_id").select(*R.REQUEST_COLS)


def same(got, want, more=1):
    key = lambda rows: sorted((r["query_id"], r["rank"], r["doc_id"], f"{r['score']:.5f}", r["total"]) for r in rows)
    got, want = key(got.collect()), key(want.collect())
    assert got == want and len(got) >= more


def test_an_index_of_prose_takes_less_room_than_its_texts(spark):
    rnd = random.Random(3)
    words = ["".join(rnd.choices("abcdefghijklmnop", k=rnd.randint(2, 9))) for _ in range(600)]
    rows = [(str(i), " ".join(rnd.choices(words, k=300)), "", "", "", "", "0") for i in range(200)]
    docs = build_documents(raw_products(spark.createDataFrame(rows, PRODUCT))).checkpoint(eager=True)
    at = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    was = folder_bytes(at)
    index = bm25.text_index(docs)
    taken, text = folder_bytes(at) - was, sum(len(r[1]) for r in rows)
    # before, a row for each field, term and document and the vocabulary in checkpoints: 0.94 of the texts
    assert taken * 2 < text
    assert index.texts.select(F.size("lists").alias("n")).distinct().collect() == [(1,)]
    assert sorted(map(tuple, index.postings.select("field", "term", "doc_id").collect())) == sorted(
        {(f, t, r[0]) for r in rows for f in ("product_name", "search_text") for t in r[1].split()})


@pytest.mark.parametrize("small", [False, True])
def test_scores_over_lists_equal_those_by_joins(spark, monkeypatch, small):
    if small:
        for of, name, n in ((long_texts, "BLOCK", 60), (long_texts, "TOKENS", 40), (long_texts, "TERMS_AT_ONCE", 500), (near_terms, "TERMS_AT_ONCE", 20)):
            monkeypatch.setattr(of, name, n)
    rnd = random.Random(7)
    words = [f"{rnd.choice('abcd')}{rnd.choice('aeiou')}{rnd.choice('klmn')}{rnd.choice(['', 's', 'en', 'ation'])}" for _ in range(40)]
    words += ["soy", "soya", "the", "then", "öl", "counterrevolutionaries"] * 3
    text = lambda n: " ".join(rnd.choices(words, k=n))
    rows = [(str(i), text(rnd.randint(0, 40)), text(i % 2), text(i % 3 * 4), text(i % 4 * 9), "", f"0.{i % 10}") for i in range(60)]
    rows += [rows[3], rows[4][:1] + (rows[5][1],) + rows[4][2:], (None, rows[6][1], "", "", "", "", "0"), ("70", None, "", "", "", "", None)]
    raw = spark.createDataFrame(rows, PRODUCT)
    docs = build_documents(raw_products(raw)).withColumn("id", F.nullif("id", F.lit(""))).checkpoint(eager=True)
    index, st = bm25.text_index(docs), search_table(docs).checkpoint(eager=True)
    texts = [(str(i), text(n)) for i, n in enumerate((7, 8, 12, 20, 40, 70))] + [("d", r) for r in (rows[5][1] + " the then soya",)]
    texts += [("m", rows[8][1] + " soy the"), ("m", rows[9][1] + " the soy then")]  # one id, two texts
    texts += [("s", words[0]), ("t", rows[12][1] + " - ! - " + rows[13][1])]
    req = asked(spark, texts).checkpoint(eager=True)
    same(bm25.bm25_search(req, index, st), every_pair(req, index, st), 60)
    if small:
        return
    only = req.where("query_id NOT IN ('m', 's')")
    same(bm25.bm25_search(only, index, st), every_pair(only, index, st), 60)


def test_near_terms_equal_the_joined_neighbourhoods(spark, monkeypatch):
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choices("abcé𝒳", k=rnd.randint(1, 18)))
    near = lambda w: "".join(rnd.sample(w, len(w))) if len(w) < 5 else w[1] + w[0] + w[2:-2] + w[-1] + w[-2]
    vocab = sorted({word() for _ in range(250)})
    vocab = sorted({*vocab, *(near(w) for w in vocab), *(w[1:] for w in vocab if len(w) > 1), *(w + "a" for w in vocab)})
    words = spark.createDataFrame([(w,) for w in vocab[::3] + ["zz", "abcabcabcabcabcabcabc"]], "term string")
    terms = spark.createDataFrame([(w,) for w in vocab], "term string")
    monkeypatch.setattr(near_terms, "TERMS_AT_ONCE", 100)
    index = bm25.TextIndex(None, None, None, bm25.vocabulary_keys(terms), vocab=terms)
    got = sorted(map(tuple, index.expansions(words).collect()))
    assert got == sorted(map(tuple, bm25.fuzzy_expansions(words, index.near).collect())) and len(got) > 2 * len(vocab[::3])
