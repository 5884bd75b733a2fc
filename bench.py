"""Headline benchmark.  Prints one JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).

Queries timed (each a full Spark job, results materialised with a count or
a collect):
  ingest_index   raw products (lineitem x part volume variant) -> parsed
                 documents -> search table + postings + vocabulary grams
  dictionary     entity dictionary build over the same products
  annotate       phrase annotation of the derived phrase set
  search_tiered  all derived phrases ranked against the volume documents
  index_numeric  index of the part products
  search_numeric numeric-constraint phrases against the part products
  index_text     positional index of the part products
  search_bm25    all derived phrases ranked by BM25 against the part products
  evaluate       grading + P@k / NDCG / MRR over the search hits
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from larder.session import build_session
    scratch = tempfile.mkdtemp(prefix="larder-bench-")
    spark = build_session(f"local[{cpus}]", cpus * 2, app="larder-bench", extra={
        "spark.driver.memory": "16g",
        "spark.local.dir": scratch,
        "spark.checkpoint.dir": os.path.join(scratch, "ckpt"),
    })
    from pyspark.sql import functions as F

    from larder.operators.annotate import annotate
    from larder.operators.dictionary import build_dictionary
    from larder.operators.filters import derive_requests
    from larder.operators.retrieve import search
    from larder.plans import catalog as C
    from larder.plans import fixtures as fx
    from larder.plans.index import build_index

    times = {}

    def timed(name, fn):
        t0 = time.time()
        out = fn()
        times[name] = round(time.time() - t0, 3)
        return out

    vol = timed("ingest_index", lambda: build_index(spark, fx.products_volume(spark, sf_dir)))
    n_docs = vol.search.count()
    texts = vol.docs.select(F.coalesce("brand", F.lit("")).alias("brands"), F.coalesce("category", F.lit("")).alias("categories"),
                            F.coalesce("ingredients", F.lit("")).alias("ingredients_text"))
    timed("dictionary", lambda: build_dictionary(spark, texts).collect())
    phrases = fx.phrases(spark, sf_dir)
    ann = timed("annotate", lambda: annotate(phrases, vol.dictionary).checkpoint(eager=True))
    n_phrases = ann.count()

    def run_search():
        req = derive_requests(ann, vol.dictionary)
        return search(req, vol.search, 10, vol.postings, vol.vgrams, vol.counts).collect()

    hits = timed("search_tiered", run_search)
    from larder.operators.bm25 import bm25_search, text_index
    timed("index_numeric", lambda: C.index(spark, sf_dir))
    timed("search_numeric", lambda: C.q_filter_numeric(spark, sf_dir).count())
    part = C.index(spark, sf_dir)
    text = timed("index_text", lambda: text_index(part.docs))
    timed("search_bm25", lambda: bm25_search(derive_requests(ann, part.dictionary), text, part.search).collect())
    if "eval_metrics" in C.QUERIES:
        timed("evaluate", lambda: C.QUERIES["eval_metrics"](spark, sf_dir).collect())
    total = round(sum(times.values()), 3)
    print(json.dumps({
        "metric": "total_sec", "value": total, "unit": "sec", "queries": times, "sf": sf_dir,
        "docs": n_docs, "phrases": n_phrases, "hits": len(hits),
        "docs_per_sec_ingest": round(n_docs / times["ingest_index"], 1),
        "phrases_per_sec_search": round(n_phrases / times["search_tiered"], 2),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
