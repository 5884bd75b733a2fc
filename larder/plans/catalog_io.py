"""Registered queries of the sources, the sinks, the table of changes, paging past the end and the options of the
phrase parser.  What a query writes goes to a folder of its own under the shared checkpoint folder and is read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from larder.fixed_values import DICTIONARY_TOP, FLAG_NAMES
from larder.plans import fixtures as fx
from larder.plans import oracle_sql as O
from larder.plans.catalog import (BM25_PHRASES, SEARCH_PHRASES, _DICT_SQL, _bm25_oracle, _ranked, _search_oracle, dictionary_df, docs, flat_annotations,
                                  flat_annotations_sql, index, phrase_set, phrase_set_sql, r6, raw, register, requests)
from larder.session import ensure_checkpoint_dir


def own_folder(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/queries/{name}-{uuid.uuid4().hex}"


_RAW_COLS = "code, product_name, brands, categories, ingredients_text, nova_group, round(completeness, 6) AS completeness"


def _raw_view(df):
    return df.select("code", "product_name", "brands", "categories", "ingredients_text", "nova_group",
                     r6(F.col("completeness")).alias("completeness"))


@register("csv_products", f"SELECT {_RAW_COLS} FROM ({O.raw_products_sql()})")
def q_csv_products(spark, sf):
    """S-2 .. S-4: products written as CSV and read through a list of paths of which only the last is there."""
    from larder.sources.products import products_source
    folder = own_folder(spark, "csv")
    fx.products_raw(spark, sf).write.option("header", True).option("escape", '"').csv(f"{folder}/products.csv")
    return _raw_view(products_source(spark, [f"{folder}/none.parquet", f"{folder}/none.csv", f"{folder}/products.csv"]))


@register("limited_products", f"SELECT {_RAW_COLS} FROM ({O.raw_products_sql()}) ORDER BY code LIMIT 77")
def q_limited_products(spark, sf):
    """S-5: the first rows by code, chosen before parsing."""
    from larder.sources.products import products_source
    folder = own_folder(spark, "limit")
    fx.products_raw(spark, sf).write.parquet(folder)
    return _raw_view(products_source(spark, [folder], 77))


@register("documents_json", f"""SELECT id, product_name, search_text, {', '.join(FLAG_NAMES)}, n_nutrients::BIGINT AS n_nutrients,
    round(completeness, 6) AS completeness FROM ({O.docs_sql()})""")
def q_documents_json(spark, sf):
    """S-7/S-8: documents written with JSON text for attributes and metadata, read back with types."""
    from larder.sources.products import read_documents, write_documents
    folder = own_folder(spark, "documents")
    write_documents(docs(spark, sf), folder, json_encoded=True)
    return read_documents(spark, folder).select(
        "id", "product_name", "search_text", *[F.col(f"attributes.flags.{f}").alias(f) for f in FLAG_NAMES],
        F.size("attributes.nutrition").cast("long").alias("n_nutrients"), r6(F.col("metadata.completeness")).alias("completeness"))


@register("create_if_absent", f"SELECT id, product_name FROM ({O.docs_sql()})")
def q_create_if_absent(spark, sf):
    """S-13: a target that is there is left as it is; a dropped one is made anew."""
    from larder.sources.products import read_documents, write_documents
    from larder.streaming.table import drop_table
    folder = own_folder(spark, "absent")
    write_documents(docs(spark, sf).withColumn("product_name", F.lit("dropped")), folder, mode="ignore")
    drop_table(spark, folder)
    write_documents(docs(spark, sf), folder, mode="ignore")
    write_documents(docs(spark, sf).withColumn("product_name", F.lit("too late")), folder, mode="ignore")
    return read_documents(spark, folder).select("id", "product_name")


@register("rebuild_metrics", f"""SELECT (SELECT count(*) FROM part) AS attempted, count(*) AS written,
    count_if(n_nutrients > 0) AS with_nutrition FROM ({O.docs_sql()}) WHERE id <> ''""")
def q_rebuild_metrics(spark, sf):
    """S-12 over documents that were written and read back."""
    from larder.sources.products import read_documents, write_documents
    from larder.streaming.ingest import rebuild_metrics, split_rejects
    folder = own_folder(spark, "rebuild")
    good, _bad = split_rejects(docs(spark, sf))
    write_documents(good, folder)
    return rebuild_metrics(fx.products_raw(spark, sf), read_documents(spark, folder))


@register("dictionary_json", _DICT_SQL)
def q_dictionary_json(spark, sf):
    """S-14: the built terms as one JSON object, read back as the lookup dictionary."""
    from larder.operators.dictionary import dictionary_topk, read_dictionary_json, write_dictionary_json
    folder = own_folder(spark, "dictionary")
    write_dictionary_json(dictionary_topk(raw(spark, sf), DICTIONARY_TOP), folder)
    return read_dictionary_json(spark, folder)


@register("evidence_file", f"""SELECT phrase AS query_id, length(phrase)::BIGINT AS n_chars FROM ({phrase_set_sql(SEARCH_PHRASES)})""")
def q_evidence_file(spark, sf):
    """S-16: records written as JSON lines and read back."""
    from larder.operators.evaluate import write_evidence
    folder = own_folder(spark, "evidence")
    write_evidence(phrase_set(spark, sf, SEARCH_PHRASES).select("query_id", F.struct("phrase").alias("nested")), folder)
    back = spark.read.schema("query_id string, nested struct<phrase:string>").json(folder)
    return back.select("query_id", F.length("nested.phrase").cast("long").alias("n_chars"))


@register("upsert_changes", """SELECT cast(p_partkey AS varchar) AS id, CASE WHEN p_partkey % 15 = 0 THEN 'third' WHEN p_partkey % 10 = 0
    THEN upper(p_name) ELSE p_name END AS name, CASE WHEN p_partkey % 15 = 0 THEN 3 WHEN p_partkey % 10 = 0 THEN 2 ELSE 1 END AS batch FROM part
    UNION ALL SELECT 'new-' || p_partkey, p_name, 3 FROM part WHERE p_partkey % 50 = 0""")
def q_upsert_changes(spark, sf):
    """S-10: three batches, the second replayed, compacted in between, merged on read."""
    from larder.streaming import table
    folder = own_folder(spark, "changes")
    part = fx.table(spark, sf, "part")
    rows = lambda where, id_, name, batch: part.where(where).selectExpr(f"{id_} AS id", f"{name} AS name", f"{batch} AS batch")
    key = "cast(p_partkey AS string)"
    table.write_changes(rows("true", key, "p_name", 1), folder, "s.0")
    table.write_changes(rows("p_partkey % 10 = 0", key, "upper(p_name)", 2), folder, "s.1")
    table.compact(spark, folder)
    table.write_changes(rows("p_partkey % 10 = 0", key, "'replayed'", 2), folder, "s.1")
    table.write_changes(rows("p_partkey % 15 = 0", key, "'third'", 3).unionByName(
        rows("p_partkey % 50 = 0", "concat('new-', p_partkey)", "p_name", 3)), folder, "s.2")
    return table.read_table(spark, folder)


# ----------------------------------------------------------------- R-18
_FROM = "CASE length(query_id) % 3 WHEN 0 THEN 0 WHEN 1 THEN 40 ELSE 100000 END"


@register("search_past_end", f"""
    WITH q AS ({phrase_set_sql(SEARCH_PHRASES)}),
    s AS ({O.scored_sql(O.requests_sql(O.annotate_sql(phrase_set_sql(SEARCH_PHRASES), _DICT_SQL), _DICT_SQL), O.search_docs_sql())}),
    t AS (SELECT query_id, count(*) AS total FROM s GROUP BY query_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s)
    SELECT q.query_id, r.rank, r.doc_id, r.score, coalesce(t.total, 0) AS total
    FROM q LEFT JOIN t USING (query_id) LEFT JOIN r ON r.query_id = q.query_id AND rank > {_FROM.replace('query_id', 'q.query_id')}
         AND rank <= {_FROM.replace('query_id', 'q.query_id')} + 20""")
def q_search_past_end(spark, sf):
    """R-18: the total of each request, also where its page lies past the end or nothing matches."""
    req = requests(spark, sf, phrase_set(spark, sf, SEARCH_PHRASES)).withColumn("from_", F.expr(_FROM))
    return _ranked(index(spark, sf), req, empty_pages=True)


@register("search_cursor", f"SELECT * FROM ({_search_oracle(SEARCH_PHRASES, k=40)}) WHERE rank > 20")
def q_search_cursor(spark, sf):
    """R-18/D-11: the second page of each request, asked for by the last hit of its first page."""
    req = requests(spark, sf, phrase_set(spark, sf, SEARCH_PHRASES))
    last = _ranked(index(spark, sf), req).where("rank = 20").select(
        "query_id", F.col("score").alias("after_score"), F.col("doc_id").alias("after_id"))
    return _ranked(index(spark, sf), req.join(last, "query_id"))


# ----------------------------------------------------------------- Q-10 / Q-11
# the same phrases, once with punctuation and once with the words and values it stands for
_PUNCT = ["concat(p_name, ' < ', p_size, '.5g sugars')", "concat(p_name, ' >= ', p_size, ' kcal')", "concat('1/4 cup ', p_name)",
          "concat(p_size, '.25 kg ', p_name)"]


@register("numeric_punctuation", f"""
    SELECT p_name || ' < ' || p_size || '.5g sugars' AS query_id, 'sugars:lte:' || p_size || '.5:g' AS numeric, '' AS recipe FROM part
    UNION SELECT p_name || ' >= ' || p_size || ' kcal', 'kcal:gte:' || p_size || '.0:kcal', '' FROM part
    UNION SELECT '1/4 cup ' || p_name, '', '1/4 cup:0.25:cup' FROM part
    UNION SELECT p_size || '.25 kg ' || p_name, '', p_size || '.25 kg:' || p_size || '.25:kg' FROM part""")
def q_numeric_punctuation(spark, sf):
    """Q-10/Q-11 with the punctuation of numbers kept: signs, decimals and fractions."""
    from larder.operators.annotate import annotate
    a = annotate(phrase_set(spark, sf, _PUNCT), dictionary_df(spark, sf), keep_numeric_punct=True)
    return flat_annotations(a).select("query_id", "numeric", "recipe")




# ----------------------------------------------------------------- I-3 / S-9
@register("search_incremental", _bm25_oracle(BM25_PHRASES))
def q_search_incremental(spark, sf):
    """BM25 on an index that grew by three batches: all products under other names, then each half as it is, with a
    replayed batch and a merge in between; the rows are those of an index built at once."""
    from larder.operators.bm25 import bm25_search
    from larder.streaming import text_index
    folder = own_folder(spark, "index")
    ix = index(spark, sf)
    half = lambda k: ix.docs.where(F.pmod(F.xxhash64("id"), F.lit(2)) == k)
    other = F.concat(F.lit("widget "), "product_name", F.lit(" old"))
    text_index.add_batch(ix.docs.withColumn("product_name", other).withColumn("search_text", other), folder, "b.0")
    text_index.add_batch(half(0), folder, "b.1")
    text_index.compact(spark, folder)
    text_index.add_batch(half(0), folder, "b.1")
    text_index.add_batch(half(1), folder, "b.2")
    return bm25_search(requests(spark, sf, phrase_set(spark, sf, BM25_PHRASES)), text_index.read_index(spark, folder), ix.search)


# ----------------------------------------------------------------- Q-20 on a stream
@register("annotate_stream", flat_annotations_sql(O.annotate_sql(phrase_set_sql(SEARCH_PHRASES), _DICT_SQL)))
def q_annotate_stream(spark, sf):
    """Q-20 over a stream of phrases: each phrase comes in two files and is answered once; the stream is started twice."""
    from larder.streaming.phrases import annotate_stream, read_annotations
    folder = own_folder(spark, "phrases")
    said = phrase_set(spark, sf, SEARCH_PHRASES).withColumn("asked_at", F.timestamp_seconds(F.lit(1_700_000_000)))
    said.unionByName(said).repartition(4).write.parquet(f"{folder}/in")
    for _ in range(2):
        annotate_stream(spark, f"{folder}/in", f"{folder}/out", f"{folder}/progress", dictionary_df(spark, sf)).awaitTermination()
    return flat_annotations(read_annotations(spark, f"{folder}/out"))
