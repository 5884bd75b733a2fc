"""Look-ups, browse and autocomplete (L-1 .. L-10), as joins over tables of
requests rather than one request at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.fixed_values import AUTOCOMPLETE_SIZE, DEFAULT_PAGE_SIZE, EDGE_NGRAM_MAX
from larder.functions.text import analyzed_terms, autocomplete_clean, edge_ngrams
from larder.operators.joins import broadcast_if_small, spread
from larder.operators.retrieve import BLOCK_TOKENS, MATCH_BROADCAST_ROWS
from larder.session import ensure_checkpoint_dir


def lookup_by_id(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """L-1/L-2: one row per requested id, document columns NULL when absent."""
    return ids.select("id").join(docs, "id", "left")


def compare_ids(docs: DataFrame, requests: DataFrame) -> DataFrame:
    """L-3/J-5: ``requests(request_id, pos, id)`` in request order; duplicates
    kept, missing ids dropped."""
    return requests.join(docs, "id", "inner")


def browse_requests(values: DataFrame, kind: str = "brand", size: int = DEFAULT_PAGE_SIZE) -> DataFrame:
    """L-4: ``values(query_id, value)`` -> filter-only retrieval requests
    (empty text plus an explicit brand / category / ingredient filter)."""
    if not 1 <= size <= 100:
        raise ValueError("size must be between 1 and 100")
    flags = "struct<" + ",".join(f"{f}:boolean" for f in (
        "is_organic", "is_vegan", "is_vegetarian", "is_palm_oil_free", "is_high_protein", "is_low_sugar",
        "is_low_sodium", "is_gluten_free", "is_lactose_free")) + ">"
    cols = {"brand": "brand_f", "category": "category_f", "ingredients": "ingredients_f"}
    out = values.select(
        "query_id", F.lit("").alias("text"),
        *[(F.nullif(F.trim("value"), F.lit("")) if cols[kind] == c else F.lit(None).cast("string")).alias(c)
          for c in ("brand_f", "category_f", "ingredients_f")],
        F.lit(None).cast(flags).alias("flag_filters"),
        F.array().cast("array<struct<nutrient:string,operator:string,value:double,unit:string,"
                       "comparison_basis:string>>").alias("numeric_filters"),
        F.array().cast("array<string>").alias("modifiers"),
        F.lit(size).alias("size"), F.lit(0).alias("from_"))
    return out.withColumn("flag_filters", F.struct(*[F.lit(None).cast("boolean").alias(f) for f in (
        "is_organic", "is_vegan", "is_vegetarian", "is_palm_oil_free", "is_high_protein", "is_low_sugar",
        "is_low_sodium", "is_gluten_free", "is_lactose_free")]))


def name_prefixes(docs: DataFrame, max_len: int = EDGE_NGRAM_MAX) -> DataFrame:
    """(key, name): lower-case prefixes (1..max_len chars) of each distinct
    product name; the equi-join side of prefix autocomplete."""
    names = docs.select(F.col("product_name").alias("name")).where(
        F.col("name").isNotNull() & (F.col("name") != "")).distinct()
    low = F.lower("name")
    keys = F.transform(F.sequence(F.lit(1), F.least(F.length(low), F.lit(max_len))), lambda i: F.substring(low, 1, i))
    return names.select(F.explode(keys).alias("key"), "name")


def autocomplete_prefix(docs: DataFrame, queries: DataFrame, k: int = AUTOCOMPLETE_SIZE,
                        max_len: int = EDGE_NGRAM_MAX) -> DataFrame:
    """L-8/L-9: distinct names whose lower-case form starts with the cleaned,
    lower-cased query; top k by name.  ``queries(query_id, query)``.

    A prefix of up to ``max_len`` characters is a key itself, so it needs the
    first k names of its key only: each task cuts its rows to k a key before the
    exchange, and a one-letter prefix carries k rows, not all its names."""
    q = queries.select("query_id", F.lower(autocomplete_clean(F.col("query"))).alias("prefix")).where(
        F.col("prefix") != "")
    q = q.withColumn("key", F.substring("prefix", 1, max_len))
    keys = name_prefixes(docs, max_len)
    first = keys.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy("name"))).where(F.col("rank") <= k)
    short = q.where(F.length("prefix") <= max_len).join(first, "key").select("query_id", "rank", "name")
    longer = (q.where(F.length("prefix") > max_len).join(keys.where(F.length("key") == max_len), "key")
              .where(F.lower("name").startswith(F.col("prefix")))
              .withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("name"))).where(F.col("rank") <= k))
    return short.unionByName(longer.select("query_id", "rank", "name")).withColumn("rank", F.col("rank").cast("long"))


def autocomplete_terms(docs: DataFrame, queries: DataFrame, k: int = AUTOCOMPLETE_SIZE) -> DataFrame:
    """L-7: the words of a query meet the edge n-grams (2 to EDGE_NGRAM_MAX
    characters) of the words in name and search text, the last word as a prefix
    of one.  A document scores the query words matched in its better field; top
    k by (score, name, id).  ``queries(query_id, query)``.

    Query words are few and join the n-grams of the distinct words; only the
    words that match go on to the documents.  Documents that hold the same ones
    of them in the same fields are a class: it is scored once, and only its first
    k documents can be among the top k of a query."""
    ensure_checkpoint_dir(docs.sparkSession)
    q = queries.select("query_id", analyzed_terms(F.col("query")).alias("w")).select(
        "query_id", F.posexplode("w").alias("i", "term"), F.size("w").alias("n"))
    q = q.select("query_id", "term", (F.col("i") == F.col("n") - 1).alias("is_last")).where(
        (F.length("term") <= EDGE_NGRAM_MAX) & (F.col("is_last") | (F.length("term") >= 2))).distinct()
    # what follows is kept by document, so the words of a document are not exchanged
    named = spread(docs.where(F.col("product_name") != "").select("id", "product_name", "search_text"), "id")
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.array_distinct(analyzed_terms(F.col(f))).alias("words"))
                       for f in ("product_name", "search_text")])
    post = (named.select(F.col("id").alias("doc_id"), F.explode(fields).alias("f"))
            .select("doc_id", "f.field", F.explode("f.words").alias("word")).where(F.length("word") >= 2))
    vocabulary = post.select("word").distinct()
    keys = vocabulary.select("word", F.explode(edge_ngrams(F.col("word"), 1)).alias("term"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("term", "is_last")) - 1
    q = q.withColumn("i", place).withColumn("block", F.floor(F.col("i") / BLOCK_TOKENS)).withColumn(
        "bit", F.expr(f"shiftleft(1L, i % {BLOCK_TOKENS})"))
    found = q.join(keys.hint("merge"), "term").select("word", "query_id", "block", "bit").distinct().checkpoint(eager=True)
    wanted = broadcast_if_small(found.select("word").distinct(), MATCH_BROADCAST_ROWS)
    held = (post.join(wanted, "word").groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("field", "word"))).alias("held"))
            .withColumn("class", F.sha2(F.to_json(F.struct("held")), 256)))
    # a size estimated from the compressed file must not broadcast the documents
    own = held.select("doc_id", "class").hint("merge").join(
        named.select(F.col("id").alias("doc_id"), F.col("product_name").alias("name")), "doc_id")
    best = F.row_number().over(Window.partitionBy("class").orderBy("name", "doc_id"))
    heads = own.withColumn("place", best).where(F.col("place") <= k).select("class", "doc_id", "name")
    classes = held.groupBy("class").agg(F.first("held").alias("held")).select(
        "class", F.monotonically_increasing_id().alias("no"), "held").checkpoint(eager=True)
    hits = (spread(classes.select("no", "held"), "no").select("no", F.explode("held").alias("h")).select("no", "h.*")
            .join(broadcast_if_small(found, MATCH_BROADCAST_ROWS), "word"))

    def bits(field):
        return F.coalesce(F.bit_or(F.when(F.col("field") == field, F.col("bit"))), F.lit(0).cast("long"))

    each = hits.groupBy("query_id", "no", "block").agg(bits("product_name").alias("a"), bits("search_text").alias("b"))
    score = each.groupBy("query_id", "no").agg(
        F.greatest(F.sum(F.bit_count("a")), F.sum(F.bit_count("b"))).alias("score"))
    rows = score.hint("merge").join(classes.select("class", "no").join(heads, "class"), "no")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "name", "doc_id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("long").alias("rank"), "doc_id", "name", "score")


def doc_count(docs: DataFrame) -> DataFrame:
    """L-10."""
    return docs.agg(F.count(F.lit(1)).alias("documents"))
