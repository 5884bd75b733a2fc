"""Entity dictionaries and coverage aggregates (A-1 .. A-5, S-14).

The dictionary is built by frequency with a capped top-N per kind, so its size
is bounded by ``sum(DICTIONARY_TOP) + len(static sets)`` whatever the input
size; that bound is what makes broadcasting it safe.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larder.fixed_values import (
    ALLERGENS,
    ALWAYS_INCLUDE_INGREDIENTS,
    COUNTRIES,
    DICTIONARY_NULL_WORDS,
    DICTIONARY_PIECE_MAX_LEN,
    DICTIONARY_TOP,
    ENTITY_KINDS,
    EXACT_VALUE_MAX_LEN,
    FACET_TOP,
    FLAG_NAMES,
    NUTRITION_TERMS,
    SUSTAINABILITY_LABELS,
)
from larder.functions.parse import _WS_CLASS, col_, evaluate_once, py_strip

DICTIONARY_SCHEMA = "term string, kind string, priority int"


def clean_text(c) -> F.Column:
    """A-1 text part: trim, lower-case, drop ' (...)' and 'en:tag', drop
    characters outside [a-z0-9 whitespace - % & '], collapse whitespace."""
    s = F.lower(py_strip(col_(c)))
    s = F.regexp_replace(s, rf"{_WS_CLASS}*\([^)]*\)", "")
    s = F.regexp_replace(s, rf"{_WS_CLASS}*en:[a-z0-9\-]+", "")
    s = F.regexp_replace(s, rf"[^a-z0-9{_WS_CLASS[1:-1]}\-%&']+", "")
    return py_strip(F.regexp_replace(s, rf"{_WS_CLASS}+", " "))


def usable(s) -> F.Column:
    """A-1 validity: not empty, at most 48 characters, not a null word."""
    s = col_(s)
    return ~((s == "") | (F.length(s) > DICTIONARY_PIECE_MAX_LEN) | s.isin(*DICTIONARY_NULL_WORDS))


def clean_piece(c) -> F.Column:
    """A-1: dictionary piece clean-up; NULL when unusable."""
    s = clean_text(c)
    return F.when(usable(s), s)


def term_counts(raw: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Per (kind, term) frequency over comma pieces of brands / categories /
    ingredients.  Partial aggregation happens before the shuffle.  ``order``
    names columns that order the rows; then ``first`` is where the term is first seen."""
    at = F.struct(*[F.col(c) for c in order]) if order else F.lit(None).cast("int")
    src = raw.select(
        at.alias("at"), F.posexplode(F.array(F.col("brands"), F.col("categories"), F.col("ingredients_text"))).alias("k", "v"))
    kinds = F.element_at(F.array(*[F.lit(k) for k in ENTITY_KINDS[:3]]), F.col("k") + 1)
    pieces = src.select("at", kinds.alias("kind"), F.posexplode(F.split(F.coalesce("v", F.lit("")), ",")).alias("place", "piece"))
    # cleaned once per piece, then tested (the test reads it three times)
    cleaned = evaluate_once(pieces, "term", clean_text("piece")).select("kind", "term", "at", "place")
    aggs = [F.count(F.lit(1)).alias("n")] + ([F.min(F.struct("at", "place")).alias("first")] if order else [])
    return cleaned.where(usable("term")).groupBy("kind", "term").agg(*aggs)


def dictionary_topk(raw: DataFrame, top: dict | None = None, order: list[str] | None = None) -> DataFrame:
    """A-2: top-N terms per kind by frequency; ties go to the term that is first
    seen in the rows' ``order``, or without one by term.  ``row_number <= N``
    plans as a partial WindowGroupLimit before the exchange, so each task ships
    at most N rows per kind."""
    top = top or DICTIONARY_TOP
    counts = term_counts(raw, order)
    w = Window.partitionBy("kind").orderBy(F.col("n").desc(), F.col("first" if order else "term"))
    limit = max(top.values())
    ranked = counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
    cap = F.element_at(F.create_map(*[x for k, v in top.items() for x in (F.lit(k), F.lit(v))]), F.col("kind"))
    return ranked.where(F.col("rank") <= cap).select("kind", "term", "n", F.col("rank").cast("long").alias("rank"))


def always_include(spark: SparkSession, built: DataFrame) -> DataFrame:
    """A-3: the always-included ingredients that the frequency build missed."""
    extra = spark.createDataFrame([(t,) for t in ALWAYS_INCLUDE_INGREDIENTS], "term string").withColumn(
        "kind", F.lit("ingredients"))
    return extra.join(built.select("kind", "term"), ["kind", "term"], "left_anti")


def static_entities(spark: SparkSession) -> DataFrame:
    rows = ([(t, "allergens") for t in ALLERGENS] + [(t, "sustainability_labels") for t in SUSTAINABILITY_LABELS]
            + [(t, "nutrition") for t in NUTRITION_TERMS] + [(t, "countries") for t in COUNTRIES])
    return spark.createDataFrame(rows, "term string, kind string")


def build_dictionary(spark: SparkSession, raw: DataFrame, top: dict | None = None) -> DataFrame:
    """Full lookup dictionary (term, kind, priority, in_categories,
    in_ingredients): one row per term with its
    highest-precedence kind (brands > categories > ingredients > allergens >
    sustainability > nutrition > countries)."""
    return lookup_dictionary(spark, dictionary_topk(raw, top).select("term", "kind"))


def lookup_dictionary(spark: SparkSession, built: DataFrame) -> DataFrame:
    """``build_dictionary`` from its built terms (term, kind)."""
    # A-3: the always-included ingredients are added unconditionally; a term
    # already built as an ingredient collapses in the group-by below, which
    # equals adding only the missing ones and reads the top-N table once.
    extra = spark.createDataFrame([(t, "ingredients") for t in ALWAYS_INCLUDE_INGREDIENTS], "term string, kind string")
    every = built.unionByName(extra).unionByName(static_entities(spark))
    prio = F.array_position(F.array(*[F.lit(k) for k in ENTITY_KINDS]), F.col("kind")).cast("int")
    best = every.select("term", prio.alias("priority"), (F.col("kind") == "categories").alias("c"),
                        (F.col("kind") == "ingredients").alias("i")).groupBy("term").agg(
        F.min("priority").alias("priority"), F.max("c").alias("in_categories"), F.max("i").alias("in_ingredients"))
    kind = F.element_at(F.array(*[F.lit(k) for k in ENTITY_KINDS]), F.col("priority"))
    return best.select("term", kind.alias("kind"), "priority", "in_categories", "in_ingredients")


def facet_terms(docs: DataFrame, top: int = FACET_TOP) -> DataFrame:
    """A-4: top values of each exact-value field (values over 256 chars are not
    indexed), split on comma, trimmed, lower-cased, distinct."""
    fields = {"brands": "brand", "categories": "category", "ingredients": "ingredients"}
    out = None
    for kind, col in fields.items():
        v = F.col(col)
        vals = docs.select(F.when(F.length(v) <= EXACT_VALUE_MAX_LEN, v).alias("value")).where(
            F.col("value").isNotNull())
        counts = vals.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
        # ordered limit: per-task top-k, then a merge of at most top x tasks rows
        topv = counts.orderBy(F.col("n").desc(), F.col("value")).limit(top)
        terms = topv.select(F.lit(kind).alias("kind"), F.explode(F.split("value", ",")).alias("piece")).select(
            "kind", F.lower(py_strip("piece")).alias("term")).where(F.col("term") != "")
        out = terms if out is None else out.unionByName(terms)
    return out.distinct()


def coverage_metrics(docs: DataFrame) -> DataFrame:
    """A-5: documents, documents with nutrition, and per-flag counts in one pass."""
    aggs = [F.count(F.lit(1)).alias("n_docs"),
            F.count_if(F.size("attributes.nutrition") > 0).alias("with_nutrition")]
    aggs += [F.count_if(F.col(f"attributes.flags.{f}")).alias(f"n_{f}") for f in FLAG_NAMES]
    return docs.agg(*aggs)


def write_dictionary(dictionary: DataFrame, path: str) -> None:
    """S-14 sink."""
    dictionary.write.mode("overwrite").parquet(path)


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """S-14 source; terms lower-cased on load."""
    return spark.read.parquet(path).withColumn("term", F.lower("term"))


def write_dictionary_json(built: DataFrame, path: str, source: str = "") -> None:
    """S-14 sink, JSON layout: one object with a list of terms for each built kind, the most frequent first, then
    the always-included ingredients that are missing.  ``built`` is ``dictionary_topk`` (at most ``DICTIONARY_TOP`` terms a kind)."""
    rows = built.select("kind", "term", "rank").unionByName(
        always_include(built.sparkSession, built).select("kind", "term", F.lit(1 << 40).cast("long").alias("rank")))
    lists = rows.groupBy("kind").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("terms"))
    one = lists.agg(*[F.coalesce(F.first(F.when(F.col("kind") == k, F.col("terms")), True), F.array().cast("array<string>")).alias(k)
                      for k in ENTITY_KINDS[:3]])
    one = one.select(F.lit(source).alias("source"), "*")
    one.coalesce(1).write.mode("overwrite").json(path)


def read_dictionary_json(spark: SparkSession, path: str) -> DataFrame:
    """S-14 source, JSON layout: the lookup dictionary; terms lower-cased on load, kinds that are absent empty."""
    kinds = ENTITY_KINDS[:3]
    one = spark.read.schema(", ".join(f"{k} array<string>" for k in kinds)).option("multiLine", True).json(path)
    lists = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("terms")) for k in kinds])
    built = one.select(F.explode(lists).alias("l")).select(F.explode("l.terms").alias("term"), F.col("l.kind").alias("kind"))
    return lookup_dictionary(spark, built.select(F.lower("term").alias("term"), "kind").where("term IS NOT NULL").distinct())
