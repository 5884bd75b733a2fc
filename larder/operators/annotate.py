"""Search-phrase annotation over a table (or micro-batch) of phrases (Q-9 .. Q-20).

Input: ``phrases(query_id, phrase)``.  Output: one row per phrase with the
normalised text, constraints, intent and entities.  Everything is column
expressions except the dictionary lookup of n-grams, which is an equi-join
against the (size-bounded, broadcast) dictionary followed by a per-phrase
greedy span cover folded with ``aggregate``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.fixed_values import (
    BRAND_INTENT_PATTERNS,
    CATEGORY_INTENT_PATTERN,
    DEFAULT_PAGE_SIZE,
    DIETARY_PATTERNS,
    ENTITY_BUCKETS,
    EXPLICIT_BRAND_PATTERNS,
    FILTER_KEYS,
    INGREDIENT_INTENT_PATTERN,
    MAX_NGRAM,
    MODIFIER_PATTERN,
    NORMALIZATION_STEPS,
    NUMERIC_PATTERNS,
    RECIPE_QTY_PATTERN,
    SYNONYM_PAIRS,
)
from larder.functions.parse import collapse_ws
from larder.functions.text import canonicalize, ngrams, normalize_phrase, tokenize
from larder.operators.joins import broadcast_if_small

U = "(?U)"
EXPL_T = "array<struct<field:string,explanation:string>>"
NUMERIC_T = "array<struct<nutrient:string,operator:string,value:double,unit:string,comparison_basis:string>>"
RECIPE_T = "array<struct<raw:string,value:double,unit:string>>"
ENTITY_T = "array<struct<value:string,explanation:string>>"


def _expl(field, text):
    return F.struct(F.lit(field).alias("field"), text.alias("explanation"))


def _num_str(c):
    """Python float repr for ordinary magnitudes (200.0, 2.5)."""
    return c.cast("string")


def normalized_query(phrase, keep_numeric_punct: bool = False, pairs=SYNONYM_PAIRS) -> F.Column:
    """Q-1 then Q-8."""
    return canonicalize(normalize_phrase(phrase, keep_numeric_punct), pairs)


def _with_comparators(pattern: str) -> str:
    """A sign that stands after a space has no word boundary before it."""
    return pattern.replace(r"\b(?:", r"(?:(?=[<>])|\b(?![<>]))(?:", 1)


def extract_constraints(df: DataFrame, text_col: str = "normalized_query", keep_numeric_punct: bool = False) -> DataFrame:
    """Q-9 .. Q-14 on ``text_col``; adds modifiers, numeric_filters,
    recipe_quantities, filter_<key> columns, explanations and cleaned_query.
    With ``keep_numeric_punct`` the signs of Q-10 match wherever they stand, and
    a fraction is read whole, not from its last digits on."""
    t = F.col(text_col)
    mods = F.array_distinct(F.regexp_extract_all(t, F.lit(U + MODIFIER_PATTERN), 0))
    df = df.withColumn("modifiers", mods).withColumn(
        "_expl", F.transform("modifiers", lambda m: _expl("modifiers", F.concat(
            F.lit("Extracted modifier '"), m, F.lit("'"))))).withColumn("_t", t)
    df = df.withColumn("numeric_filters", F.array().cast(NUMERIC_T))

    # Q-10 numeric bounds: all lte matches, then gte on the reduced text.
    for pattern, op in NUMERIC_PATTERNS:
        p = F.lit(U + (_with_comparators(pattern) if keep_numeric_punct else pattern))
        whole = F.regexp_extract_all("_t", p, 0)
        vals = F.regexp_extract_all("_t", p, 1)
        units = F.regexp_extract_all("_t", p, 2)
        nuts = F.regexp_extract_all("_t", p, 3)
        items = F.transform(F.arrays_zip(whole.alias("m"), vals.alias("v"), units.alias("u"), nuts.alias("w")),
                            lambda z: F.struct(
                                F.when(z["w"] != "", z["w"]).otherwise(z["u"]).alias("nutrient"),
                                F.lit(op).alias("operator"),
                                z["v"].cast("double").alias("value"),
                                z["u"].alias("unit"),
                                F.lit("per_100g").alias("comparison_basis")))
        df = df.withColumn("_m", whole).withColumn("_items", items)
        df = df.withColumn("numeric_filters", F.concat("numeric_filters", "_items")).withColumn(
            "_expl", F.concat("_expl", F.transform("_items", lambda x: _expl("numeric", F.concat(
                F.lit("Numeric constraint: "), x["nutrient"], F.lit(" "), x["operator"], F.lit(" "),
                _num_str(x["value"]), x["unit"])))))
        df = df.withColumn("_t", F.aggregate("_m", F.col("_t"), lambda acc, m: F.trim(F.replace(acc, m, F.lit(" ")))))

    # Q-11 recipe quantities.
    p = F.lit(U + (r"(?<![./\d])" if keep_numeric_punct else "") + RECIPE_QTY_PATTERN)
    whole = F.regexp_extract_all("_t", p, 0)
    nums = F.regexp_extract_all("_t", p, 1)
    units = F.regexp_extract_all("_t", p, 2)

    def qty(v):
        num = F.split(v, "/").getItem(0).cast("double")
        den = F.get(F.split(v, "/"), 1).cast("double")
        return F.when(v.contains("/"), F.when(den != 0, num / den).otherwise(F.lit(0.0))).otherwise(v.cast("double"))

    rq = F.transform(F.arrays_zip(whole.alias("m"), nums.alias("v"), units.alias("u")), lambda z: F.struct(
        z["m"].alias("raw"), qty(z["v"]).alias("value"), z["u"].alias("unit")))
    df = df.withColumn("_m", whole).withColumn("recipe_quantities", rq.cast(RECIPE_T))
    df = df.withColumn("_expl", F.concat("_expl", F.transform("recipe_quantities", lambda x: _expl(
        "recipe_quantity", F.concat(F.lit("Extracted recipe quantity: "), x["raw"],
                                    F.lit(" (separated from product retrieval term)"))))))
    df = df.withColumn("_t", F.aggregate("_m", F.col("_t"), lambda acc, m: F.trim(F.replace(acc, m, F.lit(" ")))))

    # Q-12 dietary patterns, in order; first match per key wins; text reduced
    # only when something remains.
    for key in FILTER_KEYS:
        df = df.withColumn(f"filter_{key}", F.lit(None).cast("boolean"))
    for pattern, key, value, explanation in DIETARY_PATTERNS:
        pat = U + pattern
        hit = F.col(f"filter_{key}").isNull() & F.col("_t").rlike(pat)
        reduced = F.trim(F.regexp_replace("_t", pat, ""))
        df = df.withColumn("_hit", hit).withColumn("_red", reduced)
        df = (df.withColumn(f"filter_{key}", F.when(F.col("_hit"), F.lit(value)).otherwise(F.col(f"filter_{key}")))
              .withColumn("_expl", F.when(F.col("_hit"), F.array_append("_expl", _expl(key, F.lit(explanation))))
                          .otherwise(F.col("_expl")))
              .withColumn("_t", F.when(F.col("_hit") & (F.col("_red") != ""), F.col("_red")).otherwise(F.col("_t"))))

    # Q-13 final collapse.
    return (df.withColumn("cleaned_query", collapse_ws("_t"))
            .withColumn("explanations", F.col("_expl").cast(EXPL_T))
            .drop("_t", "_m", "_items", "_expl", "_hit", "_red"))


def detect_intent(text) -> F.Column:
    """Q-15 on the cleaned text."""
    t = F.col(text) if isinstance(text, str) else text
    brand = None
    for p in BRAND_INTENT_PATTERNS:
        h = t.rlike(U + p)
        brand = h if brand is None else (brand | h)
    return (F.when(brand, "brand_search")
            .when(t.rlike(U + CATEGORY_INTENT_PATTERN), "category_browse")
            .when(t.rlike(U + INGREDIENT_INTENT_PATTERN), "ingredient_search")
            .otherwise("generic_search"))


def explicit_brand(text) -> F.Column:
    """Q-16: first of three patterns that matches (brand intent only is
    checked by the caller); NULL when none."""
    t = F.col(text) if isinstance(text, str) else text
    out = None
    for p in reversed(EXPLICIT_BRAND_PATTERNS):
        v = F.trim(F.regexp_extract(t, U + p, 1))
        cand = F.when(t.rlike(U + p) & (v != ""), v)
        out = cand if out is None else F.when(t.rlike(U + p), cand).otherwise(out)
    return out


_EXPLAIN_BY_KIND = {
    "brands": "brands lookup dictionary",
    "categories": "categories lookup dictionary",
    "ingredients": "ingredients lookup dictionary",
    "allergens": "allergens lookup dictionary",
    "sustainability_labels": "sustainability labels lookup dictionary",
    "nutrition": "nutrition lookup dictionary",
}


def _entity_explanation(kind, value):
    expl = F.concat(F.lit("Matched '"), value, F.lit("' as a recognized country or region"))
    for k, words in _EXPLAIN_BY_KIND.items():
        expl = F.when(kind == k, F.concat(F.lit("Matched '"), value, F.lit(f"' in the {words}"))).otherwise(expl)
    return expl


def match_entities(df: DataFrame, dictionary: DataFrame, text_col: str = "cleaned_query") -> DataFrame:
    """Q-17 .. Q-19: dictionary n-gram matches with greedy longest-first span
    suppression.  Adds ``matched`` = array<struct<kind,value>> in match order."""
    grams = df.select("query_id", F.posexplode(ngrams(tokenize(F.col(text_col)), MAX_NGRAM)).alias("idx", "g"))
    # The dictionary is capped by construction (top-N per kind + fixed sets);
    # the size is still checked before broadcasting (shuffle join beyond it).
    hits = grams.join(broadcast_if_small(dictionary.select(F.col("term"), F.col("kind"))),
                      F.col("g.text") == F.col("term"))
    per_q = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(
        "idx", F.col("g.text").alias("text"), F.col("g.n").alias("n"), "kind"))).alias("cands"))
    out = df.join(per_q, "query_id", "left")

    toks = tokenize(F.col(text_col))
    init = F.struct(F.array().cast("array<int>").alias("used"),
                    F.array().cast("array<struct<kind:string,value:string>>").alias("out"))

    def step(acc, c):
        n = c["n"]
        starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(toks) - n, F.lit(0))), lambda i: (
            (F.size(toks) >= n)
            & (F.array_join(F.slice(toks, i + 1, n), " ") == c["text"])
            & ~F.exists(acc["used"], lambda u: (u >= i) & (u < i + n))))
        first = F.get(starts, 0)
        return F.when(first.isNull(), acc).otherwise(F.struct(
            F.concat(acc["used"], F.sequence(first, first + n - 1)).alias("used"),
            F.array_append(acc["out"], F.struct(c["kind"].alias("kind"), c["text"].alias("value"))).alias("out")))

    matched = F.aggregate(F.coalesce("cands", F.array().cast(
        "array<struct<idx:int,text:string,n:int,kind:string>>")), init, step)["out"]
    return out.withColumn("matched", matched).drop("cands")


def annotate(phrases: DataFrame, dictionary: DataFrame, size: int = DEFAULT_PAGE_SIZE, from_: int = 0,
             phrase_col: str = "phrase", keep_numeric_punct: bool = False, pairs=SYNONYM_PAIRS) -> DataFrame:
    """Q-20: full annotation of a phrase table.  ``pairs`` are the synonyms (S-17: ``sources.judgments.synonym_pairs``)."""
    df = phrases.withColumn("original_query", F.col(phrase_col)).withColumn(
        "normalized_query", normalized_query(F.col(phrase_col), keep_numeric_punct, pairs))
    df = extract_constraints(df, keep_numeric_punct=keep_numeric_punct)
    df = df.withColumn("intent", detect_intent("cleaned_query"))
    df = match_entities(df, dictionary)
    expl_brand = F.when(F.col("intent") == "brand_search", explicit_brand("cleaned_query"))
    explicit = F.when(expl_brand.isNotNull(), F.array(F.struct(
        expl_brand.alias("value"),
        F.concat(F.lit("Explicitly extracted '"), expl_brand, F.lit("' from intent pattern")).alias("explanation"),
    ))).otherwise(F.array().cast(ENTITY_T))

    def bucket(kind):
        vals = F.filter("matched", lambda m: m["kind"] == kind)
        return F.transform(vals, lambda m: F.struct(m["value"].alias("value"),
                                                    _entity_explanation(m["kind"], m["value"]).alias("explanation")))

    buckets = []
    for b in ENTITY_BUCKETS:
        if b == "products":
            col = F.array().cast(ENTITY_T)
        elif b == "brands":
            col = F.concat(explicit, bucket("brands"))
        else:
            col = bucket(b)
        buckets.append(col.cast(ENTITY_T).alias(b))
    filters = F.struct(*[F.col(f"filter_{k}").alias(k) for k in FILTER_KEYS])
    return df.select(
        "query_id", "original_query", "normalized_query", F.col("cleaned_query").alias("text_term"), "intent",
        F.struct(*buckets).alias("entities"), filters.alias("filters"), "numeric_filters", "modifiers",
        "recipe_quantities", "explanations",
        F.struct(F.lit(size).alias("size"), F.lit(from_).alias("from")).alias("pagination"),
        F.array(*[F.lit(s) for s in NORMALIZATION_STEPS]).alias("normalization_steps"),
    )
