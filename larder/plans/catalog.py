"""Registered queries: each is a Spark job over the driver tables (or data
Spark derives from them) plus, where SQL can state it, a DuckDB oracle.

Every query runs over whole tables; limits appear only where they are the
feature (top-k, paging, autocomplete size).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.fixed_values import FLAG_NAMES
from larder.functions.parse import evaluate_once
from larder.operators.enrich import build_documents
from larder.plans import fixtures as fx
from larder.plans import oracle_sql as O
from larder.sources.products import raw_products

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def r6(c):
    return F.round(c, 6)


# ----------------------------------------------------------------- inputs
def raw(spark, sf):
    return raw_products(fx.products_raw(spark, sf))


def docs(spark, sf):
    return build_documents(raw(spark, sf))


def _nutrients_long(df, key):
    # the filter that Spark derives from the explode would parse each row once more
    df = evaluate_once(df.select(key, F.col("nutriments").alias("_n")), "nutriments", F.col("_n"))
    return df.select(key, F.explode("nutriments").alias("nutrient", "n")).select(
        key, "nutrient", r6(F.col("n.value")).alias("value"), r6(F.col("n.per_100g")).alias("per_100g"),
        F.col("n.unit").alias("unit"))


# ----------------------------------------------------------------- ingest
_JSON_ROWS = "SELECT code, nutriments AS nutriments_raw FROM ({p}) WHERE starts_with(trim(nutriments), '{{')"
_LIST_ROWS = ("SELECT code, nutriments AS nutriments_raw FROM ({p}) "
              "WHERE NOT starts_with(trim(nutriments), '{{') AND nutriments <> '[]'")


@register("nutriment_parse_json", O.nutriments_long_sql(_JSON_ROWS.format(p=fx.products_raw_sql())))
def q_nutriment_parse_json(spark, sf):
    r = raw(spark, sf).join(
        fx.products_raw(spark, sf).filter(F.trim("nutriments").startswith("{")).select("code"), "code", "left_semi")
    return _nutrients_long(r, "code")


@register("nutriment_parse_list", O.nutriments_long_sql(_LIST_ROWS.format(p=fx.products_raw_sql())))
def q_nutriment_parse_list(spark, sf):
    src = fx.products_raw(spark, sf)
    r = raw(spark, sf).join(
        src.filter(~F.trim("nutriments").startswith("{") & (F.col("nutriments") != "[]")).select("code"),
        "code", "left_semi")
    return _nutrients_long(r, "code")


@register("nutriment_scalar_events", O.nutriments_long_sql(
    "SELECT event_id, props AS nutriments_raw FROM events", key="event_id"))
def q_nutriment_scalar_events(spark, sf):
    from larder.functions.parse import parse_nutriments
    ev = fx.table(spark, sf, "events").select("event_id", parse_nutriments(F.col("props")).alias("nutriments"))
    return _nutrients_long(ev, "event_id")


@register("multilingual_pick", f"SELECT code, product_name, ingredients_text FROM ({O.raw_products_sql()})")
def q_multilingual_pick(spark, sf):
    return raw(spark, sf).select("code", "product_name", "ingredients_text")


@register("safe_casts", f"""SELECT code, nutriscore_grade, nova_group, round(completeness, 6) AS completeness,
    ecoscore_grade FROM ({O.raw_products_sql()})""")
def q_safe_casts(spark, sf):
    return raw(spark, sf).select("code", "nutriscore_grade", "nova_group", r6(F.col("completeness")).alias(
        "completeness"), "ecoscore_grade")


_DRIFT_SRC = ("SELECT cast(p_partkey AS varchar) AS ID, p_name AS product_name_clean, concat('x ', p_name) "
              "AS product_name, p_brand AS brand, p_type AS Category, p_name AS ingredients, "
              "p_retailprice AS completeness FROM part")


@register("schema_drift", f"""SELECT code, product_name, brands, categories, ingredients_text, nova_group,
    round(completeness, 6) AS completeness FROM ({O.raw_products_sql(
    "SELECT ID AS code, product_name_clean AS product_name, brand AS brands, Category AS categories, "
    "ingredients AS ingredients_text, NULL AS nutriments, NULL AS nutriscore_grade, NULL AS nova_group, "
    "NULL AS ecoscore_grade, completeness FROM (" + _DRIFT_SRC + ")")})""")
def q_schema_drift(spark, sf):
    src = fx.table(spark, sf, "part").selectExpr(
        "cast(p_partkey AS string) AS ID", "p_name AS product_name_clean", "concat('x ', p_name) AS product_name",
        "p_brand AS brand", "p_type AS Category", "p_name AS ingredients", "p_retailprice AS completeness")
    r = raw_products(src)
    return r.select("code", "product_name", "brands", "categories", "ingredients_text", "nova_group",
                    r6(F.col("completeness")).alias("completeness"))


@register("flags_all", f"SELECT id, {', '.join(FLAG_NAMES)} FROM ({O.docs_sql()})")
def q_flags_all(spark, sf):
    return docs(spark, sf).select("id", *[F.col(f"attributes.flags.{f}").alias(f) for f in FLAG_NAMES])


@register("documents_text", f"""SELECT id, product_name, brand, category, ingredients, search_text,
    semantic_document FROM ({O.docs_sql()})""")
def q_documents_text(spark, sf):
    return docs(spark, sf).select("id", "product_name", "brand", "category", "ingredients", "search_text",
                                  "semantic_document")


@register("flag_frequency", "SELECT count(*) AS n_docs, count_if(n_nutrients > 0) AS with_nutrition, "
          + ", ".join(f"count_if({f}) AS n_{f}" for f in FLAG_NAMES) + f" FROM ({O.docs_sql()})")
def q_flag_frequency(spark, sf):
    from larder.operators.dictionary import coverage_metrics
    return coverage_metrics(docs(spark, sf))


# ----------------------------------------------------------------- phrase sets
def phrase_set(spark, sf, exprs: list[str]) -> DataFrame:
    """Distinct phrases from SQL expressions over ``part``; the phrase is its id."""
    part = fx.table(spark, sf, "part")
    out = None
    for e in exprs:
        d = part.selectExpr(f"{e} AS phrase")
        out = d if out is None else out.unionAll(d)
    return out.distinct().select(F.col("phrase").alias("query_id"), "phrase")


def phrase_set_sql(exprs: list[str]) -> str:
    body = " UNION ALL ".join(f"SELECT {e} AS phrase FROM part" for e in exprs)
    return f"SELECT DISTINCT phrase AS query_id, phrase FROM ({body})"


SEARCH_PHRASES = ["concat('organic ', p_name)", "concat('palm oil free ', p_name)",
                  "concat(p_name, ' under 200 calories')", "concat('by brand ', lower(p_brand))"]
ENTITY_PHRASES = ["concat(p_name, ' ', lower(p_type), ' ', p_name)",
                  "concat('show me ', lower(p_type), ' products with ', p_name)",
                  "concat('vegan ', p_name, ' from canada contains soya lecithin')"]
NUMERIC_PHRASES = ["concat(p_name, ' under ', p_size * 10, ' calories')",
                   "concat('at least ', p_size % 30, 'g protein ', p_name)",
                   "concat('500 ml ', p_name, ' over ', p_size, ' g sugars')"]
PALM_PHRASES = ["concat('palm oil free ', p_name)", "concat(p_name, ' with palm oil')",
                "concat('no palm oil ', p_name, ' high protein')"]


def index(spark, sf):
    from larder.plans.index import shared_index
    return shared_index(spark, f"part:{sf}", lambda: fx.products_raw(spark, sf))


def dictionary_df(spark, sf):
    from larder.plans.index import shared_dictionary
    return shared_dictionary(spark, f"part:{sf}", lambda: fx.products_raw(spark, sf))


def annotations(spark, sf, phrases):
    from larder.operators.annotate import annotate
    return annotate(phrases, dictionary_df(spark, sf))


def requests(spark, sf, phrases, overrides=None):
    from larder.operators.annotate import annotate
    from larder.operators.filters import derive_requests
    d = dictionary_df(spark, sf)
    return derive_requests(annotate(phrases, d), d, overrides)


def search_tbl(spark, sf):
    return index(spark, sf).search


def _join(arr_col, fmt=None):
    return F.array_join(arr_col if fmt is None else F.transform(arr_col, fmt), "|")


def flat_annotations(a: DataFrame) -> DataFrame:
    """Scalar view of annotations for comparison."""
    from larder.fixed_values import ENTITY_KINDS, FILTER_KEYS
    cols = [
        "query_id", "normalized_query", "text_term", "intent",
        _join(F.col("modifiers")).alias("modifiers"),
        _join(F.col("numeric_filters"), lambda x: F.concat_ws(":", x["nutrient"], x["operator"],
                                                                x["value"].cast("string"), x["unit"])).alias("numeric"),
        _join(F.col("recipe_quantities"), lambda x: F.concat_ws(":", x["raw"], x["value"].cast("string"),
                                                                  x["unit"])).alias("recipe"),
        _join(F.col("explanations"), lambda x: F.concat_ws(":", x["field"], x["explanation"])).alias("explanations"),
    ]
    cols += [F.col(f"filters.{k}").alias(f"f_{k}") for k in FILTER_KEYS]
    cols += [_join(F.col(f"entities.{k}"), lambda e: e["value"]).alias(f"e_{k}") for k in ENTITY_KINDS]
    return a.select(*cols)


def flat_annotations_sql(ann: str) -> str:
    from larder.fixed_values import ENTITY_KINDS, FILTER_KEYS
    cols = ["query_id", "nq AS normalized_query", "cq AS text_term", "intent",
            "array_to_string(modifiers, '|') AS modifiers",
            "array_to_string(list_transform(numeric_filters, lambda x: concat_ws(':', x.nutrient, x.operator, "
            "cast(x.value AS varchar), x.unit)), '|') AS numeric",
            "array_to_string(list_transform(recipe_quantities, lambda x: concat_ws(':', x.raw, "
            "cast(x.value AS varchar), x.unit)), '|') AS recipe",
            "array_to_string(list_transform(expl, lambda x: concat_ws(':', x.field, x.explanation)), '|') "
            "AS explanations"]
    cols += [f"f_{k}" for k in FILTER_KEYS]
    cols += [f"array_to_string({O.kind_values(k)}, '|') AS e_{k}" for k in ENTITY_KINDS]
    return f"SELECT {', '.join(cols)} FROM ({ann})"


_DICT_SQL = O.dictionary_sql()


@register("dictionary_topk", O.dictionary_topk_sql(by_code=True))
def q_dictionary_topk(spark, sf):
    from larder.operators.dictionary import dictionary_topk
    return dictionary_topk(raw(spark, sf), order=["code"])


@register("dictionary_always_include", _DICT_SQL)
def q_dictionary_always_include(spark, sf):
    return dictionary_df(spark, sf)


@register("annotate_full", flat_annotations_sql(O.annotate_sql(phrase_set_sql(SEARCH_PHRASES), _DICT_SQL)))
def q_annotate_full(spark, sf):
    return flat_annotations(annotations(spark, sf, phrase_set(spark, sf, SEARCH_PHRASES)))


@register("entities_greedy", flat_annotations_sql(O.annotate_sql(phrase_set_sql(ENTITY_PHRASES), _DICT_SQL)))
def q_entities_greedy(spark, sf):
    return flat_annotations(annotations(spark, sf, phrase_set(spark, sf, ENTITY_PHRASES)))


@register("numeric_constraints", flat_annotations_sql(O.annotate_sql(phrase_set_sql(NUMERIC_PHRASES), _DICT_SQL)))
def q_numeric_constraints(spark, sf):
    return flat_annotations(annotations(spark, sf, phrase_set(spark, sf, NUMERIC_PHRASES)))


@register("dietary_filters", flat_annotations_sql(O.annotate_sql(phrase_set_sql(PALM_PHRASES), _DICT_SQL)))
def q_dietary_filters(spark, sf):
    return flat_annotations(annotations(spark, sf, phrase_set(spark, sf, PALM_PHRASES)))


def _search_oracle(phrase_exprs, k=20, src_sql=None):
    req = O.requests_sql(O.annotate_sql(phrase_set_sql(phrase_exprs), _DICT_SQL), _DICT_SQL)
    return O.ranked_sql(O.scored_sql(req, O.search_docs_sql(src_sql)), k)


def _search(spark, sf, phrase_exprs, k=None):
    return _ranked(index(spark, sf), requests(spark, sf, phrase_set(spark, sf, phrase_exprs)), k)


def _ranked(ix, req, k=None, empty_pages=False):
    from larder.operators.retrieve import search
    return search(req, ix.search, k, ix.postings, ix.vgrams, ix.counts, empty_pages)


@register("search_tiered", _search_oracle(SEARCH_PHRASES))
def q_search_tiered(spark, sf):
    return _search(spark, sf, SEARCH_PHRASES)


@register("filter_numeric", _search_oracle(NUMERIC_PHRASES))
def q_filter_numeric(spark, sf):
    return _search(spark, sf, NUMERIC_PHRASES)


@register("filter_palm_oil", _search_oracle(PALM_PHRASES))
def q_filter_palm_oil(spark, sf):
    return _search(spark, sf, PALM_PHRASES)


@register("filter_flags", _search_oracle(ENTITY_PHRASES))
def q_filter_flags(spark, sf):
    return _search(spark, sf, ENTITY_PHRASES)


FLAGSHIP = "search_tiered"


# ----------------------------------------------------------------- evaluation
def classic_judgments(spark, sf) -> DataFrame:
    """Classic judgments for the four search templates (one per phrase)."""
    part = fx.table(spark, sf, "part")
    names = part.select("p_name").distinct()
    brands = part.select(F.lower("p_brand").alias("b")).distinct()
    brand = F.regexp_replace("b", "#", "")
    words = F.split("p_name", " ")
    empty = F.array().cast("array<string>")
    no_flags = F.create_map().cast("map<string,boolean>")
    no_nut = F.lit(None).cast("struct<nutrient:string,operator:string,value:double>")

    def row(q, typ, kws, dis, brand, flags, nut):
        return [q.alias("query_id"), q.alias("query"), F.lit(typ).alias("type"), kws.alias("relevant_keywords"),
                dis.alias("disallowed_keywords"), brand.cast("string").alias("relevant_brand"),
                flags.alias("required_flags"), nut.alias("nutrition_constraint")]

    a = names.select(*row(F.concat(F.lit("organic "), "p_name"), "dietary", words, empty, F.lit(None),
                          F.create_map(F.lit("is_organic"), F.lit(True)), no_nut))
    b = names.select(*row(F.concat(F.lit("palm oil free "), "p_name"), "dietary", words,
                          F.array(F.lit("palm oil")), F.lit(None),
                          F.create_map(F.lit("is_palm_oil_free"), F.lit(True)), no_nut))
    c = names.select(*row(F.concat("p_name", F.lit(" under 200 calories")), "nutrition_numeric", words, empty,
                          F.lit(None), no_flags,
                          F.struct(F.lit("calories").alias("nutrient"), F.lit("lte").alias("operator"),
                                   F.lit(200.0).alias("value"))))
    d = brands.select(*row(F.concat(F.lit("by brand "), "b"), "brand", empty, empty, brand, no_flags, no_nut))
    return a.unionByName(b).unionByName(c).unionByName(d)


def structured_judgments(spark, sf) -> DataFrame:
    j = classic_judgments(spark, sf)
    rel = F.struct(
        F.when(F.size("relevant_keywords") > 0, F.array("relevant_keywords")).otherwise(
            F.array().cast("array<array<string>>")).alias("required_any"),
        F.array().cast("array<string>").alias("required_all"),
        F.array().cast("array<string>").alias("optional"),
        F.transform("disallowed_keywords", lambda t: F.struct(t.alias("term"), F.lit("all").alias("scope"))).alias(
            "excluded"),
        F.lit("all").alias("excluded_scope"),
        F.col("required_flags").alias("required_flags"),
        F.col("nutrition_constraint").alias("nutrition"),
        F.col("relevant_brand").alias("brand"),
        F.lit("anywhere").alias("group_scope"))
    return j.select("query_id", "query", "type", rel.alias("relevance"))


_SPLIT = "string_split(p_name, ' ')"
CLASSIC_JUDGMENTS_SQL = f"""
SELECT 'organic ' || p_name AS query_id, 'dietary' AS type, {_SPLIT} AS kws, []::VARCHAR[] AS dis,
       NULL::VARCHAR AS brand, [{{'k': 'is_organic', 'v': true}}] AS flags, NULL::VARCHAR AS nut_name,
       NULL::VARCHAR AS nut_op, NULL::DOUBLE AS nut_val FROM (SELECT DISTINCT p_name FROM part)
UNION ALL
SELECT 'palm oil free ' || p_name, 'dietary', {_SPLIT}, ['palm oil'], NULL, [{{'k': 'is_palm_oil_free', 'v': true}}],
       NULL, NULL, NULL FROM (SELECT DISTINCT p_name FROM part)
UNION ALL
SELECT p_name || ' under 200 calories', 'nutrition_numeric', {_SPLIT}, []::VARCHAR[], NULL,
       []::STRUCT(k VARCHAR, v BOOLEAN)[], 'calories', 'lte', 200.0 FROM (SELECT DISTINCT p_name FROM part)
UNION ALL
SELECT 'by brand ' || b, 'brand', []::VARCHAR[], []::VARCHAR[], replace(b, '#', ''), []::STRUCT(k VARCHAR, v BOOLEAN)[],
       NULL, NULL, NULL FROM (SELECT DISTINCT lower(p_brand) AS b FROM part)
"""


def eval_hits(spark, sf, k=10, phrases=SEARCH_PHRASES):
    """Top-k hits of the search phrases joined to the product fields."""
    hits = _search(spark, sf, phrases, k)
    d = index(spark, sf).docs.select(F.col("id").alias("doc_id"), "product_name", "brand", "category", "search_text",
                               F.col("attributes.flags").alias("flags"),
                               F.col("attributes.nutrition").alias("nutrition"))
    return hits.join(d, "doc_id")


def graded_classic(spark, sf):
    from larder.operators.evaluate import grade_classic
    j = classic_judgments(spark, sf)
    h = eval_hits(spark, sf).join(j.select("query_id", F.struct(*j.columns).alias("item")), "query_id")
    return h.select("query_id", "rank", "doc_id", grade_classic(
        F.col("product_name"), F.col("brand"), F.col("search_text"), F.col("flags"), F.col("item")).alias("grade"))


def graded_structured(spark, sf):
    from larder.operators.evaluate import grade_structured
    j = structured_judgments(spark, sf)
    h = eval_hits(spark, sf).join(j.select("query_id", "relevance"), "query_id")
    return h.select("query_id", "rank", "doc_id", grade_structured(
        F.col("product_name"), F.col("brand"), F.col("search_text"), F.col("flags"), F.col("nutrition"),
        F.col("relevance")).alias("grade"))


def _hits_docs_sql(phrases=SEARCH_PHRASES):
    hits = _search_oracle(phrases, 10)
    return f"""
    WITH h AS ({hits}), d AS ({O.search_docs_sql()})
    SELECT h.query_id, h.rank, h.total, h.doc_id, lower(coalesce(d.product_name, '')) AS name,
           lower(coalesce(d.brand, '')) AS brand, lower(coalesce(d.search_text, '')) AS text, d.*
    EXCLUDE (product_name, brand, search_text)
    FROM h JOIN d ON d.id = h.doc_id
    """


def _flag_of(key: str) -> str:
    return "CASE " + " ".join(f"WHEN {key} = '{f}' THEN {f}" for f in FLAG_NAMES) + " END"


GRADE_CLASSIC_SQL = f"""
WITH hd AS ({_hits_docs_sql()}), j AS ({CLASSIC_JUDGMENTS_SQL})
SELECT hd.query_id, rank, doc_id,
  CASE WHEN list_bool_or(list_transform(j.dis, lambda x: contains(name, lower(x)) OR contains(text, lower(x)))) THEN 0
       WHEN coalesce(list_bool_or(list_transform(j.flags, lambda f: NOT coalesce({_flag_of('f.k')} = f.v, false))),
                     false) THEN 0
       WHEN j.brand IS NOT NULL AND j.brand <> '' AND NOT contains(hd.brand, lower(j.brand))
            AND NOT contains(name, lower(j.brand)) THEN 0
       WHEN len(j.kws) = 0 THEN 3
       WHEN len(list_filter(j.kws, lambda k: contains(name, lower(k)) OR contains(text, lower(k))
            OR contains(hd.brand, lower(k)))) = len(j.kws)
         THEN CASE WHEN list_bool_and(list_transform(j.kws, lambda k: contains(name, lower(k)))) THEN 3 ELSE 2 END
       WHEN len(list_filter(j.kws, lambda k: contains(name, lower(k)) OR contains(text, lower(k))
            OR contains(hd.brand, lower(k)))) / len(j.kws) >= 0.5 THEN 1
       ELSE 0 END AS grade
FROM hd JOIN j ON j.query_id = hd.query_id
"""


def _tp(hay: str, term: str) -> str:
    """E-2 in RE2 (no look-behind): boundary groups instead."""
    t = f"lower({term})"
    alts = (f"array_to_string(list_sort(list_distinct(list_filter([regexp_escape({t}), "
            f"CASE WHEN ends_with({t}, 'y') THEN regexp_escape(left({t}, length({t}) - 1) || 'ies') END, "
            f"CASE WHEN NOT ends_with({t}, 's') THEN regexp_escape({t} || 's') END], lambda v: v IS NOT NULL))), '|')")
    return (f"(coalesce({term}, '') <> '' AND regexp_matches({hay}, "
            f"'(^|[^a-z0-9])(?:' || {alts} || ')([^a-z0-9]|$)'))")


GRADE_STRUCTURED_SQL = f"""
WITH hd AS ({_hits_docs_sql()}), j AS ({CLASSIC_JUDGMENTS_SQL}),
g AS (
  SELECT hd.query_id, rank, doc_id,
    list_bool_or(list_transform(j.dis, lambda x: {_tp('name', 'x')} OR {_tp('text', 'x')})) AS excluded,
    coalesce(list_bool_or(list_transform(j.flags, lambda f: NOT coalesce({_flag_of('f.k')} = f.v, false))), false)
      AS flag_fail,
    (j.brand IS NOT NULL AND j.brand <> '' AND NOT {_tp('hd.brand', 'j.brand')} AND NOT {_tp('name', 'j.brand')})
      AS brand_fail,
    len(j.kws) > 0 AS has_kw,
    list_bool_and(list_transform(j.kws, lambda t: {_tp('name', 't')})) AS in_name,
    list_bool_and(list_transform(j.kws, lambda t: {_tp('text', 't')})) AS anywhere,
    list_bool_or(list_transform(j.kws, lambda t: {_tp('text', 't')})) AS partial,
    CASE WHEN j.nut_name IS NULL THEN NULL
         ELSE (SELECT CASE WHEN v IS NULL THEN false WHEN j.nut_op = 'gte' THEN v >= j.nut_val
                           WHEN j.nut_op = 'lte' THEN v <= j.nut_val ELSE false END
               FROM (SELECT coalesce(list_filter(hd.nuts, lambda e: e.k = {O.nutrient_key('j.nut_name')})[1].p,
                                     list_filter(hd.nuts, lambda e: e.k = {O.nutrient_key('j.nut_name')})[1].v) AS v))
    END AS nut_ok,
    len(j.flags) > 0 AS has_flags
  FROM hd JOIN j ON j.query_id = hd.query_id)
SELECT query_id, rank, doc_id,
  CASE WHEN excluded OR flag_fail OR brand_fail THEN 0
       WHEN nut_ok = false THEN 0
       WHEN has_kw THEN CASE WHEN in_name THEN 3 WHEN anywhere THEN 2 WHEN partial THEN 1 ELSE 0 END
       ELSE 2 END AS grade
FROM g
"""


def _metrics_sql(graded_sql: str, binary: bool, compat: bool) -> str:
    gain = "CASE WHEN grade >= 2 THEN 1.0 ELSE 0.0 END" if binary else "(pow(2.0, grade) - 1)"
    return f"""
    WITH g0 AS ({graded_sql}),
    g AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank, grade
          FROM g0 WHERE grade IS NOT NULL),
    per AS (SELECT query_id,
              sum(CASE WHEN rank <= 5 AND grade >= 2 THEN 1 ELSE 0 END) / 5.0 AS p5,
              sum(CASE WHEN grade >= 2 THEN 1 ELSE 0 END) / 10.0 AS p10,
              sum({gain} / log2(rank + 1)) AS dcg,
              list_sort(list({gain}), 'DESC') AS gains,
              min(CASE WHEN grade >= 2 THEN rank END) AS first_rel
            FROM g WHERE rank <= 10 GROUP BY query_id),
    m AS (SELECT query_id, p5, p10,
            CASE WHEN list_sum(list_transform(gains, lambda x, i: x / log2(i + 1))) > 0
                 THEN dcg / list_sum(list_transform(gains, lambda x, i: x / log2(i + 1))) ELSE 0.0 END AS ndcg,
            CASE WHEN first_rel IS NULL THEN 0.0 ELSE 1.0 / (first_rel + {1 if compat else 0}) END AS mrr
          FROM per),
    j AS ({CLASSIC_JUDGMENTS_SQL})
    SELECT j.query_id, j.type, {", ".join(f"round({m if binary else f'coalesce({m}, 0.0)'}, 6) AS {m}"
                                           for m in ("p5", "p10", "ndcg", "mrr"))}
    FROM j LEFT JOIN m ON m.query_id = j.query_id
    """


def _metrics(spark, sf, structured=False, binary=False, compat=False):
    from larder.operators.evaluate import query_metrics
    g = graded_structured(spark, sf) if structured else graded_classic(spark, sf)
    m = query_metrics(g, classic_judgments(spark, sf), binary=binary, compat_mrr=compat)
    return m.select("query_id", "type", *[r6(F.col(c)).alias(c) for c in ("p5", "p10", "ndcg", "mrr")])


@register("grade_classic", GRADE_CLASSIC_SQL)
def q_grade_classic(spark, sf):
    return graded_classic(spark, sf)


@register("grade_structured", GRADE_STRUCTURED_SQL)
def q_grade_structured(spark, sf):
    return graded_structured(spark, sf)


@register("eval_metrics", _metrics_sql(GRADE_CLASSIC_SQL, False, False))
def q_eval_metrics(spark, sf):
    return _metrics(spark, sf)


@register("precision_at_k", f"SELECT query_id, p5, p10 FROM ({_metrics_sql(GRADE_CLASSIC_SQL, False, False)})")
def q_precision_at_k(spark, sf):
    return _metrics(spark, sf).select("query_id", "p5", "p10")


@register("ndcg_graded", f"SELECT query_id, ndcg FROM ({_metrics_sql(GRADE_CLASSIC_SQL, False, False)})")
def q_ndcg_graded(spark, sf):
    return _metrics(spark, sf).select("query_id", "ndcg")


@register("mrr", f"SELECT query_id, mrr FROM ({_metrics_sql(GRADE_CLASSIC_SQL, False, False)})")
def q_mrr(spark, sf):
    return _metrics(spark, sf).select("query_id", "mrr")


@register("ndcg_binary", f"SELECT query_id, ndcg FROM ({_metrics_sql(GRADE_STRUCTURED_SQL, True, True)})")
def q_ndcg_binary(spark, sf):
    return _metrics(spark, sf, structured=True, binary=True, compat=True).select("query_id", "ndcg")


@register("mrr_compat", f"SELECT query_id, mrr FROM ({_metrics_sql(GRADE_STRUCTURED_SQL, True, True)})")
def q_mrr_compat(spark, sf):
    return _metrics(spark, sf, structured=True, binary=True, compat=True).select("query_id", "mrr")


@register("metrics_by_type", f"""
    SELECT type, count(*) AS n,
      floor(sum(cast(round(p5 * 1000000) AS bigint)) / count(*) + 0.5) / 1000000 AS p5,
      floor(sum(cast(round(p10 * 1000000) AS bigint)) / count(*) + 0.5) / 1000000 AS p10,
      floor(sum(cast(round(ndcg * 1000000) AS bigint)) / count(*) + 0.5) / 1000000 AS ndcg,
      floor(sum(cast(round(mrr * 1000000) AS bigint)) / count(*) + 0.5) / 1000000 AS mrr
    FROM ({_metrics_sql(GRADE_CLASSIC_SQL, False, False)}) GROUP BY ROLLUP (type)""")
def q_metrics_by_type(spark, sf):
    from larder.operators.evaluate import metrics_by_type
    return metrics_by_type(_metrics(spark, sf))


@register("metrics_by_type_structured", f"""
    SELECT type, count(*) AS n,
      floor(sum(cast(round(p5 * 1000000) AS bigint)) / count(p5) + 0.5) / 1000000 AS p5,
      floor(sum(cast(round(p10 * 1000000) AS bigint)) / count(p10) + 0.5) / 1000000 AS p10,
      floor(sum(cast(round(ndcg * 1000000) AS bigint)) / count(ndcg) + 0.5) / 1000000 AS ndcg,
      floor(sum(cast(round(mrr * 1000000) AS bigint)) / count(mrr) + 0.5) / 1000000 AS mrr
    FROM ({_metrics_sql(GRADE_STRUCTURED_SQL, True, True)}) GROUP BY ROLLUP (type)""")
def q_metrics_by_type_structured(spark, sf):
    from larder.operators.evaluate import metrics_by_type
    return metrics_by_type(_metrics(spark, sf, structured=True, binary=True, compat=True))


@register("latency_percentiles", """
    WITH s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS idx,
                      count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
    SELECT event_type, any_value(n) AS n, max(CASE WHEN idx = floor(n * 0.5) THEN value END) AS p50,
           max(CASE WHEN idx = floor(n * 0.95) THEN value END) AS p95, round(avg(value), 6) AS avg
    FROM s GROUP BY event_type""")
def q_latency_percentiles(spark, sf):
    from larder.operators.evaluate import latency_percentiles
    ev = fx.table(spark, sf, "events")
    out = latency_percentiles(ev, "event_type", "value")
    return out.select("event_type", "n", "p50", "p95", r6(F.col("avg")).alias("avg"))


# ----------------------------------------------------------------- look-ups
_IDS_SQL = ("SELECT DISTINCT lpad(cast(l_partkey AS varchar), 13, '0') AS id FROM lineitem UNION "
            "SELECT DISTINCT lpad(cast(l_suppkey * 1000 AS varchar), 13, '0') FROM lineitem")


def _ids(spark, sf):
    li = fx.table(spark, sf, "lineitem")
    return (li.select(F.lpad(F.col("l_partkey").cast("string"), 13, "0").alias("id"))
            .union(li.select(F.lpad((F.col("l_suppkey") * 1000).cast("string"), 13, "0").alias("id"))).distinct())


@register("lookup_by_id", f"""SELECT i.id, d.product_name, d.brand FROM ({_IDS_SQL}) i
    LEFT JOIN ({O.docs_sql()}) d ON d.id = i.id""")
def q_lookup_by_id(spark, sf):
    from larder.operators.lookup import lookup_by_id
    return lookup_by_id(docs(spark, sf), _ids(spark, sf)).select("id", "product_name", "brand")


@register("compare_ids", f"""SELECT l_orderkey AS request_id, l_linenumber AS pos, d.id, d.product_name
    FROM lineitem JOIN ({O.docs_sql()}) d ON d.id = lpad(cast(l_partkey AS varchar), 13, '0')""")
def q_compare_ids(spark, sf):
    from larder.operators.lookup import compare_ids
    req = fx.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("request_id"), F.col("l_linenumber").alias("pos"),
        F.lpad(F.col("l_partkey").cast("string"), 13, "0").alias("id"))
    return compare_ids(docs(spark, sf), req).select("request_id", "pos", "id", "product_name")


def _browse_sql(kind: str, values: str) -> str:
    cols = ", ".join((f"v AS {c}" if c == kind else f"NULL::VARCHAR AS {c}") for c in ("brand_f", "category_f", "ingredients_f"))
    return O.ranked_sql(O.scored_sql(
        f"SELECT v AS query_id, '' AS text, {cols}, " + ", ".join(f"NULL::BOOLEAN AS {f}" for f in FLAG_NAMES)
        + ", []::STRUCT(nutrient VARCHAR, operator VARCHAR, value DOUBLE, unit VARCHAR, comparison_basis VARCHAR)[] "
        f"AS numeric_filters, []::VARCHAR[] AS modifiers FROM (SELECT DISTINCT {values} AS v FROM part)",
        O.search_docs_sql()), 20)


def _browse(spark, sf, kind, values):
    from larder.operators.lookup import browse_requests
    vals = fx.table(spark, sf, "part").selectExpr(f"{values} AS query_id", f"{values} AS value").distinct()
    return _ranked(index(spark, sf), browse_requests(vals, kind, 20))


for _name, _kind, _col, _values in (("browse_brand", "brand", "brand_f", "replace(lower(p_brand), '#', '')"),
                                    ("browse_category", "category", "category_f", "lower(p_type)"),
                                    ("browse_ingredients", "ingredients", "ingredients_f", "p_name")):
    def _mk_browse(kind, values):
        def fn(spark, sf):
            return _browse(spark, sf, kind, values)
        return fn
    register(_name, _browse_sql(_col, _values))(_mk_browse(_kind, _values))


_PREFIX_SQL = "SELECT DISTINCT left(p_name, 1 + cast(p_size % 6 AS integer)) AS q FROM part"


@register("autocomplete_prefix", f"""
    WITH q AS (SELECT q AS query_id, lower(regexp_replace(regexp_replace(q, '[^\\p{{L}}\\p{{N}}_\\s\\-\\.]', '', 'g'),
                      '\\s+', ' ', 'g')) AS prefix FROM ({_PREFIX_SQL})),
    n AS (SELECT DISTINCT product_name AS name FROM ({O.docs_sql()}) WHERE product_name <> ''),
    h AS (SELECT query_id, name, row_number() OVER (PARTITION BY query_id ORDER BY name) AS rank
          FROM q JOIN n ON starts_with(lower(n.name), trim(q.prefix)) WHERE trim(q.prefix) <> '')
    SELECT query_id, rank, name FROM h WHERE rank <= 5""")
def q_autocomplete_prefix(spark, sf):
    from larder.operators.lookup import autocomplete_prefix
    qs = fx.table(spark, sf, "part").select(
        F.expr("left(p_name, 1 + cast(p_size % 6 AS int))").alias("query")).distinct().select(
        F.col("query").alias("query_id"), "query")
    return autocomplete_prefix(docs(spark, sf), qs)


_TYPED_SQL = "SELECT DISTINCT left(p_name, 4 + cast(p_size % 11 AS integer)) AS q FROM part"
_WORDS = "list_filter(regexp_split_to_array(lower({c}), '[^\\p{{L}}\\p{{N}}_]+'), lambda t: t <> '')"


@register("autocomplete_terms", f"""
    WITH q AS (SELECT q AS query_id, {_WORDS.format(c="q")} AS w FROM ({_TYPED_SQL})),
    d AS (SELECT id AS doc_id, product_name AS name, {_WORDS.format(c="product_name")} AS a, {_WORDS.format(c="search_text")} AS b
          FROM ({O.docs_sql()}) WHERE product_name <> ''),
    t AS (SELECT query_id, w[i] AS term, i = len(w) AS is_last FROM (SELECT query_id, w, unnest(range(1, len(w) + 1)) AS i FROM q)),
    v AS (SELECT DISTINCT doc_id, 'a' AS field, x FROM (SELECT doc_id, unnest(a) AS x FROM d)
          UNION ALL SELECT DISTINCT doc_id, 'b', x FROM (SELECT doc_id, unnest(b) AS x FROM d)),
    m AS (SELECT DISTINCT query_id, doc_id, field, term, is_last FROM t JOIN v ON starts_with(x, term) AND length(x) >= 2
          AND length(term) <= 20 AND (is_last OR length(term) >= 2)),
    s AS (SELECT query_id, doc_id, max(n) AS score FROM (SELECT query_id, doc_id, field, count(*) AS n FROM m GROUP BY ALL) GROUP BY ALL),
    r AS (SELECT s.*, name, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, name, doc_id) AS rank
          FROM s JOIN d USING (doc_id))
    SELECT query_id, rank, doc_id, name, score FROM r WHERE rank <= 5""")
def q_autocomplete_terms(spark, sf):
    from larder.operators.lookup import autocomplete_terms
    qs = fx.table(spark, sf, "part").select(F.expr("left(p_name, 4 + cast(p_size % 11 AS int))").alias("query")).distinct().select(
        F.col("query").alias("query_id"), "query")
    return autocomplete_terms(docs(spark, sf), qs)


@register("doc_count", f"SELECT count(*) AS documents FROM ({O.docs_sql()})")
def q_doc_count(spark, sf):
    from larder.operators.lookup import doc_count
    return doc_count(docs(spark, sf))


# ----------------------------------------------------------------- text layer
@register("normalize_phrases", f"SELECT conv_id, turn, {O.normalize('text')} AS normalized FROM conversations")
def q_normalize_phrases(spark, sf):
    from larder.functions.text import normalize_phrase
    c = fx.table(spark, sf, "conversations")
    return c.select("conv_id", "turn", normalize_phrase(F.col("text")).alias("normalized"))


@register("canonicalize", f"SELECT doc_id, {O.canon('lower(text)')} AS canonical FROM documents")
def q_canonicalize(spark, sf):
    from larder.functions.text import canonicalize
    d = fx.table(spark, sf, "documents")
    return d.select("doc_id", canonicalize(F.lower("text")).alias("canonical"))


@register("ngrams", f"""
    WITH p AS (SELECT cast(item_id AS varchar) AS query_id, {O.normalize("array_to_string(regexp_split_to_array(trim(text), '\\s+'), ' ')")} AS nq FROM benchmark),
    t AS (SELECT query_id, CASE WHEN nq = '' THEN []::VARCHAR[] ELSE string_split(nq, ' ') END AS toks FROM p),
    g AS (SELECT query_id, list_sort(flatten(list_transform(range(1, least(4, len(toks)) + 1), lambda n:
            list_transform(range(0, len(toks) - n + 1), lambda i: {{'neg_len': -length(array_to_string(toks[i + 1:i + n], ' ')),
            'n': n, 'pos': i, 'text': array_to_string(toks[i + 1:i + n], ' ')}})))) AS gs FROM t)
    SELECT query_id, idx, g.text AS text, g.n AS n, g.pos AS pos
    FROM (SELECT query_id, generate_subscripts(gs, 1) - 1 AS idx, unnest(gs) AS g FROM g)""")
def q_ngrams(spark, sf):
    from larder.functions.text import ngrams, normalize_phrase, tokenize
    b = fx.benchmark_phrases(spark, sf)
    g = b.select("query_id", F.posexplode(ngrams(tokenize(normalize_phrase(F.col("phrase"))))).alias("idx", "g"))
    return g.select("query_id", F.col("idx").cast("long").alias("idx"), F.col("g.text").alias("text"),
                    F.col("g.n").cast("long").alias("n"), F.col("g.pos").cast("long").alias("pos"))


@register("synonym_expand", f"""
    WITH t AS (SELECT DISTINCT unnest(string_split({O.normalize('ingredients_text')}, ' ')) AS token
               FROM ({O.raw_products_sql()}) WHERE ingredients_text <> '')
    SELECT token, unnest({O.variants_sql('token')}) AS variant FROM t WHERE length(token) > 1""")
def q_synonym_expand(spark, sf):
    from larder.functions.text import normalize_phrase, synonym_variants, tokenize
    r = raw(spark, sf).where(F.col("ingredients_text") != "")
    toks = r.select(F.explode(tokenize(normalize_phrase(F.col("ingredients_text")))).alias("token")).distinct()
    return toks.where(F.length("token") > 1).select("token", F.explode(synonym_variants(F.col("token"))).alias(
        "variant"))


@register("edge_ngrams", f"""
    WITH w AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(product_name), '[^\\p{{L}}\\p{{N}}_]+')) AS word
               FROM ({O.docs_sql()}))
    SELECT word, unnest(list_transform(range(2, least(20, length(word)) + 1), lambda i: left(word, i))) AS prefix
    FROM w WHERE length(word) >= 2""")
def q_edge_ngrams(spark, sf):
    from larder.functions.text import analyzed_terms, edge_ngrams
    w = docs(spark, sf).select(F.explode(analyzed_terms(F.col("product_name"))).alias("word")).distinct()
    return w.where(F.length("word") >= 2).select("word", F.explode(edge_ngrams(F.col("word"))).alias("prefix"))


_FIELDS = {"product_name": "product_name", "brand": "brand", "category": "category", "ingredients": "ingredients",
           "search_text": "search_text", "semantic_document": "semantic_document"}


def _term_counts(docs) -> DataFrame:
    """(field, term, doc_id, tf), counted where the documents of an id lie: terms are not exchanged."""
    from larder.operators.bm25 import field_terms
    from larder.operators.joins import spread
    return field_terms(spread(docs, "id"), _FIELDS).groupBy("field", "term", "doc_id").agg(F.count(F.lit(1)).alias("tf"))


@register("postings_tf", "WITH d AS (" + O.docs_sql() + ") " + " UNION ALL ".join(
    f"""SELECT '{f}' AS field, term, id AS doc_id, count(*) AS tf FROM (
          SELECT id, unnest(list_filter(regexp_split_to_array(lower(coalesce({c}, '')), '[^\\p{{L}}\\p{{N}}_]+'),
                 lambda x: x <> '')) AS term FROM d) GROUP BY ALL""" for f, c in _FIELDS.items()))
def q_postings_tf(spark, sf):
    return _term_counts(docs(spark, sf))


@register("term_df", "WITH d AS (" + O.docs_sql() + ") " + " UNION ALL ".join(
    f"""SELECT '{f}' AS field, term, count(DISTINCT id) AS df FROM (
          SELECT id, unnest(list_filter(regexp_split_to_array(lower(coalesce({c}, '')), '[^\\p{{L}}\\p{{N}}_]+'),
                 lambda x: x <> '')) AS term FROM d) GROUP BY ALL""" for f, c in _FIELDS.items()))
def q_term_df(spark, sf):
    return _term_counts(docs(spark, sf)).groupBy("field", "term").agg(F.count("doc_id").alias("df"))


# ----------------------------------------------------------------- BM25 path
def _bm25(spark, sf, phrase_exprs, clause=None, k=None):
    from larder.operators.bm25 import bm25_search
    from larder.plans.index import shared_text_index
    ix = index(spark, sf)
    req = requests(spark, sf, phrase_set(spark, sf, phrase_exprs))
    return bm25_search(req, shared_text_index(ix), ix.search, k, clause)


def _bm25_oracle(phrase_exprs, clause=None, k=20):
    req = O.requests_sql(O.annotate_sql(phrase_set_sql(phrase_exprs), _DICT_SQL), _DICT_SQL)
    return O.bm25_sql(req, O.search_docs_sql(), clause, k)


BM25_PHRASES = ["concat('organic ', p_name)", "concat(p_name, ' ', lower(p_type))",
                "concat(p_name, ' soya lecithin')", "concat(p_name, ' fresh')"]


@register("search_bm25", _bm25_oracle(BM25_PHRASES))
def q_search_bm25(spark, sf):
    return _bm25(spark, sf, BM25_PHRASES)


@register("search_phrase", _bm25_oracle(BM25_PHRASES, "phrase"))
def q_search_phrase(spark, sf):
    return _bm25(spark, sf, BM25_PHRASES, "phrase")


@register("search_and", _bm25_oracle(BM25_PHRASES, "and"))
def q_search_and(spark, sf):
    return _bm25(spark, sf, BM25_PHRASES, "and")


# ----------------------------------------------------------------- incremental
@register("upsert_latest", """
    SELECT user_id, event_id, ts, event_type, value FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
    WHERE rn = 1""")
def q_upsert_latest(spark, sf):
    from larder.streaming.ingest import keep_latest
    ev = fx.table(spark, sf, "events").select("user_id", "event_id", "ts", "event_type", "value")
    return keep_latest(ev, "user_id", ["ts", "event_id"]).select("user_id", "event_id", "ts", "event_type", "value")


# A document that quotes an address has it as its code; the others have none.
_ADDRESS = "[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+"
_DOCS_AS_PRODUCTS = (f"SELECT regexp_extract(text, '{_ADDRESS}') AS code, text "
                     "AS product_name, source AS brands, lang AS categories, NULL AS ingredients_text, "
                     "NULL AS nutriments, NULL AS nutriscore_grade, NULL AS nova_group, NULL AS ecoscore_grade, "
                     "NULL AS completeness FROM documents")


@register("rejects", f"""SELECT code AS _id, 'missing_id' AS error FROM ({O.raw_products_sql(_DOCS_AS_PRODUCTS)})
    WHERE code = ''""")
def q_rejects(spark, sf):
    from larder.streaming.ingest import split_rejects
    src = fx.table(spark, sf, "documents").selectExpr(
        f"regexp_extract(text, '{_ADDRESS}', 0) AS code", "text AS product_name", "source AS brands", "lang AS categories")
    _good, bad = split_rejects(build_documents(raw_products(src)))
    return bad


# ----------------------------------------------------------------- more annotation views
MOD_PHRASES = ["concat('fresh ', p_name, ' frozen')", "concat('wild salted ', p_name, ' fresh')"]
RECIPE_PHRASES = ["concat(p_size, ' cups ', p_name)", "concat('1/2 tbsp ', p_name, ' ', p_size % 4, ' kg')",
                  "concat(p_size, ' g ', p_name)"]
INTENT_PHRASES = ["concat('category ', lower(p_type))", "concat(p_name, ' ingredients')",
                  "concat('show me ', lower(p_brand), ' products')", "concat('products by ', p_name)",
                  "concat(p_name, ' made of ', lower(p_type))"]
PROMO_PHRASES = ["concat(replace(lower(p_brand), '#', ''), ' ', p_name)",
                 "concat(p_name, ' ', replace(lower(p_brand), '#', ''))"]
FILTER_ONLY_PHRASES = ["concat('category ', lower(p_type))", "concat('in category ', lower(p_type), ' vegan')"]

for _name, _phr in (("modifiers", MOD_PHRASES), ("recipe_quantities", RECIPE_PHRASES), ("intent", INTENT_PHRASES)):
    def _mk(phr):
        def fn(spark, sf):
            return flat_annotations(annotations(spark, sf, phrase_set(spark, sf, phr)))
        return fn
    register(_name, flat_annotations_sql(O.annotate_sql(phrase_set_sql(_phr), _DICT_SQL)))(_mk(_phr))


@register("brand_promotion", f"""SELECT query_id, intent, text, brand_f, category_f, ingredients_f
    FROM ({O.requests_sql(O.annotate_sql(phrase_set_sql(PROMO_PHRASES + INTENT_PHRASES), _DICT_SQL), _DICT_SQL)})""")
def q_brand_promotion(spark, sf):
    r = requests(spark, sf, phrase_set(spark, sf, PROMO_PHRASES + INTENT_PHRASES))
    return r.select("query_id", "intent", "text", "brand_f", "category_f", "ingredients_f")


@register("search_filter_only", _search_oracle(FILTER_ONLY_PHRASES, k=20))
def q_search_filter_only(spark, sf):
    return _search(spark, sf, FILTER_ONLY_PHRASES, k=20)


@register("search_paged", f"SELECT * FROM ({_search_oracle(SEARCH_PHRASES, k=20)}) WHERE rank > 10")
def q_search_paged(spark, sf):
    from larder.operators.annotate import annotate
    from larder.operators.filters import derive_requests
    ix = index(spark, sf)
    req = derive_requests(annotate(phrase_set(spark, sf, SEARCH_PHRASES), ix.dictionary, size=10, from_=10),
                          ix.dictionary)
    return _ranked(ix, req)


@register("search_paged_mixed", f"""SELECT * FROM ({_search_oracle(SEARCH_PHRASES, k=90)})
    WHERE rank > 20 * (length(query_id) % 3)
      AND rank <= 20 * (length(query_id) % 3) + CASE length(query_id) % 4 WHEN 0 THEN 5 WHEN 1 THEN 20 ELSE 50 END""")
def q_search_paged_mixed(spark, sf):
    """R-18/D-11: page sizes 5, 20 and 50 and offsets 0, 20 and 40 in one table of requests."""
    req = requests(spark, sf, phrase_set(spark, sf, SEARCH_PHRASES))
    req = req.withColumn("from_", F.expr("20 * (length(query_id) % 3)")).withColumn(
        "size", F.expr("CASE length(query_id) % 4 WHEN 0 THEN 5 WHEN 1 THEN 20 ELSE 50 END"))
    return _ranked(index(spark, sf), req)


@register("search_modifiers", _search_oracle(MOD_PHRASES))
def q_search_modifiers(spark, sf):
    """R-6: phrases whose modifier occurs in names."""
    return _search(spark, sf, MOD_PHRASES)


def _facet_sql():
    parts = []
    for kind, col in (("brands", "brand"), ("categories", "category"), ("ingredients", "ingredients")):
        parts.append(f"""SELECT '{kind}' AS kind, lower({O.strip('piece')}) AS term FROM (
          SELECT unnest(string_split(value, ',')) AS piece FROM (
            SELECT {col} AS value, count(*) AS n FROM d WHERE {col} IS NOT NULL AND length({col}) <= 256
            GROUP BY {col} ORDER BY n DESC, value LIMIT 10000))""")
    return f"WITH d AS ({O.docs_sql()}) SELECT DISTINCT kind, term FROM (" + " UNION ALL ".join(parts) + \
        ") WHERE term <> ''"


@register("facet_terms", _facet_sql())
def q_facet_terms(spark, sf):
    from larder.operators.dictionary import facet_terms
    return facet_terms(docs(spark, sf))


# ----------------------------------------------------------------- E-16
VERIFY_CASES = [
    ("min_protein", "concat(p_name, ' with at least 20g protein')"),
    ("max_calories", "concat(p_name, ' under 200 calories')"),
    ("low_sugar", "concat('low sugar ', p_name)"),
    ("high_protein", "concat('high protein ', p_name)"),
]


@register("verify_constraints", f"""
    WITH h AS ({_search_oracle([e for _c, e in VERIFY_CASES], 10)}), d AS ({O.search_docs_sql()}),
    cases AS ({' UNION ALL '.join(f"SELECT DISTINCT {e} AS query_id, '{c}' AS check_kind, "
                                   f"string_split(p_name, ' ')[-1] AS needle FROM part" for c, e in VERIFY_CASES)}),
    chk AS (
      SELECT h.query_id, h.total, c.check_kind,
        CASE c.check_kind
          WHEN 'min_protein' THEN coalesce(list_filter(d.nuts, lambda e: e.k = 'proteins')[1].p >= 20.0, false)
          WHEN 'max_calories' THEN coalesce(coalesce(list_filter(d.nuts, lambda e: e.k = 'energy-kcal')[1].p,
                                                     list_filter(d.nuts, lambda e: e.k = 'calories')[1].p) <= 200.0, false)
          WHEN 'low_sugar' THEN d.is_low_sugar OR coalesce(list_filter(d.nuts, lambda e: e.k = 'sugars')[1].p
                                                           BETWEEN 0 AND 5.0, false)
          ELSE d.is_high_protein OR coalesce(list_filter(d.nuts, lambda e: e.k = 'proteins')[1].p >= 10.0, false)
        END AS constraint_ok,
        contains(lower(concat_ws(' ', d.product_name, d.category, d.search_text)), c.needle) AS category_ok
      FROM h JOIN cases c USING (query_id) JOIN d ON d.id = h.doc_id)
    SELECT c.query_id, c.check_kind, coalesce(any_value(chk.total), 0) AS total, count(chk.query_id) AS sample_size,
           count_if(CASE WHEN c.check_kind IN ('low_sugar', 'high_protein') THEN constraint_ok AND category_ok
                         ELSE constraint_ok END) AS n_ok,
           coalesce(bool_and(CASE WHEN c.check_kind IN ('low_sugar', 'high_protein') THEN constraint_ok AND category_ok
                                  ELSE constraint_ok END), true) AS passed
    FROM cases c LEFT JOIN chk USING (query_id) GROUP BY c.query_id, c.check_kind""")
def q_verify_constraints(spark, sf):
    from larder.operators.evaluate import verify_constraints
    part = fx.table(spark, sf, "part")
    cases = None
    for kind, expr in VERIFY_CASES:
        c = part.selectExpr(f"{expr} AS query_id", f"'{kind}' AS check_kind",
                            "element_at(split(p_name, ' '), -1) AS needle").distinct()
        cases = c if cases is None else cases.unionByName(c)
    hits = _search(spark, sf, [e for _c, e in VERIFY_CASES], 10)
    return verify_constraints(hits, docs(spark, sf), cases)


FUZZY_PHRASES = ["concat(p_name, 's')", "concat(substring(p_name, 2), ' ', lower(p_type))",
                 "concat(replace(p_name, 'e', 'a'), ' widgte')"]


@register("search_fuzzy", _bm25_oracle(FUZZY_PHRASES, "fuzzy"))
def q_search_fuzzy(spark, sf):
    """R-11 .. R-13: mistyped phrases."""
    return _bm25(spark, sf, FUZZY_PHRASES, "fuzzy")


@register("search_bm25_boosts", _bm25_oracle(MOD_PHRASES + PALM_PHRASES))
def q_search_bm25_boosts(spark, sf):
    """R-16/R-17: modifiers that occur in names, and products without palm oil."""
    return _bm25(spark, sf, MOD_PHRASES + PALM_PHRASES)


# ----------------------------------------------------------------- L-5 overrides
_OVERRIDES_SQL = ("SELECT p_name AS query_id, NULL::VARCHAR AS o_brand, lower(min(p_type)) AS o_category, "
                  "NULL::VARCHAR AS o_ingredients, CASE WHEN min(p_size) % 3 = 0 THEN true END AS o_organic, "
                  + ", ".join(f"NULL::BOOLEAN AS o_{k}" for k in ("vegan", "vegetarian", "palm_oil", "high_protein",
                                                                 "low_sugar", "low_sodium", "gluten_free",
                                                                 "lactose_free"))
                  + " FROM part GROUP BY p_name")


@register("search_overrides", O.ranked_sql(O.scored_sql(O.requests_sql(
    O.annotate_sql("SELECT DISTINCT p_name AS query_id, p_name AS phrase FROM part", _DICT_SQL), _DICT_SQL,
    _OVERRIDES_SQL), O.search_docs_sql()), 20))
def q_search_overrides(spark, sf):
    """L-5: phrases plus explicit filters (category, organic) per request."""
    ix = index(spark, sf)
    part = fx.table(spark, sf, "part")
    ph = part.select(F.col("p_name").alias("query_id"), F.col("p_name").alias("phrase")).distinct()
    ov = part.groupBy("p_name").agg(F.lower(F.min("p_type")).alias("category"),
                                    F.when(F.min("p_size") % 3 == 0, F.lit(True)).alias("organic")).select(
        F.col("p_name").alias("query_id"), F.lit(None).cast("string").alias("brand"), "category",
        F.lit(None).cast("string").alias("ingredients"), "organic")
    return _ranked(ix, requests(spark, sf, ph, ov))


def _overrides(columns: dict[str, str], flags: dict[str, str]) -> tuple[list[str], str]:
    """Select lists of explicit filters: for Spark, and for DuckDB (``o_`` names)."""
    from larder.fixed_values import FILTER_KEYS
    values = {k: columns.get(k, "cast(NULL AS varchar(99))") for k in ("brand", "category", "ingredients")}
    values |= {k: flags.get(k, "cast(NULL AS boolean)") for k in FILTER_KEYS}
    return [f"{v} AS {k}" for k, v in values.items()], ", ".join(f"{v} AS o_{k}" for k, v in values.items())


# every fourth request has an empty brand, which is no filter
_TEXT_OVERRIDES = _overrides({"brand": "CASE WHEN min(p_size) % 4 = 0 THEN '' ELSE replace(lower(min(p_brand)), '#', '') END",
                              "ingredients": "CASE WHEN min(p_size) % 2 = 0 THEN 'Probiotic' END"}, {})
_SIGNATURES = _overrides({}, {"vegan": "CASE WHEN p_size % 2 = 0 THEN true END", "organic": "CASE WHEN p_size % 5 = 1 THEN false END",
                              "palm_oil": "CASE WHEN p_size % 3 = 0 THEN false END",
                              "low_sugar": "CASE WHEN p_size % 7 = 3 THEN true END"})


@register("override_filters", O.ranked_sql(O.scored_sql(O.requests_sql(
    O.annotate_sql("SELECT DISTINCT p_name AS query_id, p_name AS phrase FROM part", _DICT_SQL), _DICT_SQL,
    f"SELECT p_name AS query_id, {_TEXT_OVERRIDES[1]} FROM part GROUP BY p_name"), O.search_docs_sql()), 20))
def q_override_filters(spark, sf):
    """D-1/D-9: explicit brand and ingredient filters, some of them empty."""
    part = fx.table(spark, sf, "part")
    ph = part.selectExpr("p_name AS query_id", "p_name AS phrase").distinct()
    ov = part.groupBy(F.col("p_name").alias("query_id")).agg(*[F.expr(e) for e in _TEXT_OVERRIDES[0]])
    return _ranked(index(spark, sf), requests(spark, sf, ph, ov))


@register("search_signature", O.ranked_sql(O.scored_sql(O.requests_sql(
    O.annotate_sql("SELECT DISTINCT concat('flags ', p_size) AS query_id, '' AS phrase FROM part", _DICT_SQL), _DICT_SQL,
    f"SELECT DISTINCT concat('flags ', p_size) AS query_id, {_SIGNATURES[1]} FROM part"), O.search_docs_sql()), 20))
def q_search_signature(spark, sf):
    """P-10: requests with flags only, or with no condition at all."""
    part = fx.table(spark, sf, "part")
    ph = part.selectExpr("concat('flags ', p_size) AS query_id", "'' AS phrase").distinct()
    ov = part.selectExpr("concat('flags ', p_size) AS query_id", *_SIGNATURES[0]).distinct()
    return _ranked(index(spark, sf), requests(spark, sf, ph, ov))


# Judgments that use every part of the structured layout: by the length of the name a list of alternatives, words that
# must all occur, optional words with a required flag, exclusions with and without a scope, name scopes, or nothing.
_RICH_PHRASES = ["concat('organic ', p_name)", "concat(p_name, ' under 200 calories')"]
_W1, _W2 = "split_part(p_name, ' ', 1)", "split_part(p_name, ' ', 2)"


def _rich_rows(list_of) -> str:
    k = "length(p_name) % 6"
    any_ = (f"CASE {k} WHEN 1 THEN {list_of(list_of(_W1), list_of(_W2))} WHEN 3 THEN {list_of(list_of(_W1, _W2))} "
            f"WHEN 5 THEN {list_of(list_of(_W1, chr(39) + 'frozen' + chr(39)))} END")
    words = f"CASE {k} WHEN 0 THEN {list_of(_W1, _W2)} WHEN 5 THEN {list_of(_W2)} END"
    excluded = f"CASE {k} WHEN 3 THEN {list_of(chr(39) + 'fresh' + chr(39))} WHEN 5 THEN {list_of(chr(39) + 'palm' + chr(39))} END"
    return " UNION ALL ".join(f"""SELECT {e} AS query_id, {any_} AS any_, {words} AS words,
        CASE {k} WHEN 2 THEN {list_of(_W1)} END AS optional, {excluded} AS excluded,
        CASE {k} WHEN 3 THEN 'name' END AS excluded_scope, CASE {k} WHEN 2 THEN true END AS organic,
        CASE WHEN {k} IN ({nutrition}) THEN 200.0E0 END AS calories, CASE {k} WHEN 1 THEN 'name' WHEN 5 THEN 'name' END AS scope
        FROM (SELECT DISTINCT p_name FROM part) AS n{i}""" for i, (e, nutrition) in enumerate(zip(_RICH_PHRASES, ("-1", "0, 2"))))


def rich_judgments(spark, sf) -> DataFrame:
    part = fx.table(spark, sf, "part")
    rows = spark.sql(_rich_rows(lambda *x: f"array({', '.join(x)})").replace("FROM part", "FROM {part}"), part=part)
    none = F.lit(None)
    rel = F.struct(
        F.col("any_").alias("required_any"), F.col("words").alias("required_all"), "optional",
        F.transform("excluded", lambda t: F.struct(t.alias("term"), none.cast("string").alias("scope"))).alias("excluded"),
        "excluded_scope", F.when(F.col("organic"), F.create_map(F.lit("is_organic"), F.lit(True))).alias("required_flags"),
        F.when(F.col("calories").isNotNull(), F.struct(F.lit("calories").alias("nutrient"), F.lit("lte").alias("operator"),
                                                       F.col("calories").alias("value"))).alias("nutrition"),
        none.cast("string").alias("brand"), F.col("scope").alias("group_scope"))
    return rows.select("query_id", rel.alias("relevance"))


def _all_in(hay: str, words: str) -> str:
    return f"len(list_filter({words}, lambda t: {_tp(hay, 't')})) = len({words})"


_WIDE = "CASE WHEN j.scope = 'name' THEN name ELSE text END"
_CALORIES = "list_filter(hd.nuts, lambda e: e.k = 'energy-kcal')[1]"
GRADE_RICH_SQL = f"""
WITH hd AS ({_hits_docs_sql(_RICH_PHRASES)}), j AS ({_rich_rows(lambda *x: f"[{', '.join(x)}]")}),
g AS (SELECT hd.query_id, rank, doc_id, j.*  EXCLUDE (query_id),
    coalesce(len(list_filter(excluded, lambda x: {_tp('name', 'x')} OR (coalesce(excluded_scope, 'all') <> 'name'
             AND {_tp('text', 'x')}))) > 0, false) AS is_excluded,
    is_organic, coalesce({_CALORIES}.p, {_CALORIES}.v) AS kcal,
    coalesce(len(list_filter(any_, lambda g: {_all_in('name', 'g')})) > 0, false) AS in_name,
    coalesce(len(list_filter(any_, lambda g: {_all_in(_WIDE, 'g')})) > 0, false)
      OR coalesce({_all_in(_WIDE, 'words')}, false) AS anywhere,
    coalesce(len(list_filter(any_, lambda g: len(list_filter(g, lambda t: {_tp(_WIDE, 't')})) > 0)) > 0, false) AS partial,
    coalesce({_all_in('name', 'optional')}, false) AS optional_ok
  FROM hd JOIN j ON j.query_id = hd.query_id)
SELECT query_id, rank, doc_id,
  CASE WHEN any_ IS NULL AND words IS NULL AND optional IS NULL AND excluded IS NULL AND organic IS NULL AND calories IS NULL
            AND scope IS NULL THEN NULL
       WHEN is_excluded OR (organic AND NOT is_organic) THEN 0
       WHEN calories IS NOT NULL AND NOT coalesce(kcal <= calories, false) THEN 0
       WHEN any_ IS NOT NULL OR words IS NOT NULL
         THEN CASE WHEN in_name THEN 3 WHEN anywhere THEN 2 WHEN partial THEN 1 ELSE 0 END
       WHEN (organic OR calories IS NOT NULL) AND optional_ok THEN 3 ELSE 2 END AS grade
FROM g
"""


@register("grade_structured_rich", GRADE_RICH_SQL)
def q_grade_structured_rich(spark, sf):
    """E-6/E-7: optional and required words, exclusions and name scopes; a judgment without content grades nothing."""
    from larder.operators.evaluate import grade_structured
    h = eval_hits(spark, sf, phrases=_RICH_PHRASES).join(rich_judgments(spark, sf), "query_id")
    return h.select("query_id", "rank", "doc_id", grade_structured(
        F.col("product_name"), F.col("brand"), F.col("search_text"), F.col("flags"), F.col("nutrition"),
        F.col("relevance")).alias("grade"))


@register("evidence", f"""
    WITH a AS ({O.annotate_sql(phrase_set_sql(SEARCH_PHRASES), _DICT_SQL)}),
    hd AS ({_hits_docs_sql()}), c AS ({GRADE_CLASSIC_SQL}), s AS ({GRADE_STRUCTURED_SQL}),
    h AS (SELECT hd.query_id, any_value(hd.total) AS total, string_agg(concat_ws(':', hd.doc_id, name, hd.brand, hd.category,
            hd.is_organic, c.grade, s.grade), '|' ORDER BY hd.rank) AS hits
          FROM hd JOIN c USING (query_id, rank, doc_id) JOIN s USING (query_id, rank, doc_id) GROUP BY hd.query_id),
    mc AS ({_metrics_sql(GRADE_CLASSIC_SQL, False, False)}), ms AS ({_metrics_sql(GRADE_STRUCTURED_SQL, True, True)})
    SELECT a.query_id, a.intent, a.cq AS text_term, coalesce(h.total, 0) AS total, coalesce(h.hits, '') AS hits,
           mc.p5, mc.p10, mc.ndcg, mc.mrr, ms.p5 AS s_p5, ms.p10 AS s_p10, ms.ndcg AS s_ndcg, ms.mrr AS s_mrr
    FROM a LEFT JOIN h USING (query_id) LEFT JOIN mc USING (query_id) LEFT JOIN ms USING (query_id)""")
def q_evidence(spark, sf):
    from larder.operators.evaluate import evidence_records, grade_classic, grade_structured
    ann = annotations(spark, sf, phrase_set(spark, sf, SEARCH_PHRASES)).select("query_id", "intent", "text_term", "filters")
    fields = [F.col(c) for c in ("product_name", "brand", "search_text", "flags")]
    judged = classic_judgments(spark, sf)
    judged = judged.select("query_id", F.struct(*judged.columns).alias("item")).join(
        structured_judgments(spark, sf).select("query_id", "relevance"), "query_id")
    graded = eval_hits(spark, sf).join(judged, "query_id")
    hits = graded.select("query_id", "rank", "doc_id", "score", "total", "product_name", "brand", "category", "flags",
                         grade_classic(*fields, F.col("item")).alias("classic_grade"),
                         grade_structured(*fields, F.col("nutrition"), F.col("relevance")).alias("structured_grade"))
    rec = evidence_records(ann, hits, _metrics(spark, sf), _metrics(spark, sf, structured=True, binary=True, compat=True))
    text = F.array_join(F.transform(F.coalesce("hits", F.array()), lambda h: F.concat_ws(
        ":", h["doc_id"], F.lower(F.coalesce(h["product_name"], F.lit(""))), F.lower(F.coalesce(h["brand"], F.lit(""))),
        h["category"], h["flags"]["is_organic"].cast("string"), h["classic_grade"].cast("string"),
        h["structured_grade"].cast("string"))), "|")
    total = F.coalesce(F.get(F.col("hits"), 0)["total"], F.lit(0)).alias("total")
    return rec.select("query_id", "intent", "text_term", total, text.alias("hits"),
                      *[F.col(f"metrics_classic.{m}") for m in ("p5", "p10", "ndcg", "mrr")],
                      *[F.col(f"metrics_structured.{m}").alias(f"s_{m}") for m in ("p5", "p10", "ndcg", "mrr")])


@register("explain", f"""
    WITH r AS ({O.requests_sql(O.annotate_sql(phrase_set_sql(SEARCH_PHRASES), _DICT_SQL), _DICT_SQL)}),
    s AS ({O.scored_sql(O.requests_sql(O.annotate_sql(phrase_set_sql(SEARCH_PHRASES), _DICT_SQL), _DICT_SQL),
                        O.search_docs_sql())}),
    t AS (SELECT query_id, count(*) AS n FROM s GROUP BY query_id)
    SELECT r.query_id, r.intent, r.text AS query_text, r.brand_f, r.category_f, len(r.numeric_filters) AS n_numeric,
           len(r.modifiers) AS n_modifiers, 20 AS size, 1 AS page, coalesce(t.n, 0) AS total_results
    FROM r LEFT JOIN t USING (query_id)""")
def q_explain(spark, sf):
    from larder.operators.annotate import annotate
    from larder.operators.filters import derive_requests
    from larder.operators.retrieve import explain_records, scored_hits
    ix = index(spark, sf)
    ann = annotate(phrase_set(spark, sf, SEARCH_PHRASES), ix.dictionary).checkpoint(eager=True)
    req = derive_requests(ann, ix.dictionary).checkpoint(eager=True)
    rec = explain_records(ann, req, scored_hits(req, ix.search, ix.postings, ix.vgrams, counts=ix.counts))
    return rec.select("query_id", "intent", "query_text", "brand_f", "category_f",
                      F.size("numeric_filters").cast("long").alias("n_numeric"),
                      F.size("modifiers").cast("long").alias("n_modifiers"),
                      "size", "page", "total_results")


# filters by terms: the words of the filter may come in any order, but whole
_TERM_FILTERS = _overrides({"brand": "CASE WHEN min(p_size) % 3 = 0 THEN replace(lower(min(p_brand)), '#', '') "
                                     "WHEN min(p_size) % 3 = 1 THEN 'brand1' END",
                            "category": "CASE WHEN min(p_size) % 2 = 0 THEN concat('foods ', lower(min(p_type))) END",
                            "ingredients": "CASE WHEN min(p_size) % 5 = 0 THEN 'lecithin soy' END"}, {})


@register("filter_brand_tokens", O.bm25_sql(O.requests_sql(
    O.annotate_sql("SELECT DISTINCT p_name AS query_id, p_name AS phrase FROM part", _DICT_SQL), _DICT_SQL,
    f"SELECT p_name AS query_id, {_TERM_FILTERS[1]} FROM part GROUP BY p_name"), O.search_docs_sql(), None, 20))
def q_filter_brand_tokens(spark, sf):
    """P-1 .. P-3 in the index: brand, category and ingredient filters by terms."""
    from larder.operators.bm25 import bm25_search
    from larder.plans.index import shared_text_index
    ix = index(spark, sf)
    part = fx.table(spark, sf, "part")
    ph = part.selectExpr("p_name AS query_id", "p_name AS phrase").distinct()
    ov = part.groupBy(F.col("p_name").alias("query_id")).agg(*[F.expr(e) for e in _TERM_FILTERS[0]])
    return bm25_search(requests(spark, sf, ph, ov), shared_text_index(ix), ix.search)


# ----------------------------------------------------------------- real text
# documents as the indexed texts, whole benchmark passages as phrases
_PASSAGE = "lower(array_to_string(regexp_split_to_array(trim(text), '\\s+'), ' '))"
_TEXT_DOCS_SQL = ("SELECT cast(doc_id AS varchar) AS id, nullif(text, '') AS product_name, NULL::VARCHAR AS brand, NULL::VARCHAR AS category, "
                  "NULL::VARCHAR AS ingredients, coalesce(text, '') AS search_text, lower(coalesce(text, '')) AS name_l, '' AS brand_l, "
                  "'' AS cat_l, '' AS ing_l, 0.0 AS completeness, []::STRUCT(k VARCHAR, p DOUBLE, v DOUBLE)[] AS nuts, "
                  + ", ".join(f"false AS {f}" for f in FLAG_NAMES) + " FROM documents")
_PASSAGE_REQUESTS_SQL = (f"SELECT cast(item_id AS varchar) AS query_id, {_PASSAGE} AS text, NULL::VARCHAR AS brand_f, "
                         "NULL::VARCHAR AS category_f, NULL::VARCHAR AS ingredients_f, "
                         + ", ".join(f"NULL::BOOLEAN AS {f}" for f in FLAG_NAMES)
                         + ", []::STRUCT(nutrient VARCHAR, operator VARCHAR, value DOUBLE, unit VARCHAR, comparison_basis VARCHAR)[] "
                         "AS numeric_filters, []::VARCHAR[] AS modifiers FROM benchmark")


def text_documents(spark, sf) -> DataFrame:
    src = fx.table(spark, sf, "documents").selectExpr(
        "cast(doc_id AS string) AS code", "text AS product_name",
        *[f"cast(NULL AS string) AS {c}" for c in ("brands", "categories", "ingredients_text", "nutriscore_grade", "nova_group", "ecoscore_grade")],
        "cast(NULL AS map<string,struct<value:double,per_100g:double,unit:string>>) AS nutriments", "0.0D AS completeness")
    return build_documents(src)


def passage_requests(spark, sf) -> DataFrame:
    from larder.operators.lookup import browse_requests
    b = fx.benchmark_phrases(spark, sf)
    # an empty value is no filter: a request by its text alone
    return browse_requests(b.select("query_id", F.lit("").alias("value"))).drop("text").join(
        b.select("query_id", F.lower("phrase").alias("text")), "query_id")


@register("search_documents", O.bm25_sql(_PASSAGE_REQUESTS_SQL, _TEXT_DOCS_SQL, None, 20))
def q_search_documents(spark, sf):
    """BM25 with the fuzzy clause on prose: each benchmark passage, whole, against whole documents."""
    from larder.operators.bm25 import bm25_search, text_index
    from larder.operators.enrich import search_table
    texts = text_documents(spark, sf)
    return bm25_search(passage_requests(spark, sf), text_index(texts), search_table(texts))


from larder.plans import catalog_io  # noqa: E402,F401  registers its queries
