"""Relevance grading and retrieval metrics (E-1 .. E-16).

Hits are graded by joining them to the judgment table on query_id (J-4);
every per-query quantity is an aggregate over at most k graded hits, so no
group grows with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.session import ensure_checkpoint_dir
from larder.fixed_values import EVAL_K, FLAG_NAMES, NUTRIENT_FIELD_MAP

# Judgment layouts (FIXTURES §4), with required_flags as a map.
CLASSIC_SCHEMA = ("query_id string, query string, type string, relevant_keywords array<string>, "
                  "disallowed_keywords array<string>, relevant_brand string, required_flags map<string,boolean>, "
                  "nutrition_constraint struct<nutrient:string,operator:string,value:double>")
STRUCTURED_SCHEMA = ("query_id string, query string, type string, relevance struct<"
                     "required_any:array<array<string>>, required_all:array<string>, optional:array<string>, "
                     "excluded:array<struct<term:string,scope:string>>, excluded_scope:string, "
                     "required_flags:map<string,boolean>, nutrition:struct<nutrient:string,operator:string,"
                     "value:double>, brand:string, group_scope:string>")


def flags_map(flags) -> F.Column:
    return F.create_map(*[x for f in FLAG_NAMES for x in (F.lit(f), flags[f])])


def _nmap() -> F.Column:
    return F.create_map(*[x for k, v in NUTRIENT_FIELD_MAP.items() for x in (F.lit(k), F.lit(v))])


# ------------------------------------------------------------------ E-1 classic
def grade_classic(product_name, brand, search_text, flags, item) -> F.Column:
    """E-1 classic 0-3 grade of one hit against one classic judgment row."""
    name = F.lower(F.coalesce(product_name, F.lit("")))
    br = F.lower(F.coalesce(brand, F.lit("")))
    text = F.lower(F.coalesce(search_text, F.lit("")))
    fm = flags_map(flags)
    disallowed = F.exists(F.coalesce(item["disallowed_keywords"], F.array().cast("array<string>")),
                          lambda d: name.contains(F.lower(d)) | text.contains(F.lower(d)))
    flag_fail = F.exists(F.map_entries(F.coalesce(item["required_flags"], F.create_map().cast(
        "map<string,boolean>"))), lambda e: ~F.coalesce(F.try_element_at(fm, e["key"]) == e["value"], F.lit(False)))
    rb = F.lower(item["relevant_brand"])
    brand_fail = (rb.isNotNull() & (rb != "")) & ~br.contains(rb) & ~name.contains(rb)
    kws = F.coalesce(item["relevant_keywords"], F.array().cast("array<string>"))
    matched = F.size(F.filter(kws, lambda k: name.contains(F.lower(k)) | text.contains(F.lower(k))
                              | br.contains(F.lower(k))))
    ratio = matched / F.size(kws)
    all_in_name = F.forall(kws, lambda k: name.contains(F.lower(k)))
    by_kw = (F.when(ratio == 1.0, F.when(all_in_name, 3).otherwise(2))
             .when(ratio >= 0.5, 1).otherwise(0))
    return (F.when(disallowed, 0).when(flag_fail, 0).when(brand_fail, 0)
            .when(F.size(kws) == 0, 3).otherwise(by_kw)).cast("int")


# --------------------------------------------------------------- E-2 .. E-7
def term_pattern(term) -> F.Column:
    """E-2: word-bounded, plural-tolerant pattern for a term column
    ('berry' also matches 'berries', 'oat' also 'oats'; never 'goat')."""
    base = F.lower(term)
    variants = F.array_distinct(F.filter(F.array(
        base,
        F.when(base.endswith("y"), F.concat(F.regexp_replace(base, "y$", ""), F.lit("ies"))),
        F.when(~base.endswith("s"), F.concat(base, F.lit("s"))),
    ), lambda v: v.isNotNull()))
    ordered = F.array_sort(variants, lambda a, b: F.when(F.length(a) > F.length(b), -1).when(
        F.length(a) < F.length(b), 1).otherwise(0))
    alts = F.array_join(F.transform(ordered, lambda v: F.concat(F.lit(r"\Q"), v, F.lit(r"\E"))), "|")
    return F.concat(F.lit("(?<![a-z0-9])(?:"), alts, F.lit(")(?![a-z0-9])"))


def term_present(hay, term) -> F.Column:
    return F.when(term.isNull() | (term == ""), F.lit(False)).otherwise(F.regexp_like(hay, term_pattern(term)))


def grade_structured(product_name, brand, search_text, flags, nutrition, rel) -> F.Column:
    """E-6 structured grade (NULL when the judgment has no relevance block, E-7)."""
    name = F.lower(F.coalesce(product_name, F.lit("")))
    br = F.lower(F.coalesce(brand, F.lit("")))
    text = F.lower(F.coalesce(search_text, F.lit("")))
    scope_default = F.coalesce(rel["excluded_scope"], F.lit("all"))
    excluded = F.exists(F.coalesce(rel["excluded"], F.array().cast("array<struct<term:string,scope:string>>")),
                        lambda ex: term_present(name, ex["term"]) | (
                            (F.coalesce(ex["scope"], scope_default) != "name") & term_present(text, ex["term"])))
    fm = flags_map(flags)
    flag_fail = F.exists(F.map_entries(F.coalesce(rel["required_flags"], F.create_map().cast(
        "map<string,boolean>"))), lambda e: ~F.coalesce(F.try_element_at(fm, e["key"]) == e["value"], F.lit(False)))
    rb = rel["brand"]
    brand_fail = rb.isNotNull() & (rb != "") & ~term_present(br, rb) & ~term_present(name, rb)
    hard = excluded | flag_fail | brand_fail

    scope = F.coalesce(rel["group_scope"], F.lit("anywhere"))
    wide = F.when(scope == "anywhere", text).otherwise(name)
    groups = F.coalesce(rel["required_any"], F.array().cast("array<array<string>>"))
    g_all = F.coalesce(rel["required_all"], F.array().cast("array<string>"))
    in_name = F.exists(groups, lambda g: F.forall(g, lambda t: term_present(name, t)))
    anywhere = (F.exists(groups, lambda g: F.forall(g, lambda t: term_present(wide, t)))
                | ((F.size(g_all) > 0) & F.forall(g_all, lambda t: term_present(
                    F.when(scope != "name", text).otherwise(name), t))))
    partial = F.exists(groups, lambda g: F.exists(g, lambda t: term_present(wide, t)))

    nut = rel["nutrition"]
    key = F.coalesce(F.try_element_at(_nmap(), nut["nutrient"]), nut["nutrient"])
    entry = F.try_element_at(nutrition, key)
    val = F.coalesce(entry["per_100g"], entry["value"])
    op = F.coalesce(nut["operator"], F.lit("gte"))
    target = F.coalesce(nut["value"], F.lit(0.0))
    nut_ok = (F.when(nut.isNull(), F.lit(None).cast("boolean"))
              .when(val.isNull(), F.lit(False))
              .when(op == "gte", val >= target)
              .when(op == "lte", val <= target)
              .otherwise(F.lit(False)))
    has_kw = (F.size(groups) > 0) | (F.size(g_all) > 0)
    optional = F.coalesce(rel["optional"], F.array().cast("array<string>"))
    relative_ok = F.coalesce(nut_ok, F.lit(False)) | (F.size(F.coalesce(rel["required_flags"], F.create_map().cast(
        "map<string,boolean>"))) > 0)
    no_kw = F.when(relative_ok & (F.size(optional) > 0) & F.forall(optional, lambda o: term_present(name, o)),
                   3).otherwise(2)
    graded = (F.when(hard, 0).when(nut_ok == F.lit(False), 0)
              .when(has_kw, F.when(in_name, 3).when(anywhere, 2).when(partial, 1).otherwise(0))
              .otherwise(no_kw))
    parts = [rel[f] for f in ("required_any", "required_all", "optional", "excluded", "excluded_scope", "required_flags", "nutrition",
                              "brand", "group_scope")]
    # a judgment that states nothing grades nothing
    return F.when(rel.isNotNull() & F.greatest(*[p.isNotNull() for p in parts]), graded).cast("int")


# --------------------------------------------------------------- metrics
def query_metrics(graded: DataFrame, judged: DataFrame, k: int = EVAL_K, grade_col: str = "grade",
                  binary: bool = False, compat_mrr: bool = False) -> DataFrame:
    """E-8 .. E-12 per judged query: p5, p10, ndcg, mrr.  ``graded`` has
    (query_id, rank, grade) for the top-k hits; queries without graded hits
    score 0.  ``binary`` uses gain 1 for grade >= 2 (E-10) and has NULL for
    queries without graded hits; ``compat_mrr`` scores rank r
    as 1/(r+1) (E-12)."""
    g = graded.where(F.col(grade_col).isNotNull())
    if binary:
        # NULL grades are dropped before the top-k cut (E-10): re-rank.
        w = Window.partitionBy("query_id").orderBy("rank")
        g = g.withColumn("rank", F.row_number().over(w))
    g = g.where(F.col("rank") <= k)
    rel = (F.col(grade_col) >= 2).cast("int")
    gain = rel.cast("double") if binary else (F.pow(F.lit(2.0), F.col(grade_col)) - 1)
    disc = F.log2(F.col("rank") + 1)
    per = g.groupBy("query_id").agg(
        (F.sum(F.when(F.col("rank") <= 5, rel).otherwise(0)) / 5.0).alias("p5"),
        (F.sum(rel) / float(k)).alias("p10"),
        F.sum(gain / disc).alias("dcg"),
        F.array_sort(F.collect_list(gain), lambda a, b: F.when(a > b, -1).when(a < b, 1).otherwise(0)).alias(
            "gains"),
        F.min(F.when(rel == 1, F.col("rank"))).alias("first_rel"),
    )
    idcg = F.aggregate(F.transform(F.col("gains"), lambda x, i: x / F.log2(i + 2.0)), F.lit(0.0),
                       lambda a, b: a + b)
    per = per.select("query_id", "p5", "p10", F.when(idcg > 0, F.col("dcg") / idcg).otherwise(0.0).alias("ndcg"),
                     (F.when(F.col("first_rel").isNull(), 0.0).otherwise(
                         1.0 / (F.col("first_rel") + (1 if compat_mrr else 0)))).alias("mrr"))
    out = judged.select("query_id", "type").join(per, "query_id", "left")
    return out.select("query_id", "type", *[(F.col(c) if binary else F.coalesce(F.col(c), F.lit(0.0))).alias(c)
                                            for c in ("p5", "p10", "ndcg", "mrr")])


def metrics_by_type(per_query: DataFrame, metrics=("p5", "p10", "ndcg", "mrr")) -> DataFrame:
    """E-13: means per type and overall in one pass (rollup; type NULL = all).
    Sums run in integer micro-units, so the means do not depend on the order
    in which partial sums meet (6 decimals, half-up)."""
    micro = per_query.select("type", *[F.round(F.col(c) * 1000000).cast("bigint").alias(c) for c in metrics])
    m = micro.rollup("type").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in metrics],
                                  *[F.count(c).alias(f"_n_{c}") for c in metrics])
    # a NULL metric is left out of its mean
    return m.select("type", "n", *[(F.floor(F.col(c) / F.nullif(F.col(f"_n_{c}"), F.lit(0)) + 0.5) / 1000000).alias(c)
                                   for c in metrics])


def exact_order_stats(df: DataFrame, group: str, value: str, fractions: dict[str, float],
                      partitions: int | None = None) -> DataFrame:
    """E-14: exact index-picked order statistics per group (sorted[int(f*n)]),
    without gathering a group into one task: a range-partitioned sort spreads
    a hot group over many partitions, per-partition counts (a tiny table)
    give each row its global index, and the wanted indices are filtered."""
    spark = df.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    s = (df.select(group, value).where(F.col(value).isNotNull())
         .repartitionByRange(parts, group, value).withColumn("_pid", F.spark_partition_id()))
    # read by two branches: both must see the same sampled bounds
    ensure_checkpoint_dir(spark)
    s = s.checkpoint(eager=True)
    w_local = Window.partitionBy("_pid", group).orderBy(value)
    s = s.withColumn("_local", F.row_number().over(w_local) - 1)
    counts = s.groupBy("_pid", group).agg(F.count(F.lit(1)).alias("_c"))
    w_off = Window.partitionBy(group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    counts = (counts.withColumn("_off", F.coalesce(F.sum("_c").over(w_off), F.lit(0)))
              .withColumn("_n", F.sum("_c").over(Window.partitionBy(group))))
    # counts has one row per (partition, group): small for few groups, but not
    # bounded by construction, so AQE picks the join from its runtime size.
    idx = s.join(counts, ["_pid", group]).withColumn("_idx", F.col("_off") + F.col("_local"))
    wanted = None
    for name, f in fractions.items():
        hit = F.when(F.col("_idx") == F.floor(F.col("_n") * f), F.col(value))
        col = F.max(hit).alias(name)
        wanted = [col] if wanted is None else wanted + [col]
    return idx.groupBy(group).agg(F.first("_n").alias("n"), *wanted)


def latency_percentiles(latencies: DataFrame, group: str = "kind", value: str = "latency_ms") -> DataFrame:
    """E-14: avg, p50 = sorted[n//2], p95 = sorted[int(0.95 n)] per group."""
    stats = exact_order_stats(latencies, group, value, {"p50": 0.5, "p95": 0.95})
    avgs = latencies.groupBy(group).agg(F.avg(value).alias("avg"))
    return stats.join(avgs, group)


def verify_constraints(hits: DataFrame, docs: DataFrame, cases: DataFrame) -> DataFrame:
    """E-16: every returned hit of a case satisfies its constraint (and, for
    the category cases, mentions the case word).  ``cases(query_id,
    check_kind, needle)``; hits are the top-k (query_id, doc_id, total)."""
    d = docs.select(F.col("id").alias("doc_id"), "product_name", "category", "search_text",
                    F.col("attributes.flags").alias("flags"), F.col("attributes.nutrition").alias("nut"))

    def per100(key):
        return F.try_element_at(F.col("nut"), F.lit(key))["per_100g"]

    kind = F.col("check_kind")
    constraint = (F.when(kind == "min_protein", F.coalesce(per100("proteins") >= 20.0, F.lit(False)))
                  .when(kind == "max_calories", F.coalesce(F.coalesce(per100("energy-kcal"), per100("calories"))
                                                           <= 200.0, F.lit(False)))
                  .when(kind == "low_sugar", F.col("flags.is_low_sugar")
                        | F.coalesce(per100("sugars").between(0.0, 5.0), F.lit(False)))
                  .otherwise(F.col("flags.is_high_protein") | F.coalesce(per100("proteins") >= 10.0, F.lit(False))))
    hay = F.lower(F.concat_ws(" ", "product_name", "category", "search_text"))
    ok = F.when(kind.isin("low_sugar", "high_protein"), constraint & hay.contains(F.col("needle"))).otherwise(
        constraint)
    chk = hits.join(cases, "query_id").join(d, "doc_id").select("query_id", "total", ok.alias("ok"))
    agg = chk.groupBy("query_id").agg(F.first("total").alias("total"), F.count(F.lit(1)).alias("sample_size"),
                                      F.count_if("ok").alias("n_ok"), F.bool_and("ok").alias("passed"))
    out = cases.select("query_id", "check_kind").join(agg, "query_id", "left")
    return out.select("query_id", "check_kind", F.coalesce("total", F.lit(0)).cast("long").alias("total"),
                      F.coalesce("sample_size", F.lit(0)).cast("long").alias("sample_size"),
                      F.coalesce("n_ok", F.lit(0)).cast("long").alias("n_ok"),
                      F.coalesce("passed", F.lit(True)).alias("passed"))


def evidence_records(annotations: DataFrame, hits: DataFrame, classic: DataFrame, structured: DataFrame | None = None) -> DataFrame:
    """E-15: one nested record per phrase: the columns of ``annotations``, the
    ``hits`` (query_id, rank and any further columns, such as both grades, name,
    brand, category and flags; at most k per phrase, so the collected list is
    bounded) and the metrics of one or both graders."""
    cols = ["rank"] + [c for c in hits.columns if c not in ("query_id", "rank")]
    out = annotations.join(hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("hits")), "query_id", "left")
    for name, metrics in (("metrics_classic", classic), ("metrics_structured", structured)):
        if metrics is not None:
            out = out.join(metrics.select("query_id", F.struct("p5", "p10", "ndcg", "mrr").alias(name)), "query_id", "left")
    return out


def write_evidence(records: DataFrame, path: str) -> None:
    """S-16 evidence sink (JSON lines)."""
    records.write.mode("overwrite").json(path)
