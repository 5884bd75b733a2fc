"""Test inputs derived from the driver tables.

There is no product table among the driver tables, so a raw product view is
derived from ``part`` (and, for volume, ``lineitem`` joined to ``part``).  The
expressions are plain SQL accepted by both Spark and DuckDB; the oracle SQL
uses the very same text, so both sides start from identical input rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.operators.joins import spread

PRODUCT_EXPRS = {
    "code": "lpad(cast({key} AS varchar(20)), 13, '0')",
    "product_name": ("CASE WHEN p_partkey % 3 = 0 THEN concat('[{{\"lang\": \"fr\", \"text\": \"pièce ', p_name, "
                     "'\"}} {{\"lang\": \"en\", \"text\": \"', p_name, '\"}}]') ELSE p_name END"),
    "brands": "CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE replace(p_brand, '#', '') END",
    "categories": ("concat(p_type, ', ', CASE p_partkey % 8 WHEN 0 THEN 'Organic foods' WHEN 1 THEN 'Vegan' "
                   "WHEN 2 THEN 'Vegetarian' WHEN 3 THEN 'No sugar added' WHEN 4 THEN 'Low sodium' "
                   "WHEN 5 THEN 'Gluten-free' WHEN 6 THEN 'Dairy free' ELSE 'High protein' END)"),
    "ingredients_text": ("CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE concat(p_name, "
                         "CASE WHEN p_partkey % 4 = 0 THEN ', palm oil' ELSE '' END, "
                         "CASE WHEN p_partkey % 5 = 0 THEN ', soya lecithin' ELSE '' END, "
                         "CASE WHEN p_partkey % 6 = 0 THEN ', probiotic culture' ELSE '' END) END"),
    "nutriments": ("CASE p_partkey % 4 WHEN 0 THEN concat('{{\"energy\": {{\"value\": ', p_size*10, "
                   "', \"per_100g\": ', p_size*10, ', \"unit\": \"kcal\"}}, \"proteins\": {{\"value\": ', p_size, "
                   "', \"100g\": ', p_size, ', \"unit\": \"g\"}}}}') "
                   "WHEN 1 THEN concat('{{\"sugars\": ', p_size % 12, ', \"sodium\": 0.', p_size, ', \"vegan\": true}}') "
                   "WHEN 2 THEN concat('[{{\"name\": \"proteins\", \"value\": ', p_size, ', \"100g\": ', p_size, "
                   "', \"unit\": \"g\"}} {{\"name\": \"sugars\", \"value\": nan, \"100g\": nan, \"unit\": \"g\"}}]') "
                   "ELSE CASE WHEN p_partkey % 8 = 3 THEN '{{not valid json' ELSE '[]' END END"),
    "nutriscore_grade": ("CASE p_size % 5 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'c' WHEN 3 THEN 'd' "
                         "ELSE NULL END"),
    "nova_group": "CASE WHEN p_partkey % 13 = 0 THEN 'unknown' ELSE concat(p_size % 4 + 1, '.0') END",
    "ecoscore_grade": "cast(NULL AS varchar(20))",
    "completeness": ("CASE WHEN p_partkey % 17 = 0 THEN 'n/a' ELSE concat('0.', "
                     "lpad(cast(p_size AS varchar(20)), 2, '0')) END"),
}


def products_raw_select(key: str = "p_partkey") -> list[str]:
    out = []
    for name, expr in PRODUCT_EXPRS.items():
        out.append(f"{expr.format(key=key)} AS {name}")
    return out


def products_raw_sql() -> str:
    """Raw product rows over ``part`` (SQL text, DuckDB and Spark)."""
    return "SELECT " + ", ".join(products_raw_select()) + " FROM part"


def products_volume_sql() -> str:
    """Volume variant: one product per line item, code = orderkey-linenumber."""
    sel = products_raw_select()
    sel[0] = "concat(l_orderkey, '-', l_linenumber) AS code"
    return ("SELECT " + ", ".join(sel) + " FROM lineitem JOIN part ON l_partkey = p_partkey")


# Search phrases derived from part: four templates over distinct part rows.
PHRASES_SQL = (
    "SELECT DISTINCT phrase FROM ("
    "SELECT concat('organic ', p_name) AS phrase FROM part "
    "UNION ALL SELECT concat('palm oil free ', p_name) FROM part "
    "UNION ALL SELECT concat(p_name, ' under 200 calories') FROM part "
    "UNION ALL SELECT concat('by brand ', lower(p_brand)) FROM part) t"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def products_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "part")).selectExpr(*products_raw_select())


def products_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    sel = products_raw_select()
    sel[0] = "concat(l_orderkey, '-', l_linenumber) AS code"
    return li.join(part, F.col("l_partkey") == F.col("p_partkey")).selectExpr(*sel)


def phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct phrases; the phrase text is its own query id."""
    part = table(spark, sf_dir, "part")
    templates = [
        F.concat(F.lit("organic "), "p_name"),
        F.concat(F.lit("palm oil free "), "p_name"),
        F.concat("p_name", F.lit(" under 200 calories")),
        F.concat(F.lit("by brand "), F.lower("p_brand")),
    ]
    out = None
    for t in templates:
        d = part.select(t.alias("phrase"))
        out = d if out is None else out.unionAll(d)
    return out.distinct().select(F.col("phrase").alias("query_id"), F.col("phrase"))


def benchmark_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark passage, whole, as a phrase."""
    b = table(spark, sf_dir, "benchmark")
    words = F.array_join(F.split(F.trim("text"), r"\s+"), " ")
    return b.select(F.col("item_id").cast("string").alias("query_id"), words.alias("phrase"))
