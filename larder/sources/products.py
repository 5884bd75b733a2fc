"""Product sources and sinks (S-1 .. S-8, S-13, S-18).

``resolve_products`` takes any DataFrame whose columns drift between the
known naming schemes and returns the fixed raw-product layout; the Parquet
scan underneath keeps column pruning and filter pushdown.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from larder.functions import parse as P
from larder.streaming.table import table_exists

RAW_COLUMNS = ["code", "product_name", "brands", "categories", "ingredients_text", "nutriments",
               "nutriscore_grade", "nova_group", "ecoscore_grade", "completeness"]

# Candidate source names per logical column, first present wins (case-insensitive).
DRIFT = {
    "code": ["code", "id"],
    "product_name": ["product_name_clean", "product_name"],
    "brands": ["brands_clean", "brands", "brand"],
    "categories": ["categories_clean", "categories", "category"],
    "ingredients_text": ["ingredients_clean", "ingredients_text", "ingredients"],
    "nutriments": ["nutriments", "attributes"],
    "nutriscore_grade": ["nutriscore_grade"],
    "nova_group": ["nova_group"],
    "ecoscore_grade": ["ecoscore_grade"],
    "completeness": ["completeness"],
}

CSV_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in RAW_COLUMNS])


def resolve_columns(df: DataFrame) -> DataFrame:
    """S-1: pick, per logical column, the first present source column; absent
    optional columns become NULL.  Output keeps source types."""
    present = {f.name.lower(): f for f in df.schema.fields}
    out = []
    for logical, names in DRIFT.items():
        hit = next((present[n] for n in names if n in present), None)
        if hit is None:
            if logical in ("code", "product_name"):
                raise ValueError(f"no column for {logical} among {names}")
            out.append(F.lit(None).cast("string").alias(logical))
        elif logical == "nutriments" and hit.name.lower() == "attributes":
            # attributes fallback: use its nutrition part, typed or JSON text.
            if isinstance(hit.dataType, T.StructType):
                out.append(F.col(hit.name)["nutrition"].alias(logical))
            else:
                out.append(F.get_json_object(F.col(hit.name), "$.nutrition").alias(logical))
        else:
            out.append(F.col(hit.name).alias(logical))
    return df.select(*out)


def raw_products(df: DataFrame) -> DataFrame:
    """Cleansed raw products (RawProduct layout) from a drift-resolved frame."""
    r = resolve_columns(df)
    types = {f.name: f.dataType for f in r.schema.fields}

    def opt_str(c):
        return F.when(F.col(c).isNotNull(), P.safe_str(c, types[c]))

    r = r.select(
        P.safe_str("code", types["code"]).alias("code"),
        P.safe_str("product_name", types["product_name"]).alias("name_raw"),
        P.safe_strip("brands", types["brands"]).alias("brands"),
        P.safe_strip("categories", types["categories"]).alias("categories"),
        P.safe_str("ingredients_text", types["ingredients_text"]).alias("ing_raw"),
        (F.col("nutriments") if isinstance(types["nutriments"], T.MapType)
         else P.safe_str("nutriments", types["nutriments"])).alias("nut_raw"),
        opt_str("nutriscore_grade").alias("nutriscore_grade"),
        P.safe_int("nova_group").alias("nova_group"),
        opt_str("ecoscore_grade").alias("ecoscore_grade"),
        P.safe_float("completeness").alias("completeness"),
    )
    r = P.with_multilingual(r, "name_raw", "product_name")
    r = P.with_multilingual(r, "ing_raw", "ingredients_text")
    if isinstance(types["nutriments"], T.MapType):
        r = r.withColumn("nutriments", P.sanitize_nutrition(
            F.coalesce(F.col("nut_raw"), F.create_map().cast(P.NUTRITION_TYPE))))
    else:
        r = P.with_nutriments(r, "nut_raw", "nutriments")
    return r.select("code", "product_name", "brands", "categories", "ingredients_text", "nutriments",
                    "nutriscore_grade", "nova_group", "ecoscore_grade", "completeness")


def first_rows(df: DataFrame, limit: int | None) -> DataFrame:
    """S-5: the first ``limit`` rows by code, chosen before anything is parsed: each task keeps ``limit`` rows at most."""
    if limit is None:
        return df
    r = resolve_columns(df)
    types = dict(r.dtypes)
    plain = [c for c in r.columns if not types[c].startswith("map")]
    return r.orderBy(P.safe_str("code", r.schema["code"].dataType), *plain).limit(limit)


def read_parquet_products(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """S-1 on a Parquet path."""
    return raw_products(first_rows(spark.read.parquet(path), limit))


def read_csv_products(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """S-2 / S-3: CSV with an explicit schema (never inferred)."""
    df = (spark.read.schema(CSV_SCHEMA).option("header", True).option("multiLine", True)
          .option("escape", '"').csv(path))
    return raw_products(first_rows(df, limit))


def first_existing(spark: SparkSession, paths: Iterable[str]) -> str:
    """S-4: first readable path of an ordered candidate list."""
    tried = []
    for p in paths:
        tried.append(p)
        try:
            fmt = "csv" if p.lower().endswith(".csv") else "parquet"
            spark.read.format(fmt).load(p).schema  # noqa: B018 - resolves the path only
            return p
        except AnalysisException:
            continue
    raise FileNotFoundError(f"none of the source paths exist: {tried}")


def products_source(spark: SparkSession, paths: Iterable[str], limit: int | None = None) -> DataFrame:
    """S-4 + S-5: read the first existing source; optional row limit (ordered by
    code so that the chosen rows are deterministic)."""
    p = first_existing(spark, paths)
    return (read_csv_products if p.lower().endswith(".csv") else read_parquet_products)(spark, p, limit)


def write_documents(docs: DataFrame, path: str, json_encoded: bool = False, mode: str = "overwrite") -> None:
    """S-7: normalised Parquet sink (native nested types, or JSON-encoded
    attributes/metadata for compatibility).  ``mode='ignore'`` is S-13: for a
    target that is there, no row is derived."""
    if mode == "ignore" and table_exists(docs.sparkSession, path):
        return
    out = docs
    if json_encoded:
        out = docs.withColumn("attributes", F.to_json("attributes")).withColumn("metadata", F.to_json("metadata"))
    out.write.mode(mode).parquet(path)


ATTRIBUTES_TYPE = ("struct<nutrition:map<string,struct<value:double,per_100g:double,unit:string>>,"
                   "flags:struct<is_organic:boolean,is_vegan:boolean,is_vegetarian:boolean,"
                   "is_palm_oil_free:boolean,is_high_protein:boolean,is_low_sugar:boolean,"
                   "is_low_sodium:boolean,is_gluten_free:boolean,is_lactose_free:boolean>>")
METADATA_TYPE = "struct<nutriscore_grade:string,nova_group:int,ecoscore_grade:string,completeness:double>"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """S-8: normalised reader; JSON-encoded attributes/metadata are decoded."""
    df = spark.read.parquet(path)
    types = {f.name: f.dataType for f in df.schema.fields}
    if isinstance(types.get("attributes"), T.StringType):
        df = df.withColumn("attributes", F.from_json("attributes", ATTRIBUTES_TYPE))
    if isinstance(types.get("metadata"), T.StringType):
        df = df.withColumn("metadata", F.from_json("metadata", METADATA_TYPE))
    return df
