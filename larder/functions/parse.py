"""Scalar cleansing and parsing as Column expressions (C-1 .. C-15, S-18).

All of these run inside the JVM (regex, variant and higher-order functions);
no Python code runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.fixed_values import MISSING_NUTRIENT

# Python's str.isspace() set: Unicode White_Space plus the four separators
# U+001C..U+001F.  As a literal character list (for btrim) and as an explicit
# regex class (no (?U) needed, which keeps the matcher on its fast path).
PY_WS_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B))
               + "\u2028\u2029\u202f\u205f\u3000")
_WS_CLASS = (r"[\t\n\x{0b}\x{0c}\r\x{1c}-\x{1f} \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}"
             r"\x{202f}\x{205f}\x{3000}]")

NUTRIENT_STRUCT = T.StructType([
    T.StructField("value", T.DoubleType()),
    T.StructField("per_100g", T.DoubleType()),
    T.StructField("unit", T.StringType()),
])
NUTRITION_TYPE = T.MapType(T.StringType(), NUTRIENT_STRUCT)


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def null_nan(c) -> Column:
    """NaN -> NULL for a double column (NaN compares true with >= in Spark)."""
    c = col_(c)
    return F.when(~F.isnan(c), c)


def py_strip(c) -> Column:
    """Strip leading/trailing whitespace the way Python's str.strip() does
    (a character-set trim, no regex)."""
    return F.btrim(col_(c), F.lit(PY_WS_CHARS))


def collapse_ws(c) -> Column:
    """C-6: collapse whitespace runs into one space, then strip."""
    return py_strip(F.regexp_replace(col_(c), rf"{_WS_CLASS}+", " "))


def safe_str(c, dtype: T.DataType | None = None) -> Column:
    """C-1: NULL (and NaN for floating columns) -> '', else the text form."""
    c = col_(c)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        c = F.when(~F.isnan(c), c)
    return F.coalesce(c.cast("string"), F.lit(""))


def safe_strip(c, dtype: T.DataType | None = None) -> Column:
    """C-2."""
    return py_strip(safe_str(c, dtype))


def to_double(c) -> Column:
    """C-5: number or numeric text -> double, anything else (and NaN) -> NULL.
    The cast alone would also take the suffixes of typed literals ('5d', '1f')."""
    c = col_(c)
    return F.when(~_typed_literal(c.try_cast("string")), null_nan(c.try_cast("double")))


def _typed_literal(text: Column) -> Column:
    return F.coalesce(text.rlike(r"[0-9.][dDfF]\s*$"), F.lit(False))


def safe_float(c) -> Column:
    """C-3: to double else 0.0."""
    return F.coalesce(to_double(c), F.lit(0.0))


def safe_int(c) -> Column:
    """C-4: via double, truncated toward zero, else NULL."""
    return to_double(c).try_cast("int")


# --- C-7 .. C-10 multilingual text ------------------------------------------
_BLOCK = r"\{([^{}]+)\}"
_LANG = r"""(?U)['"]lang['"]\s*:\s*['"]([^'"]*)['"]"""
_TEXT1 = r"""(?sU)['"]text['"]\s*:\s*(['"])(.*?)\1\s*(?:,|$)"""
_TEXT2 = r"""(?sU)['"]text['"]\s*:\s*'(.*)'\s*$"""
_TEXT3 = r"""(?sU)['"]text['"]\s*:\s*"(.*)"\s*$"""
PREFERRED_LANGS = ["en", "main", "fr"]


def multilingual_entries(raw) -> Column:
    """C-7: text like ``[{'lang': 'fr', 'text': '...'} ...]`` -> array<struct<lang,text>>."""
    raw = col_(raw)
    blocks = F.regexp_extract_all(raw, F.lit(_BLOCK), 1)

    def entry(b):
        text = (F.when(b.rlike(_TEXT1), F.regexp_extract(b, _TEXT1, 2))
                .when(b.rlike(_TEXT2), F.regexp_extract(b, _TEXT2, 1))
                .when(b.rlike(_TEXT3), F.regexp_extract(b, _TEXT3, 1)))
        return F.struct(
            F.when(b.rlike(_LANG), F.regexp_extract(b, _LANG, 1)).alias("lang"),
            py_strip(text).alias("text"),
        )

    entries = F.transform(blocks, entry)
    entries = F.filter(entries, lambda e: e["lang"].isNotNull() & e["text"].isNotNull())
    empty = F.array().cast("array<struct<lang:string,text:string>>")
    return F.when(raw.isNull() | (raw == "") | (raw == "[]"), empty).otherwise(entries)


def pick_language(entries, preferred=PREFERRED_LANGS) -> Column:
    """C-8: first entry (list order) whose lang is in the preferred set with a
    non-empty text, else the first non-empty text, else ''."""
    entries = col_(entries)
    pref = F.filter(entries, lambda e: e["lang"].isin(*preferred) & (e["text"] != ""))
    anyt = F.filter(entries, lambda e: e["text"] != "")
    return F.coalesce(F.get(pref, 0)["text"], F.get(anyt, 0)["text"], F.lit(""))


def parse_multilingual_text(raw) -> Column:
    """C-9/C-10: multilingual pick, falling back to the stripped raw text."""
    raw = col_(raw)
    picked = pick_language(multilingual_entries(raw))
    return F.when(picked != "", picked).otherwise(py_strip(raw))


# --- C-11 .. C-14 nutriments ---------------------------------------------------
_NAN_LITERAL = r"(?<=[:\[,\s])NaN(?=\s*[,}\]])"
_NUMERIC_VARIANT = r"^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL.*)$"
_L_NAME = r"""['"]name['"]\s*:\s*['"]([^'"]*)['"]"""
_L_VALUE = r"""['"]value['"]\s*:\s*([^\s,}]+)"""
_L_100G = r"""['"]100g['"]\s*:\s*([^\s,}]+)"""
_L_UNIT = r"""['"]unit['"]\s*:\s*['"]([^'"]*)['"]"""


def _nutrient(value, per_100g, unit) -> Column:
    return F.struct(value.cast("double").alias("value"), per_100g.cast("double").alias("per_100g"),
                    unit.cast("string").alias("unit"))


def _json_entries(obj: Column) -> Column:
    """C-12: map<string,variant> -> nutrition map (numbers, strings and
    booleans stay distinguishable through the VARIANT type)."""
    def number(x, path):
        return F.when(~_typed_literal(F.try_variant_get(x, path, "string")), null_nan(F.try_variant_get(x, path, "double")))

    def entry(_k, x):
        kind = F.schema_of_variant(x)
        is_obj = kind.startswith("OBJECT")
        has_per = F.try_variant_get(x, "$.per_100g", "variant").isNotNull()
        per = F.when(has_per, number(x, "$.per_100g")).otherwise(number(x, "$['100g']"))
        unit = F.try_variant_get(x, "$.unit", "string")
        scalar = null_nan(F.try_variant_get(x, "$", "double"))
        return F.when(is_obj, F.struct(
            number(x, "$.value").alias("value"),
            per.alias("per_100g"),
            F.when(unit != "", unit).alias("unit"),
            F.lit(True).alias("keep"),
        )).otherwise(F.struct(
            scalar.alias("value"), scalar.alias("per_100g"), F.lit(None).cast("string").alias("unit"),
            kind.rlike(_NUMERIC_VARIANT).alias("keep"),
        ))

    parsed = F.map_filter(F.transform_values(obj, entry), lambda _k, v: v["keep"])
    return F.transform_values(parsed, lambda _k, v: _nutrient(v["value"], v["per_100g"], v["unit"]))


def _json_object(text: Column) -> Column:
    """Entries of a JSON object by key.  NaN is null, Infinity a number, the
    last of repeated keys counts.  Where a value itself is not valid, its entry
    alone is lost."""
    clean = F.regexp_replace(F.regexp_replace(text, _NAN_LITERAL, "null"), r"(:\s*-?)Infinity\b", "$11e999")
    typed = F.from_json(clean, "map<string,variant>")
    loose = F.transform_values(F.from_json(clean, "map<string,string>"), lambda _k, v: F.try_parse_json(v))
    entries = F.map_entries(F.coalesce(typed, loose))

    def last_of_keys(entries):
        keys = F.transform(entries, lambda e: e["key"])
        return F.filter(entries, lambda e, i: F.array_position(F.slice(keys, i + 2, F.size(keys)), e["key"]) == 0)

    # as a lambda's variable the entries are parsed once, not once more for each entry
    return F.map_from_entries(F.get(F.transform(F.array(entries), last_of_keys), 0))


def _json_nutriments(text: Column) -> Column:
    """C-12/C-13: JSON object branch."""
    parsed = _json_entries(_json_object(text))
    energy = F.try_element_at(parsed, F.lit("energy"))
    with_alias = F.when(
        F.map_contains_key(parsed, "energy") & ~F.map_contains_key(parsed, "energy-kcal"),
        F.map_concat(parsed, F.create_map(F.lit("energy-kcal"), energy)),
    ).otherwise(parsed)
    return F.coalesce(with_alias, F.create_map().cast(NUTRITION_TYPE))


def _list_number(b: Column, pattern: str) -> Column:
    raw = F.regexp_replace(F.regexp_extract(b, pattern, 1), r"""^['"]+|['"]+$""", "")
    num = F.when(~F.lower(raw).isin("nan", "none", "null"), to_double(raw))
    return F.when(b.rlike(pattern), num)


def _list_records(blocks: Column) -> Column:
    recs = F.transform(blocks, lambda b: F.struct(
        F.when(b.rlike(_L_NAME), F.regexp_extract(b, _L_NAME, 1)).alias("name"),
        _list_number(b, _L_VALUE).alias("value"),
        _list_number(b, _L_100G).alias("per_100g"),
        F.when(b.rlike(_L_UNIT), F.regexp_extract(b, _L_UNIT, 1)).alias("unit"),
    ))
    return F.filter(recs, lambda r: r["name"].isNotNull())


def _list_map(recs: Column) -> Column:
    last = F.filter(recs, lambda r, i: F.size(F.filter(recs, lambda s, j: (j > i) & (s["name"] == r["name"]))) == 0)
    return F.map_from_entries(F.transform(last, lambda r: F.struct(
        r["name"].alias("key"), _nutrient(r["value"], r["per_100g"], r["unit"]).alias("value"))))


def _list_nutriments(text: Column) -> Column:
    """C-14: list-of-blocks branch; a later duplicate name wins."""
    return _list_map(_list_records(F.regexp_extract_all(text, F.lit(_BLOCK), 1)))


def parse_nutriments(raw) -> Column:
    """C-11: '' / '[]' -> {}, text starting with '{' -> JSON branch, else list branch."""
    raw = col_(raw)
    s = F.coalesce(raw, F.lit(""))
    text = py_strip(s)
    empty = F.create_map().cast(NUTRITION_TYPE)
    return (F.when((s == "") | (s == "[]"), empty)
            .when(text.startswith("{"), _json_nutriments(text))
            .otherwise(_list_nutriments(text)))


def nutrient_per_100g(nutrition, key: str) -> Column:
    """C-15: per_100g of a nutrient, absent -> -1.0."""
    entry = F.try_element_at(col_(nutrition), F.lit(key))
    return F.coalesce(entry["per_100g"], F.lit(MISSING_NUTRIENT))


def sanitize_nutrition(nutrition) -> Column:
    """S-18: NaN -> NULL inside the nutrition map."""
    return F.transform_values(col_(nutrition), lambda _k, v: _nutrient(
        null_nan(v["value"]), null_nan(v["per_100g"]), v["unit"]))


# --- staged forms ---------------------------------------------------------------
# Catalyst does not collapse a projection into the next one when that would
# evaluate a non-trivial expression more than once, so materialising the
# intermediate arrays / maps as columns makes each regex / JSON parse run once
# per row.


def with_multilingual(df, src: str, out: str):
    """C-9/C-10 as two projections: entries once, then the pick."""
    tmp = f"__{out}_entries"
    df = df.withColumn(tmp, multilingual_entries(F.col(src)))
    df = df.withColumn(f"__{out}_pick", pick_language(F.col(tmp)))
    pick = F.col(f"__{out}_pick")
    return df.withColumn(out, F.when(pick != "", pick).otherwise(py_strip(F.col(src)))).drop(tmp, f"__{out}_pick")


def with_nutriments(df, src: str, out: str):
    """C-11 .. C-14 as staged projections (same result as ``parse_nutriments``)."""
    p = f"__{out}"
    df = df.withColumn(f"{p}_s", F.coalesce(F.col(src), F.lit("")))
    df = df.withColumn(f"{p}_t", py_strip(F.col(f"{p}_s")))
    s, t = F.col(f"{p}_s"), F.col(f"{p}_t")
    empty_c = (s == "") | (s == "[]")
    is_json = ~empty_c & t.startswith("{")
    is_list = ~empty_c & ~t.startswith("{")
    df = df.withColumn(f"{p}_obj", F.when(is_json, _json_object(t)))
    df = df.withColumn(f"{p}_blocks", F.when(is_list, F.regexp_extract_all(t, F.lit(_BLOCK), 1)))
    df = df.withColumn(f"{p}_jm", _json_entries(F.col(f"{p}_obj")))
    df = df.withColumn(f"{p}_recs", _list_records(F.col(f"{p}_blocks")))
    df = df.withColumn(f"{p}_lm", _list_map(F.col(f"{p}_recs")))
    jm = F.col(f"{p}_jm")
    energy = F.try_element_at(jm, F.lit("energy"))
    with_alias = F.when(F.map_contains_key(jm, "energy") & ~F.map_contains_key(jm, "energy-kcal"),
                        F.map_concat(jm, F.create_map(F.lit("energy-kcal"), energy))).otherwise(jm)
    empty = F.create_map().cast(NUTRITION_TYPE)
    res = (F.when(empty_c, empty).when(is_json, F.coalesce(with_alias, empty))
           .otherwise(F.coalesce(F.col(f"{p}_lm"), empty)))
    df = df.withColumn(out, res)
    return df.drop(*[f"{p}_{x}" for x in ("s", "t", "obj", "blocks", "jm", "recs", "lm")])


def evaluate_once(df, name: str, expr: Column):
    """Add column ``name`` = ``expr`` so that ``expr`` runs once per row even
    when later filters test the column several times.  Without this, a filter
    on a projected column is pushed below the projection with the expression
    inlined into every test.  A one-element generator output is never
    inlined."""
    return df.withColumn(name, F.explode(F.array(expr)))
