"""DuckDB SQL building blocks for the oracle queries.

These restate the semantics independently in SQL (RE2 regexes, DuckDB JSON
functions, list lambdas) over the same driver tables.  RE2 has no
look-behind and an ASCII ``\\w``/``\\b``, so patterns are spelled out with
explicit classes where that matters.
"""

from __future__ import annotations

from larder.fixed_values import SYNONYM_PAIRS
from larder.plans.fixtures import products_raw_sql

WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def ml_pick(x: str) -> str:
    """Multilingual pick (C-7..C-9) in SQL."""
    blocks = f"regexp_extract_all({x}, '\\{{([^{{}}]+)\\}}', 1)"
    lang = r"""['"]lang['"]\s*:\s*['"]([^'"]*)['"]"""
    t1 = r"""(?s)['"]text['"]\s*:\s*'(.*?)'\s*(?:,|$)"""
    t1b = r"""(?s)['"]text['"]\s*:\s*"(.*?)"\s*(?:,|$)"""
    t2 = r"""(?s)['"]text['"]\s*:\s*'(.*)'\s*$"""
    t3 = r"""(?s)['"]text['"]\s*:\s*"(.*)"\s*$"""

    def q(p):
        return "'" + p.replace("'", "''") + "'"

    # RE2 has no back-references: the same-quote lazy match is split in two,
    # and the earlier match position decides which quote opened the text.
    text = (f"CASE WHEN regexp_matches(b, {q(t1)}) OR regexp_matches(b, {q(t1b)}) THEN "
            f"CASE WHEN NOT regexp_matches(b, {q(t1b)}) THEN regexp_extract(b, {q(t1)}, 1) "
            f"WHEN NOT regexp_matches(b, {q(t1)}) THEN regexp_extract(b, {q(t1b)}, 1) "
            f"WHEN strpos(b, regexp_extract(b, {q(t1)}, 0)) <= strpos(b, regexp_extract(b, {q(t1b)}, 0)) "
            f"THEN regexp_extract(b, {q(t1)}, 1) ELSE regexp_extract(b, {q(t1b)}, 1) END "
            f"WHEN regexp_matches(b, {q(t2)}) THEN regexp_extract(b, {q(t2)}, 1) "
            f"WHEN regexp_matches(b, {q(t3)}) THEN regexp_extract(b, {q(t3)}, 1) END")
    entries = (f"list_filter(list_transform({blocks}, lambda b: {{'lang': CASE WHEN regexp_matches(b, {q(lang)}) "
               f"THEN regexp_extract(b, {q(lang)}, 1) END, 'text': {strip(text)}}}), "
               f"lambda e: e.lang IS NOT NULL AND e.text IS NOT NULL)")
    pref = f"list_filter({entries}, lambda e: e.lang IN ('en','main','fr') AND e.text <> '')"
    anyt = f"list_filter({entries}, lambda e: e.text <> '')"
    picked = f"coalesce(({pref})[1].text, ({anyt})[1].text, '')"
    picked = f"CASE WHEN {x} = '' OR {x} = '[]' THEN '' ELSE {picked} END"
    return f"CASE WHEN {picked} <> '' THEN {picked} ELSE {strip(x)} END"


def canon(x: str) -> str:
    out = x
    for head, var in SYNONYM_PAIRS:
        alts = "|".join(sorted({head, var}, key=len, reverse=True))
        out = f"regexp_replace({out}, '\\b(?:{alts})\\b', '{head}', 'gi')"
    return out


def raw_products_sql(src_sql: str | None = None) -> str:
    """Cleansed raw products without the nutriments map (scalar columns)."""
    src = src_sql or products_raw_sql()
    return f"""
    SELECT coalesce(cast(code AS varchar), '') AS code,
           {ml_pick("coalesce(cast(product_name AS varchar), '')")} AS product_name,
           {strip("coalesce(cast(brands AS varchar), '')")} AS brands,
           {strip("coalesce(cast(categories AS varchar), '')")} AS categories,
           {ml_pick("coalesce(cast(ingredients_text AS varchar), '')")} AS ingredients_text,
           coalesce(cast(nutriments AS varchar), '') AS nutriments_raw,
           cast(nutriscore_grade AS varchar) AS nutriscore_grade,
           cast(trunc(CASE WHEN isnan(try_cast(nova_group AS double)) THEN NULL
                           ELSE try_cast(nova_group AS double) END) AS integer) AS nova_group,
           cast(ecoscore_grade AS varchar) AS ecoscore_grade,
           coalesce(CASE WHEN isnan(try_cast(completeness AS double)) THEN NULL
                         ELSE try_cast(completeness AS double) END, 0.0) AS completeness
    FROM ({src}) src
    """


def nutriments_long_sql(src_sql: str, key: str = "code", raw: str = "nutriments_raw") -> str:
    """Long-form nutriments (key, nutrient, value, per_100g, unit) from a
    relation with a key column and raw nutriment text."""
    j = (f"regexp_replace(t, '([:\\[,\\s])NaN(\\s*[,}}\\]])', '\\1null\\2', 'g')")
    return f"""
    WITH base AS (SELECT {key} AS k, {raw} AS s, {strip(raw)} AS t FROM ({src_sql}) b0),
    js AS (SELECT k, {j} AS jt FROM base WHERE s <> '' AND s <> '[]' AND starts_with(t, '{{')),
    jv AS (SELECT k, jt FROM js WHERE json_valid(jt) AND json_type(jt) = 'OBJECT'),
    jk AS (SELECT k, jt, unnest(json_keys(jt)) AS nutrient FROM jv),
    je AS (SELECT k, nutrient, json_extract(jt, '$."' || nutrient || '"') AS e FROM jk),
    jr AS (
      SELECT k, nutrient,
        CASE WHEN json_type(e) = 'OBJECT' THEN try_cast(json_extract_string(e, '$.value') AS double)
             ELSE try_cast(json_extract_string(e, '$') AS double) END AS value,
        CASE WHEN json_type(e) = 'OBJECT' THEN
               CASE WHEN json_exists(e, '$.per_100g') THEN try_cast(json_extract_string(e, '$.per_100g') AS double)
                    ELSE try_cast(json_extract_string(e, '$."100g"') AS double) END
             ELSE try_cast(json_extract_string(e, '$') AS double) END AS per_100g,
        CASE WHEN json_type(e) = 'OBJECT' THEN nullif(json_extract_string(e, '$.unit'), '') END AS unit
      FROM je WHERE json_type(e) IN ('OBJECT', 'BIGINT', 'UBIGINT', 'DOUBLE')),
    jall AS (
      SELECT * FROM jr
      UNION ALL
      SELECT k, 'energy-kcal', value, per_100g, unit FROM jr a
      WHERE nutrient = 'energy' AND NOT EXISTS (
        SELECT 1 FROM jr b WHERE b.k = a.k AND b.nutrient = 'energy-kcal')),
    lb AS (SELECT k, unnest(regexp_extract_all(t, '\\{{([^{{}}]+)\\}}', 1)) AS b,
                  generate_subscripts(regexp_extract_all(t, '\\{{([^{{}}]+)\\}}', 1), 1) AS i
           FROM base WHERE s <> '' AND s <> '[]' AND NOT starts_with(t, '{{')),
    lr AS (
      SELECT k, i,
        regexp_extract(b, '[''"]name[''"]\\s*:\\s*[''"]([^''"]*)[''"]', 1) AS nutrient,
        CASE WHEN regexp_matches(b, '[''"]name[''"]\\s*:\\s*[''"]([^''"]*)[''"]') THEN 1 END AS ok,
        CASE WHEN regexp_matches(b, '[''"]value[''"]\\s*:\\s*([^\\s,}}]+)') THEN
          trim(regexp_extract(b, '[''"]value[''"]\\s*:\\s*([^\\s,}}]+)', 1), '''"') END AS v,
        CASE WHEN regexp_matches(b, '[''"]100g[''"]\\s*:\\s*([^\\s,}}]+)') THEN
          trim(regexp_extract(b, '[''"]100g[''"]\\s*:\\s*([^\\s,}}]+)', 1), '''"') END AS g,
        CASE WHEN regexp_matches(b, '[''"]unit[''"]\\s*:\\s*[''"]([^''"]*)[''"]') THEN
          regexp_extract(b, '[''"]unit[''"]\\s*:\\s*[''"]([^''"]*)[''"]', 1) END AS unit
      FROM lb),
    ll AS (
      SELECT k, nutrient,
        CASE WHEN lower(v) IN ('nan', 'none', 'null') THEN NULL ELSE try_cast(v AS double) END AS value,
        CASE WHEN lower(g) IN ('nan', 'none', 'null') THEN NULL ELSE try_cast(g AS double) END AS per_100g,
        unit
      FROM (SELECT *, row_number() OVER (PARTITION BY k, nutrient ORDER BY i DESC) AS rn FROM lr WHERE ok = 1)
      WHERE rn = 1)
    SELECT k AS {key}, nutrient,
           CASE WHEN isnan(value) THEN NULL ELSE round(value, 6) END AS value,
           CASE WHEN isnan(per_100g) THEN NULL ELSE round(per_100g, 6) END AS per_100g, unit
    FROM (SELECT * FROM jall UNION ALL SELECT * FROM ll)
    """


def docs_sql(src_sql: str | None = None) -> str:
    """Documents with flags (scalar columns) over raw products."""
    rp = raw_products_sql(src_sql)
    nl = nutriments_long_sql("SELECT code, nutriments_raw FROM rp")
    return f"""
    WITH rp AS ({rp}),
    nl AS ({nl}),
    nut AS (SELECT code,
              max(CASE WHEN nutrient = 'proteins' THEN per_100g END) AS proteins,
              max(CASE WHEN nutrient = 'sugars' THEN per_100g END) AS sugars,
              max(CASE WHEN nutrient = 'sodium' THEN per_100g END) AS sodium,
              count(*) AS n_nutrients
            FROM nl GROUP BY code),
    d AS (
      SELECT rp.*, lower(categories) AS cat, lower(ingredients_text) AS ing,
             coalesce(nut.proteins, -1.0) AS proteins, coalesce(nut.sugars, -1.0) AS sugars,
             coalesce(nut.sodium, -1.0) AS sodium, coalesce(nut.n_nutrients, 0) AS n_nutrients
      FROM rp LEFT JOIN nut USING (code))
    SELECT code AS id, product_name, nullif(brands, '') AS brand, nullif(categories, '') AS category,
      nullif(ingredients_text, '') AS ingredients, completeness, n_nutrients,
      concat_ws(' ', nullif(product_name, ''), nullif(brands, ''), nullif(categories, ''),
                nullif(ingredients_text, '')) AS search_text,
      concat_ws(chr(10) || chr(10),
        CASE WHEN product_name <> '' THEN 'Product: ' || product_name END,
        CASE WHEN brands <> '' THEN 'Brand: ' || brands END,
        CASE WHEN categories <> '' THEN 'Category: ' || categories END,
        CASE WHEN ingredients_text <> '' THEN 'Ingredients:' || chr(10) || ingredients_text END) AS semantic_document,
      (contains(cat, 'organic') OR contains(ing, 'organic') OR contains(cat, 'bio') OR contains(ing, 'bio')) AS is_organic,
      (contains(cat, 'vegan') OR contains(ing, 'vegan')) AS is_vegan,
      (contains(cat, 'vegetarian') OR contains(ing, 'vegetarian') OR contains(cat, 'vegan') OR contains(ing, 'vegan'))
        AS is_vegetarian,
      NOT contains(ing, 'palm oil') AS is_palm_oil_free,
      (contains(cat, 'high protein') OR proteins >= 10.0) AS is_high_protein,
      (contains(cat, 'low sugar') OR contains(cat, 'sugar free') OR contains(cat, 'no sugar')
        OR (sugars >= 0 AND sugars <= 5.0)) AS is_low_sugar,
      (contains(cat, 'low sodium') OR contains(cat, 'low salt') OR (sodium >= 0 AND sodium <= 0.12)) AS is_low_sodium,
      (contains(cat, 'gluten free') OR contains(cat, 'gluten-free') OR contains(cat, 'sans gluten')) AS is_gluten_free,
      (contains(cat, 'lactose free') OR contains(cat, 'dairy free') OR contains(cat, 'sans lactose')) AS is_lactose_free
    FROM d
    """


def normalize(x: str) -> str:
    """Q-1 in SQL."""
    keep = WS[1:-1]
    return strip(f"regexp_replace(regexp_replace(lower(coalesce({x}, '')), '[^\\p{{L}}\\p{{N}}_{keep}\\-]', '', 'g'), "
                 f"'{WS}+', ' ', 'g')")


# ------------------------------------------------------------------ annotation
from larder.fixed_values import (  # noqa: E402
    AND_MATCH_BOOST as AND_BOOST_V,
    BM25_B,
    BM25_K1,
    FUZZY_BOOST as FUZZY_BOOST_V,
    MODIFIER_BOOST as MODIFIER_BOOST_V,
    PALM_OIL_FREE_BOOST as PALM_BOOST_V,
    PHRASE_BOOST as PHRASE_BOOST_V,
    ALLERGENS,
    ALWAYS_INCLUDE_INGREDIENTS,
    BRAND_INTENT_PATTERNS,
    CATEGORY_INTENT_PATTERN,
    COUNTRIES,
    DICTIONARY_TOP,
    DIETARY_PATTERNS,
    ENTITY_KINDS,
    EXPLICIT_BRAND_PATTERNS,
    FILTER_KEYS,
    INGREDIENT_INTENT_PATTERN,
    MODIFIER_PATTERN,
    NUMERIC_PATTERNS,
    NUTRIENT_FIELD_MAP,
    NUTRITION_TERMS,
    RECIPE_QTY_PATTERN,
    SUSTAINABILITY_LABELS,
)


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_list(items) -> str:
    return "[" + ", ".join(q(x) for x in items) + "]"


def clean_piece(x: str) -> str:
    s = f"lower({strip(x)})"
    s = f"regexp_replace({s}, '{WS}*\\([^)]*\\)', '', 'g')"
    s = f"regexp_replace({s}, '{WS}*en:[a-z0-9\\-]+', '', 'g')"
    s = f"regexp_replace({s}, '[^a-z0-9{WS[1:-1]}\\-%&'']+', '', 'g')"
    s = strip(f"regexp_replace({s}, '{WS}+', ' ', 'g')")
    return (f"CASE WHEN {s} = '' OR length({s}) > 48 OR {s} IN ('null', 'none', 'nan') THEN NULL ELSE {s} END")


def dictionary_topk_sql(raw_sql: str | None = None, by_code: bool = False) -> str:
    """Ties by term, or by the first row (of ``code``) and piece that hold it."""
    rp = raw_products_sql(raw_sql)
    caps = " ".join(f"WHEN {q(k)} THEN {v}" for k, v in DICTIONARY_TOP.items())
    return f"""
    WITH rp AS ({rp}),
    pieces AS (
      SELECT 'brands' AS kind, code, unnest(string_split(brands, ',')) AS piece, generate_subscripts(string_split(brands, ','), 1) AS i FROM rp
      UNION ALL SELECT 'categories', code, unnest(string_split(categories, ',')), generate_subscripts(string_split(categories, ','), 1) FROM rp
      UNION ALL SELECT 'ingredients', code, unnest(string_split(ingredients_text, ',')),
             generate_subscripts(string_split(ingredients_text, ','), 1) FROM rp),
    cleaned AS (SELECT kind, code, i, {clean_piece('piece')} AS term FROM pieces),
    counts AS (SELECT kind, term, count(*) AS n, min({{'code': code, 'i': i}}) AS first FROM cleaned WHERE term IS NOT NULL GROUP BY kind, term),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, {'first' if by_code else 'term'}) AS rank FROM counts)
    SELECT kind, term, n, rank FROM ranked WHERE rank <= CASE kind {caps} END
    """


def dictionary_sql(raw_sql: str | None = None) -> str:
    """(term, kind, priority, in_categories, in_ingredients)."""
    static = []
    for kind, words in (("allergens", ALLERGENS), ("sustainability_labels", SUSTAINABILITY_LABELS),
                        ("nutrition", NUTRITION_TERMS), ("countries", COUNTRIES)):
        static += [f"SELECT {q(w)} AS term, {q(kind)} AS kind" for w in words]
    always = " UNION ALL ".join(f"SELECT {q(w)} AS term" for w in ALWAYS_INCLUDE_INGREDIENTS)
    prio = " ".join(f"WHEN {q(k)} THEN {i + 1}" for i, k in enumerate(ENTITY_KINDS))
    kinds = " ".join(f"WHEN {i + 1} THEN {q(k)}" for i, k in enumerate(ENTITY_KINDS))
    return f"""
    WITH built AS (SELECT term, kind FROM ({dictionary_topk_sql(raw_sql)})),
    extra AS (SELECT term, 'ingredients' AS kind FROM ({always}) a
              WHERE term NOT IN (SELECT term FROM built WHERE kind = 'ingredients')),
    every AS (SELECT * FROM built UNION ALL SELECT * FROM extra UNION ALL {' UNION ALL '.join(static)}),
    best AS (SELECT term, min(CASE kind {prio} END) AS priority, bool_or(kind = 'categories') AS in_categories,
                    bool_or(kind = 'ingredients') AS in_ingredients FROM every GROUP BY term)
    SELECT term, CASE priority {kinds} END AS kind, priority, in_categories, in_ingredients FROM best
    """


def _expl(field: str, text: str) -> str:
    return f"{{'field': {q(field)}, 'explanation': {text}}}"


def annotate_sql(phrases_sql: str, dict_sql: str) -> str:
    """Full phrase annotation (Q-1 .. Q-19) as SQL; one row per query_id."""
    ctes = [f"ph AS ({phrases_sql})",
            f"dict AS ({dict_sql})",
            f"n0 AS (SELECT query_id, phrase, {canon(normalize('phrase'))} AS nq FROM ph)"]
    mod = f"regexp_extract_all(nq, {q(MODIFIER_PATTERN)}, 0)"
    ctes.append(f"n1 AS (SELECT *, list_filter({mod}, lambda x, i: list_position({mod}, x) = i) AS modifiers FROM n0)")
    ctes.append("n2 AS (SELECT *, nq AS t, list_transform(modifiers, lambda m: "
                + _expl("modifiers", "'Extracted modifier ''' || m || ''''") + ") AS expl, "
                "[]::STRUCT(nutrient VARCHAR, operator VARCHAR, value DOUBLE, unit VARCHAR, "
                "comparison_basis VARCHAR)[] AS numeric_filters FROM n1)")
    prev = "n2"
    for i, (pat, op) in enumerate(NUMERIC_PATTERNS):
        p = q(pat)
        items = (f"list_transform(range(1, len(regexp_extract_all(t, {p}, 0)) + 1), lambda i: "
                 f"{{'nutrient': coalesce(nullif(regexp_extract_all(t, {p}, 3)[i], ''), regexp_extract_all(t, {p}, 2)[i]), "
                 f"'operator': {q(op)}, 'value': cast(regexp_extract_all(t, {p}, 1)[i] AS double), "
                 f"'unit': regexp_extract_all(t, {p}, 2)[i], 'comparison_basis': 'per_100g'}})")
        ctes.append(f"u{i}a AS (SELECT *, {items} AS items, regexp_extract_all(t, {p}, 0) AS ms FROM {prev})")
        ctes.append(
            f"u{i} AS (SELECT * EXCLUDE (items, ms, t, expl, numeric_filters), "
            f"list_concat(numeric_filters, items) AS numeric_filters, "
            f"list_concat(expl, list_transform(items, lambda x: "
            + _expl("numeric", "'Numeric constraint: ' || x.nutrient || ' ' || x.operator || ' ' || "
                               "cast(x.value AS varchar) || x.unit") + ")) AS expl, "
            f"list_reduce(ms, lambda acc, m: trim(replace(acc, m, ' ')), t) AS t FROM u{i}a)")
        prev = f"u{i}"
    p = q(RECIPE_QTY_PATTERN)
    val = ("CASE WHEN contains(z.v, '/') THEN CASE WHEN cast(split_part(z.v, '/', 2) AS double) <> 0 THEN "
           "cast(split_part(z.v, '/', 1) AS double) / cast(split_part(z.v, '/', 2) AS double) ELSE 0.0 END "
           "ELSE cast(z.v AS double) END")
    ctes.append(
        f"r0 AS (SELECT *, list_transform(range(1, len(regexp_extract_all(t, {p}, 0)) + 1), lambda i: "
        f"{{'raw': regexp_extract_all(t, {p}, 0)[i], 'v': regexp_extract_all(t, {p}, 1)[i], "
        f"'unit': regexp_extract_all(t, {p}, 2)[i]}}) AS rq0, regexp_extract_all(t, {p}, 0) AS ms FROM {prev})")
    ctes.append(
        "r1 AS (SELECT * EXCLUDE (rq0, ms, t, expl), list_transform(rq0, lambda z: {'raw': z.raw, 'value': "
        + val + ", 'unit': z.unit}) AS recipe_quantities, "
        "list_concat(expl, list_transform(rq0, lambda z: "
        + _expl("recipe_quantity", "'Extracted recipe quantity: ' || z.raw || ' (separated from product "
                                   "retrieval term)'") + ")) AS expl, "
        "list_reduce(ms, lambda acc, m: trim(replace(acc, m, ' ')), t) AS t FROM r0)")
    prev = "r1"
    filt_init = ", ".join(f"NULL::BOOLEAN AS f_{k}" for k in FILTER_KEYS)
    ctes.append(f"d0 AS (SELECT *, {filt_init} FROM {prev})")
    prev = "d0"
    for i, (pat, key, value, explanation) in enumerate(DIETARY_PATTERNS):
        p = q(pat)
        ctes.append(f"d{i + 1}h AS (SELECT *, (f_{key} IS NULL AND regexp_matches(t, {p})) AS h, "
                    f"trim(regexp_replace(t, {p}, '', 'g')) AS red FROM {prev})")
        ctes.append(
            f"d{i + 1} AS (SELECT * EXCLUDE (h, red, f_{key}, t, expl), "
            f"CASE WHEN h THEN {'true' if value else 'false'} ELSE f_{key} END AS f_{key}, "
            f"CASE WHEN h AND red <> '' THEN red ELSE t END AS t, "
            f"CASE WHEN h THEN list_append(expl, {_expl(key, q(explanation))}) ELSE expl END AS expl "
            f"FROM d{i + 1}h)")
        prev = f"d{i + 1}"
    brand_any = " OR ".join(f"regexp_matches(cq, {q(p)})" for p in BRAND_INTENT_PATTERNS)
    ctes.append(f"c0 AS (SELECT * EXCLUDE (t), regexp_replace(trim(t), ' +', ' ', 'g') AS cq FROM {prev})")
    ctes.append(
        f"c1 AS (SELECT *, CASE WHEN {brand_any} THEN 'brand_search' "
        f"WHEN regexp_matches(cq, {q(CATEGORY_INTENT_PATTERN)}) THEN 'category_browse' "
        f"WHEN regexp_matches(cq, {q(INGREDIENT_INTENT_PATTERN)}) THEN 'ingredient_search' "
        f"ELSE 'generic_search' END AS intent, "
        f"CASE WHEN cq = '' THEN []::VARCHAR[] ELSE string_split(cq, ' ') END AS toks FROM c0)")
    eb = "CASE " + " ".join(
        f"WHEN regexp_matches(cq, {q(p)}) THEN nullif(trim(regexp_extract(cq, {q(p)}, 1)), '')"
        for p in EXPLICIT_BRAND_PATTERNS) + " END"
    ctes.append(f"c2 AS (SELECT *, CASE WHEN intent = 'brand_search' THEN {eb} END AS explicit_brand FROM c1)")
    ng = ("list_sort(flatten(list_transform(range(1, least(4, len(toks)) + 1), lambda n: "
          "list_transform(range(0, len(toks) - n + 1), lambda i: "
          "{'neg_len': -length(array_to_string(toks[i + 1:i + n], ' ')), 'n': n, 'pos': i, "
          "'text': array_to_string(toks[i + 1:i + n], ' ')}))))")
    ctes.append(f"g0 AS (SELECT query_id, toks, unnest({ng}) AS g, generate_subscripts({ng}, 1) AS idx FROM c2)")
    ctes.append("g1 AS (SELECT g0.query_id, any_value(g0.toks) AS toks, list({'idx': idx, 'text': g.text, 'n': g.n, "
                "'kind': dict.kind} ORDER BY idx) AS cands FROM g0 JOIN dict ON g.text = dict.term "
                "GROUP BY g0.query_id)")
    step = ("list_reduce(cands, lambda acc, c: CASE WHEN list_filter(range(0, len(toks) - c.n + 1), lambda i: "
            "array_to_string(toks[i + 1:i + c.n], ' ') = c.text AND NOT list_has_any(acc.used, range(i, i + c.n)))[1] "
            "IS NULL THEN acc ELSE {'used': list_concat(acc.used, range(list_filter(range(0, len(toks) - c.n + 1), "
            "lambda i: array_to_string(toks[i + 1:i + c.n], ' ') = c.text AND NOT list_has_any(acc.used, "
            "range(i, i + c.n)))[1], list_filter(range(0, len(toks) - c.n + 1), lambda i: "
            "array_to_string(toks[i + 1:i + c.n], ' ') = c.text AND NOT list_has_any(acc.used, range(i, i + c.n)))[1] "
            "+ c.n)), 'out': list_append(acc.out, {'kind': c.kind, 'value': c.text})} END, "
            "{'used': []::BIGINT[], 'out': []::STRUCT(kind VARCHAR, value VARCHAR)[]})")
    ctes.append(f"g2 AS (SELECT query_id, {step}.out AS matched FROM g1)")
    ctes.append("a AS (SELECT c2.*, coalesce(g2.matched, []::STRUCT(kind VARCHAR, value VARCHAR)[]) AS matched "
                "FROM c2 LEFT JOIN g2 USING (query_id))")
    return "WITH " + ",\n".join(ctes) + "\nSELECT * FROM a"


def kind_values(kind: str, override: str | None = None) -> str:
    vals = f"list_transform(list_filter(matched, lambda m: m.kind = {q(kind)}), lambda m: m.value)"
    if kind == "brands":
        vals = (f"list_concat(CASE WHEN explicit_brand IS NOT NULL THEN [explicit_brand] ELSE []::VARCHAR[] END, "
                f"{vals})")
    if override:
        vals = f"list_concat({vals}, CASE WHEN {override} IS NOT NULL THEN [{override}] ELSE []::VARCHAR[] END)"
    return vals


def requests_sql(ann: str, dict_sql: str, overrides_sql: str | None = None) -> str:
    """Filter derivation (D-1 .. D-11) over annotate_sql output; optional
    overrides(query_id, brand, category, ingredients, <filter keys>)."""
    if overrides_sql:
        keys = ", ".join(f"coalesce(ov.o_{k}, a0.f_{k}) AS f_{k}" for k in FILTER_KEYS)
        excl = ", ".join(f"f_{k}" for k in FILTER_KEYS)
        ann = (f"SELECT a0.* EXCLUDE ({excl}), {keys}, ov.o_brand, ov.o_category, ov.o_ingredients "
               f"FROM ({ann}) a0 LEFT JOIN ({overrides_sql}) ov USING (query_id)")
        ob, oc, oi = "o_brand", "o_category", "o_ingredients"
    else:
        ob = oc = oi = None
    brands = kind_values("brands", ob)
    b0 = f"({brands})[1]"
    stripped = (f"trim(regexp_replace(regexp_replace(' ' || text_term || ' ', "
                f"'([^a-z0-9])' || regexp_escape({b0}) || '([^a-z0-9])', '\\1 \\2', 'g'), '\\s+', ' ', 'g'))")
    flags = {"is_palm_oil_free": "NOT f_palm_oil"}
    for k in FILTER_KEYS:
        if k != "palm_oil":
            flags[f"is_{k}"] = f"f_{k}"
    flag_cols = ", ".join(f"{v} AS {k}" for k, v in flags.items())
    return f"""
    WITH ann AS ({ann}), dict2 AS ({dict_sql}),
    b AS (SELECT ann.*, cq AS text_term, {b0} AS b0, {stripped} AS remaining,
                 coalesce((SELECT in_categories OR in_ingredients FROM dict2 WHERE term = lower({b0})), false) AS amb
          FROM ann),
    r AS (SELECT *,
      CASE WHEN intent = 'brand_search' OR {ob or 'NULL'} IS NOT NULL THEN b0
           WHEN b0 IS NOT NULL AND intent = 'generic_search' AND NOT amb AND text_term <> '' AND remaining <> ''
           THEN b0 END AS brand_f,
      (intent = 'generic_search' AND {ob or 'NULL'} IS NULL AND b0 IS NOT NULL AND NOT amb AND text_term <> ''
       AND remaining <> '') AS promoted
      FROM b)
    SELECT query_id, intent,
      CASE WHEN intent IN ('brand_search', 'category_browse', 'ingredient_search') THEN ''
           WHEN promoted THEN remaining ELSE text_term END AS text,
      nullif(trim(brand_f), '') AS brand_f,
      nullif(trim(CASE WHEN intent = 'category_browse' OR {oc or 'NULL'} IS NOT NULL
           THEN ({kind_values('categories', oc)})[1] END), '') AS category_f,
      nullif(trim(CASE WHEN intent = 'ingredient_search' OR {oi or 'NULL'} IS NOT NULL
           THEN ({kind_values('ingredients', oi)})[1] END), '') AS ingredients_f,
      {flag_cols}, numeric_filters, modifiers
    FROM r
    """


def nutrient_key(x: str) -> str:
    cases = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in NUTRIENT_FIELD_MAP.items())
    return f"CASE {x} {cases} ELSE {x} END"


def variants_sql(t: str) -> str:
    parts = [t]
    for a, b in SYNONYM_PAIRS:
        parts.append(f"CASE WHEN {t} = {q(a)} THEN {q(b)} WHEN {t} = {q(b)} THEN {q(a)} END")
    return "list_filter([" + ", ".join(parts) + "], lambda v: v IS NOT NULL)"


def search_docs_sql(src_sql: str | None = None) -> str:
    """Documents with lower / canonical fields, flags and a nutrient list."""
    rp = raw_products_sql(src_sql)
    nl = nutriments_long_sql("SELECT code, nutriments_raw FROM rp")
    return f"""
    WITH rp AS ({rp}), nl AS ({nl}),
    nut AS (SELECT code, list({{'k': nutrient, 'p': per_100g, 'v': value}}) AS nuts FROM nl GROUP BY code),
    d AS ({docs_sql(src_sql)})
    SELECT d.*, coalesce(nut.nuts, []) AS nuts,
      lower(coalesce(product_name, '')) AS name_l, lower(coalesce(brand, '')) AS brand_l,
      lower(coalesce(category, '')) AS cat_l, lower(coalesce(ingredients, '')) AS ing_l,
      lower(coalesce(search_text, '')) AS text_l,
      {canon("lower(coalesce(product_name, ''))")} AS name_c, {canon("lower(coalesce(brand, ''))")} AS brand_c,
      {canon("lower(coalesce(category, ''))")} AS cat_c, {canon("lower(coalesce(ingredients, ''))")} AS ing_c,
      {canon("lower(coalesce(search_text, ''))")} AS text_c
    FROM d LEFT JOIN nut ON nut.code = d.id
    """


def scored_sql(req_sql: str, docs: str) -> str:
    """Reference tiered scoring of every (request, document) pair (the oracle
    may enumerate pairs; the Spark plan never does)."""
    from larder.fixed_values import FLAG_NAMES
    toks = "list_filter(string_split(lower(text), ' '), lambda t: length(t) > 1)"
    fields = ["name_l", "brand_l", "cat_l", "ing_l", "text_l"]
    cand = (f"(text = '' OR len({toks}) = 0 OR list_bool_or(list_transform(flatten(list_transform({toks}, "
            f"lambda t: {variants_sql('t')})), lambda v: " + " OR ".join(f"contains({f}, v)" for f in fields) + ")))")
    flag_ok = " AND ".join(f"(r.{f} IS NULL OR d.{f} = r.{f})" for f in FLAG_NAMES)
    num_ok = ("coalesce(list_bool_and(list_transform(numeric_filters, lambda nf: coalesce(CASE WHEN nf.operator = 'gte' THEN "
              f"(list_filter(nuts, lambda e: e.k = {nutrient_key('nf.nutrient')})[1].p) >= nf.value "
              "WHEN nf.operator = 'lte' THEN "
              f"(list_filter(nuts, lambda e: e.k = {nutrient_key('nf.nutrient')})[1].p) <= nf.value "
              "ELSE true END, false))), true)")
    best = ("list_transform(" + toks + ", lambda t: greatest(CASE WHEN contains(name_c, t) THEN 3.0 ELSE 0.0 END, "
            "CASE WHEN contains(brand_c, t) THEN 2.0 ELSE 0.0 END, CASE WHEN contains(cat_c, t) THEN 1.5 ELSE 0.0 END, "
            "CASE WHEN contains(ing_c, t) THEN 1.2 ELSE 0.0 END, CASE WHEN contains(text_c, t) THEN 1.0 ELSE 0.0 END))")
    phrase = ("CASE WHEN contains(name_c, lower(text)) THEN 30.0 WHEN contains(brand_c, lower(text)) THEN 20.0 "
              "WHEN contains(cat_c, lower(text)) THEN 15.0 WHEN contains(text_c, lower(text)) THEN 10.0 ELSE 0.0 END")
    return f"""
    WITH req AS ({req_sql}), docs AS ({docs}),
    p AS (SELECT r.query_id, r.text, r.modifiers, r.numeric_filters, d.*
          FROM req r, docs d
          WHERE (r.brand_f IS NULL OR contains(d.brand_l, lower(r.brand_f)))
            AND (r.category_f IS NULL OR contains(d.cat_l, lower(r.category_f)))
            AND (r.ingredients_f IS NULL OR contains(d.ing_l, lower(r.ingredients_f)))
            AND {flag_ok}),
    c AS (SELECT *, {best} AS best FROM p WHERE {cand} AND {num_ok}),
    s0 AS (SELECT *, list_reduce(best, lambda acc, b: acc + b * 2.0, {phrase})
                     + CASE WHEN len(best) > 0 AND len(list_filter(best, lambda b: b > 0)) = len(best) THEN 5.0
                            ELSE 0.0 END AS s FROM c),
    s1 AS (SELECT query_id, id AS doc_id, completeness,
             list_reduce(modifiers, lambda acc, m: acc + CASE WHEN contains(name_c, lower(m)) THEN 5.0 ELSE 0.0 END,
                         CASE WHEN text = '' THEN 1.0 ELSE s END) AS s
           FROM s0 WHERE text = '' OR s > 0)
    SELECT query_id, doc_id, round(s + completeness * 0.15, 6) AS score FROM s1
    """


def ranked_sql(scored: str, k: int) -> str:
    return f"""
    SELECT query_id, rank, doc_id, score, total FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank,
             count(*) OVER (PARTITION BY query_id) AS total FROM ({scored}))
    WHERE rank <= {k}
    """


def _terms(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower(coalesce({x}, '')), '[^\\p{{L}}\\p{{N}}_]+'), lambda t: t <> '')"


def osa(a: str, b: str) -> str:
    """Edit distance with swaps of neighbours, no part edited twice, row by row."""
    cost = f"CASE WHEN {a}[i] = {b}[j] THEN 0 ELSE 1 END"
    swap = (f"CASE WHEN i > 1 AND j > 1 AND {a}[i] = {b}[j - 1] AND {a}[i - 1] = {b}[j] THEN st.older[j - 1] + 1 "
            "ELSE 1000000 END")
    row = (f"list_reduce(range(1, length({b}) + 1), lambda done, j: list_append(done, least(st.last[j + 1] + 1, "
           f"done[j] + 1, st.last[j] + {cost}, {swap})), [i])")
    return (f"list_reduce(range(1, length({a}) + 1), lambda st, i: {{'last': {row}, 'older': st.last}}, "
            f"{{'last': range(0, length({b}) + 1), 'older': range(0, length({b}) + 1)}}).last[length({b}) + 1]")


def bm25_sql(req_sql: str, docs: str, clause: str | None = None, k: int = 10) -> str:
    from larder.fixed_values import FIELD_BOOSTS, FLAG_NAMES
    fields = {"product_name": ("product_name", True), "brand": ("brand", False), "category": ("category", True),
              "ingredients": ("ingredients", True), "search_text": ("search_text", True)}
    base = " UNION ALL ".join(
        f"SELECT '{f}' AS field, id AS doc_id, unnest({_terms(c)}) AS term, "
        f"generate_subscripts({_terms(c)}, 1) - 1 AS pos, {'true' if syn else 'false'} AS syn FROM d"
        for f, (c, syn) in fields.items())
    partner = "CASE " + " ".join(f"WHEN term = {q(a)} THEN {q(b)} WHEN term = {q(b)} THEN {q(a)}"
                                 for a, b in SYNONYM_PAIRS) + " END"
    dls = " UNION ALL ".join(f"SELECT '{f}' AS field, id AS doc_id, len({_terms(c)}) AS dl FROM d"
                             for f, (c, _s) in fields.items())
    boost = "CASE field " + " ".join(f"WHEN '{f}' THEN {v}" for f, v in FIELD_BOOSTS.items()) + " END"
    keep = {"phrase": "AND phrase IS NOT NULL", "and": "AND all_terms IS NOT NULL", "fuzzy": "AND msm IS NOT NULL"}.get(clause, "")
    flag_ok = " AND ".join(f"(r.{f} IS NULL OR d.{f} = r.{f})" for f in FLAG_NAMES)

    def holds(wanted, text, syn):
        w, h = _terms(wanted), _terms(text)
        also = f" OR list_contains({h}, {partner.replace('term', 't')})" if syn else ""
        return (f"({wanted} IS NULL OR (len({w}) > 0 AND "
                f"len(list_filter({w}, lambda t: list_contains({h}, t){also})) = len({w})))")

    return f"""
    WITH req AS ({req_sql}), d AS ({docs}),
    b0 AS ({base}),
    post AS (SELECT field, doc_id, term, pos FROM b0
             UNION ALL SELECT field, doc_id, {partner} AS term, pos FROM b0 WHERE syn AND {partner} IS NOT NULL),
    dl AS ({dls}),
    stats AS (SELECT field, count(*) AS n_docs, avg(dl) AS avgdl FROM dl WHERE dl > 0 GROUP BY field),
    dfs AS (SELECT field, term, count(DISTINCT doc_id) AS df FROM post GROUP BY field, term),
    qt AS (SELECT query_id, unnest({_terms('text')}) AS term, generate_subscripts({_terms('text')}, 1) - 1 AS qpos,
                  len(regexp_split_to_array(trim(text), '\\s+')) AS nw
           FROM req WHERE text <> ''),
    nq AS (SELECT query_id, count(*) AS nq, any_value(nw) AS nw FROM qt GROUP BY query_id),
    qterm AS (SELECT DISTINCT term, CASE WHEN length(term) <= 2 THEN 0 WHEN length(term) <= 5 THEN 1 ELSE 2 END AS k FROM qt),
    vt AS (SELECT DISTINCT term FROM post),
    -- terms within k edits have a text in common after at most k deletions from each
    v1 AS (SELECT term, term AS d FROM vt UNION SELECT term, substr(term, 1, i - 1) || substr(term, i + 1)
           FROM (SELECT term, unnest(range(1, length(term) + 1)) AS i FROM vt)),
    v2 AS (SELECT term, d FROM v1 UNION SELECT term, substr(d, 1, i - 1) || substr(d, i + 1)
           FROM (SELECT term, d, unnest(range(1, length(d) + 1)) AS i FROM v1 WHERE d <> term)),
    q1 AS (SELECT term, k, term AS d FROM qterm UNION SELECT term, k, substr(term, 1, i - 1) || substr(term, i + 1)
           FROM (SELECT term, k, unnest(range(1, length(term) + 1)) AS i FROM qterm WHERE k >= 1)),
    q2 AS (SELECT term, k, d FROM q1 UNION SELECT term, k, substr(d, 1, i - 1) || substr(d, i + 1)
           FROM (SELECT term, k, d, unnest(range(1, length(d) + 1)) AS i FROM q1 WHERE d <> term AND k >= 2)),
    ex AS (SELECT q.term, v.term AS vterm FROM (SELECT DISTINCT q2.term, q2.k, v2.term AS near FROM q2 JOIN v2 USING (d)) q
           JOIN vt v ON v.term = q.near
           WHERE abs(length(q.term) - length(v.term)) <= q.k AND CASE WHEN damerau_levenshtein(q.term, v.term) <= q.k  -- counts bytes, so it cuts plain letters only
             * CASE WHEN strlen(q.term) = length(q.term) AND strlen(v.term) = length(v.term) THEN 1 ELSE 4 END THEN {osa('q.term', 'v.term')} <= q.k END),
    tfs AS MATERIALIZED (SELECT field, doc_id, term, count(*) AS tf FROM post GROUP BY ALL),
    need AS (SELECT query_id, least(nq, CASE WHEN nw <= 1 THEN 1 WHEN nw = 2 THEN 2 ELSE greatest(2, nw // 2 + 1) END) AS need FROM nq),
    qx AS MATERIALIZED (SELECT query_id, qpos, qt.term = vterm AS exact, vterm AS term FROM qt JOIN ex USING (term)),
    enough AS MATERIALIZED (SELECT query_id, doc_id, field FROM qx JOIN tfs USING (term) JOIN need USING (query_id)
               GROUP BY query_id, doc_id, field HAVING count(DISTINCT qpos) >= any_value(need)),
    tf AS (SELECT query_id, doc_id, field, term, qpos, exact, tf FROM enough JOIN qx USING (query_id) JOIN tfs USING (doc_id, field, term)),
    hits AS (SELECT query_id, doc_id, field, qpos, pos FROM tf JOIN post USING (doc_id, field, term) WHERE exact),
    sc AS (SELECT tf.*, ln(1 + (n_docs - df + 0.5) / (df + 0.5)) AS idf,
                  {BM25_K1} * (1 - {BM25_B} + {BM25_B} * dl.dl / avgdl) AS norm
           FROM tf JOIN stats USING (field) JOIN dfs USING (field, term) JOIN dl USING (field, doc_id)),
    ppos AS (SELECT query_id, doc_id, field, qpos, max(idf * tf / (tf + norm)) AS any_s,
                    max(CASE WHEN exact THEN idf * tf / (tf + norm) END) AS s, max(CASE WHEN exact THEN idf END) AS idf,
                    any_value(norm) AS norm FROM sc GROUP BY ALL),
    pfield AS (SELECT query_id, doc_id, field, sum(s) AS fs, count(s) AS matched, sum(any_s) AS any_s, count(*) AS any_n,
                      sum(idf) AS idf_sum, any_value(norm) AS norm FROM ppos GROUP BY ALL),
    ph AS (SELECT query_id, doc_id, field, count(*) AS pf FROM (
             SELECT h.query_id, doc_id, field, pos - qpos AS start, count(DISTINCT qpos) AS c FROM hits h GROUP BY ALL) x JOIN nq USING (query_id) WHERE c = nq GROUP BY ALL),
    pf AS (SELECT p.*, nq.nq, nq.nw, ph.pf, {boost} AS boost FROM pfield p JOIN nq USING (query_id)
           LEFT JOIN ph USING (query_id, doc_id, field)),
    best AS (SELECT query_id, doc_id,
               max(CASE WHEN pf IS NOT NULL THEN boost * idf_sum * pf / (pf + norm) END) AS phrase,
               max(CASE WHEN matched = nq THEN boost * fs END) AS all_terms,
               max(CASE WHEN any_n >= CASE WHEN nw <= 1 THEN 1 WHEN nw = 2 THEN 2
                                           ELSE greatest(2, nw // 2 + 1) END THEN boost * any_s END) AS msm
             FROM pf GROUP BY ALL),
    hit AS (SELECT *, coalesce(phrase * {PHRASE_BOOST_V}, 0.0) + coalesce(all_terms * {AND_BOOST_V}, 0.0)
                      + coalesce(msm * {FUZZY_BOOST_V}, 0.0) AS text_score
            FROM best WHERE (phrase IS NOT NULL OR all_terms IS NOT NULL OR msm IS NOT NULL) {keep}),
    s AS (SELECT r.query_id, d.id AS doc_id,
            round(text_score
              + list_reduce(r.modifiers, lambda acc, m: acc + CASE WHEN list_contains({_terms('d.name_l')}, lower(m))
                            THEN {MODIFIER_BOOST_V} ELSE 0.0 END, 0.0)
              + CASE WHEN r.is_palm_oil_free AND d.is_palm_oil_free THEN {PALM_BOOST_V} ELSE 0.0 END
              + d.completeness * 0.15, 6) AS score
          FROM hit JOIN req r USING (query_id) JOIN d ON d.id = hit.doc_id
          WHERE {holds('r.brand_f', 'd.brand_l', False)} AND {holds('r.category_f', 'd.cat_l', True)}
            AND {holds('r.ingredients_f', 'd.ing_l', True)}
            AND {flag_ok}
            AND coalesce(list_bool_and(list_transform(r.numeric_filters, lambda nf: coalesce(CASE
                  WHEN nf.operator = 'gte' THEN (list_filter(d.nuts, lambda e: e.k = {nutrient_key('nf.nutrient')})[1].p) >= nf.value
                  WHEN nf.operator = 'lte' THEN (list_filter(d.nuts, lambda e: e.k = {nutrient_key('nf.nutrient')})[1].p) <= nf.value
                  ELSE true END, false))), true))
    {ranked_sql('SELECT * FROM s', k).replace('SELECT query_id, rank', 'SELECT query_id, rank', 1)}
    """
