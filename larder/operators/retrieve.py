"""Filtered, tiered retrieval for many phrases at once (P-*, J-1, J-7, R-2 .. R-8, R-18).

Plan shape (no phrase x document cross join anywhere):

1. *Candidate keys* per request: each query token (length > 1) and its
   synonym variants; phrases made only of one-letter words use those words;
   filter-only requests use the first word of their brand / category /
   ingredient filter.
2. *Key -> vocabulary words*: a space-free key is a substring of a field iff
   it is a substring of one of the field's words, so keys are matched against
   the distinct vocabulary (small next to the documents) through an
   equi-join on the key's rarest character gram, then verified with ``contains``.
3. *Words -> documents* through the postings table (word, doc_id, mask).  The
   mask tells the fields, so the token part of the score is an aggregate of
   numbers.  Hot words are the skew case; AQE splits those partitions.
4. Cores with neither text nor a text filter take every document that the
   flags common to their requests allow: the compatible 9-bit flag vectors
   equi-join the documents' flag vector.
5. *Views*: documents that hold the same matching words in the same fields, the
   same of the sought texts (phrases, filters, modifiers), the same asked-for
   flags and lie on the same side of every bound are one view: to every request
   they differ in completeness and id alone.  A document is read once to find
   its view; what is scored are pairs of core and view.
6. *Cores*: requests that differ only in flags, numeric bounds and paging share
   a core, which is scored once.  Its views fall into classes: equal in the
   flags that some request asks for, and on the same side of every bound.  A
   class keeps its count and its best documents (``row_number`` planned as a
   partial WindowGroupLimit before the exchange), and a request adds up the
   counts and merges the heads of the classes that it accepts.  So a bound or a
   flag chooses classes; it isn't tested on each pair of request and document.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark import StorageLevel

from larder.fixed_values import (
    ALL_TOKENS_BONUS,
    COMPLETENESS_WEIGHT,
    FLAG_NAMES,
    MODIFIER_NAME_BONUS,
    NUTRIENT_FIELD_MAP,
    SYNONYM_PAIRS,
    TIER_PHRASE,
    TOKEN_MULTIPLIER,
)
from larder.functions.parse import _WS_CLASS, evaluate_once
from larder.functions.text import grams, synonym_variants

WORD_SPLIT = rf"{_WS_CLASS}+"
TOKEN_WEIGHTS = [("name_c", 3.0), ("brand_c", 2.0), ("cat_c", 1.5), ("ing_c", 1.2), ("text_c", 1.0)]


# ------------------------------------------------------------------ index side
# Scored fields in the order of their weights: bit i of a posting is set when the field holds the word.
IN_LOWER_TEXT = 1 << len(TOKEN_WEIGHTS)
# Filters, the fields that they are sought in, and the bits of the words of these.
FILTERED = {"brand_f": ("brand_l", IN_LOWER_TEXT << 1), "category_f": ("cat_l", IN_LOWER_TEXT << 2),
            "ingredients_f": ("ing_l", IN_LOWER_TEXT << 3)}
# Tokens of one block of a text fit the bits of a long.
BLOCK_TOKENS = 60


def postings(search_tbl: DataFrame) -> DataFrame:
    """(word, doc_id, mask) for every distinct whitespace word of a document:
    which canonical fields hold it, whether (``IN_LOWER_TEXT``) the lower-cased
    search text, which contains every other field, does, and which of the fields
    of ``FILTERED``."""
    def of(field, bit):
        return F.transform(F.array_distinct(F.split(field, WORD_SPLIT)), lambda w: F.struct(w.alias("word"), F.lit(bit).alias("bit")))

    words = F.flatten(F.array(*[of(c, 1 << i) for i, (c, _w) in enumerate(TOKEN_WEIGHTS)], of("text_l", IN_LOWER_TEXT),
                              *[of(c, bit) for c, bit in FILTERED.values()]))
    return (search_tbl.select("doc_id", F.explode(words).alias("w")).select("doc_id", "w.word", "w.bit")
            .where(F.col("word") != "").groupBy("doc_id", "word").agg(F.bit_or("bit").alias("mask"))
            .select("word", "doc_id", "mask"))


def vocabulary_grams(post: DataFrame) -> DataFrame:
    """(gram, word): every distinct 1-, 2- and 3-character substring of each
    vocabulary word.  Built from the distinct vocabulary, not the documents."""
    vocab = post.select("word").distinct()
    g = F.array_distinct(F.flatten(F.array(grams("word", 1), grams("word", 2), grams("word", 3))))
    return vocab.select(F.explode(g).alias("gram"), "word")


def gram_counts(vgrams: DataFrame) -> DataFrame:
    """(gram, n): how many vocabulary words hold each gram."""
    return vgrams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- request side
def _tokens(text) -> F.Column:
    return F.filter(F.split(text, " "), lambda t: F.length(t) > 1)


def _first_word(v) -> F.Column:
    return F.get(F.filter(F.split(F.lower(v), WORD_SPLIT), lambda t: t != ""), 0)


def candidate_keys(req: DataFrame, pairs=SYNONYM_PAIRS) -> DataFrame:
    """(query_id, tok, key, own) rows for requests answered through the
    postings: each token by its number, under its own key and those of its
    synonyms; keys that choose documents but score nothing have ``tok`` -1."""
    text = F.col("text")
    toks = _tokens(text)
    own = F.flatten(F.transform(toks, lambda t, i: F.transform(synonym_variants(t, pairs), lambda v: F.struct(
        i.alias("tok"), v.alias("key"), (v == t).alias("own")))))

    def plain(keys):
        return F.transform(keys, lambda k: F.struct(F.lit(-1).alias("tok"), k.alias("key"), F.lit(False).alias("own")))

    single = F.filter(F.split(text, " "), lambda t: F.length(t) == 1)
    keys = (F.when(text != "", F.when(F.size(toks) > 0, own).otherwise(plain(single)))
            .when(F.col("brand_f").isNotNull(), plain(F.array(_first_word("brand_f"))))
            .when(F.col("category_f").isNotNull(), plain(F.array(_first_word("category_f"))))
            .when(F.col("ingredients_f").isNotNull(), plain(F.array(_first_word("ingredients_f")))))
    return req.select("query_id", F.explode(keys).alias("k")).select("query_id", "k.*").where(
        F.col("key").isNotNull()).distinct()


# (query_id, tok, word) matches above this many rows are joined by shuffle instead
# of broadcast.
MATCH_BROADCAST_ROWS = 2_000_000


def matching_words(keys: DataFrame, vgrams: DataFrame, counts: DataFrame) -> DataFrame:
    """(key, word): the vocabulary words that contain each of ``keys`` (key).
    Of a key's grams the rarest is read; a key with a gram that no word holds
    matches none.  ``contains`` tests the others on the word itself."""
    each = keys.select("key", F.explode(grams("key", 3)).alias("gram")).join(counts, "gram", "left")
    rarest = each.groupBy("key").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("rare"))
    rarest = rarest.where(F.col("rare.n") > 0).select("key", F.col("rare.gram").alias("gram"))
    return rarest.join(vgrams, "gram").where(F.col("word").contains(F.col("key"))).select("key", "word")


def postings_candidates(req: DataFrame, post: DataFrame, vgrams: DataFrame, counts: DataFrame | None = None,
                        pairs=SYNONYM_PAIRS, found: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, n_match, tok_score): documents holding some key as a
    substring of a word, with the number of tokens that a canonical field
    contains and the sum of their best field weights.

    A token is contained in a field iff one of the field's words contains it,
    so both follow from the postings' masks: no text is read here.  The (query,
    word) match table is small next to the postings (phrases x matching
    vocabulary words).  When its size check passes it is broadcast, so the
    postings stay in their doc_id partitioning and the aggregates below need no
    exchange; otherwise both sides shuffle on the word.  ``found`` are the
    ``matching_words`` of the keys, if known."""
    from larder.operators.joins import broadcast_if_small
    keys = candidate_keys(req, pairs)
    if found is None:
        found = matching_words(keys.select("key").distinct(), vgrams, counts if counts is not None else gram_counts(vgrams))
    words = (keys.join(found, "key").groupBy("query_id", "tok", "word").agg(F.max("own").alias("own"))
             .groupBy("query_id", F.floor(F.col("tok") / BLOCK_TOKENS).alias("block"), "word")
             .agg(F.coalesce(F.bit_or(F.when(F.col("own"), F.expr(f"shiftleft(1L, pmod(tok, {BLOCK_TOKENS}))"))),
                             F.lit(0).cast("long")).alias("toks")))
    words = broadcast_if_small(words.checkpoint(eager=True), MATCH_BROADCAST_ROWS)
    held = [F.bit_or(F.when(F.col("mask").bitwiseAND(1 << i) != 0, F.col("toks")).otherwise(F.lit(0).cast("long"))).alias(f"_f{i}")
            for i in range(len(TOKEN_WEIGHTS))]
    per_block = post.join(words, "word").groupBy("query_id", "doc_id", "block").agg(
        F.max(F.col("mask").bitwiseAND(IN_LOWER_TEXT)).alias("cand"), *held)
    # a token counts in the first of its fields, which weighs most
    seen, score = F.lit(0).cast("long"), F.lit(0.0)
    for i, (_c, weight) in enumerate(TOKEN_WEIGHTS):
        new = F.col(f"_f{i}").bitwiseAND(F.bitwise_not(seen))
        score = score + F.bit_count(new) * F.lit(weight)
        seen = seen.bitwiseOR(F.col(f"_f{i}"))
    return (per_block.groupBy("query_id", "doc_id").agg(
        F.max("cand").alias("cand"), F.sum(F.bit_count(seen)).alias("n_match"), F.sum(score).alias("tok_score"))
        .where(F.col("cand") != 0).drop("cand"))


def _flag_bits(flags) -> F.Column:
    out = F.lit(0)
    for i, f in enumerate(FLAG_NAMES):
        out = out + F.when(flags[f], F.lit(1 << i)).otherwise(F.lit(0))
    return out


def _flag_masks() -> tuple[F.Column, F.Column]:
    """Bits of the flags that a request asks for, and of those it wants true."""
    mask = want = F.lit(0)
    for i, f in enumerate(FLAG_NAMES):
        v = F.col(f"flag_filters.{f}")
        mask = mask + F.when(v.isNotNull(), F.lit(1 << i)).otherwise(F.lit(0))
        want = want + F.when(v, F.lit(1 << i)).otherwise(F.lit(0))
    return mask, want


def _by_flags_alone() -> F.Column:
    """Whether a request has no text and no text filter."""
    return ((F.col("text") == "") & F.col("brand_f").isNull() & F.col("category_f").isNull() & F.col("ingredients_f").isNull())


def signature_candidates(req: DataFrame, docs: DataFrame, mask=None, want=None) -> DataFrame:
    """(query_id, doc_id) for requests with no text and no text filter; ``docs`` are (doc_id, fvec), the flag bits."""
    plain = req.where(_by_flags_alone())
    if mask is None:
        mask, want = _flag_masks()
    sig = plain.select("query_id", mask.alias("mask"), want.alias("want"))
    vec = sig.select("query_id", F.explode(F.filter(
        F.sequence(F.lit(0), F.lit((1 << len(FLAG_NAMES)) - 1)),
        lambda v: (v.bitwiseAND(F.col("mask")) == F.col("want")))).alias("fvec"))
    return vec.join(docs.select("doc_id", "fvec"), "fvec").select("query_id", "doc_id", F.lit(0).cast("long").alias("n_match"), F.lit(0.0).alias("tok_score"))


# ------------------------------------------------------------------- scoring
def nutrient_map() -> F.Column:
    """P-8 name map as a literal map column (unknown names pass through)."""
    return F.create_map(*[x for k, v in NUTRIENT_FIELD_MAP.items() for x in (F.lit(k), F.lit(v))])


def numeric_ok(numeric_filters, nutrition) -> F.Column:
    """P-7/P-8: every numeric filter holds on the mapped nutrient (missing fails)."""
    def one(nf):
        key = F.coalesce(F.try_element_at(nutrient_map(), nf["nutrient"]), nf["nutrient"])
        entry = F.try_element_at(nutrition, key)
        actual = F.when(nf["comparison_basis"] == "per_100g", entry["per_100g"]).otherwise(entry["value"])
        return (F.when(actual.isNull(), F.lit(False))
                .when(nf["operator"] == "gte", actual >= nf["value"])
                .when(nf["operator"] == "lte", actual <= nf["value"])
                .otherwise(F.lit(True)))
    return (F.size(numeric_filters) == 0) | F.forall(numeric_filters, one)


def text_filters_ok() -> F.Column:
    """P-1 .. P-3 over the joined (request, document) row."""
    ok = F.lit(True)
    for f, col in (("brand_f", "brand_l"), ("category_f", "cat_l"), ("ingredients_f", "ing_l")):
        ok = ok & (F.col(f).isNull() | F.col(col).contains(F.lower(F.col(f))))
    return ok


def filters_ok() -> F.Column:
    """P-1 .. P-8 over the joined (request, document) row."""
    ok = text_filters_ok()
    for f in FLAG_NAMES:
        want = F.col(f"flag_filters.{f}")
        ok = ok & (want.isNull() | (F.col(f"flags.{f}") == want))
    return ok & numeric_ok(F.col("numeric_filters"), F.col("nutrition"))


def _every_token() -> F.Column:
    return F.col("n_match") == F.size(_tokens(F.lower(F.col("text"))))


def phrase_tier(q) -> F.Column:
    """What a text earns by the first field that contains it whole (null: none)."""
    return (F.when(F.col("name_c").contains(q), TIER_PHRASE["product_name"])
            .when(F.col("brand_c").contains(q), TIER_PHRASE["brand"])
            .when(F.col("cat_c").contains(q), TIER_PHRASE["category"])
            .when(F.col("text_c").contains(q), TIER_PHRASE["search_text"]))


def _text_part(df: DataFrame, phrase) -> tuple[DataFrame, F.Column]:
    """R-2 .. R-5 from ``n_match``, ``tok_score`` and the phrase's tier where every token matched; null: not a hit."""
    every = _every_token()
    s0 = (F.when(every & (F.col("text") != ""), F.coalesce(phrase, F.lit(0.0))).otherwise(F.lit(0.0)) + F.col("tok_score") * TOKEN_MULTIPLIER
          + F.when(every & (F.col("n_match") > 0), F.lit(ALL_TOKENS_BONUS)).otherwise(F.lit(0.0)))
    return df.withColumn("_s0", s0), F.when(F.col("text") == "", F.lit(1.0)).when(F.col("_s0") > 0, F.col("_s0"))


def with_tiered_score(df: DataFrame, out: str = "score") -> DataFrame:
    """R-2 .. R-7 from ``n_match`` and ``tok_score``; NULL means "not a hit"
    (text present and nothing matched).  A field that contains the whole text
    contains each of its tokens, so the texts of a document are searched only
    where every token matched."""
    df, first = _text_part(df, phrase_tier(F.lower(F.col("text"))))
    mods = F.when(F.size("modifiers") == 0, F.lit(0.0)).otherwise(F.aggregate(F.col("modifiers"), F.lit(0.0), lambda acc, m: acc + F.when(
        F.col("name_c").contains(F.lower(m)), F.lit(MODIFIER_NAME_BONUS)).otherwise(F.lit(0.0))))
    return df.withColumn(out, first + mods + F.col("completeness") * COMPLETENESS_WEIGHT).drop("_s0")


REQUEST_COLS = ["query_id", "text", "brand_f", "category_f", "ingredients_f", "flag_filters", "numeric_filters",
                "modifiers", "size", "from_"]
DOC_COLS = ["doc_id", "name_c", "brand_c", "cat_c", "text_c", "brand_l", "cat_l", "ing_l", "flags",
            "nutrition", "completeness"]


def scored_hits(req: DataFrame, search_tbl: DataFrame, post: DataFrame | None = None,
                vgrams: DataFrame | None = None, materialize: bool = True, counts: DataFrame | None = None) -> DataFrame:
    """Every (query_id, doc_id, score) that the tiered scorer keeps.

    The request table feeds three branches (postings keys, signature path,
    scoring join); it is checkpointed once so annotation is not re-run per
    branch (and a lost executor re-reads it instead of re-annotating)."""
    req = req.select(*REQUEST_COLS)
    if materialize:
        req = req.checkpoint(eager=True)
    post = post if post is not None else postings(search_tbl)
    vgrams = vgrams if vgrams is not None else vocabulary_grams(post)
    bits = search_tbl.select("doc_id", _flag_bits(F.col("flags")).alias("fvec"))
    cands = postings_candidates(req, post, vgrams, counts).unionByName(signature_candidates(req, bits))
    rows = cands.join(req, "query_id").join(search_tbl.select(*DOC_COLS), "doc_id").where(filters_ok())
    rows = rows.select("query_id", "doc_id", "size", "from_", "text", "modifiers", "completeness",
                       "n_match", "tok_score", "name_c", "brand_c", "cat_c", "text_c")
    scored = with_tiered_score(rows, "_raw")
    scored = evaluate_once(scored, "score", F.round("_raw", 6)).select("query_id", "doc_id", "size", "from_",
                                                                       "score")
    return scored.where(F.col("score").isNotNull())


def top_hits(scored: DataFrame, limit: int | None = None, settle: bool = False) -> DataFrame:
    """R-18: rank by (score desc, doc_id), keep the page [from, from+size),
    attach the total per phrase.  ``limit`` makes it a top-k report; without it
    the largest page end among the requests is used, a literal that lets the
    planner cut each task to ``limit`` rows per phrase before the exchange; the
    per-row page bounds are applied after.  ``settle`` computes the hits at
    once, writes them to the shared folder and releases the scored set."""
    # top-k and totals both read the scored set: persist it so scoring runs
    # once (a persisted block lost with an executor is recomputed)
    scored = scored.persist(StorageLevel.MEMORY_AND_DISK)
    if limit is None:
        limit = scored.agg(F.max(F.col("from_") + F.col("size"))).first()[0] or 0
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("doc_id"))
    ranked = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
    page = ranked.where((F.col("rank") > F.col("from_")) & (F.col("rank") <= F.col("from_") + F.col("size")))
    totals = scored.groupBy("query_id").agg(F.count(F.lit(1)).alias("total"))
    hits = page.join(totals, "query_id").select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id",
                                                "score", "total")
    if settle:
        hits = hits.checkpoint(eager=True)
        scored.unpersist()
    return hits


# --------------------------------------------------------------------- cores
CURSOR = {"after_score": "double", "after_id": "string"}
CORE_COLS = ["text", "brand_f", "category_f", "ingredients_f", "modifiers", *CURSOR]


def with_cursor(req: DataFrame) -> DataFrame:
    """Requests with the columns of a cursor, null where they have none."""
    return req.withColumns({c: F.col(c).cast(t) if c in req.columns else F.lit(None).cast(t) for c, t in CURSOR.items()})


def _row_key(cols: list[str]) -> F.Column:
    return F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256)


def with_core(req: DataFrame) -> DataFrame:
    """Requests with ``core`` (what they share but flags, bounds and page sizes), ``mask, want`` (flag bits) and
    ``limits``: their numeric filters on the mapped nutrient."""
    mask, want = _flag_masks()
    req = with_cursor(req)
    limits = F.transform("numeric_filters", lambda nf: F.struct(
        F.coalesce(F.try_element_at(nutrient_map(), nf["nutrient"]), nf["nutrient"]).alias("nutrient"),
        F.coalesce(nf["comparison_basis"] == "per_100g", F.lit(False)).alias("per_100g"),
        nf["operator"].alias("operator"), nf["value"].alias("value")))
    return req.select("*", _row_key(CORE_COLS).alias("core"), mask.alias("mask"), want.alias("want"), limits.alias("limits"))


def core_requests(req: DataFrame) -> DataFrame:
    """One request for each core of ``with_core``, named by it in ``query_id``:

    * ``asked``: the flags that some request asks for; ``must``, ``must_not``:
      those that all ask for with the same value;
    * ``keys``: for each nutrient with a bound its distinct bounds, whether all
      requests have one (a missing value then fails all), and the loosest lower
      and upper bounds (null where some request has none): no request of the
      core accepts a document outside."""
    flags = req.groupBy("core", *CORE_COLS).agg(
        F.count(F.lit(1)).alias("n"), F.bit_or("mask").alias("asked"), F.bit_and("want").alias("must"),
        F.bit_and(F.col("mask").bitwiseAND(F.bitwise_not("want"))).alias("must_not"))
    one = req.select("core", "query_id", F.explode("limits").alias("l")).select("core", "query_id", "l.*")
    own = one.groupBy("core", "query_id", "nutrient", "per_100g").agg(
        F.collect_set("value").alias("values"), F.max(F.when(F.col("operator") == "gte", F.col("value"))).alias("low"),
        F.min(F.when(F.col("operator") == "lte", F.col("value"))).alias("high"))
    per_key = own.groupBy("core", "nutrient", "per_100g").agg(
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("values")))).alias("bounds"), F.count(F.lit(1)).alias("asked_by"),
        F.count("low").alias("n_low"), F.min("low").alias("low"), F.count("high").alias("n_high"), F.max("high").alias("high"))
    loosest = flags.select("core", "n").join(per_key, "core").select("core", F.struct(
        "nutrient", "per_100g", "bounds", (F.col("asked_by") == F.col("n")).alias("needed"),
        F.when(F.col("n_low") == F.col("n"), F.col("low")).alias("low"),
        F.when(F.col("n_high") == F.col("n"), F.col("high")).alias("high")).alias("key"))
    keys = loosest.groupBy("core").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    none = F.array().cast(dict(keys.dtypes)["keys"])
    return flags.join(keys, "core", "left").select(
        F.col("core").alias("query_id"), *CORE_COLS, "asked", "must", "must_not", F.coalesce("keys", none).alias("keys"))


def amount(key) -> F.Column:
    entry = F.try_element_at(F.col("nutrition"), key["nutrient"])
    return F.when(key["per_100g"], entry["per_100g"]).otherwise(entry["value"])


def side(bounds, v) -> F.Column:
    """Where a value lies among sorted bounds: 2i before the i-th (from 0), 2i + 1 on it, -1 if missing."""
    below = F.size(F.filter(bounds, lambda b: b < v))
    return F.when(v.isNotNull(), below * 2 + F.array_contains(bounds, v).cast("int")).otherwise(-1)


# Sought texts begin with a letter for the fields: a phrase (name, brand, category, text), a modifier (name), a filter.
PHRASE, MODIFIER, FILTER_MARKS = "p", "m", {"brand_f": "b", "category_f": "c", "ingredients_f": "i"}
# Sets of words with sought texts above this many are joined by shuffle instead of broadcast (about 500 bytes each).
SOUGHT_BROADCAST_ROWS = 100_000


def _sought(mark: str, text) -> F.Column:
    return F.concat(F.lit(mark), F.lower(text))


def _holds(needle) -> F.Column:
    """What a row of the search table earns by a sought text: the tier of a phrase, 1 for others, null if it isn't there."""
    mark, text = F.substring(needle, 1, 1), F.substring(needle, 2, 1 << 30)
    out = F.when(mark == PHRASE, phrase_tier(text)).when((mark == MODIFIER) & F.col("name_c").contains(text), 1.0)
    for f, (field, _bit) in FILTERED.items():
        out = out.when((mark == FILTER_MARKS[f]) & F.col(field).contains(text), 1.0)
    return out


def _sought_by_words(cores: DataFrame) -> DataFrame:
    """(needle, bit, pieces): modifiers and filters; a word of the field of ``bit`` must contain each piece."""
    bit = F.lit(1)
    for f, mark in FILTER_MARKS.items():
        bit = F.when(F.col("needle").startswith(mark), FILTERED[f][1]).otherwise(bit)
    all_ = F.array_compact(F.concat(F.transform("modifiers", lambda m: _sought(MODIFIER, m)),
                                    F.array(*[_sought(mark, F.col(f)) for f, mark in FILTER_MARKS.items()])))
    pieces = F.array_distinct(F.filter(F.split(F.substring("needle", 2, 1 << 30), WORD_SPLIT), lambda p: p != ""))
    return cores.select(F.explode(all_).alias("needle")).distinct().select("needle", bit.alias("bit"), pieces.alias("pieces"))


@dataclass
class CoreHits:
    """``pairs``: each core and view that it may accept (core, view, base, copies, n, low, high, flag_bits, sides, amounts,
    after_score, after_id); ``base`` is the score without completeness, which lies from ``low`` to ``high`` in the view's
    ``n`` rows, each counted ``copies`` times.  ``rows``: (view, doc_id, completeness)."""
    pairs: DataFrame
    rows: DataFrame
    cursors: bool


def _word_sets(cores: DataFrame, post: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, words, set): the matching words of each document with their fields; equal ones have one ``set``."""
    from larder.operators.joins import broadcast_if_small
    words = broadcast_if_small(found.select("word").distinct().checkpoint(eager=True), MATCH_BROADCAST_ROWS)
    held = post.join(words, "word", "left_semi").groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.struct("word", "mask"))).alias("words"))
    return held.withColumn("set", F.sha2(F.to_json("words"), 256))


def _sought_in(cores: DataFrame, sets: DataFrame, in_sets: DataFrame, cands: DataFrame, found: DataFrame, needles: DataFrame) -> DataFrame:
    """(set, sought): the texts that documents with these words may hold."""
    phrases = cands.join(cores.select("query_id", "text"), "query_id").where((F.col("text") != "") & _every_token()).select(
        F.col("doc_id").alias("set"), _sought(PHRASE, F.col("text")).alias("needle"))
    by_word = needles.select("needle", "bit", F.size("pieces").alias("n"), F.explode("pieces").alias("key")).join(found, "key").join(
        in_sets, "word").where(F.col("mask").bitwiseAND(F.col("bit")) != 0).groupBy("needle", "doc_id", "n").agg(
        F.count_distinct("key").alias("met")).where("met = n").select(F.col("doc_id").alias("set"), "needle")
    # a text without words may be anywhere
    blank = needles.where(F.size("pieces") == 0).select("needle")
    anywhere = sets.select("set").unionByName(sets.sparkSession.createDataFrame([("",)], "set string")).crossJoin(blank)
    return (phrases.unionByName(by_word).unionByName(anywhere.select("set", "needle")).groupBy("set")
            .agg(F.sort_array(F.collect_set("needle")).alias("sought")).checkpoint(eager=True))


def core_hits(cores: DataFrame, search_tbl: DataFrame, post: DataFrame, vgrams: DataFrame, counts: DataFrame | None = None,
              pairs=SYNONYM_PAIRS) -> CoreHits:
    """What the tiered scorer keeps for each of ``core_requests`` and some request of the core may accept."""
    from larder.operators.joins import broadcast_if_small
    needles = _sought_by_words(cores).checkpoint(eager=True)
    keys = candidate_keys(cores, pairs).select("key").unionByName(needles.select(F.explode("pieces").alias("key"))).distinct()
    found = matching_words(keys, vgrams, counts if counts is not None else gram_counts(vgrams)).checkpoint(eager=True)
    own = _word_sets(cores, post, found).persist(StorageLevel.MEMORY_AND_DISK)
    sets = own.groupBy("set").agg(F.first("words").alias("words")).checkpoint(eager=True)
    in_sets = sets.select(F.explode("words").alias("w"), F.col("set").alias("doc_id")).select("w.word", "doc_id", "w.mask")
    cands = postings_candidates(cores, in_sets, vgrams, counts, pairs, found).checkpoint(eager=True)
    sought = broadcast_if_small(_sought_in(cores, sets, in_sets, cands, found, needles), SOUGHT_BROADCAST_ROWS)

    # flags and bounds of all requests, as one value
    asked = cores.agg(F.coalesce(F.bit_or("asked"), F.lit(0)).alias("asked"))
    every = cores.select(F.explode("keys").alias("k")).select("k.nutrient", "k.per_100g", F.explode("k.bounds").alias("b")).groupBy(
        "nutrient", "per_100g").agg(F.sort_array(F.collect_set("b")).alias("bounds"))
    every = every.agg(F.sort_array(F.collect_list(F.struct("nutrient", "per_100g", "bounds"))).alias("keys")).checkpoint(eager=True)
    flags_alone = cores.where(_by_flags_alone()).limit(1).count() > 0

    docs = search_tbl.select("doc_id", "name_c", "brand_c", "cat_c", "text_c", "brand_l", "cat_l", "ing_l", "nutrition", "completeness",
                             _flag_bits(F.col("flags")).bitwiseAND(asked.checkpoint(eager=True).scalar()).alias("fvec")).where("doc_id IS NOT NULL")
    rows = docs.join(own.select("doc_id", "set"), "doc_id", "left" if flags_alone else "inner")
    if flags_alone:
        # rows that repeat an id meet each of its flag vectors
        rows = rows.join(docs.groupBy("doc_id").agg(F.sort_array(F.collect_list("fvec")).alias("vectors")), "doc_id")
    else:
        rows = rows.withColumn("vectors", F.lit(None).cast("array<int>"))
    rows = rows.withColumn("set", F.coalesce("set", F.lit(""))).join(sought, "set", "left")
    held = F.filter(F.transform("sought", lambda n: F.struct(n.alias("needle"), _holds(n).alias("value"))), lambda h: h["value"].isNotNull())
    rows = evaluate_once(rows, "_keys", every.scalar()).withColumn("seen", F.transform("_keys", amount)).withColumn(
        "_sides", F.transform("_keys", lambda k, i: side(k["bounds"], F.get("seen", i)))).withColumn("held", held)
    same = F.sha2(F.to_json(F.struct("set", "held", "fvec", "_sides", "vectors")), 256)
    rows = rows.select("doc_id", "completeness", same.alias("view"), "set", "held", "fvec", "vectors", "seen").persist(
        StorageLevel.MEMORY_AND_DISK)
    views = rows.groupBy("view").agg(*[F.first(c).alias(c) for c in ("set", "held", "fvec", "vectors", "seen")],
                                     F.count(F.lit(1)).alias("n"), F.min("completeness").alias("low"), F.max("completeness").alias("high"))
    views = views.checkpoint(eager=True)
    own.unpersist()

    mask = F.col("must").bitwiseOR(F.col("must_not"))
    by_words = cands.withColumnRenamed("doc_id", "set").join(views, "set").withColumn("copies", F.lit(1)).join(cores, "query_id")
    by_flags = signature_candidates(cores, views.select(F.col("view").alias("doc_id"), "fvec"), mask, F.col("must")).withColumnRenamed(
        "doc_id", "view").join(views, "view").join(cores, "query_id").withColumn("copies", F.size(F.filter(
            "vectors", lambda v: v.bitwiseAND(mask) == F.col("must"))))
    met = by_words.unionByName(by_flags).where(F.col("fvec").bitwiseAND(mask) == F.col("must"))

    def value(needle):
        return F.get(F.filter("held", lambda h: h["needle"] == needle), 0)["value"]

    for f, mark in FILTER_MARKS.items():
        met = met.where(F.col(f).isNull() | value(_sought(mark, F.col(f))).isNotNull())
    met, first = _text_part(met, value(_sought(PHRASE, F.col("text"))))
    mods = F.size(F.filter("modifiers", lambda m: F.coalesce(value(_sought(MODIFIER, m)).isNotNull(), F.lit(False)))) * F.lit(MODIFIER_NAME_BONUS)
    met = evaluate_once(evaluate_once(met, "base", first + mods).where("base IS NOT NULL"), "_keys", every.scalar())
    met = met.withColumn("amounts", F.transform("keys", lambda k: F.get("seen", F.array_position(
        F.transform("_keys", lambda a: F.struct(a["nutrient"], a["per_100g"])), F.struct(k["nutrient"], k["per_100g"])).cast("int") - 1)))
    sides = F.transform("keys", lambda k, i: side(k["bounds"], F.get("amounts", i)))
    met = met.select(F.col("query_id").alias("core"), "view", "base", "copies", "n", "low", "high",
                     F.col("fvec").bitwiseAND(F.col("asked")).alias("flag_bits"), sides.alias("sides"), "amounts", *CURSOR)
    cursors = cores.where("after_score IS NOT NULL").limit(1).count() > 0
    return CoreHits(met.checkpoint(eager=True), rows, cursors)


def _accepts() -> F.Column:
    """Whether a request accepts a class: its flags, and its bounds on the amounts of any document of the class."""
    def holds(f):
        at = F.array_position(F.transform("keys", lambda k: F.struct(k["nutrient"], k["per_100g"])), F.struct(f["nutrient"], f["per_100g"]))
        v = F.get("amounts", at.cast("int") - 1)
        return F.coalesce(F.when(f["operator"] == "gte", v >= f["value"]).when(f["operator"] == "lte", v <= f["value"])
                          .otherwise(v.isNotNull()), F.lit(False))
    return (F.col("flag_bits").bitwiseAND(F.col("mask")) == F.col("want")) & ((F.size("limits") == 0) | F.forall("limits", holds))


IN_CLASS = ["core", "flag_bits", "sides"]


def _best_first() -> list:
    return [F.col("score").desc(), F.col("doc_id")]


def _score(completeness) -> F.Column:
    return F.round(F.col("base") + completeness * COMPLETENESS_WEIGHT, 6)


def _is_passed() -> F.Column:
    return F.coalesce(_score(F.col("low")) > F.col("after_score"), F.lit(False))


def _is_cut() -> F.Column:
    """Whether the cursor lies in the view: some of its documents may come before it, others after."""
    return F.col("after_score").isNotNull() & ~_is_passed() & F.coalesce(_score(F.col("high")) >= F.col("after_score"), F.lit(False))


def _cut_rows(hits: CoreHits) -> DataFrame:
    """The documents of the views that a cursor cuts; ``ahead`` marks those up to it."""
    rows = hits.pairs.where(_is_cut()).join(hits.rows.select("view", "doc_id", "completeness"), "view").withColumn(
        "score", _score(F.col("completeness")))
    ahead = (F.col("score") > F.col("after_score")) | ((F.col("score") == F.col("after_score")) & (F.col("doc_id") <= F.col("after_id")))
    return rows.withColumn("ahead", F.coalesce(ahead, F.lit(False)))


# Completeness in steps: two steps apart, scores differ after rounding.
STEPS = 100_000


def view_heads(rows: DataFrame, limit: int) -> DataFrame:
    """(view, doc_id, completeness, first_id, near): the documents of each view of (view, doc_id, completeness) that may be
    among its first ``limit``, whatever is added to their scores: of those with one completeness the first by id, and none
    with ``limit`` documents two steps above.  ``first_id`` has the largest completeness, ``near`` others in reach of it."""
    place = F.row_number().over(Window.partitionBy("view", "completeness").orderBy("doc_id"))
    rows = rows.select("view", "doc_id", "completeness").withColumn("place", place).where(F.col("place") <= limit)
    c = F.least(F.greatest("completeness", F.lit(-1e9)), F.lit(1e9))
    rows = rows.withColumn("step", -F.floor(c * STEPS))
    view = Window.partitionBy("view").orderBy("step")
    rows = rows.withColumn("above", F.count(F.lit(1)).over(view.rangeBetween(Window.unboundedPreceding, -2))).where(F.col("above") < limit)
    best = Window.partitionBy("view").orderBy(F.col("completeness").desc(), "doc_id")
    rows = rows.withColumns({"first_id": F.first("doc_id").over(best), "_top": F.first("completeness").over(best), "_step": F.first("step").over(best)})
    near = F.max((F.col("completeness") != F.col("_top")) & (F.col("step") <= F.col("_step") + 1)).over(Window.partitionBy("view"))
    return rows.withColumn("near", near).select("view", "doc_id", "completeness", "first_id", "near")


def class_heads(hits: CoreHits, limit: int) -> DataFrame:
    """The first ``limit`` documents of each class after the cursor."""
    heads = view_heads(hits.rows, limit).checkpoint(eager=True)
    free = hits.pairs.where(~_is_passed() & ~_is_cut()).join(heads.select("view", "first_id", "near").distinct(), "view")
    # the best documents of the first views leave no place for others
    best = Window.partitionBy(*IN_CLASS)
    high = _score(F.col("high"))
    free = free.withColumns({"_turn": F.row_number().over(best.orderBy(high.desc(), "first_id")), "_rank": F.rank().over(best.orderBy(high.desc()))})
    free = free.where((F.col("_turn") <= limit) | (F.col("near") & (F.col("_rank") <= limit)))
    rows = free.select(*IN_CLASS, "view", "base", "copies").join(heads.select("view", "doc_id", "completeness"), "view").select(
        *IN_CLASS, "doc_id", _score(F.col("completeness")).alias("score"), "copies")
    if hits.cursors:
        rows = rows.unionByName(_cut_rows(hits).where("NOT ahead").select(*IN_CLASS, "doc_id", "score", "copies"))
    rows = rows.select(*IN_CLASS, "doc_id", "score", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
    place = F.row_number().over(Window.partitionBy(*IN_CLASS).orderBy(*_best_first()))
    return rows.withColumn("place", place).where(F.col("place") <= limit).select(*IN_CLASS, "doc_id", "score")


def class_counts(hits: CoreHits) -> DataFrame:
    """(class, n, n_ahead, amounts): the documents of each class, those up to the cursor, and the amounts of some document."""
    n = F.col("n") * F.col("copies")
    rows = hits.pairs.where(~_is_cut()).select(*IN_CLASS, "amounts", n.alias("n"), F.when(_is_passed(), n).otherwise(0).alias("n_ahead"))
    if hits.cursors:
        rows = rows.unionByName(_cut_rows(hits).select(*IN_CLASS, "amounts", F.col("copies").cast("long").alias("n"),
                                                       F.when(F.col("ahead"), F.col("copies").cast("long")).otherwise(0).alias("n_ahead")))
    return rows.groupBy(*IN_CLASS).agg(F.sum("n").alias("n"), F.sum("n_ahead").alias("n_ahead"), F.first("amounts").alias("amounts"))


def search(req: DataFrame, search_tbl: DataFrame, limit: int | None = None, post: DataFrame | None = None,
           vgrams: DataFrame | None = None, counts: DataFrame | None = None, empty_pages: bool = False,
           pairs=SYNONYM_PAIRS) -> DataFrame:
    """Requests x documents -> ranked hits (query_id, rank, doc_id, score, total),
    written to the shared folder.  ``limit`` makes it a top-k report; without it
    each request gets its page.  With ``empty_pages`` a request without hits on
    its page has one row: its total, and null for the rest.  A deep page is
    asked for by the last hit before it (``after_score``, ``after_id``) instead
    of ``from_``: then only the counts of the hits before it are kept.

    Requests that differ in their id alone are ranked once, by the smallest
    id, and share its hits.  ``pairs`` are the synonyms of the search table."""
    columns = [*REQUEST_COLS, *CURSOR]
    req = with_cursor(req).select(*columns, _row_key(columns[1:]).alias("_key")).checkpoint(eager=True)
    first = req.groupBy("_key").agg(F.min("query_id").alias("query_id"))
    if limit is None:
        limit = req.agg(F.max(F.col("from_") + F.col("size"))).first()[0] or 0
    own = with_core(req.join(first, ["_key", "query_id"])).checkpoint(eager=True)
    cores = core_requests(own).checkpoint(eager=True)
    post = post if post is not None else postings(search_tbl)
    vgrams = vgrams if vgrams is not None else vocabulary_grams(post)
    scored = core_hits(cores, search_tbl, post, vgrams, counts, pairs)
    heads = class_heads(scored, limit).checkpoint(eager=True)
    classes = class_counts(scored).checkpoint(eager=True)
    scored.rows.unpersist()
    asking = own.join(cores.select(F.col("query_id").alias("core"), "keys"), "core")
    chosen = asking.join(classes, "core").where(_accepts()).select("query_id", "size", "from_", *IN_CLASS, "n", "n_ahead")
    sums = chosen.groupBy("query_id").agg(F.sum("n").alias("total"), F.sum("n_ahead").alias("before"))
    totals = own.select("query_id").join(sums, "query_id", "left").select("query_id", F.coalesce("total", F.lit(0)).alias("total"), "before")
    merged = chosen.select("query_id", "size", "from_", *IN_CLASS).join(heads, IN_CLASS)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*_best_first()))
    ranked = merged.withColumn("rank", rank).where(F.col("rank") <= limit)
    page = ranked.where((F.col("rank") > F.col("from_")) & (F.col("rank") <= F.col("from_") + F.col("size")))
    hits = totals.join(page.select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", "score"), "query_id",
                       "left" if empty_pages else "inner").withColumn("rank", F.col("rank") + F.col("before"))
    ids = req.select("_key", F.col("query_id").alias("_id")).join(first, "_key").select("query_id", "_id")
    return hits.join(ids, "query_id").select(F.col("_id").alias("query_id"), "rank", "doc_id", "score", "total").checkpoint(eager=True)


def explain_records(ann: DataFrame, req: DataFrame, scored: DataFrame) -> DataFrame:
    """R-20: one record per phrase with its parse, entities, constraints,
    derived filters, paging and total hit count (phrases without hits get 0)."""
    totals = scored.groupBy("query_id").agg(F.count(F.lit(1)).alias("total_results"))
    r = req.select("query_id", F.col("text").alias("query_text"), "parsed_query", "brand_f", "category_f",
                   "ingredients_f", "flag_filters", "size", "from_", "page")
    out = ann.select("query_id", "original_query", "normalized_query", "intent", "entities", "filters",
                     "numeric_filters", "modifiers", "recipe_quantities").join(r, "query_id")
    return out.join(totals, "query_id", "left").withColumn(
        "total_results", F.coalesce(F.col("total_results"), F.lit(0)).cast("long"))
