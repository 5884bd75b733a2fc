"""Index-style ranking: analysed terms with positions, BM25 per field,
best-fields combination, phrase / all-terms / fuzzy minimum-should-match
clauses (I-1 .. I-3, R-9 .. R-17).

``text_index`` analyses the documents once and saves, for each document, the
terms of its fields in their order (fields of one text share a list), document
counts, field statistics and the vocabulary.  Postings are derived from the lists
and neighbourhoods from the vocabulary where they are joined; a search reads no
document text but that of the filters.

A long text needs many of its terms in one field (R-12).  In prose, where a term
has hundreds of expansions, nearly every document holds that many, so a search
scores long texts where the lists lie, some documents at a time (``long_texts``):
no row is made for a term of a text and a document, and nothing is exchanged but
the filter columns of the documents and the heads of the pages.  Expansions are
kept by term, not by text.  ``clause_scores`` has the same scores by joins: with
``need`` of ``n`` positions required, a field that matches holds at least ``j`` of
any ``n - need + j`` of them; the rarest ones are counted first, as bits.

Short texts are scored by classes: fields of one kind and length that hold the
terms of the short texts at the same places score alike, so a class is scored
once and its documents take the scores of the texts that match it.  Postings lie
by document: no join or aggregate below exchanges rows of (text, document, term).
A search ranks views of documents, as the tiered one does (``retrieve``): no row
is made for each pair of short text and document.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.fixed_values import (
    AND_MATCH_BOOST,
    BM25_B,
    BM25_K1,
    COMPLETENESS_WEIGHT,
    FIELD_BOOSTS,
    FLAG_NAMES,
    FUZZY_BOOST,
    MODIFIER_BOOST,
    PALM_OIL_FREE_BOOST,
    PHRASE_BOOST,
    SYNONYM_PAIRS,
)
from larder.functions.parse import evaluate_once
from larder.functions.text import analyzed_terms
from larder.operators.joins import broadcast_if_small, spread
from larder.operators.long_texts import long_hits, term_counts
from larder.operators.near_terms import near_terms
from larder.operators.retrieve import CURSOR, REQUEST_COLS, CoreHits, amount, class_counts, class_heads, numeric_ok, side, top_hits, with_core
from larder.session import ensure_checkpoint_dir

# Field -> (document column, synonym expansion at index time).
INDEX_FIELDS = {
    "product_name": ("product_name", True),
    "brand": ("brand", False),
    "category": ("category", True),
    "ingredients": ("ingredients", True),
    "search_text": ("search_text", True),
}
EMPTY = "array<string>"


def field_terms(docs: DataFrame, fields: dict[str, str]) -> DataFrame:
    """(field, doc_id, pos, term) for each analysed term of each field."""
    parts = F.array(*[F.struct(F.lit(f).alias("field"), analyzed_terms(F.col(c)).alias("terms")) for f, c in fields.items()])
    return (docs.select(F.col("id").alias("doc_id"), F.explode(parts).alias("f"))
            .select("f.field", "doc_id", F.posexplode("f.terms").alias("pos", "term")))


def _partner(term, pairs) -> F.Column:
    out = F.lit(None).cast("string")
    for a, b in pairs:
        out = F.when(term == a, F.lit(b)).when(term == b, F.lit(a)).otherwise(out)
    return out


def positional_postings(docs: DataFrame, pairs=SYNONYM_PAIRS) -> DataFrame:
    """I-1/I-3: (field, term, doc_id, dl, tf, positions) with synonym partners
    injected at the same position for the synonym-analysed fields; ``dl`` is the
    number of terms of the field, partners not counted."""
    parts = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(s).alias("syn"), analyzed_terms(F.col(c)).alias("terms"))
                      for f, (c, s) in INDEX_FIELDS.items()])
    # the terms of a document are counted where it lies
    base = (spread(docs, "id").select(F.col("id").alias("doc_id"), F.explode(parts).alias("f"))
            .select("doc_id", "f.field", "f.syn", F.size("f.terms").alias("dl"), F.posexplode("f.terms").alias("pos", "term")))
    term = F.col("term")
    both = F.array_compact(F.array(term, F.when(F.col("syn"), _partner(term, pairs))))
    return (base.select("field", "doc_id", "dl", "pos", F.explode(both).alias("term"))
            .groupBy("field", "term", "doc_id", "dl")
            .agg(F.count(F.lit(1)).alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions")))


# The bit of each field in the sets of fields that share a list of terms.
FIELD_BITS = {f: 1 << i for i, f in enumerate(INDEX_FIELDS)}


def _fields_of(bits) -> F.Column:
    """The fields of a set of bits."""
    return F.get(F.array(*[F.array(*[F.lit(f) for f, b in FIELD_BITS.items() if m & b]).cast(EMPTY)
                           for m in range(1 << len(FIELD_BITS))]), bits)


def _own_terms(texts: DataFrame, pairs) -> DataFrame:
    """(doc_id, lists) of ``texts`` (doc_id, own: the fields' bit, syn, text), a row each: fields of one text share a list."""
    one = F.transform("own", lambda p: F.struct(p["syn"].alias("syn"), p["text"].alias("text")))
    rows = texts.select("doc_id", "own", F.array_distinct(one).alias("one"))
    rows = rows.select("doc_id", F.transform("one", lambda t: F.struct(
        F.aggregate(F.filter("own", lambda p: (p["syn"] == t["syn"]) & (p["text"] == t["text"])), F.lit(0),
                    lambda acc, p: acc.bitwiseOR(p["bit"])).alias("fields"), t["syn"].alias("syn"), analyzed_terms(t["text"]).alias("terms"))).alias("lists"))
    known = F.array(*[F.lit(w) for w in sorted({w for pair in pairs for w in pair})]).cast(EMPTY)

    def partners(terms):
        return F.array_compact(F.transform(terms, lambda t, i: F.concat(i.cast("string"), F.lit("="), _partner(t, pairs))))

    return rows.select("doc_id", F.transform("lists", lambda x: F.struct(
        x["fields"].alias("fields"), F.size(x["terms"]).alias("dl"), F.size(x["terms"]).alias("plain"),
        F.when(x["syn"] & F.arrays_overlap(x["terms"], known), F.concat(x["terms"], partners(x["terms"]))).otherwise(x["terms"]).alias("terms"))
    ).alias("lists"))


def packed(post: DataFrame) -> DataFrame:
    """(doc_id, lists) of postings: every term is listed with its place."""
    lists = post.groupBy("doc_id", "field", "dl").agg(F.flatten(F.collect_list(F.transform(
        "positions", lambda p: F.concat(p.cast("string"), F.lit("="), F.col("term"))))).alias("terms"))
    bit = F.element_at(F.create_map(*[F.lit(x) for f, b in FIELD_BITS.items() for x in (f, b)]), F.col("field"))
    return lists.groupBy("doc_id").agg(F.collect_list(F.struct(
        bit.alias("fields"), F.col("dl").cast("int").alias("dl"), F.lit(0).alias("plain"), "terms")).alias("lists"))


def document_terms(docs: DataFrame, buckets: int, pairs=SYNONYM_PAIRS) -> DataFrame:
    """(doc_id, lists), a row for each id, dealt by it to ``buckets`` tasks.  A list has the ``fields`` (bits) whose terms
    it holds, their length ``dl`` and ``terms``: the first ``plain`` ones at the places 0, 1, ..., others as ``place=term``
    (synonym partners, and all terms where several documents have one id)."""
    parts = F.array(*[F.struct(F.lit(FIELD_BITS[f]).alias("bit"), F.lit(s).alias("syn"), F.col(c).alias("text"))
                      for f, (c, s) in INDEX_FIELDS.items()])
    texts = docs.select(F.col("id").alias("doc_id"), F.filter(parts, lambda p: p["text"] != "").alias("own"))
    twice = docs.groupBy(F.col("id").alias("_id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_id")
    if twice.limit(1).count() == 0:
        return _own_terms(texts.repartition(buckets, "doc_id"), pairs)
    # documents of one id: their terms count together where their fields are of one length
    twice = broadcast_if_small(twice, TERM_BROADCAST_ROWS)
    alone = texts.join(twice, F.col("doc_id").eqNullSafe(F.col("_id")), "left_anti")
    merged = packed(positional_postings(docs.join(twice, F.col("id").eqNullSafe(F.col("_id")), "left_semi"), pairs))
    return _own_terms(alone.repartition(buckets, "doc_id"), pairs).unionByName(merged.repartition(buckets, "doc_id"))


def _entries(texts: DataFrame) -> DataFrame:
    """(doc_id, fields, dl, pos, term): every term of the lists at its place."""
    rows = texts.select("doc_id", F.explode("lists").alias("l")).select(
        "doc_id", "l.fields", "l.dl", "l.plain", F.posexplode("l.terms").alias("pos", "term"))
    marked = F.col("pos") >= F.col("plain")
    return rows.select("doc_id", "fields", "dl",
                       F.when(marked, F.substring_index("term", "=", 1).try_cast("int")).otherwise(F.col("pos")).alias("pos"),
                       F.when(marked, F.expr("substring(term, instr(term, '=') + 1)")).otherwise(F.col("term")).alias("term"))


def _listed_postings(entries: DataFrame) -> DataFrame:
    """Postings (field, term, doc_id, dl, tf, positions) of the terms of lists."""
    return entries.groupBy("doc_id", "fields", "dl", "term").agg(
        F.count(F.lit(1)).alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions")).select(
        F.explode(_fields_of(F.col("fields"))).alias("field"), "term", "doc_id", "dl", "tf", "positions")


def field_stats(texts: DataFrame) -> DataFrame:
    """(field, n_docs, avgdl): documents with the field and mean length in terms."""
    lists = texts.select(F.explode("lists").alias("l")).select("l.fields", "l.dl").where("dl > 0")
    return lists.select(F.explode(_fields_of(F.col("fields"))).alias("field"), "dl").groupBy("field").agg(
        F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))


def vocabulary(texts: DataFrame) -> DataFrame:
    """(term, a column for each field: the documents that hold the term in it)."""
    return term_counts(texts, FIELD_BITS).groupBy("term").agg(*[F.sum(f).alias(f) for f in FIELD_BITS])


def term_stats(vocab: DataFrame) -> DataFrame:
    """(field, term, df) of ``vocabulary``."""
    each = F.array(*[F.struct(F.lit(f).alias("field"), "term", F.col(f).alias("df")) for f in FIELD_BITS])
    return vocab.select(F.explode(each).alias("t")).select("t.*").where("df > 0")


@dataclass
class TextIndex:
    postings: DataFrame  # field, term, doc_id, dl, tf, positions
    terms: DataFrame     # field, term, df
    stats: DataFrame     # field, n_docs, avgdl
    near: DataFrame      # key, vterm
    pairs: list = field(default_factory=lambda: SYNONYM_PAIRS)
    texts: DataFrame | None = None  # doc_id, lists: where there are none, they are derived from the postings
    vocab: DataFrame | None = None  # term: where there is none, expansions are found by ``near``

    def lists(self) -> DataFrame:
        return packed(self.postings) if self.texts is None else self.texts

    def expansions(self, qterms: DataFrame) -> DataFrame:
        """(term, vterm) of ``fuzzy_expansions``."""
        if self.vocab is None:
            return fuzzy_expansions(qterms, self.near)
        # few terms are long; their segments are joined
        long = vocabulary_keys(self.vocab.where(F.length("term") > DELETION_MAX_LEN))
        return near_terms(qterms, self.vocab, DELETION_MAX_LEN).unionByName(fuzzy_expansions(qterms, long))


def text_index(docs: DataFrame, buckets: int | None = None, pairs=SYNONYM_PAIRS) -> TextIndex:
    """I-3: analyses ``docs`` once; every table is written in the shared folder, the terms bucketed by document."""
    from larder.plans.index import bucket_count, bucketed_table, saved_table
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    n = buckets or bucket_count(docs)
    texts = bucketed_table(spark, document_terms(docs, n, pairs), "doc_id", n, "terms", dealt=True)
    vocab = saved_table(vocabulary(texts), "vocabulary")
    # the keys are many times the vocabulary: they are derived where a search joins them, and not saved
    near = vocabulary_keys(spread(vocab.select("term"), "term"))
    return TextIndex(_listed_postings(_entries(texts)), term_stats(vocab), field_stats(texts).checkpoint(eager=True), near, pairs, texts,
                     vocab.select("term"))


# Rows of query terms above this many are joined by shuffle instead of broadcast (about 100 bytes each).
TERM_BROADCAST_ROWS = 1_000_000
# Texts that need fewer positions than this are joined to all their postings at once.
PRUNE_NEED = 4
_BITS = 60


@dataclass
class TextPlan:
    """What a batch of texts asks for.  ``places``: a row for each term of a text and field that can match (query_id, nw, nq,
    qpos, term, field, reach, probed); ``near``: the expansions of the terms (term, vterm); ``weights``: of these in each
    field (field, vterm, df, avgdl, idf)."""
    places: DataFrame
    near: DataFrame
    weights: DataFrame

    def terms(self, where: str = "true") -> DataFrame:
        """A row for each place, field and expansion: query_id, nw, nq, qpos, term, exact, field, avgdl, idf, reach, probed."""
        q = self.places.where(where).join(self.near, "term").withColumn("exact", F.col("term") == F.col("vterm")).drop("term")
        return q.join(self.weights.drop("df"), ["field", "vterm"]).withColumnRenamed("vterm", "term")


def text_plan(req: DataFrame, index: TextIndex) -> TextPlan:
    """Query terms with their expansions, without fields that can't match: ``need`` positions are required, ``probed`` ones
    (the rarest) are counted first and ``reach`` of them required."""
    from larder.plans.index import saved_table
    # the minimum counts the words of the text, which may hold several terms
    q = req.where(F.col("text") != "").select(
        "query_id", F.size(F.split(F.trim("text"), r"\s+")).alias("nw"), analyzed_terms(F.col("text")).alias("terms"))
    q = q.select("query_id", "nw", F.size("terms").alias("nq"), F.posexplode("terms").alias("qpos", "term")).checkpoint(eager=True)
    near = saved_table(index.expansions(q), "near")
    found = broadcast_if_small(near.select(F.col("vterm").alias("term")).distinct(), TERM_BROADCAST_ROWS)
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = saved_table(index.terms.join(found, "term", "left_semi").join(F.broadcast(index.stats), "field").select(
        "field", F.col("term").alias("vterm"), "df", "avgdl", idf.alias("idf")), "weights")
    cost = near.join(weights, "vterm").groupBy("term", "field").agg(F.sum("df").alias("df"))
    q = q.join(broadcast_if_small(cost, TERM_BROADCAST_ROWS), "term").checkpoint(eager=True)
    need = F.least(tiered_minimum_should_match(F.col("nw")), F.col("nq"))
    per_field = Window.partitionBy("query_id", "field")
    places = q.groupBy("query_id", "field", "nw", "nq", "qpos").agg(F.sum("df").alias("cost"))
    places = places.withColumn("present", F.count(F.lit(1)).over(per_field)).withColumn("need", need).where("present >= need")
    places = places.withColumn("place", F.row_number().over(per_field.orderBy("cost", "qpos")))
    reach = F.floor(F.col("need") / 2).cast("int")
    places = places.withColumn("reach", F.when(F.col("need") >= PRUNE_NEED, reach))
    probed = F.col("place") <= F.col("present") - F.col("need") + F.col("reach")
    places = q.drop("df").join(places.select("query_id", "field", "qpos", "reach", F.coalesce(probed, F.lit(False)).alias("probed")),
                               ["query_id", "field", "qpos"]).checkpoint(eager=True)
    return TextPlan(places, near, weights)


def _planned_terms(req: DataFrame, index: TextIndex) -> DataFrame:
    """The rows of ``TextPlan.terms``."""
    return text_plan(req, index).terms().checkpoint(eager=True)


def matching_postings(req: DataFrame, index: TextIndex) -> DataFrame:
    """A row for each query term and posting that can count: all of them for short texts, those of the documents
    that hold enough rare terms for long ones."""
    q = _planned_terms(req, index)
    few = broadcast_if_small(q.where("reach IS NULL").select("field", "term", *TERM_COLS), TERM_BROADCAST_ROWS)
    return index.postings.join(few, ["field", "term"]).select(*HIT_COLS).unionByName(_long_postings(q.where("reach IS NOT NULL"), index))


TERM_COLS = ["query_id", "nw", "nq", "qpos", "exact", "avgdl", "idf"]
HIT_COLS = ["query_id", "doc_id", "field", "nw", "nq", "qpos", "exact", "avgdl", "idf", "dl", "tf", "positions"]


def _long_postings(many: DataFrame, index: TextIndex) -> DataFrame:
    """``matching_postings`` of the long texts."""
    # the postings are bucketed by document: with broadcast terms, nothing is exchanged up to the candidates
    rare = broadcast_if_small(many.where("probed").select("field", "term", "query_id", "reach", "qpos"), TERM_BROADCAST_ROWS)
    bits = index.postings.select("field", "term", "doc_id").join(rare, ["field", "term"]).groupBy(
        "doc_id", "query_id", "field", "reach", F.floor(F.col("qpos") / _BITS).alias("block")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, qpos % {_BITS})")).alias("held"))
    cands = bits.groupBy("doc_id", "query_id", "field", "reach").agg(F.sum(F.bit_count("held")).alias("n")).where("n >= reach")
    wanted = broadcast_if_small(many.select("field", "term").distinct(), TERM_BROADCAST_ROWS)
    theirs = index.postings.join(wanted, ["field", "term"], "left_semi").withColumnRenamed("field", "_field")
    # by document alone, so that both sides keep their places
    met = cands.select("doc_id", "query_id", "field").join(theirs, "doc_id").where(F.col("field") == F.col("_field")).drop("_field")
    terms = broadcast_if_small(many.select("field", "term", *TERM_COLS), TERM_BROADCAST_ROWS)
    return met.join(terms, ["query_id", "field", "term"]).select(*HIT_COLS)


def _field_classes(few: DataFrame, index: TextIndex) -> DataFrame:
    """(doc_id, field, class, held): for each field of a document the postings of the terms of ``few`` in it; fields with
    the same ones are of a class."""
    wanted = broadcast_if_small(few.select("field", "term").distinct(), TERM_BROADCAST_ROWS)
    post = index.postings
    if index.texts is not None:  # only the terms that are wanted are gathered
        post = _listed_postings(_entries(index.texts).join(broadcast_if_small(few.select("term").distinct(), TERM_BROADCAST_ROWS), "term", "left_semi"))
    held = post.join(wanted, ["field", "term"], "left_semi").groupBy("doc_id", "field").agg(
        F.sort_array(F.collect_list(F.struct("term", "dl", "tf", "positions"))).alias("held"))
    return held.withColumn("class", F.sha2(F.to_json(F.struct("field", "held")), 256))


def _class_scores(few: DataFrame, index: TextIndex, k1: float, b: float) -> tuple[DataFrame, DataFrame]:
    """The fields' classes (doc_id, class) and (class, query_id, phrase, all_terms, fuzzy) of the short texts that match them."""
    own = _field_classes(few, index)
    classes = own.groupBy("class").agg(F.first("field").alias("field"), F.first("held").alias("held")).select(
        F.monotonically_increasing_id().alias("no"), "class", "field", "held").checkpoint(eager=True)
    rows = spread(classes.drop("class"), "no").select("no", "field", F.explode("held").alias("h")).select("no", "field", "h.*")
    # matches are counted as bits, without positions; only what matches is scored
    n = F.least(tiered_minimum_should_match(F.col("nw")), F.col("nq")).alias("need")
    asked = broadcast_if_small(few.select("field", "term", "query_id", n, "qpos"), TERM_BROADCAST_ROWS)
    bits = rows.select("no", "field", "term").join(asked, ["field", "term"]).groupBy(
        "no", "query_id", "need", F.floor(F.col("qpos") / _BITS).alias("block")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, qpos % {_BITS})")).alias("held"))
    matched = bits.groupBy("no", "query_id", "need").agg(F.sum(F.bit_count("held")).alias("n")).where("n >= need").select(
        F.col("no").alias("_no"), "query_id")
    terms = broadcast_if_small(few.select("field", "term", *TERM_COLS), TERM_BROADCAST_ROWS)
    # by class alone, so that both sides keep their places
    hits = rows.join(matched, F.col("no") == F.col("_no")).drop("_no").join(terms, ["query_id", "field", "term"])
    scores = _field_scores(hits, "no", k1, b).join(classes.select("no", "class"), "no").drop("no").checkpoint(eager=True)
    return own.select("doc_id", "class"), scores


def _short_scores(few: DataFrame, index: TextIndex, k1: float, b: float) -> DataFrame:
    """(query_id, doc_id, phrase, all_terms, fuzzy) of the short texts and each field that matches one."""
    own, scores = _class_scores(few, index, k1, b)
    return own.join(broadcast_if_small(scores, TERM_BROADCAST_ROWS), "class").drop("class")


def tiered_minimum_should_match(n) -> F.Column:
    """R-12: 1 for one term, 2 for two, else max(2, n // 2 + 1)."""
    return F.when(n <= 1, 1).when(n == 2, 2).otherwise(F.greatest(F.lit(2), F.floor(n / 2) + 1)).cast("int")


def clause_scores(req: DataFrame, index: TextIndex, k1: float = BM25_K1, b: float = BM25_B) -> DataFrame:
    """Text requests -> (query_id, doc_id, phrase, all_terms, fuzzy): the best
    field's boost x BM25 for each clause, NULL where it doesn't match.

    * ``phrase``: all terms at neighbouring positions;
    * ``all_terms``: every term as it is;
    * ``fuzzy`` (R-11 .. R-13): at least the minimum of terms, each within its
      edit distance; of a term's expansions the best one counts."""
    q = _planned_terms(req, index)
    short = _short_scores(q.where("reach IS NULL"), index, k1, b)
    long = _field_scores(_long_postings(q.where("reach IS NOT NULL"), index), "doc_id", k1, b)
    best = [F.max(c).alias(c) for c in ("phrase", "all_terms", "fuzzy")]
    # a text is short or long
    return short.groupBy("query_id", "doc_id").agg(*best).unionByName(long.groupBy("query_id", "doc_id").agg(*best))


def _field_scores(hits: DataFrame, unit: str, k1: float, b: float) -> DataFrame:
    """(query_id, unit, phrase, all_terms, fuzzy) for each field of a unit (document or class) that matches a clause."""
    hits = hits.withColumn("norm", k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    hits = hits.withColumn("s", F.col("idf") * F.col("tf") / (F.col("tf") + F.col("norm")))

    def exact(c):
        return F.max(F.when(F.col("exact"), F.col(c)))

    per_pos = hits.groupBy("query_id", unit, "field", "nw", "nq", "qpos").agg(
        F.max("s").alias("any_s"), exact("s").alias("s"), exact("idf").alias("idf"), exact("positions").alias("positions"),
        F.max("norm").alias("norm"))
    starts = F.transform("positions", lambda p: p - F.col("qpos"))
    per_field = per_pos.groupBy("query_id", unit, "field", "nw", "nq").agg(
        F.sum("any_s").alias("any_s"), F.count(F.lit(1)).alias("any_n"), F.sum("s").alias("s"), F.count("s").alias("n"),
        F.sum("idf").alias("idf"), F.max("norm").alias("norm"), F.collect_list(starts).alias("starts"))
    common = F.aggregate(F.slice("starts", 2, F.greatest(F.size("starts") - 1, F.lit(0))), F.get("starts", 0),
                         lambda acc, s: F.array_intersect(acc, s))
    per_field = per_field.withColumn("pf", F.when(F.col("n") == F.col("nq"), F.size(common)).otherwise(0))
    boosts = F.create_map(*[x for f, v in FIELD_BOOSTS.items() for x in (F.lit(f), F.lit(v))])
    boost = F.element_at(boosts, F.col("field"))
    return per_field.select(
        "query_id", unit,
        F.when(F.col("pf") > 0, boost * F.col("idf") * F.col("pf") / (F.col("pf") + F.col("norm"))).alias("phrase"),
        F.when(F.col("n") == F.col("nq"), boost * F.col("s")).alias("all_terms"),
        F.when(F.col("any_n") >= tiered_minimum_should_match(F.col("nw")), boost * F.col("any_s")).alias("fuzzy")).where(
        F.coalesce("phrase", "all_terms", "fuzzy").isNotNull())


def _holds_terms(field: str, text: str, wanted: str, pairs) -> F.Column:
    """Whether each term of the filter is a term of the field (or, in fields
    with synonyms, the partner of one); a filter without terms holds nowhere."""
    have, want = analyzed_terms(F.col(text)), analyzed_terms(F.col(wanted))
    partner = INDEX_FIELDS[field][1]
    each = F.forall(want, lambda t: F.array_contains(have, t) | (
        F.coalesce(F.array_contains(have, _partner(t, pairs)), F.lit(False)) if partner else F.lit(False)))
    return F.col(wanted).isNull() | ((F.size(want) > 0) & each)


def term_filters_ok(pairs=SYNONYM_PAIRS) -> F.Column:
    """P-1 .. P-8 of the index: brand, category and ingredient filters by terms
    in any order, flags and numbers as in the tiered search."""
    ok = (_holds_terms("brand", "brand_l", "brand_f", pairs) & _holds_terms("category", "cat_l", "category_f", pairs)
          & _holds_terms("ingredients", "ing_l", "ingredients_f", pairs))
    for f in FLAG_NAMES:
        want = F.col(f"flag_filters.{f}")
        ok = ok & (want.isNull() | (F.col(f"flags.{f}") == want))
    # a test of the size is cheaper than a walk over no filters
    return ok & F.when(F.size("numeric_filters") == 0, True).otherwise(numeric_ok(F.col("numeric_filters"), F.col("nutrition")))


CLAUSES = ("phrase", "all_terms", "fuzzy")


def _base_score() -> F.Column:
    """The score without completeness."""
    text_score = sum((F.coalesce(F.col(c) * w, F.lit(0.0)) for c, w in zip(CLAUSES, (PHRASE_BOOST, AND_MATCH_BOOST, FUZZY_BOOST))), F.lit(0.0))
    mods = F.when(F.size("modifiers") == 0, 0.0).otherwise(F.aggregate(F.col("modifiers"), F.lit(0.0), lambda acc, m: acc + F.when(
        F.exists(analyzed_terms(F.col("name_l")), lambda t: t == F.lower(m)), F.lit(MODIFIER_BOOST)).otherwise(0.0)))
    palm = F.when(F.col("flag_filters.is_palm_oil_free") & F.col("flags.is_palm_oil_free"),
                  F.lit(PALM_OIL_FREE_BOOST)).otherwise(F.lit(0.0))
    return text_score + mods + palm


def _asked_terms(req: DataFrame, pairs) -> DataFrame:
    """One row: for each field that filters or modifiers read, the terms that matter to some request."""
    def terms(of):
        return F.array_distinct(F.flatten(F.collect_set(of)))

    def with_partners(field, f):
        mine = analyzed_terms(F.col(f))
        return terms(F.concat(mine, F.array_compact(F.transform(mine, lambda t: _partner(t, pairs)))) if INDEX_FIELDS[field][1] else mine)

    return req.agg(F.struct(terms(F.transform("modifiers", lambda m: F.lower(m))).alias("name_l"), with_partners("brand", "brand_f").alias("brand_l"),
                            with_partners("category", "category_f").alias("cat_l"),
                            with_partners("ingredients", "ingredients_f").alias("ing_l")).alias("asked")).checkpoint(eager=True)


def filter_columns(req: DataFrame, search_tbl: DataFrame, pairs) -> DataFrame:
    """The columns that filters and modifiers read, of the texts only the terms that some request asks for."""
    rows = evaluate_once(search_tbl.select("doc_id", "name_l", "brand_l", "cat_l", "ing_l", "flags", "nutrition", "completeness"),
                         "_asked", _asked_terms(req, pairs).scalar())

    def held(c):
        return F.when(F.size(F.col(f"_asked.{c}")) > 0, F.array_join(F.array_sort(
            F.array_intersect(analyzed_terms(F.col(c)), F.col(f"_asked.{c}"))), " ")).otherwise("")

    return rows.withColumns({c: held(c) for c in ("name_l", "brand_l", "cat_l", "ing_l")}).drop("_asked")


def _view_hits(req: DataFrame, few: DataFrame, index: TextIndex, search_tbl: DataFrame, kept: F.Column) -> CoreHits:
    """Short texts by views of documents: those whose fields are of the same classes and hold the same terms that filters or
    modifiers ask for, with the same flags and on the same side of every bound, differ in completeness and id alone."""
    own, scores = _class_scores(few, index, BM25_K1, BM25_B)
    matched = broadcast_if_small(scores.select("class").distinct().checkpoint(eager=True), TERM_BROADCAST_ROWS)
    sets = own.join(matched, "class", "left_semi").groupBy("doc_id").agg(F.sort_array(F.collect_set("class")).alias("classes"))
    sets = sets.withColumn("set", F.sha2(F.concat_ws(",", "classes"), 256))
    bounds = with_core(req).select(F.explode("limits").alias("l")).select("l.*").groupBy("nutrient", "per_100g").agg(
        F.sort_array(F.collect_set("value")).alias("bounds"))
    bounds = bounds.agg(F.sort_array(F.collect_list(F.struct("nutrient", "per_100g", "bounds"))).alias("keys")).checkpoint(eager=True)
    # no text is exchanged: the terms that matter are taken out of it first
    rows = evaluate_once(filter_columns(req, search_tbl, index.pairs).join(sets, "doc_id"), "_keys", bounds.scalar())
    rows = rows.withColumn("_seen", F.transform("_keys", amount)).withColumn(
        "_sides", F.transform("_keys", lambda k, i: side(k["bounds"], F.get("_seen", i))))
    same = F.sha2(F.to_json(F.struct("set", "name_l", "brand_l", "cat_l", "ing_l", "flags", "_sides"), {"ignoreNullFields": "false"}), 256)
    seen = ["set", "classes", "name_l", "brand_l", "cat_l", "ing_l", "flags", "nutrition"]
    rows = rows.select("doc_id", "completeness", same.alias("view"), *seen).persist(StorageLevel.MEMORY_AND_DISK)
    views = rows.groupBy("view").agg(*[F.first(c).alias(c) for c in seen], F.count(F.lit(1)).alias("n"),
                                     F.min("completeness").alias("low"), F.max("completeness").alias("high")).checkpoint(eager=True)
    in_sets = views.groupBy("set").agg(F.first("classes").alias("classes")).select("set", F.explode("classes").alias("class"))
    h = in_sets.join(scores, "class").groupBy("set", "query_id").agg(*[F.max(c).alias(c) for c in CLAUSES]).where(kept)
    met = h.join(views.drop("classes"), "set").join(req, "query_id").where(term_filters_ok(index.pairs))
    pairs = met.select(F.col("query_id").alias("core"), "view", _base_score().alias("base"), F.lit(1).alias("copies"), "n", "low", "high",
                       F.lit(0).alias("flag_bits"), F.array().cast("array<int>").alias("sides"), F.array().cast("array<double>").alias("amounts"),
                       *[F.lit(None).cast(t).alias(c) for c, t in CURSOR.items()])
    return CoreHits(pairs.checkpoint(eager=True), rows, False)


def _view_page(req: DataFrame, hits: CoreHits, limit: int) -> DataFrame:
    """``top_hits`` of the views."""
    heads = class_heads(hits, limit).select(F.col("core").alias("query_id"), "doc_id", "score")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id"))
    page = heads.withColumn("rank", rank).join(req.select("query_id", "size", "from_"), "query_id").where(
        (F.col("rank") > F.col("from_")) & (F.col("rank") <= F.col("from_") + F.col("size")))
    totals = class_counts(hits).select(F.col("core").alias("query_id"), F.col("n").alias("total"))
    out = page.join(totals, "query_id").select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", "score", "total")
    out = out.checkpoint(eager=True)
    hits.rows.unpersist()
    return out


def bm25_search(req: DataFrame, index: TextIndex, search_tbl: DataFrame, limit: int | None = None,
                clause: str | None = None) -> DataFrame:
    """Filtered BM25 ranking of text requests (R-9 .. R-17): 10 x phrase + 5 x
    all terms + 0.5 x fuzzy, plus modifiers in the name, the palm-oil-free flag
    and completeness.  ``clause`` = 'phrase', 'and' or 'fuzzy' keeps the
    documents that match that clause."""
    req = req.select(*REQUEST_COLS).checkpoint(eager=True)
    if limit is None:
        limit = req.agg(F.max(F.col("from_") + F.col("size"))).first()[0] or 0
    column = {"phrase": "phrase", "and": "all_terms", "fuzzy": "fuzzy"}
    kept = F.col(column[clause]).isNotNull() if clause else F.coalesce(*CLAUSES).isNotNull()
    # sums of a row meet in any order: rounding makes equal scores equal, so that ties go by id
    plan = text_plan(req, index)
    many = plan.places.where("reach IS NOT NULL")
    few = plan.terms("reach IS NULL").checkpoint(eager=True)
    long = many.limit(1).count() > 0
    if long and few.limit(1).count() == 0:
        return _long_page(req, plan, many, index, search_tbl, kept, limit)
    short = _view_page(req, _view_hits(req, few, index, search_tbl, kept), limit)
    return short.unionByName(_long_page(req, plan, many, index, search_tbl, kept, limit)) if long else short


def _long_page(req: DataFrame, plan: TextPlan, many: DataFrame, index: TextIndex, search_tbl: DataFrame, kept: F.Column, limit: int) -> DataFrame:
    """The pages of the long texts (``many`` of the places): scored where the lists of terms lie, with the columns of the
    filters beside them.  What shares an id with others, of other texts or lengths of a field, is scored by joins."""
    own = filter_columns(req, search_tbl, index.pairs)
    # an id of several texts is one query whose places have several terms
    mixed = many.groupBy("query_id", "field", "qpos").agg(
        F.count_distinct("term").alias("n"), F.count_distinct("nw", "nq").alias("m")).where("n > 1 OR m > 1").select("query_id").distinct()
    mixed = mixed.checkpoint(eager=True)
    # an id of several documents may have several lists of a field
    bits = [F.aggregate("lists.fields", F.lit(0), f) for f in (lambda a, x: a + F.bit_count(x), lambda a, x: a.bitwiseOR(x))]
    merged = F.coalesce(bits[0] > F.bit_count(bits[1]), F.lit(False))
    lists = index.lists()
    h = long_hits(many.join(F.broadcast(mixed), "query_id", "left_anti"), plan.near, plan.weights,
                  lists.where(~merged).join(own.hint("shuffle_hash"), "doc_id"), FIELD_BITS, FIELD_BOOSTS, BM25_K1, BM25_B)

    def by_joins(terms, ix):
        return _field_scores(_long_postings(terms.checkpoint(eager=True), ix), "doc_id", BM25_K1, BM25_B).groupBy("query_id", "doc_id").agg(
            *[F.max(c).alias(c) for c in CLAUSES]).join(own, "doc_id")

    terms = plan.terms("reach IS NOT NULL")
    if mixed.limit(1).count():
        h = h.unionByName(by_joins(terms.join(F.broadcast(mixed), "query_id", "left_semi"), index))
    if lists.where(merged).limit(1).count():
        few = replace(index, postings=_listed_postings(_entries(lists.where(merged))))
        h = h.unionByName(by_joins(terms.join(F.broadcast(mixed), "query_id", "left_anti"), few))
    rows = h.where(kept).join(broadcast_if_small(req, TERM_BROADCAST_ROWS), "query_id").where(term_filters_ok(index.pairs))
    score = _base_score() + F.col("completeness") * COMPLETENESS_WEIGHT
    return top_hits(rows.select("query_id", "doc_id", "size", "from_", F.round(score, 6).alias("score")), limit, settle=True)


# ------------------------------------------------------------------ R-13 fuzzy
def auto_fuzziness(term) -> F.Column:
    """R-13 AUTO: 0 edits for 1-2 characters, 1 for 3-5, 2 above."""
    n = F.length(term)
    return F.when(n <= 2, 0).when(n <= 5, 1).otherwise(2)


def deletions(word, max_del: int = 2) -> F.Column:
    """The word and every string obtained by deleting up to ``max_del``
    characters (the delete neighbourhood); distinct."""
    n = F.length(word)
    one = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
                      lambda i: F.concat(F.substring(word, 1, i - 1), F.substring(word, i + 1, n)))
    one = F.when(n >= 1, one).otherwise(F.array().cast("array<string>"))
    two = F.flatten(F.transform(one, lambda w: F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))),
        lambda i: F.concat(F.substring(w, 1, i - 1), F.substring(w, i + 1, n)))))
    parts = [F.array(word), one] + ([F.when(n >= 2, two).otherwise(F.array().cast("array<string>"))]
                                    if max_del >= 2 else [])
    return F.array_distinct(F.concat(*parts))


def osa_distance(a, b) -> F.Column:
    """Edit distance in which swapping two neighbours is one edit and no part
    is edited twice, by the row-wise recurrence: the fold keeps the last two
    rows of the table and the character before."""
    width = F.length(b)
    chars = F.transform(F.sequence(F.lit(1), F.greatest(width, F.lit(1))), lambda j: F.substring(b, j, 1))
    start = F.sequence(F.lit(0), width)

    def row(state, i):
        c = F.substring(a, i, 1)

        def cell(done, j):
            same = F.element_at(chars, j) == c
            best = F.least(F.element_at(state["last"], j + 1) + 1, F.element_at(done, -1) + 1,
                           F.element_at(state["last"], j) + F.when(same, 0).otherwise(1))
            swapped = (i > 1) & (j > 1) & (F.try_element_at(chars, j - 1) == c) & (F.element_at(chars, j) == state["before"])
            return F.concat(done, F.array(F.when(swapped, F.least(
                best, F.try_element_at(state["older"], F.greatest(j - 1, F.lit(1))) + 1)).otherwise(best)))

        cells = F.aggregate(F.sequence(F.lit(1), width), F.array(i), cell)
        return F.struct(cells.alias("last"), state["last"].alias("older"), c.alias("before"))

    first = F.struct(start.alias("last"), start.alias("older"), F.lit("").alias("before"))
    full = F.aggregate(F.sequence(F.lit(1), F.length(a)), first, row, lambda s: F.element_at(s["last"], -1))
    return F.when((F.length(a) > 0) & (width > 0), full).otherwise(F.greatest(F.length(a), width))


def osa_within(a, b, k) -> F.Column:
    """Whether the distance is at most ``k`` (2 at most).  Without swaps a
    distance is never smaller, and at most twice as large: most pairs are
    settled by the built-in one."""
    plain = F.levenshtein(a, b, 4)
    # each edit that the plain distance exceeds k by is a swap; what is left may change letters
    left = 2 * k - plain
    letters = [F.array_join(F.sort_array(F.split(w, "")), "") for w in (a, b)]
    return (F.when((plain < 0) | (left < 0), False).when(plain <= k, True)
            .when(F.abs(F.length(a) - F.length(b)) > left, False).when(F.levenshtein(*letters) > 2 * left, False)
            .otherwise(osa_distance(a, b) <= k))


# Vocabulary terms up to this length are found by deletions, longer ones by segments.
DELETION_MAX_LEN = 16
SEGMENTS = 5


def _segment_keys(length, word, shifts, n) -> F.Column:
    """Keys (length, segment, text) of the segments of a word of ``length``, read from ``word`` (of ``n`` characters)
    at their places moved by each of ``shifts``."""
    def at(i, shift):
        start, stop = F.floor(length * i / SEGMENTS), F.floor(length * (i + 1) / SEGMENTS)
        return F.when((start + shift >= 0) & (stop + shift <= n), F.concat_ws(
            ":", length.cast("string"), i.cast("string"), F.substring(word, (start + shift + 1).cast("int"), (stop - start).cast("int"))))
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(SEGMENTS - 1)), lambda i: F.array_compact(
        F.transform(shifts, lambda d: at(i, d)))))


def _cuts(spark) -> DataFrame:
    """(n, a, b): the places left out of a term of ``n`` characters for each key; those past its end leave out nothing."""
    n = spark.range(1, DELETION_MAX_LEN + 1, 1, 1).select(F.col("id").cast("int").alias("n"))
    a = n.select("n", F.explode(F.sequence(F.lit(1), F.when(F.col("n") > 1, F.col("n") + 1).otherwise(2))).alias("a")).where("n > 1 OR a = 2")
    b = F.when((F.col("n") > 3) & (F.col("a") < F.col("n")), F.sequence(F.col("a") + 1, F.col("n"))).otherwise(F.array().cast("array<int>"))
    return a.select("n", "a", F.explode(F.concat(b, F.array(F.col("n") + 2))).alias("b"))


def vocabulary_keys(vocab: DataFrame) -> DataFrame:
    """(key, vterm): the keys by which query terms find a term.  Terms up to
    ``DELETION_MAX_LEN`` have their delete neighbourhood, as deep as any query
    term of a near length may go; longer ones have five segments, of which two
    edits (a swap touches two at most) leave one whole, moved by two at most."""
    t = F.col("term")
    # a key a row, by a join with the places that are left out: arrays of keys would be built for each term
    key = F.expr("concat(substring(term, 1, a - 1), substring(term, a + 1, b - a - 1), substring(term, b + 1, n))")
    short = vocab.join(F.broadcast(_cuts(vocab.sparkSession)), F.length(t) == F.col("n")).select(key.alias("key"), t.alias("vterm"))
    n = F.length(t)
    long = vocab.where(n > DELETION_MAX_LEN).select(F.explode(_segment_keys(n, t, F.array(F.lit(0)), n)).alias("key"), t.alias("vterm"))
    return short.unionByName(long)


def fuzzy_expansions(qterms: DataFrame, near: DataFrame) -> DataFrame:
    """(term, vterm) pairs with OSA(term, vterm) <= AUTO(term): the query terms'
    keys join ``near`` (``vocabulary_keys``), then every pair is verified
    exactly.  No cap on expansions."""
    q = qterms.select("term").distinct().withColumn("k", auto_fuzziness(F.col("term")))
    t, k = F.col("term"), F.col("k")
    n = F.length(t)
    none = F.array().cast(EMPTY)
    short = (F.when(n - k > DELETION_MAX_LEN, none).when(k == 0, F.array(t)).when(k == 1, deletions(t, 1))
             .otherwise(deletions(t, 2)))
    long = F.when(n + k > DELETION_MAX_LEN, F.flatten(F.transform(
        F.sequence(F.greatest(n - k, F.lit(DELETION_MAX_LEN + 1)), n + k),
        lambda length: _segment_keys(length, t, F.sequence(-k, k), n)))).otherwise(none)
    keys = q.select("term", "k", F.explode(F.array_distinct(F.concat(short, long))).alias("key"))
    pairs = near.join(broadcast_if_small(keys, TERM_BROADCAST_ROWS), "key")
    pairs = pairs.select("term", "k", "vterm").distinct()
    return pairs.where((F.abs(F.length("term") - F.length("vterm")) <= F.col("k"))
                       & osa_within(F.col("term"), F.col("vterm"), F.col("k"))).select("term", "vterm")


def fuzzy_search(req: DataFrame, index: TextIndex, search_tbl: DataFrame, limit: int | None = None) -> DataFrame:
    """The documents that match the fuzzy clause, in the order of ``bm25_search``."""
    return bm25_search(req, index, search_tbl, limit, "fuzzy")
