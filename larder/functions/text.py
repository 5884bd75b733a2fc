"""Text column expressions: normalisation, tokens, n-grams, synonyms (Q-1 .. Q-8, L-6)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from larder.fixed_values import EDGE_NGRAM_MAX, EDGE_NGRAM_MIN, MAX_NGRAM, SYNONYM_PAIRS
from larder.functions.parse import _WS_CLASS, col_, collapse_ws, py_strip

# Python's \w on str patterns = alphanumerics of every script plus '_'.
_NOT_WORD_SPACE_HYPHEN = rf"[^\p{{L}}\p{{N}}_{_WS_CLASS[1:-1]}\-]"
_NOT_WORD_SPACE_HYPHEN_DOT = rf"[^\p{{L}}\p{{N}}_{_WS_CLASS[1:-1]}\-\.]"


# Punctuation of numbers: '.' and '/' between digits, '<', '<=', '>' and '>=' before one.
_NOT_WORD_SPACE_HYPHEN_NUMERIC = (rf"(?!(?<=\d)[./](?=\d)|[<>](?=\s*=?\s*\d)|(?<=[<>])=(?=\s*\d)){_NOT_WORD_SPACE_HYPHEN}")


def normalize_phrase(c, keep_numeric_punct: bool = False) -> Column:
    """Q-1: lower-case, drop everything but word chars, whitespace and '-',
    collapse whitespace, trim.  ``keep_numeric_punct`` keeps '2.5', '1/2' and
    '< 5' as they are, for the bounds and quantities of Q-10 and Q-11."""
    c = F.lower(F.coalesce(col_(c), F.lit("")))
    return collapse_ws(F.regexp_replace(c, _NOT_WORD_SPACE_HYPHEN_NUMERIC if keep_numeric_punct else _NOT_WORD_SPACE_HYPHEN, ""))


def autocomplete_clean(c) -> Column:
    """Q-2: like Q-1 but keeps '.', no lower-casing."""
    c = F.coalesce(col_(c), F.lit(""))
    return collapse_ws(F.regexp_replace(c, _NOT_WORD_SPACE_HYPHEN_DOT, ""))


def tokenize(c) -> Column:
    """Q-3: whitespace tokens, '' -> []."""
    s = py_strip(col_(c))
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, rf"{_WS_CLASS}+"))


def ngrams(tokens, max_n: int = MAX_NGRAM) -> Column:
    """Q-4: word n-grams 1..max_n as array<struct<text, n, pos>> ordered by
    character length desc, then n asc, then position asc."""
    tokens = col_(tokens)
    size = F.size(tokens)
    per_n = F.transform(
        F.sequence(F.lit(1), F.least(F.lit(max_n), size)),
        lambda n: F.transform(
            F.sequence(F.lit(0), size - n),
            lambda i: F.struct(
                F.array_join(F.slice(tokens, i + 1, n), " ").alias("text"),
                n.alias("n"),
                i.alias("pos"),
            ),
        ),
    )
    flat = F.when(size > 0, F.flatten(per_n)).otherwise(
        F.array().cast("array<struct<text:string,n:int,pos:int>>"))
    keyed = F.transform(flat, lambda g: F.struct(
        (-F.length(g["text"])).alias("neg_len"), g["n"].alias("n"), g["pos"].alias("pos"), g["text"].alias("text")))
    return F.transform(F.array_sort(keyed), lambda g: F.struct(g["text"].alias("text"), g["n"].alias("n"),
                                                                g["pos"].alias("pos")))


def _variant_regex(words: list[str]) -> str:
    alts = "|".join(re.escape(w) for w in sorted(set(words), key=len, reverse=True))
    return rf"(?iU)\b(?:{alts})\b"


def canonicalize(c, pairs=SYNONYM_PAIRS) -> Column:
    """Q-8: rewrite synonym variants to their canonical head, whole words only,
    case-insensitive (the replacement is the lower-case head).  One combined
    test first, so text without any synonym word costs a single regex scan."""
    src = col_(c)
    out = src
    for head, variant in pairs:
        out = F.regexp_replace(out, _variant_regex([head, variant]), head)
    every = [w for pair in pairs for w in pair]
    return F.when(src.rlike(_variant_regex(every)), out).otherwise(src)


def synonym_variants(token, pairs=SYNONYM_PAIRS) -> Column:
    """Q-7: the token plus its synonym partners, sorted and distinct."""
    token = col_(token)
    partners = [F.when(token == a, F.lit(b)).when(token == b, F.lit(a)) for a, b in pairs]
    arr = F.array(token, *partners)
    return F.array_sort(F.array_distinct(F.filter(arr, lambda x: x.isNotNull())))


def edge_ngrams(word, lo: int = EDGE_NGRAM_MIN, hi: int = EDGE_NGRAM_MAX) -> Column:
    """L-6: prefixes of a word of length lo..min(hi, len)."""
    word = col_(word)
    n = F.length(word)
    return F.when(n >= lo, F.transform(F.sequence(F.lit(lo), F.least(F.lit(hi), n)),
                                       lambda i: F.substring(word, 1, i))
                  ).otherwise(F.array().cast("array<string>"))


def analyzed_terms(c) -> Column:
    """I-1: standard-style terms, lower-cased (split on runs of non-word chars)."""
    s = F.lower(F.coalesce(col_(c), F.lit("")))
    parts = F.split(s, r"(?U)[^\p{L}\p{N}_]+")
    return F.array_remove(parts, "")


def grams(word, n: int) -> Column:
    """Distinct character n-grams of a word (the whole word when shorter)."""
    word = col_(word)
    ln = F.length(word)
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(ln - n + 1, F.lit(1))),
                                        lambda i: F.substring(word, i, n)))
