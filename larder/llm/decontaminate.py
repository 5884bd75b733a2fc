"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

Tokens are runs of letters or digits of the lower-cased text.  A mask of
``1`` and ``0`` is laid on every token position of both sides; the tokens under
its ones are hashed, those under its zeros may differ.  Seeds of benchmark
items and documents are joined on (mask, hash); each hit names an item, a
document and a diagonal (document position minus item position).  Every
alignment that is to be found has a least number of hits on its diagonal and
the ``BAND`` neighbours on either side (``least_hits`` counts it over all
placements of the unequal tokens and of one break); diagonals with fewer are
dropped before texts are read again.  Around each hit the whole item is laid on
the document along the diagonal and the equal tokens are counted one by one, so
a substituted token costs one token, not the match, and hash collisions don't
count.  An item is found where

- at least ``min_share`` of its tokens are equal on the diagonal, or
- as many are on neighbouring diagonals, in order, less one for each change of
  the diagonal (tokens inserted or left out), or
- ``min_share`` of ``STRETCH`` neighbouring tokens of it are equal on the
  diagonal (a quoted part).

``n_equal`` counts the equal tokens of the whole item: on the diagonal if they
make the share, else with neighbouring diagonals.  Two or more breaks in an
item shorter than ``STRETCH``, or one in the middle of four tokens, can leave
too few hits.

Item seeds are joined by broadcast while there are at most ``MAX_BROADCAST``
of them (their number is counted), by shuffle beyond it.  Seeds of documents
don't travel in the first case; only hits do, and documents without a hit drop
out before their tokens are compared.

Defined cases: null and empty texts contain nothing; items of one or two tokens
have a mask of their own length, an item without tokens is never reported; items that share a text are each reported; a null id,
of a document or an item, is reported as null; rows that share an id are one document in the report, at
the best of their matches; other columns are ignored by ``find_leaks`` and kept
by ``remove_leaks``; an empty table on either side gives no leak.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import cut, id_back, keyed

#: Tokens without a seed of these: two equal ones are followed by two unequal ones, so at most half and one are equal.
MASKS = ("111", "1101", "1011")
SHORT_MASKS = ("1", "11")  # for items of so many tokens
MIN_SHARE = 0.7
BAND, STRETCH = 2, 13
MAX_BROADCAST = 1_000_000


def token_array(text):
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def least_hits(longest: int, min_share: float, masks: tuple[str, ...] = MASKS, breaks: int = 0) -> list[int]:
    """Entry n: the least number of seeds left of an item of n tokens, however
    its unequal tokens and changes of the diagonal lie, while ``min_share`` are
    equal besides one for each of the ``breaks``; no seed lies across a break."""
    span = max(map(len, masks))
    # (the last tokens, equal ones less breaks so far, breaks left): least number of seeds
    states, out = {("", 0, breaks): 0}, [0]
    for n in range(1, longest + 1):
        after: dict[tuple[str, int, int], int] = {}
        for (tail, equal, left), hits in states.items():
            for bit, cut_here in (("0", 0), ("1", 0), ("0", 1), ("1", 1))[:4 if left and tail else 2]:
                seen = bit if cut_here else tail + bit
                more = sum(len(seen) >= len(m) and all(x <= y for x, y in zip(m, seen[-len(m):])) for m in masks)
                key = (seen[-(span - 1):], equal + int(bit) - cut_here, left - cut_here)
                after[key] = min(after.get(key, hits + more), hits + more)
        states = after
        out.append(min(hits for (_, equal, _), hits in states.items() if equal >= n * min_share))
    return out


def _needed(masks: tuple[str, ...], min_share: float, stretch: int) -> list[int]:
    """Hits needed by items of n tokens, the last entry also by longer ones: cut in
    blocks of 30 to 59 tokens, a long item has a block with ``min_share`` equal."""
    least = least_hits(max(59, stretch), min_share, masks, 1)
    whole = least_hits(stretch, min_share, masks)[stretch]
    each = [*least[:30], min(least[30:60])]
    each += each[30:] * (stretch - 30)
    return [max(1, min(n, whole) if i >= stretch else n) for i, n in enumerate(each)]


def _seeds(hashes, masks: tuple[str, ...]):
    """Array of the masks' seeds, null beyond the end, for each position of an array of token hashes."""
    shortest = min(map(len, masks))

    def at(i):
        return F.array(*[F.when(i + len(mask) <= F.size(hashes), F.xxhash64(
            F.lit(int(mask, 2)), *[F.get(hashes, i + k) for k, c in enumerate(mask) if c == "1"])) for mask in masks])

    positions = F.when(F.size(hashes) >= shortest, F.sequence(F.lit(0), F.size(hashes) - shortest))
    return F.transform(F.coalesce(positions, F.array().cast("array<int>")), at)


def _exploded(rows: DataFrame, keep: list[str], masks: tuple[str, ...]) -> DataFrame:
    hashed = rows.select(*keep, F.transform("tokens", lambda t: F.xxhash64(t)).alias("hashes"))
    placed = hashed.select(*keep, F.posexplode(_seeds(F.col("hashes"), masks)).alias("pos", "seeds"))
    return placed.select(*keep, "pos", F.explode("seeds").alias("seed")).where("seed IS NOT NULL")


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               item_col: str = "item_id", item_text_col: str = "text", masks: tuple[str, ...] = MASKS,
               min_share: float = MIN_SHARE, max_broadcast: int = MAX_BROADCAST, stretch: int = STRETCH) -> DataFrame:
    """One row for each document and item found in it: ``doc_id, item_id,
    n_tokens, n_equal, position``; of several places the one with most equal
    tokens, then the first."""
    found = _matches(docs, benchmark, id_col, text_col, item_col, item_text_col, masks, min_share, max_broadcast, stretch)
    best = F.max(F.struct(F.col("n_equal"), F.col("on"), (-F.col("diagonal")).alias("back")))
    return found.groupBy("did", "item_id", "n_tokens").agg(best.alias("b")).select(
        id_back().alias("doc_id"), "item_id", "n_tokens", F.col("b.n_equal").alias("n_equal"), (-F.col("b.back")).alias("position"))


def _matches(docs, benchmark, id_col, text_col, item_col, item_text_col, masks, min_share, max_broadcast, stretch) -> DataFrame:
    items = benchmark.select(F.col(f"`{item_col}`").alias("item_id"),
                             token_array(F.coalesce(F.col(f"`{item_text_col}`").cast("string"), F.lit(""))).alias("tokens"))
    # rows of items are told apart by a hash of id and tokens: ids can be null or repeat
    items = items.withColumn("key", F.xxhash64("item_id", F.isnull("item_id"), "tokens")).withColumn("n", F.size("tokens")).distinct()
    placed, kinds = _exploded(items, ["key", "n"], masks), masks
    lengths = {r["n"] for r in items.where(F.col("n").between(1, len(SHORT_MASKS))).select("n").distinct().collect()}
    for mask in (m for m in SHORT_MASKS if len(m) in lengths):
        placed, kinds = placed.unionByName(_exploded(items.where(F.col("n") == len(mask)), ["key", "n"], (mask,))), (*kinds, mask)
    seeds = cut(placed.select("key", "n", F.col("pos").alias("item_pos"), "seed").distinct())
    if seeds.count() <= max_broadcast:
        seeds = F.broadcast(seeds)
    rows = keyed(docs, id_col, text_col)
    places = _exploded(rows.select("did", "th", token_array(F.col("text")).alias("tokens")), ["did", "th"], kinds)
    needed = _needed(masks, min_share, stretch)
    enough = F.get(F.array(*map(F.lit, needed)), F.least(F.col("n"), F.lit(len(needed) - 1)))
    hits = (places.join(seeds, "seed").select("did", "th", "key", "n", (F.col("pos") - F.col("item_pos")).alias("diagonal"))
            .groupBy("did", "th", "key", "n", "diagonal").count()
            .withColumn("near", F.sum("count").over(Window.partitionBy("did", "th", "key", "n").orderBy("diagonal").rangeBetween(-BAND, BAND)))
            .where(F.col("near") >= enough)
            .groupBy("did", "th").agg(F.collect_set(F.struct("key", "diagonal")).alias("hits")))
    whole = items.select("key", "item_id", F.col("tokens").alias("item"))
    # equal rows repeat a comparison at most; the hits of a row are few
    near = (rows.join(cut(hits), ["did", "th"]).select("did", "th", token_array(F.col("text")).alias("tokens"), F.explode("hits").alias("hit"))
            .select("did", "th", "hit.key", "hit.diagonal", "tokens").join(whole, "key"))
    share = F.size("item") * min_share
    laid = near.withColumn("same", F.transform("item", lambda x, i: _same(x, i + F.col("diagonal"))))
    judged = laid.select(
        "did", "th", "item_id", "diagonal", F.size("item").alias("n_tokens"), _total(F.col("same")).alias("on"),
        _in_band().alias("near"), F.exists(
            F.when(F.size("same") >= stretch, F.sequence(F.lit(1), F.size("same") - (stretch - 1))).otherwise(F.array().cast("array<int>")),
            lambda i: _total(F.slice("same", i, stretch)) >= stretch * min_share).alias("part"), share.alias("share"))
    return judged.where("on >= share OR near >= share OR part").select(
        "did", "th", "item_id", "diagonal", "n_tokens", "on", F.when(F.col("on") >= F.col("share"), F.col("on")).otherwise(F.col("near")).alias("n_equal"))


def _same(token, place):
    """1 where the document has the token at the place, else 0."""
    return F.coalesce((F.get("tokens", place) == token).cast("int"), F.lit(0))


def _total(same):
    return F.aggregate(same, F.lit(0), lambda total, one: total + one)


def _in_band():
    """Most equal tokens of the item, in order, on the diagonal and its neighbours, less one for each change of the diagonal."""
    start = F.array(*[F.lit(0)] * (2 * BAND + 1))

    def step(best, i):
        other = F.array_max(best) - 1
        return F.array(*[F.greatest(F.get(best, F.lit(j)), other) + _same(F.get("item", i), i + F.col("diagonal") + (j - BAND))
                         for j in range(2 * BAND + 1)])

    ends = F.aggregate(F.sequence(F.lit(0), F.size("item") - 1), start, step)
    return F.array_max(ends)


def remove_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs``, all columns, without the rows in which an item was found."""
    args = {"item_col": "item_id", "item_text_col": "text", "masks": MASKS, "min_share": MIN_SHARE, "max_broadcast": MAX_BROADCAST, "stretch": STRETCH}
    found = cut(_matches(docs, benchmark, id_col, text_col, **(args | options)).select(
        F.col("did").alias("_leak_did"), F.col("th").alias("_leak_th")).distinct())
    key = keyed(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")).select(
        "_row", F.col(f"_row.`{id_col}`").alias("_id"), F.col(f"_row.`{text_col}`").alias("_text")), "_id", "_text", ["_row"])
    return key.join(found, (F.col("did") == F.col("_leak_did")) & (F.col("th") == F.col("_leak_th")), "left_anti").select("_row.*")


ORACLE_SQL = """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w
           FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w
      FROM benchmark),
dp AS (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS p FROM d),
bp AS (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS p FROM b),
ds AS (SELECT doc_id, p, 1 AS m, {one} AS s FROM dp UNION ALL SELECT doc_id, p, 2 AS m, {two} AS s FROM dp),
bs AS (SELECT item_id, p, 1 AS m, {one} AS s FROM bp UNION ALL SELECT item_id, p, 2 AS m, {two} AS s FROM bp),
h AS (SELECT DISTINCT ds.doc_id, bs.item_id, ds.p - bs.p AS g FROM ds JOIN bs USING (m, s)),
v AS (SELECT h.doc_id, h.item_id, h.g, len(b.w) AS n,
             len(list_filter(range(1, len(b.w) + 1), lambda i: i + h.g >= 1 AND d.w[i + h.g] = b.w[i])) AS e
      FROM h JOIN d USING (doc_id) JOIN b USING (item_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY e DESC, g) AS k FROM v WHERE e >= n * 0.7)
SELECT doc_id, item_id, n::INT AS n_tokens, e::INT AS n_equal, g::INT AS position FROM r WHERE k = 1
"""


def oracle_sql() -> str:
    pick = lambda mask: "concat_ws(' ', " + ", ".join(f"w[p + {k}]" for k, c in enumerate(mask) if c == "1") + ")"
    return ORACLE_SQL.replace("{one}", pick(MASKS[0])).replace("{two}", pick(MASKS[1]))
