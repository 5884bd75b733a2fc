"""Texts of over a megabyte beside short ones, through each operator that reads whole texts."""

import random

import tiktoken
from tiktoken.load import load_tiktoken_bpe

import public_tokenizers
from larder.llm import byte_bpe, decontaminate, histogram_shard, simhash, spotsigs, substring_dedup, suffix_dedup

RND = random.Random(8)
LONG = " ".join("".join(RND.choices("abcdefghé", k=RND.randint(2, 9))) for _ in range(190_000))
NO_SPACE = "x" * 700_000 + "é" * 300_000
TEXTS = {1: LONG, 2: "short text of a few words", 3: LONG, 4: NO_SPACE, 5: "", 6: None, 7: LONG[:2_000]}


def table(spark):
    assert len(LONG.encode()) > 1 << 20 and len(NO_SPACE.encode()) > 1 << 20
    return spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string").repartition(3)


def test_words_and_bytes_of_a_long_copy_go(spark):
    words = {r["doc_id"]: r for r in substring_dedup.substring_dedup(table(spark)).collect()}
    assert words[1]["spans"] == [] and words[3]["kept"] == "" and words[3]["n_words"] == 190_000 and words[4]["kept"] == NO_SPACE
    assert len(words[7]["kept"].split()) <= 1  # the last word is cut
    kept = {r["doc_id"]: r for r in suffix_dedup.suffix_dedup(table(spark)).collect()}
    assert bytes(kept[1]["kept"]).decode() == LONG and bytes(kept[3]["kept"]) == b"" and bytes(kept[7]["kept"]) == b""
    assert kept[4]["n_bytes"] == 1_300_000 and bytes(kept[4]["kept"]).decode() == "xé"  # all others are covered by a repeat


def test_fingerprints_of_long_copies_are_equal(spark):
    sim = {r["doc_id"]: r for r in simhash.near_duplicates(table(spark)).collect()}
    assert sim[1]["fp"] == sim[3]["fp"] and sim[3]["component_id"] == 1 and sim[5]["fp"] == sim[6]["fp"] == 0
    spots = {r["did"]: r["fingerprint"] for r in spotsigs.fingerprint(table(spark)).collect()}
    assert spots[1] == spots[3] and spots[4] and not spots[5]


def test_long_rows_are_sharded_whole(spark):
    got = {r["doc_id"]: r for r in histogram_shard.shard(table(spark), shards=2).collect()}
    assert len(got) == 7 and got[1]["size"] == len(LONG.encode()) + 16 and got[6]["size"] == 16
    assert {len({r["slot"] for r in got.values() if r["shard"] == s}) for s in (0, 1)} == {
        sum(r["shard"] == s for r in got.values()) for s in (0, 1)}


def test_an_item_at_the_end_of_a_long_text_is_found(spark):
    item = " ".join(f"question{i} part{i}" for i in range(12))
    docs = spark.createDataFrame([(1, f"{LONG} {item}"), (2, LONG)], "doc_id long, text string")
    found = decontaminate.find_leaks(docs, spark.createDataFrame([(9, item)], "item_id long, text string")).collect()
    assert [(r["doc_id"], r["item_id"], r["n_equal"]) for r in found] == [(1, 9, 24)]


def test_a_long_text_is_encoded_and_decoded(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = spark.createDataFrame([(1, LONG), (2, "y" * 3_000)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in byte_bpe.encode_documents(docs, path, public_tokenizers.PATTERN).collect()}
    ranks = load_tiktoken_bpe(path)
    whole = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for d, t in ((1, LONG), (2, "y" * 3_000)):
        assert bytes(got[d]["decoded"]).decode() == t and got[d]["n_tokens"] == len(whole.encode_ordinary(t))
