"""Inputs built against the hashes: texts whose hashes agree in 32 bits under one (null) id, and Thue-Morse words, whose
polynomial sums modulo 2**64 agree under every base."""

import xxhash

from larder.llm import decontaminate, simhash, spotsigs, substring_dedup, suffix_dedup

COLS = "doc_id long, text string"


def rows(spark, pairs):
    return spark.createDataFrame(pairs, COLS).repartition(2)


def meet(left, right):
    """Texts ``left(i)`` and ``right(j)`` whose 64-bit hashes agree in the upper half."""
    upper = lambda t: xxhash.xxh64_intdigest(t.encode(), 42) >> 32
    seen = {upper(left(i)): left(i) for i in range(120_000)}
    return next((seen[upper(right(j))], right(j)) for j in range(1_000_000) if upper(right(j)) in seen)


def thue_morse(n, zero="a", one="b"):
    return "".join(one if bin(i).count("1") % 2 else zero for i in range(n))


def test_null_ids_with_texts_of_one_half_hash_stay_apart(spark):
    a, b = meet(lambda i: f"left {i}", lambda j: f"right {j} more")
    got = simhash.keep_one(rows(spark, [(None, a), (None, b), (None, "third"), (None, b)])).collect()
    assert sorted(r["text"] for r in got) == sorted([a, b, "third"])


def test_removed_spans_go_to_their_own_text(spark):
    words = " ".join(f"w{i}" for i in range(60))
    again, clean = meet(lambda i: f"{words} end{i}", lambda j: " ".join(f"c{j}x{i}" for i in range(61)))
    table = rows(spark, [(1, words), (7, again), (7, clean)])
    got = {r["kept"]: r["n_words"] for r in substring_dedup.substring_dedup(table).collect()}
    assert clean in got and len(got) == 3 and all(len(k) < 200 for k in got if k not in (words, clean))
    kept = [bytes(r["kept"]).decode() for r in suffix_dedup.suffix_dedup(table).collect()]
    assert clean in kept and words in kept and again not in kept
    removed = {r["text"] for r in substring_dedup.remove_substrings(table).collect()}
    assert clean in removed and again not in removed


def test_a_leak_removes_only_the_row_that_holds_it(spark):
    item = " ".join(f"question{i}" for i in range(20))
    leak, clean = meet(lambda i: f"{item} {i}", lambda j: f"nothing of the kind {j}")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert [r["text"] for r in decontaminate.remove_leaks(rows(spark, [(None, leak), (None, clean)]), bench).collect()] == [clean]


def test_long_words_with_equal_sums_are_different_words(spark):
    for n in (1_024, 4_096):
        one, other = thue_morse(n), thue_morse(n, "b", "a")
        before = " ".join(f"w{i}" for i in range(49))
        table = rows(spark, [(1, f"{before} {one}"), (2, f"{before} {other}")])
        got = {r["doc_id"]: r["spans"] for r in substring_dedup.substring_dedup(table).collect()}
        assert got == {1: [], 2: []}
        prints = {r["fingerprint"] for r in spotsigs.fingerprint(rows(spark, [(1, f"the {one} x y"), (2, f"the {other} x y")])).collect()}
        assert len(prints) == 2


def test_runs_of_bytes_with_equal_sums(spark):
    one, other = thue_morse(2_048), thue_morse(2_048, "b", "a")
    texts = {1: one, 2: other, 3: "x" + one[:300]}
    got = {r["doc_id"]: bytes(r["kept"]).decode() for r in suffix_dedup.suffix_dedup(rows(spark, list(texts.items()))).collect()}
    first, want = {}, {}
    for d in sorted(texts):
        t, gone = texts[d], set()
        for i in range(len(t) - 99):
            if first.setdefault(t[i:i + 100], (d, i)) != (d, i):
                gone.update(range(i, i + 100))
        want[d] = "".join(c for i, c in enumerate(t) if i not in gone)
    assert got == want
