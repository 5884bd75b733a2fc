"""Merkle manifest, spelling variants and stream dedup against brute force, with nulls, empty and long texts, ties,
repeated rows, empty tables and extra columns whose names the operators use themselves."""

import random
import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
from pyspark.sql import functions as F

from larder.llm import merkle, spelling, stream_dedup

DOCS = ("doc_id long, source string, lang string, n_chars long, text string, tree string, pos long, leaf string, part int, "
        "id long, block long, up string, name string, tie long, n long, word string")


def docs(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", 2, 3, 4, "u", "v", 5, 6, "w") for r in rows], DOCS).repartition(5)


# ------------------------------------------------------------------ 11
def h(s):
    return sha256(s.encode()).hexdigest()


def brute_tree(nodes, proofs):
    """Root of the nodes; ``proofs`` (lists of (before, after), one a node) grow by the levels."""
    under = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, over = [], []
        for a in range(0, len(nodes), 16):
            run = nodes[a:a + 16]
            for k in range(len(run)):
                for i in under[a + k]:
                    proofs[i].append(("".join(run[:k]), "".join(run[k + 1:])))
            up.append(h("".join(run)))
            over.append([i for k in range(len(run)) for i in under[a + k]])
        nodes, under = up, over
    return nodes[0]


def brute_manifest(rows):
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: h("".join(map(part, (r[0], r[1], r[2], r[3], text))))
    low = lambda t: None if t is None else re.sub("[A-Z]", lambda m: m[0].lower(), t)
    trees = {}
    for r in rows:
        other = leaf(r, low(r[4])) if zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[0] is not None else None
        trees.setdefault(r[1], []).append((r[0], leaf(r, r[4]), other))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    out, tops, paths = [], [], []
    for name in names:
        trees[name].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        paths.append([[] for _ in trees[name]])
        tops.append(brute_tree([x[1] for x in trees[name]], paths[-1]))
    upper = [[] for _ in tops]
    root = brute_tree(tops, upper)
    for name, top, own, up in zip(names, tops, paths, upper):
        for (d, node, other), path in zip(trees[name], own):
            path, f = path + up, other or node
            for before, after in path:
                f = h(before + f + after)
            out.append((d, name, node, top, root, h("".join(a + b for a, b in path)), f, len(path) if other else 0))
    return out


def check_manifest(spark, rows, **how):
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    got = merkle.manifest(merkle.leaves(docs(spark, rows), tamper=(tampered, "text", lowered)), **how).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute_manifest(rows), key=str)


def test_manifest_of_sources_of_all_sizes(spark):
    rnd = random.Random(1)
    sizes = {None: 3, "": 1, "a": 16, "ä": 17, "hot": 300, "z": 33, **{f"s{i}": 1 for i in range(20)}}
    rows, d = [], 0
    for name, n in sizes.items():
        for _ in range(n):
            d += 1
            rows.append((rnd.choice([d, d, d, d, 7, None]), name, rnd.choice(["en", None, ""]), rnd.choice([d, None]),
                         rnd.choice([f"Text {d} É", "abc", "ABC", "", None])))
    check_manifest(spark, rows + rows[:9] + [(5000, "a", "en", 1, "Ab" * 700_000)])


def test_manifest_of_several_blocks(spark):
    # blocks of 16 leaves: three rounds of blocks in each source and two over the sources
    rows = [(i, "hot" if i % 3 else f"s{i % 60}", "en", i, f"T{i}") for i in range(900)]
    check_manifest(spark, rows, height=1)


def test_manifest_of_one_row_and_of_none(spark):
    check_manifest(spark, [(5, "a", "en", 1, "A")])
    assert merkle.manifest(merkle.leaves(docs(spark, []))).collect() == []


def test_rows_without_change_fold_to_the_root(spark):
    rows = docs(spark, [(i, f"s{i % 3}", "en", i, f"t{i}") for i in range(60)])
    assert merkle.manifest(merkle.leaves(rows)).where("folded <> root OR copies > 0").count() == 0


# ------------------------------------------------------------------ 12
RUN = re.compile("[A-Za-zÀ-ÿ]+")


def brute_words(rows):
    n = Counter()
    for d, t in rows:
        for run in RUN.findall(t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            v = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if v % 199 == 0:
                run = run[:v % len(run)] + run[v % len(run) + 1:]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_groups(rows):
    n = brute_words(rows)
    form, links = {}, {}
    for w in n:
        around = [v for v in n if near(w, v)]
        links[w] = len(around)
        best = min(around, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], links[w], n.get(form[w])))
    return sorted(out)


def word_rows(seed, n=400):
    rnd = random.Random(seed)
    base = ["garden", "gardén", "ÉCOLES", "écolesx", "letterss", "aaaaaa", "abababab", "ÿþ×÷øùú", "Straßen", "x" * 70, "short"]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rnd.randint(0, 12)):
            w = rnd.choice(base[:1] * 9 + base)
            for _ in range(rnd.choice([0, 0, 0, 1, 1, 2])):
                k = rnd.randrange(len(w))
                w = rnd.choice([w[:k] + w[k + 1:], w[:k] + rnd.choice("abeé") + w[k:], w[:k] + rnd.choice("abeé") + w[k + 1:]])
            words.append(rnd.choice([w, w.upper() if w.isascii() else w, w + "Ā", w + "1", w + "漢"]))
        rows.append((rnd.choice([i, i, 3, None]), rnd.choice([" ", "-", "\n"]).join(words)))
    return rows + rows[:11] + [(9, None), (10, ""), (11, "garden " * 30_000 + "é" * 300_000), (None, "ß" * 300_000)]


def two(spark, rows):
    return docs(spark, [(d, "s", "l", 0, t) for d, t in rows])


def test_spelling_groups_equal_brute_force(spark):
    rows = word_rows(4)
    expected = brute_groups(rows)
    assert sum(r[1] is not None for r in expected) > 20 and any(r[1] and r[1] != r[2] for r in expected)
    assert sorted(map(tuple, spelling.group_variants(two(spark, rows)).collect())) == expected


def test_full_filters_change_no_result(spark):
    rows = word_rows(5, 150)
    assert sorted(map(tuple, spelling.group_variants(two(spark, rows), bits=1, max_blocks=1).collect())) == brute_groups(rows)


def test_damage_of_every_second_word(spark):
    rows = [(i, "wonderful garden") for i in range(60)]
    got = {r["word"]: r["n"] for r in spelling.count_words(two(spark, rows), min_count=1, damage=2).collect()}
    want = Counter()
    for d, t in rows:
        for w in t.split():
            v = zlib.crc32(f"{d}:{w}".encode())
            want[w if v % 2 else w[:v % len(w)] + w[v % len(w) + 1:]] += 1
    assert got == {w: c for w, c in want.items() if len(w) >= 6}


def test_long_words_are_near(spark):
    a = "abcdefghij" * 2_000
    rows = [(1, f"{a} " * 40), (2, f"{a[:777]}{a[778:]} " * 5), (3, f"{a[:5]}z{a[6:]} " * 5)]
    got = {len(r["word"]): r for r in spelling.group_variants(two(spark, rows[:2])).collect()}
    assert got[19_999]["form"] == a and got[20_000]["n_near"] == 1
    assert {r["n_near"] for r in spelling.group_variants(two(spark, [rows[0], rows[2]])).collect()} == {1}


def test_words_of_an_empty_table(spark):
    assert spelling.group_variants(two(spark, [])).collect() == []
    assert spelling.group_variants(two(spark, [(1, "rare words")])).collect() == []


def test_crc_goes_on_from_a_seed():
    rnd = random.Random(3)
    texts = [bytes(rnd.randrange(256) for _ in range(n)) for n in (0, 1, 6, 63, 64, 65, 500, 7)]
    ends = np.cumsum([len(t) for t in texts])
    seed = np.array([zlib.crc32(str(i).encode()) for i in range(len(texts))], np.uint32)
    got = spelling.crc_each(np.frombuffer(b"".join(texts), np.uint8), ends - [len(t) for t in texts], np.array([len(t) for t in texts]), seed)
    assert got.tolist() == [zlib.crc32(str(i).encode() + t) for i, t in enumerate(texts)]


# ------------------------------------------------------------------ 13
EXTRA = "doc_id long, text string, file string, row long, key string, sha string, body string, n long, best string, _metadata string"


def write(spark, rows, path, parts, mode="append"):
    spark.createDataFrame([(*r, "f", 1, "k", "s", "b", 2, "x", "m") for r in rows], EXTRA).repartition(parts).write.mode(mode).parquet(path)


def check_groups(got, rows):
    """One row stays in each group of equal texts, and the others name it."""
    body = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for d, t in rows:
        groups.setdefault(body(t), []).append((-len(t or ""), d is None, d or 0, d))
    assert len(got) == len(rows)
    want = Counter((d, min(g)[3], len(g), h(b)) for b, g in groups.items() for *_, d in g)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["sha"].hex()) for r in got) == want
    kept = [r for r in got if r["kept"]]
    assert sorted(r["sha"].hex() for r in kept) == sorted(map(h, groups)) and all(r["doc_id"] == r["keep_id"] for r in kept)


def stream_rows(seed, n=120):
    rnd = random.Random(seed)
    base = ["", "one text", "onetext ", "\tone\x0btext\n", "é x", "é x", "other", "hot text", "hot  text", None]
    rows = [(rnd.choice([i, i, i, 4, None]), rnd.choice(base + ["hot text"] * 5 + [f"own {i}"] * 5)) for i in range(n)]
    return rows + rows[:13] + [(900, "L " * 600_000), (901, "L" * 600_000), (902, "L" * 599_999)]


def test_stream_dedup_in_many_batches(spark, scratch_dir):
    rows = stream_rows(1)
    write(spark, rows, f"{scratch_dir}/in", 7)
    check_groups(stream_dedup.stream_dedup(spark, f"{scratch_dir}/in", f"{scratch_dir}/state", files_each=2).collect(), rows)


def test_texts_with_one_digest_are_told_apart_by_their_bytes(spark, scratch_dir):
    rows = stream_rows(2)
    write(spark, rows, f"{scratch_dir}/in", 3)
    got = stream_dedup.stream_dedup(spark, f"{scratch_dir}/in", f"{scratch_dir}/state", key_bytes=1).collect()
    check_groups(got, rows)


def test_state_goes_on_when_files_arrive(spark, scratch_dir):
    rows, more = stream_rows(3, 40), stream_rows(4, 40)
    path, state = f"{scratch_dir}/in", f"{scratch_dir}/state"
    write(spark, rows, path, 2)
    stream_dedup.absorb(spark, path, state)
    check_groups(stream_dedup.resolve(spark, path, state).collect(), rows)
    write(spark, more, path, 2)
    check_groups(stream_dedup.resolve(spark, path, state).collect(), rows)  # not taken in yet
    stream_dedup.absorb(spark, path, state)
    stream_dedup.absorb(spark, path, state)  # nothing new
    check_groups(stream_dedup.resolve(spark, path, state).collect(), rows + more)


def test_stream_dedup_of_an_empty_table(spark, scratch_dir):
    write(spark, [], f"{scratch_dir}/in", 1)
    assert stream_dedup.stream_dedup(spark, f"{scratch_dir}/in").collect() == []


def test_hits_are_few_of_many_texts(spark, scratch_dir):
    write(spark, [(i, f"text {i // 2 if i < 20 else i}") for i in range(300)], f"{scratch_dir}/in", 2)
    stream_dedup.absorb(spark, f"{scratch_dir}/in", f"{scratch_dir}/state")
    found = stream_dedup.hits(spark, f"{scratch_dir}/state")
    texts = stream_dedup._located(spark.read.parquet(f"{scratch_dir}/in"), "doc_id", "text", 32)
    assert found.count() == 10 and stream_dedup._hit_bodies(texts, found).count() == 20
