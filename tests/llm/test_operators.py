"""The operators against brute force, with nulls, empty texts, repeated rows,
ties, clashing extra columns and empty tables."""

import base64
import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import public_tokenizers
from larder.llm import (byte_bpe, decontaminate, histogram_shard, license_scan, quality, simhash, spotsigs, substring_dedup,
                        suffix_dedup, token_output)
from larder.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASH = "doc_id long, text string, did long, th int, h long, part int, row string, gone int, fp long"
SMALL = dict(bucket_bytes=500)


def make_rows(seed, n=60):
    rnd = random.Random(seed)

    def text(size):
        return rnd.choice([" ", "  ", "\n"]).join(rnd.choice(["a", "b", "cé", "dd", "E", "the", "of"]) for _ in range(size))

    passages = [text(30) for _ in range(3)]
    rows = []
    for i in range(n):
        parts = [text(rnd.randint(0, 40))]
        if rnd.random() < 0.5:
            parts.append(rnd.choice(passages)[:rnd.randint(1, 100)])
        if rnd.random() < 0.2:
            parts.append("a" * rnd.randint(1, 80))
        if rnd.random() < 0.2:
            parts.append("ab " * rnd.randint(1, 40))
        if rnd.random() < 0.2:  # repeats itself alone
            parts.append("".join(rnd.choice("klmnop") for _ in range(rnd.randint(1, 30))) * rnd.randint(1, 5))
        rows.append((rnd.choice([i, i, i, 5, None]), rnd.choice([" ".join(parts)] * 5 + [None, ""])))
    return rows + rows[:7]


def table(spark, rows):
    """The rows with further columns whose names the operators might use themselves."""
    return spark.createDataFrame([(*r, 1, None, 3, 4, "x", None, 7) for r in rows], CLASH).repartition(3)


def order(d):
    return d if d is not None else 1 << 62


def by_text(values):
    return sorted(values, key=str)


# ------------------------------------------------------------------ 1 and 5
def brute_words(rows, width):
    first = {}
    for d, t in rows:
        words = WORD.findall(t or "")
        for i in range(len(words) - width + 1):
            key = tuple(words[i:i + width])
            first[key] = min(first.get(key, 1 << 63), order(d))
    for d, t in rows:
        words = WORD.findall(t or "")
        gone = [False] * len(words)
        for i in range(len(words) - width + 1):
            if first[tuple(words[i:i + width])] < order(d):
                gone[i:i + width] = [True] * width
        yield d, t, words, gone


@pytest.mark.parametrize("hot", [20_000, 1])
def test_substring_dedup(spark, hot):
    rows = make_rows(1)
    want = [(d, len(w), sum(g), " ".join(x for x, y in zip(w, g) if not y)) for d, _, w, g in brute_words(rows, 6)]
    got = substring_dedup.substring_dedup(table(spark, rows), width=6, hot_runs=hot, **SMALL).collect()
    assert by_text((r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), r.kept) for r in got) == by_text(want)
    for r in got:  # maximal intervals, in order
        assert all(a.end < b.start for a, b in itertools.pairwise(r.spans))


def test_remove_substrings_keeps_rows_and_columns(spark):
    rows = make_rows(2)
    df = table(spark, rows)
    want = [(d, " ".join(x for x, y in zip(w, g) if not y) if any(g) else t) for d, t, w, g in brute_words(rows, 6)]
    got = substring_dedup.remove_substrings(df, width=6, length_col="did", **SMALL)
    assert got.columns == df.columns
    found = got.collect()
    assert by_text((r.doc_id, r.text) for r in found) == by_text(want)
    assert all(r.th is None and r.h == 3 and r.row == "x" for r in found)


@pytest.mark.parametrize("hot", [20_000, 1])
def test_suffix_dedup(spark, hot):
    rows, size = make_rows(3), 21
    first = {}
    for d, b in sorted({(order(d), (t or "").encode()) for d, t in rows}):
        for i in range(len(b) - size + 1):
            first.setdefault(b[i:i + size], []).append((d, b, i))
    want = []
    for d, t in rows:
        b = (t or "").encode()
        gone = [0] * len(b)
        for i in range(len(b) - size + 1):
            if any(x < order(d) or (x == order(d) and y == b and j < i) for x, y, j in first[b[i:i + size]]):
                gone[i:i + size] = [1] * size
        spans = sum(1 for k, _ in itertools.groupby(gone) if k)
        want.append((d, len(b), spans, bytes(x for x, y in zip(b, gone) if not y)))
    got = suffix_dedup.suffix_dedup(table(spark, rows), length=size, q=8, hot_runs=hot, **SMALL).collect()
    assert by_text((r.doc_id, r.n_bytes, len(r.spans), bytes(r.kept)) for r in got) == by_text(want)


def test_refinement_is_exact():
    rnd = np.random.default_rng(5)
    text = rnd.integers(0, 2, 600).astype(np.uint8)
    at = np.arange(0, 600 - 37)
    ids, many = suffix_dedup.refine(text, at, 37)
    groups = Counter(bytes(text[i:i + 37]) for i in at)
    names = {}
    for i, x, m in zip(at, ids, many):
        s = bytes(text[i:i + 37])
        assert m == (groups[s] > 1)
        if m:
            assert names.setdefault(s, x) == x
    assert len(set(names.values())) == len(names)


# ------------------------------------------------------------------ 2
def test_spotsigs_signatures_and_neighbours(spark):
    rows = [(i, f"the Ship sails of night {i} and a day. the moon, is {i % 4}!") for i in range(40)]
    rows += [(50, None), (51, ""), (52, "..."), (7, "the other of seven"), (60, "é" * 9 + " the 日本 of the")]
    got = spotsigs.edited_fingerprints(table(spark, rows), part_bytes=300).collect()
    assert len(got) == len(rows)
    ids = sorted({r[0] for r in rows}, reverse=True)
    text = {d: [t or "" for e, t in rows if e == d] for d in ids}
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        follow = ids[(ids.index(r.doc_id) + 1) % len(ids)]
        own = [t for t in text[r.doc_id] if len(t) == r.n_chars]
        edits = {t[:len(t) - len(t) // 2] + n[:len(t) // 2] for t in own for n in text[follow] + text[r.doc_id]}
        assert r.edited in edits
    single = {r.doc_id: r for r in got if len(text[r.doc_id]) == 1}
    for d, r in single.items():
        follow = ids[(ids.index(d) + 1) % len(ids)]
        if follow in single:
            t = text[d][0]
            assert r.edited == t[:len(t) - len(t) // 2] + text[follow][0][:len(t) // 2]
            a, b = (set(re.findall(".{8}", single[x].fingerprint)) for x in (d, follow))
            assert r.near_next == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
    assert single[50].fingerprint == single[51].fingerprint == single[52].fingerprint == ""
    assert spotsigs.edited_fingerprints(table(spark, [(1, "the only one")])).first().near_next == 1.0
    assert spotsigs.edited_fingerprints(table(spark, [])).count() == 0


def brute_spots(text, chain=3):
    tokens = re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if c < "\x80" else c for c in text))
    anchors = set(spotsigs.ANCHORS)
    spots = [("^", 0)] if tokens else []
    spots += [(t, i) for i, t in enumerate(tokens) if t in anchors]
    return {(a, *[t for t in tokens[i:] if t not in anchors][:chain]) for a, i in spots}


def test_spotsigs_classes_against_brute_force(spark):
    rnd = random.Random(4)
    words = ["the", "of", "and", "rain", "sun", "wind", "hill", "sea", "tree", "fog", "ice"]
    base = [" ".join(rnd.choice(words) for _ in range(60)) for _ in range(6)]
    rows = []
    for i in range(50):
        w = rnd.choice(base).split()
        for _ in range(rnd.choice([0, 0, 1, 2, 6])):
            w[rnd.randrange(len(w))] = rnd.choice(words)
        rows.append((i, " ".join(w)))
    rows += [(90, ""), (91, None), (92, "rain")]
    got = {r.doc_id: r for r in spotsigs.similar_classes(table(spark, rows)).collect()}
    sets = {d: brute_spots(t or "") for d, t in rows}
    low = {d: d for d in sets}
    similar = lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b)
    changed = True
    while changed:
        changed = False
        for a, b in itertools.combinations(sets, 2):
            if similar(sets[a], sets[b]) and low[a] != low[b]:
                low[a] = low[b] = min(low[a], low[b])
                changed = True
    assert {d: r.class_id for d, r in got.items()} == low
    nodes = {frozenset(s) for s in sets.values()}
    for d, r in got.items():
        assert r.n_links == sum(similar(sets[d], n) for n in nodes if n != sets[d])
    assert spotsigs.similar_classes(table(spark, [])).count() == 0


def test_op2_returns_classes(spark):
    from larder.llm import queries

    sf = "/root/testdata/sf0.001"
    out = queries.op2_spotsigs(spark, sf).collect()
    want = spotsigs.similar_classes(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in out) == sorted(map(tuple, want))
    assert any(r.class_id != r.doc_id for r in out)


# ------------------------------------------------------------------ 3
def test_histogram_shard(spark):
    rnd = random.Random(6)
    rows = [(i, "x" * rnd.randint(0, 400) + str(rnd.randint(0, 900))) for i in range(1500)]
    rows += [(i, "copy " * 30) for i in range(5000, 6000)]  # a group larger than many shards
    rows += [(None, None), (None, ""), (3, rows[3][1]), (3, "other")]
    df = table(spark, rows)
    got = histogram_shard.shard(df, shards=7, tolerance=0.01, piece_bytes=9000).collect()
    size = lambda t: len((t or "").encode()) + 16
    assert by_text((r.doc_id, r.size, r.text_crc32) for r in got) == by_text(
        (d, size(t), zlib.crc32((t or "").encode())) for d, t in rows)
    load = Counter()
    for r in got:
        load[r.shard] += r.size
    ideal = sum(load.values()) / 7
    assert set(load) == set(range(7)) and all(abs(v - ideal) <= 0.02 * ideal + 416 for v in load.values())
    for s in load:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    places = {}
    for d, t in rows:
        places.setdefault(t or "", set())
    shard_of = {(r.doc_id, r.text_crc32): r.shard for r in got}
    for d, t in rows:
        places[t or ""].add(shard_of[d, zlib.crc32((t or "").encode())])
    assert sum(len(p) > 1 for p in places.values()) <= 2  # only the large group, and rarely another, is cut
    assert histogram_shard.shard(table(spark, [])).count() == 0
    alone = histogram_shard.shard(table(spark, [(1, None)])).collect()
    assert [(r.slot, r.size) for r in alone] == [(0, 16)]


def test_histogram_shard_moves_whole_rows(spark):
    rnd = random.Random(8)
    rows = [(i, "x" * rnd.randint(0, 400) + str(rnd.randint(0, 900))) for i in range(400)] + [(None, None), (None, ""), (3, "other")]
    df = table(spark, rows)
    out = histogram_shard.shard_rows(df, shards=5, tolerance=0.01)
    assert out.columns == [*df.columns, "shard", "slot"]
    got = out.withColumn("partition", F.spark_partition_id()).collect()
    assert sorted(map(repr, (tuple(r)[:len(df.columns)] for r in got))) == sorted(map(repr, map(tuple, df.collect())))
    assert len({(r.shard, r.partition) for r in got}) == len({r.shard for r in got}) == 5
    for s in range(5):
        assert [r.slot for r in got if r.shard == s] == list(range(sum(r.shard == s for r in got)))
    plan = histogram_shard.digests(out)._jdf.queryExecution().executedPlan().toString()
    above, below = plan.split("Exchange hashpartitioning", 1)
    assert "crc32" in above and "octet_length" in above and "crc32" not in below and "hashpartitioning" not in below
    assert "_row1" in above.split("Window", 1)[1]  # the text
    assert len(histogram_shard.shard_rows(out, shards=5).columns) == len(out.columns)


# ------------------------------------------------------------------ 4
def token_list(text):
    return [t for t in re.split(r"[\W_]+", (text or "").lower()) if t]


def test_decontaminate(spark):
    rnd = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    sentence = lambda n: [rnd.choice(words) for _ in range(n)]
    items = [(i, sentence(rnd.randint(12, 40))) for i in range(20)] + [(90, sentence(5)), (91, None), (92, [])]
    rows = []
    for i in range(120):
        t = sentence(rnd.randint(0, 80))
        if i % 3 == 0:
            item = list(rnd.choice(items[:20])[1])
            for _ in range(i % 4):  # substitutions, not in neighbouring places
                item[rnd.randrange(len(item))] = "changed"
            at = rnd.randint(0, len(t))
            t = t[:at] + item + t[at:]
        rows.append((i, rnd.choice([" ", ", ", "\n"]).join(t).title()))
    rows += [(200, None), (201, ""), (None, " ".join(items[0][1])), (3, rows[3][1])]
    bench = spark.createDataFrame([(i, " ".join(w) if w is not None else None, 5) for i, w in items], "item_id long, text string, pos int")
    want = {}
    for d, t in rows:
        doc = token_list(t)
        for i, w in items:
            w = w or []
            if len(w) < 12:
                continue
            for g in range(-len(w) + 1, len(doc)):
                same = sum(0 <= g + k < len(doc) and doc[g + k] == w[k] for k in range(len(w)))
                if same >= 0.7 * len(w):
                    want[d, i] = max(want.get((d, i), (0, 0)), (same, -g))
    for limit in (1_000_000, 0):
        got = decontaminate.find_leaks(table(spark, rows), bench, max_broadcast=limit).collect()
        found = {(r.doc_id, r.item_id): (r.n_equal, -r.position) for r in got}
        assert len(found) == len(got) and set(found) <= set(want)
        assert all(v == want[k] for k, v in found.items())
        # with all substitutions this far apart a seed survives
        assert {k for k in want if want[k][0] >= 0.9 * len(dict(items)[k[1]])} <= set(found)
    df = table(spark, rows)
    kept = decontaminate.remove_leaks(df, bench)
    assert kept.columns == df.columns
    leaky = {d for d, _ in found}
    assert by_text(r.doc_id for r in kept.collect()) == by_text(d for d, _ in rows if d not in leaky)
    assert decontaminate.find_leaks(table(spark, []), bench).count() == 0
    assert decontaminate.find_leaks(df, bench.limit(0)).count() == 0


def test_least_hits_against_every_placement():
    masks = [[k for k, c in enumerate(m) if c == "1"] for m in decontaminate.MASKS]
    counted = decontaminate.least_hits(14, 0.7)
    for n in range(1, 15):
        least = min(sum(all(p + k < n and same[p + k] for k in m) for m in masks for p in range(n))
                    for same in itertools.product((0, 1), repeat=n) if sum(same) >= 0.7 * n)
        assert counted[n] == least and (least or n < 3)
    assert min(decontaminate.least_hits(59, 0.7)[3:]) > 0


def test_decontaminate_finds_all_at_its_threshold(spark):
    rnd = random.Random(17)
    sentence = lambda n: [f"w{rnd.randint(0, 3000)}" for _ in range(n)]
    items = [(n, sentence(n)) for n in [*range(1, 30), 40, 59, 75]]
    rows = []
    for n, w in items:
        spread = list(range(3, n, 4))
        for gone in (range(0), spread, spread[:n * 3 // 10], *(rnd.sample(range(n), n * 3 // 10) for _ in range(6))):
            t = ["changed" if k in gone else x for k, x in enumerate(w)]
            rows.append((len(rows), " ".join(sentence(rnd.randint(0, 9)) + t + sentence(rnd.randint(0, 9)))))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    want = {}
    for d, t in rows:
        doc = token_list(t)
        for i, w in items:
            best = max((sum(0 <= g + k < len(doc) and doc[g + k] == x for k, x in enumerate(w)), -g) for g in range(-len(w) + 1, len(doc)))
            if best[0] >= 0.7 * len(w):
                want[d, i] = best
    assert len(want) >= len(rows) - 29 and {i for _, i in want} == {i for i, _ in items}
    for limit in (1_000_000, 0):
        got = decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench, max_broadcast=limit).collect()
        assert {(r.doc_id, r.item_id): (r.n_equal, -r.position) for r in got} == want


def test_decontaminate_parts_and_breaks(spark):
    rnd = random.Random(23)
    sentence = lambda n: [f"w{rnd.randint(0, 3000)}" for _ in range(n)]
    items = [(n, sentence(n)) for n in (5, 6, 8, 11, 15, 20, 25, 59, 200)]
    whole = dict(items)
    cases = [(59, whole[59][:41], 41), (59, whole[59][23:36], 13), (200, whole[200][50:150], 100), (59, whole[59][:8], None), (25, whole[25][:9], None)]
    for n, w in items[:-1]:
        for at in range(1, n):
            cases += [(n, w[:at] + ["inserted"] + w[at:], n - 1), (n, w[:at] + ["one", "more"] + w[at:], n - 1)]
            if n > 6:
                cases.append((n, w[:at] + w[at + 1:], n - 2))
    changed = ["x" if k in (4, 9, 14) else t for k, t in enumerate(whole[20])]
    cases.append((20, changed[:11] + ["inserted"] + changed[11:], 16))
    rows = [(i, " ".join(sentence(5) + t + sentence(5))) for i, (_, t, _) in enumerate(cases)]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    for i, (n, t, want) in enumerate(cases):
        if want is None:
            assert i not in got, (n, t)
        else:  # on one diagonal if that makes the share, else on both sides of the break
            r = got[i]
            assert r.item_id == n and min(want, -(-7 * n // 10)) <= r.n_equal <= max(want, n - 1), (n, t, r)
    assert len(got) == len(cases) - 2


def test_decontaminate_null_item_id(spark):
    one, two = (" ".join(f"{c}{k}" for k in range(20)) for c in "ab")
    docs = spark.createDataFrame([(1, f"x {one} y"), (2, two), (3, "x y")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, one), (None, two), (7, two), (7, two)], "item_id long, text string")
    got = decontaminate.find_leaks(docs, bench).collect()
    assert sorted((r.doc_id, r.item_id or 0, r.n_equal, r.position) for r in got) == [(1, 0, 20, 1), (2, 0, 20, 0), (2, 7, 20, 0)]
    assert [r.doc_id for r in decontaminate.remove_leaks(docs, bench).collect()] == [3]


def test_native_plans(spark):
    df = table(spark, make_rows(8))
    bench = spark.createDataFrame([(1, "a b cé dd E the of a b cé dd E the of")], "item_id long, text string")
    for out in (decontaminate.find_leaks(df, bench), license_scan.scan_licenses(df)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Arrow|Pandas|CartesianProduct|NestedLoop", plan)


# ------------------------------------------------------------------ 6
def test_license_scan(spark):
    apache = ("Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance "
              "with the License.\nYou may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless "
              "required by applicable law or agreed to in writing, software\x20distributed under the License is distributed on an \"AS IS\" "
              "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.\nSee the License for the specific "
              "language governing permissions and limitations under the License.")
    rows = [(1, "Text. Released under the MIT License."), (2, apache), (3, None), (4, ""), (5, "no license here\nAll rights reserved."),
            (6, "Licensed under CC BY-NC 4.0.\nx\nRELEASED UNDER THE MIT LICENSE!\nLicensed under CC BY-NC 4.0."),
            (7, "You may not use this file except in compliance with the License."), (None, "MIT License"), (1, "x")]
    got = {(r.doc_id, r.licenses): r for r in license_scan.scan_licenses(table(spark, rows)).collect()}
    assert set(got) == {(1, "MIT"), (2, "Apache-2.0"), (3, ""), (4, ""), (5, ""), (6, "MIT CC-BY-NC-4.0"), (7, ""), (None, "MIT"), (1, "")}
    assert got[2, "Apache-2.0"].unused_ids == "" and got[7, ""].unused_ids == "APACHE-USE"
    assert got[5, ""].unused_ids == "RIGHTS-RESERVED" and got[3, ""].n_sentences == 0
    assert license_scan.scan_licenses(table(spark, [])).count() == 0


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS BE LIABLE.
"""
GPL3 = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>.
"""
GPL2 = GPL3.replace("software:", "software;").replace("Foundation, either version 3", "Foundation; either version 2")
BSD2 = """Copyright (c) 2020, A. Holder
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD3 = BSD2 + """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""


def test_license_scan_of_wrapped_texts(spark):
    texts = {"MIT": MIT, "GPL-3.0-or-later": GPL3, "GPL-2.0-or-later": GPL2, "BSD-2-Clause": BSD2, "BSD-3-Clause": BSD3, "Apache-2.0": APACHE}
    rows, want = [], []
    for name, text in texts.items():
        one_line = re.sub(r"\n(?=.)", " ", text.replace("\n\n", "\r\r")).replace("\r\r", "\n\n")
        forms = [text, text.replace("\n", "\r\n"), one_line, *("\n".join(f"{sign}{line}" for line in text.split("\n")) for sign in ("# ", " * ", "//  "))]
        for form in ["MIT License\n" * (name == "MIT") + text, *forms]:
            rows.append((len(rows), f"int x;\n\n{form}\n\nint y"))
            want.append(name)
    for holder in ("Some Organisation", "the <organization>", "the\n   University"):
        rows.append((len(rows), BSD3.replace("the copyright holder", holder)))
        want.append("BSD-3-Clause")
    rows += [(len(rows), "This program is free software\n\nyou can redistribute it"), (len(rows) + 1, MIT.replace("copies of", "copies.\nof").replace("copies or", "or"))]
    want += ["", ""]
    got = {r.doc_id: r for r in license_scan.scan_licenses(table(spark, rows)).collect()}
    assert [got[i].licenses for i in range(len(rows))] == want
    assert got[len(rows) - 1].unused_ids == "MIT-WARRANTY"
    assert got[0].n_sentences == len([x for x in re.split(r"\n|[.!?;][ \t\r\n]+|[.!?;]+\Z", rows[0][1].lower()) if re.search("[a-z0-9]", x)])


# ------------------------------------------------------------------ 7
def brute_simhash(text, shingle=4):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    n = min(shingle, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + n]).encode(), 42) for i in range(len(words) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark):
    rnd = random.Random(9)
    rows = make_rows(9, 80)
    base = " ".join(f"word{rnd.randint(0, 99)}" for _ in range(150))
    for i in range(60):
        words = base.split()
        for _ in range(rnd.randint(0, 2)):
            words[rnd.randrange(150)] = "other"
        rows.append((1000 + i, " ".join(words)))
    prints = [(order(d), brute_simhash(t)) for d, t in rows]
    low, root = {}, {}
    for d, f in prints:
        low[f], root[f] = min(low.get(f, 1 << 63), d), f
    changed = True
    while changed:
        changed = False
        for a, b in itertools.combinations(low, 2):
            if (a ^ b).bit_count() <= 4 and root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                low[a] = low[b] = min(low[a], low[b])
                changed = True
        for f in low:
            low[f] = min(low[g] for g in low if root[g] == root[f])
    df = table(spark, rows)
    got = simhash.near_duplicates(df).collect()
    back = lambda d: None if d == 1 << 62 else d
    assert by_text((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got) == by_text(
        (back(d), f, back(low[f])) for d, f in prints)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(order(r.doc_id) for r in kept.collect()) == sorted({root[f]: low[f] for f in low}.values())
    assert simhash.near_duplicates(table(spark, [])).count() == 0


def test_links_find_each_pair_once(spark):
    rnd = random.Random(10)
    prints = {rnd.getrandbits(64) for _ in range(40)}
    for p in list(prints):
        for n in (1, 2, 3, 4, 5, 6):
            prints.add(p ^ sum(1 << b for b in rnd.sample(range(64), n)))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    for k in (4, 3, 2):
        got = [tuple(sorted((r.u, r.v))) for r in simhash.links(df, k).collect()]
        want = {tuple(sorted(x)) for x in itertools.combinations(signed, 2)
                if ((x[0] ^ x[1]) % (1 << 64)).bit_count() <= k}
        assert len(got) == len(set(got)) and set(got) == want


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 70)] + [(200, 100), (300, 200), (100, 300), (5, 5), (70, 0)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(71)}, 100: 100, 200: 100, 300: 100}


# ------------------------------------------------------------------ 8
def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    got = quality.score(docs, model).join(labels, "doc_id").toPandas()
    held = got[got.held_out]
    good, bad = held[held.quality == 1].score, held[held.quality == 0].score
    assert np.mean(good.to_numpy()[:, None] > bad.to_numpy()[None, :]) > 0.75
    assert ((held.score >= 0.3) == held.quality).mean() >= held.quality.mean()
    # the same fit again, and neither labels of held-out rows nor other columns matter
    other = labels.withColumn("quality", F.when(quality.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality.train(docs.drop("lang", "source").repartition(3), other)
    x = np.random.default_rng(0).normal(size=(5, model.vectors.shape[1] + 2))
    assert np.allclose(model.probability(x), again.probability(x), atol=1e-3)


def test_quality_edge_cases(spark):
    docs = table(spark, make_rows(11))
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.train(docs, none)
    assert {r.score for r in quality.score(docs, model).collect()} == {0.5}
    odd = spark.createDataFrame([(None, 1), (1, None), (2, 1), (2, 1), (3, 0), (4, 1), (8, 0)], "doc_id long, quality int")
    model = quality.train(docs, odd)
    got = quality.score(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    kept = quality.keep_good(docs, model, threshold=0.0)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert quality.score(table(spark, []), quality.train(table(spark, []), none)).count() == 0


# ------------------------------------------------------------------ 9 and 10
def odd_texts():
    rnd = random.Random(12)
    bits = [" ", "  ", "\n", "\t", "a", "Ab", "é", "日本", " ", "1", "23", "'s", "!", "🙂", "\x00", "\x1c", " ", "▁", "<unk>", "ñ", "x" * 90]
    return ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 30))) for _ in range(300)]


def test_byte_bpe_equals_tiktoken(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    want = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    rows = [tuple(r) for r in docs] + list(enumerate(odd_texts(), 10_000)) + [(None, None), (7, ""), (7, "x")]
    got = byte_bpe.encode_documents(table(spark, rows), path, public_tokenizers.PATTERN).collect()
    code = lambda t: np.array(want.encode_ordinary(t or ""), "<u4").tobytes()
    assert by_text((r.doc_id, r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in got) == by_text(
        (d, len(code(t)) // 4, code(t), (t or "").encode()) for d, t in rows)
    assert byte_bpe.encode_documents(table(spark, []), path, public_tokenizers.PATTERN).count() == 0


def test_bit_planes_round_trip():
    rnd = np.random.default_rng(1)
    for n, top in ((1, 1), (8, 2), (1000, 50_257), (65_536, 1 << 32), (5, 1)):
        ids = rnd.integers(0, top, n).astype("<u4")
        planes, count = token_output.shuffle_block(ids)
        assert count == n and np.array_equal(token_output.unshuffle_block(planes, n), ids)


def test_token_files(spark, scratch_dir):
    path = public_tokenizers.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    texts = odd_texts() + [None, "", "<|endoftext|> in text", "word " * 90_000]
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(None, "last"), (6, texts[2])]
    rows = random.Random(0).sample(rows, len(rows))
    token_output.write_ids(table(spark, rows), f"{scratch_dir}/ids", path, 2, file_bytes=40_000)
    got = sorted(token_output.read_ids(spark, f"{scratch_dir}/ids").collect(), key=lambda r: r.start)
    ids = [(d, own.encode(t or "", add_special_tokens=False).ids + [2]) for d, t in sorted(rows, key=lambda r: order(r[0]))]
    assert [r.doc_id for r in got] == [d for d, _ in ids]
    start = 0
    for r, (_, want) in zip(got, ids):
        assert r.start == start and np.frombuffer(bytes(r.ids), "<u4").tolist() == want
        start += len(want)
    token_output.write_ids(table(spark, []), f"{scratch_dir}/none", path, 2)
    assert token_output.read_ids(spark, f"{scratch_dir}/none").count() == 0


# ------------------------------------------------------------------ queries and pipeline
def test_pipeline_stages_against_their_inputs(spark, scratch_dir):
    import corpus_pipeline

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    scores = {r.doc_id: r.score for r in quality.score(docs, quality.train(docs, labels)).collect()}
    first = corpus_pipeline.quality_stage(spark, docs, sf)
    assert first.columns == docs.columns
    assert {r.doc_id for r in first.collect()} == {d for d, s in scores.items() if s >= 0.3}
    first.write.parquet(f"{scratch_dir}/1")
    first = spark.read.parquet(f"{scratch_dir}/1")
    second = corpus_pipeline.near_duplicate_stage(spark, first, sf)
    groups = simhash.near_duplicates(first).collect()
    assert sorted(r.doc_id for r in second.collect()) == sorted({r.component_id for r in groups})
    second.write.parquet(f"{scratch_dir}/2")
    second = spark.read.parquet(f"{scratch_dir}/2")
    rows = [(r.doc_id, r.text) for r in second.collect()]
    third = corpus_pipeline.substring_stage(spark, second, sf)
    assert third.columns == docs.columns
    found = third.collect()
    want = [(d, " ".join(x for x, y in zip(w, g) if not y) if any(g) else t) for d, t, w, g in brute_words(rows, 50)]
    assert sorted((r.doc_id, r.text) for r in found) == sorted(want)
    lengths = {r.doc_id: r.n_chars for r in second.collect()}
    old = dict(rows)
    assert all(r.n_chars == (len(r.text) if r.text != old[r.doc_id] else lengths[r.doc_id]) for r in found)


def test_pipeline_on_empty_and_null_tables(spark, scratch_dir):
    import corpus_pipeline

    ddl = "doc_id long, text string, lang string, source string, n_chars long"
    for name, rows in (("none", []), ("nulls", [(None, None, None, None, None)] * 3 + [(1, "", None, "s", 0), (2, "a b", "en", "s", 3)])):
        d = f"{scratch_dir}/{name}"
        spark.createDataFrame(rows, ddl).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        spark.createDataFrame([(None, None)] * len(rows), "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        out = corpus_pipeline.run(spark, d).collect()
        assert len(out) == (0 if not rows else 2)  # all without words are one group


def test_registered_digests(spark):
    from larder.llm import queries

    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = sorted(docs, reverse=True)
    for r in queries.op2_spotsigs(spark, sf).collect():
        t, n = docs[r.doc_id], docs[ids[(ids.index(r.doc_id) + 1) % len(ids)]]
        assert r.edited_sha256 == hashlib.sha256((t[:len(t) - len(t) // 2] + n[:len(t) // 2]).encode()).hexdigest()
    for r in queries.op7_simhash(spark, sf).collect():
        assert r.fingerprint == f"{brute_simhash(docs[r.doc_id]):016x}"
