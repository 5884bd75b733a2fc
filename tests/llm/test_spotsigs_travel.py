"""op2: large groups of near copies, and what travels besides the texts."""

import random
import re

import pytest

from larder.llm import common, spotsigs
from tests.llm.test_operators import brute_spots, table


def brute_classes(sets):
    """Smallest id reached and links, of ids and their sets."""
    similar = lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b)
    nodes = set(map(frozenset, sets.values()))
    near = {n: [m for m in nodes if m != n and similar(n, m)] for n in nodes}
    low = {n: min(d for d, s in sets.items() if s == n) for n in nodes}
    changed = True
    while changed:
        changed = False
        for n in nodes:
            least = min([low[n], *(low[m] for m in near[n])])
            changed |= least != low[n]
            low[n] = least
    return {d: (low[frozenset(s)], len(near[frozenset(s)])) for d, s in sets.items()}


def test_spotsigs_large_groups_are_counted_in_blocks(spark, monkeypatch):
    rnd = random.Random(9)
    words = ["rain", "sun", "wind", "hill", "sea", "tree", "fog", "ice", "sand", "moss"]
    texts = []
    for base in (["the " + rnd.choice(words) + f"{i}" for i in range(40)], ["of " + rnd.choice(words) + f"{i}" for i in range(25)]):
        for i in range(90):  # near copies that share most first signatures, and some too far from each other
            w = list(base)
            for _ in range(rnd.choice([0, 1, 1, 2, 3])):
                w[rnd.randrange(len(w))] = f"the {rnd.choice(words)}{rnd.randrange(300)}"
            texts.append(" ".join(w))
    rows = [*enumerate(texts), (500, texts[3]), (501, ""), (502, None), (503, "the rain")]
    sets = {d: brute_spots(t or "") for d, t in rows}
    want = brute_classes(sets)
    assert max(n for _, n in want.values()) > spotsigs.HOT
    for block in (spotsigs.BLOCK, 20):
        monkeypatch.setattr(spotsigs, "BLOCK", block)
        assert {r.doc_id: (r.class_id, r.n_links) for r in spotsigs.similar_classes(table(spark, rows)).collect()} == want


def test_spotsigs_pairs_of_a_large_group_are_not_written_out(spark):
    base = " ".join(f"the word{i}" for i in range(40))
    rows = table(spark, [(i, f"{base} the end{i}") for i in range(300)])
    assert {(r.class_id, r.n_links) for r in spotsigs.similar_classes(rows).collect()} == {(0, 299)}
    saved, counts = spotsigs._counted(common.keyed(rows, "doc_id", "text"), spotsigs.anchor_hashes(spotsigs.ANCHORS), 3)
    first = spotsigs._first_spots(saved.where("spots IS NOT NULL").select("node", "spots"), counts, 0.8, 3, 4)
    assert spotsigs._meet(first, 0.8, 1).count() <= 15 * 300  # of 44,850 pairs


def test_spotsigs_classes_travel_with_the_texts(spark):
    rows = [(i, f"the Ship sails of night {i // 2} and a day. the moon, is {i % 4} of them!" * (1 + i % 3)) for i in range(60)]
    rows += [(None, "the ship of no id"), (None, "the other of no id"), (None, "the ship of no id"), (7, "a second text of seven"), (90, ""),
             (91, None)]
    out = spotsigs.with_classes(table(spark, rows))
    plan = out._jdf.queryExecution().toString()
    assert not re.search(r"hashpartitioning\((fingerprint|edited)", plan) and "Join" not in plan.split("MapInArrow")[0]
    got = out.collect()
    assert len(got) == len(rows)
    classes = sorted((r.doc_id or -1, r.class_id or -1, r.n_links) for r in spotsigs.similar_classes(table(spark, rows)).collect())
    assert sorted((r.doc_id or -1, r.class_id or -1, r.n_links) for r in got) == classes
    texts = dict(r for r in rows if r[0] is not None and r[0] != 7)
    for r in got:
        if r.doc_id in texts:
            a, b = brute_spots(texts[r.doc_id] or ""), brute_spots(r.edited)
            assert r.length == len(a) and r.edited_length == len(b) and len(r.edited_fingerprint) == 8 * len(b)
            assert r.near_edited == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
