"""Metrics and order statistics against brute force."""

import math
import random

from larder.operators.evaluate import exact_order_stats, metrics_by_type, query_metrics


def brute(grades, k=10, binary=False, compat=False):
    rel = (grades + [0] * k)[:k]
    gains = [(1.0 if g >= 2 else 0.0) if binary else (2 ** g - 1) for g in rel]
    dcg = sum(x / math.log2(i + 2) for i, x in enumerate(gains))
    idcg = sum(x / math.log2(i + 2) for i, x in enumerate(sorted(gains, reverse=True)))
    first = next((i for i, g in enumerate(rel, 1) if g >= 2), None)
    return (sum(1 for g in rel[:5] if g >= 2) / 5, sum(1 for g in rel if g >= 2) / 10,
            dcg / idcg if idcg else 0.0, 0.0 if first is None else 1.0 / (first + (1 if compat else 0)))


def test_query_metrics_match_brute_force(spark):
    random.seed(7)
    data, judged = [], []
    for q in range(30):
        n = random.randint(0, 10)
        grades = [random.randint(0, 3) for _ in range(n)]
        judged.append((f"q{q}", "t%d" % (q % 3)))
        data += [(f"q{q}", i + 1, g) for i, g in enumerate(grades)]
    g = spark.createDataFrame(data, "query_id string, rank int, grade int")
    j = spark.createDataFrame(judged, "query_id string, type string")
    for binary, compat in ((False, False), (True, True)):
        got = {r["query_id"]: (r["p5"], r["p10"], r["ndcg"], r["mrr"])
               for r in query_metrics(g, j, binary=binary, compat_mrr=compat).collect()}
        for q, _t in judged:
            grades = [x[2] for x in sorted((d for d in data if d[0] == q), key=lambda d: d[1])]
            if binary and not grades:  # nothing graded, nothing measured
                assert got[q] == (None,) * 4
                continue
            want = brute(grades, binary=binary, compat=compat)
            assert all(abs(a - b) < 1e-9 for a, b in zip(got[q], want)), (q, got[q], want)
    by_type = metrics_by_type(query_metrics(g, j)).collect()
    assert {r["type"] for r in by_type} == {None, "t0", "t1", "t2"}
    rows = [("t", 1.0, None), ("t", 0.5, None), ("t", None, None)]
    means = metrics_by_type(spark.createDataFrame(rows, "type string, p5 double, ndcg double"), ("p5", "ndcg")).first()
    assert (means["n"], means["p5"], means["ndcg"]) == (3, 0.75, None)


def test_exact_order_stats_with_hot_group(spark):
    random.seed(3)
    rows = [("hot", random.random()) for _ in range(3000)] + [("cold%d" % (i % 5), random.random()) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: (r["n"], r["p50"], r["p95"]) for r in exact_order_stats(df, "g", "v", {"p50": 0.5, "p95": 0.95},
                                                                             partitions=7).collect()}
    groups = {}
    for g, v in rows:
        groups.setdefault(g, []).append(v)
    for g, vs in groups.items():
        vs.sort()
        assert got[g] == (len(vs), vs[len(vs) // 2], vs[int(len(vs) * 0.95)])

