"""Run registered Spark queries and their DuckDB oracles side by side.

Usage: python tools/check_oracles.py [sf_dir] [name ...]
Prints one line per query: rows, schema and order-insensitive value match.
"""

from __future__ import annotations

import hashlib
import math
import sys
import time

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])

import duckdb  # noqa: E402

from larder.session import build_session  # noqa: E402

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return repr(round(v, 6))
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return repr(v)
    return str(v)


def digest(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(norm(r[i]) for i in order) for r in rows)
    return hashlib.sha1("\n".join(lines).encode()).hexdigest(), lines


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    import importlib.util
    spec = importlib.util.spec_from_file_location("entry", __file__.rsplit("/tools/", 1)[0] + "/__spark_entry__.py")
    entry = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(entry)
    qs, sqls = entry.queries(), entry.oracle_sql()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    spark = build_session("local[8]", 8)
    bad = 0
    for name in names or list(qs):
        t0 = time.time()
        try:
            df = qs[name](spark, sf)
            rows = [tuple(r) for r in df.collect()]
            cols = df.columns
        except Exception as e:  # noqa: BLE001
            print(f"{name:28s} SPARK-ERROR {str(e)[:300]}")
            bad += 1
            continue
        ts = time.time() - t0
        if name not in sqls:
            print(f"{name:28s} rows={len(rows)} (no oracle) {ts:.1f}s")
            continue
        try:
            rel = con.execute(sqls[name])
            ocols = [d[0] for d in rel.description]
            orows = rel.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"{name:28s} SQL-ERROR {str(e)[:400]}")
            bad += 1
            continue
        h1, l1 = digest(rows, cols)
        h2, l2 = digest(orows, ocols)
        ok = (len(rows) == len(orows)) and sorted(cols) == sorted(ocols) and h1 == h2
        print(f"{name:28s} {'OK ' if ok else 'BAD'} spark={len(rows)} sql={len(orows)} {ts:.1f}s"
              + ("" if sorted(cols) == sorted(ocols) else f" cols {sorted(cols)} vs {sorted(ocols)}"))
        if not ok:
            bad += 1
            s1, s2 = set(l1), set(l2)
            for x in sorted(s1 - s2)[:3]:
                print("   spark only:", x[:300])
            for x in sorted(s2 - s1)[:3]:
                print("   sql only:  ", x[:300])
    print("mismatches:", bad)


if __name__ == "__main__":
    main()
