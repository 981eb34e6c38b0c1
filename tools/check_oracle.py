"""Run every registered query on Spark and its oracle SQL on DuckDB and
compare (column names, row count, order-insensitive values).

    python tools/check_oracle.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from pagewright.plans.catalog import ORACLE, QUERIES  # noqa: E402
from pagewright.session import get_session  # noqa: E402

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def canon(v):
    if v is None:
        return ("~",)
    if isinstance(v, float):
        if math.isnan(v):
            return ("nan",)
        return ("n", round(v, 6))
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, int):
        return ("n", float(v))
    return ("s", str(v))


def rows_of(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(canon(r[i]) for i in order) for r in records)


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 and sys.argv[1].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in sys.argv[1:] if not a.startswith("/")] or sorted(QUERIES)
    spark = get_session("local[8]", 8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    ok = bad = 0
    for name in names:
        t0 = time.time()
        try:
            sdf = QUERIES[name](spark, sf_dir)
            scols = sdf.columns
            srows = [tuple(r) for r in sdf.collect()]
        except Exception as exc:  # report and go on
            print(f"FAIL {name}: spark error {type(exc).__name__}: {str(exc)[:400]}")
            bad += 1
            continue
        t1 = time.time()
        if name not in ORACLE:
            print(f"ROWS {name}: {len(srows)} rows, spark {t1 - t0:.1f}s")
            continue
        try:
            res = con.execute(ORACLE[name])
            dcols = [d[0] for d in res.description]
            drows = res.fetchall()
        except Exception as exc:
            print(f"FAIL {name}: duckdb error {type(exc).__name__}: {str(exc)[:400]}")
            bad += 1
            continue
        t2 = time.time()
        if sorted(scols) != sorted(dcols):
            print(f"FAIL {name}: columns {sorted(scols)} vs {sorted(dcols)}")
            bad += 1
            continue
        a, b = rows_of(scols, srows), rows_of(dcols, drows)
        if a != b:
            sa, sb = set(a), set(b)
            print(f"FAIL {name}: rows {len(a)} vs {len(b)}; only spark {len(sa - sb)}, only duckdb {len(sb - sa)}")
            print("   spark-only e.g.", sorted(sa - sb)[:2])
            print("   duckdb-only e.g.", sorted(sb - sa)[:2])
            bad += 1
            continue
        ok += 1
        print(f"OK   {name}: {len(a)} rows, spark {t1 - t0:.1f}s duckdb {t2 - t1:.1f}s")
    print(f"passed {ok}, failed {bad}")


if __name__ == "__main__":
    main()
