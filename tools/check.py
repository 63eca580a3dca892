"""Run queries in Spark and their SQL in DuckDB on the same tables and compare the rows.

usage: python tools/check.py [sf] [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

from tapeloom.plans.catalog import ORACLES, QUERIES  # noqa: E402
from tapeloom.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else repr(v)
    if v is None:
        return None
    return f"{type(v).__name__}:{v}"


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    names = sys.argv[2:] or list(QUERIES)
    folder = f"/root/testdata/sf{sf}"
    spark = local_session("8")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    bad = []
    for name in names:
        try:
            t0 = time.time()
            df = QUERIES[name](spark, folder)
            cols = sorted(df.columns)
            got = df.select(cols).toArrow()
            t1 = time.time()
            mine = list(zip(*[[norm(v) for v in col.to_pylist()] for col in got.columns])) if got.num_columns else []
            if name not in ORACLES:
                print(f"{name:22s} rows {len(mine):7d} spark {t1 - t0:6.2f}s (no SQL)", flush=True)
                continue
            cur = con.execute(ORACLES[name])
            names_ = [d[0] for d in cur.description]
            if sorted(names_) != cols:
                raise AssertionError(f"columns differ {sorted(names_)} vs {cols}")
            pick = [names_.index(c) for c in cols]
            theirs = [tuple(norm(r[k]) for k in pick) for r in cur.fetchall()]
            t2 = time.time()
            a, b = Counter(mine), Counter(theirs)
            ok = a == b
            print(
                f"{name:22s} rows {len(mine):7d} spark {t1 - t0:6.2f}s duckdb {t2 - t1:6.2f}s {'ok' if ok else 'DIFF'}",
                flush=True,
            )
            if not ok:
                bad.append(name)
                print("  columns", cols, "sql rows", len(theirs), "differing", sum((a - b).values()))
                for row in sorted((a - b), key=str)[:3]:
                    print("   spark", row)
                for row in sorted((b - a), key=str)[:3]:
                    print("   sql  ", row)
        except Exception as exc:  # noqa: BLE001 - report and go on with the next query
            bad.append(name)
            print(f"{name:22s} FAILED {type(exc).__name__}: {str(exc)[:1500]}", flush=True)
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
