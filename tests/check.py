"""Compare registered queries with their SQL: ``python tests/check.py [sf] [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(v):
        if isinstance(v, float):
            return None if math.isnan(v) else v
        return v

    out = [tuple(cell(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), round(x, 4) if isinstance(x, float) else x) for x in r))


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1.5e-6)
    return type(a) is type(b) and a == b


def difference(spark, con, name, query, sql, sf_dir) -> str | None:
    """None when both results hold the same rows, else what differs."""
    df = query(spark, sf_dir)
    got = canonical([tuple(r) for r in df.collect()], df.columns)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = canonical(cur.fetchall(), names)
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}; e.g. {sorted(set(map(str, got)) ^ set(map(str, want)))[:4]}"
    for g, w in zip(got, want):
        if not all(map(same, g, w)):
            return f"{g} != {w}"
    return None if got else "no rows on either side"


if __name__ == "__main__":
    from catalog import ORACLES, QUERIES
    from isohaline.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    chosen = sys.argv[2:] or list(QUERIES)
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = local_session(), duck(sf_dir)
    spark.sparkContext.setLogLevel("OFF")
    for name in chosen:
        t = time.time()
        try:
            if name in ORACLES:
                verdict = difference(spark, con, name, QUERIES[name], ORACLES[name], sf_dir)
            else:
                verdict = f"rows only: {len(QUERIES[name](spark, sf_dir).collect())}"
        except Exception as e:  # noqa: BLE001 - the listing goes on
            verdict = f"{type(e).__name__}: {str(e)[:700]}"
        print(f"{'ok  ' if verdict is None else 'DIFF'} {name} {time.time() - t:.1f}s {verdict or ''}", flush=True)
