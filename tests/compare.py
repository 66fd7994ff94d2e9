"""Run registered queries beside their SQL on the given tables and compare the values.

    python tests/compare.py sf0.01 [name part ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def _key(value):
    if value is None:
        return "~"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6f}"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_key(r[i]) for i in order) for r in rows)


def compare(spark, con, sf, run, sql) -> str:
    """Empty when both sides agree, else what differs."""
    df = run(spark, sf)
    mine = rows_of(df.columns, df.collect())
    if sql is None:
        return "" if mine else "no rows"
    res = con.execute(sql)
    columns = [d[0] for d in res.description]
    theirs = rows_of(columns, res.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    if len(mine) != len(theirs):
        return f"{len(mine)} rows != {len(theirs)}"
    for a, b in zip(mine, theirs):
        if a != b:
            return f"{[(x[:300], y[:300]) for x, y in zip(a, b) if x != y]}"
    return "" if mine else "no rows"


def main() -> int:
    import __spark_entry__ as entry
    from semcorpus.session import local_session

    sf = f"/root/testdata/{sys.argv[1]}"
    parts = sys.argv[2:]
    spark, con = local_session(8), connect(sf)
    sqls, bad = entry.oracle_sql(), 0
    for name, run in entry.queries().items():
        if parts and not any(p in name for p in parts):
            continue
        begin = time.time()
        try:
            said = compare(spark, con, sf, run, sqls.get(name))
        except Exception as e:  # noqa: BLE001
            said = f"{type(e).__name__}: {str(e)[:1500]}"
        bad += bool(said)
        print(f"{'FAIL' if said else 'ok  '} {name} {time.time() - begin:.1f}s {'' if name in sqls else '(no sql) '}{said}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
