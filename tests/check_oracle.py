"""Runs registered queries next to their SQL: python tests/check_oracle.py [sf] [name …]."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def open_tables(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x + 0.0:.6f}"
    if hasattr(x, "isoformat"):
        return x.isoformat()
    if hasattr(x, "as_tuple"):
        return f"{float(x):.6f}"
    return str(x)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, query, sql, sf_dir):
    """(rows, seconds, None or the difference)."""
    start = time.time()
    df = query(spark, sf_dir)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    seconds = time.time() - start
    if sql is None:
        return len(got[1]), seconds, None
    cur = con.execute(sql)
    want = canonical([d[0] for d in cur.description], cur.fetchall())
    if got == want:
        return len(got[1]), seconds, None
    if got[0] != want[0]:
        return len(got[1]), seconds, f"columns {got[0]} / {want[0]}"
    a, b = set(got[1]), set(want[1])
    return len(got[1]), seconds, (f"rows {len(got[1])} / {len(want[1])}; only here {sorted(a - b)[:3]}; "
                                  f"only in SQL {sorted(b - a)[:3]}")


if __name__ == "__main__":
    from recollect.plans import catalog
    from recollect.session import build_session

    sf_dir = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.01'}"
    session = build_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    connection = open_tables(sf_dir)
    oracle = catalog.oracle_sql()
    wanted = sys.argv[2:]
    bad = 0
    for name, query in catalog.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        try:
            n, seconds, diff = compare(session, connection, query, oracle.get(name), sf_dir)
        except Exception as e:  # report and go on
            n, seconds, diff = 0, 0.0, f"{type(e).__name__}: {str(e)[:600]}"
        bad += diff is not None
        flag = "ok " if diff is None and name in oracle else "run" if diff is None else "BAD"
        print(f"{flag} {name:28s} rows={n:<7d} {seconds:6.2f}s {diff or ''}", flush=True)
    print("differences:", bad)
