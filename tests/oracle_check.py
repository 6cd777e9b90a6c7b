"""Runs registered queries and their SQL side by side and compares whole results.

    python tests/oracle_check.py /root/testdata/sf0.01 [query ...]
"""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from vocara.plans.datasets import TABLES  # noqa: E402
from vocara.plans.oracle import ORACLE  # noqa: E402
from vocara.plans.queries import QUERIES  # noqa: E402


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def compare(spark, con, sf_dir: str, name: str) -> str | None:
    """None when equal, else what differs."""
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    ours = Counter(tuple(repr(v) for v in row) for row in df.select(*columns).collect())
    cursor = con.execute(ORACLE[name])
    names = [d[0] for d in cursor.description]
    if sorted(names) != columns:
        return f"columns {columns} against {sorted(names)}"
    places = [names.index(c) for c in columns]
    theirs = Counter(tuple(repr(row[i]) for i in places) for row in cursor.fetchall())
    if ours == theirs:
        return None
    only_ours, only_theirs = ours - theirs, theirs - ours
    return (
        f"{sum(ours.values())} rows against {sum(theirs.values())}, {sum(only_ours.values())} differ: "
        f"{dict(zip(columns, next(iter(only_ours), ())))} against {dict(zip(columns, next(iter(only_theirs), ())))}"
    )


if __name__ == "__main__":
    from vocara.session import build_session

    session = build_session(8)
    session.sparkContext.setLogLevel("ERROR")
    folder = sys.argv[1]
    connection = connect(folder)
    for query_name in sys.argv[2:] or QUERIES:
        started = time.time()
        if query_name not in ORACLE:
            print(f"{query_name:24s} no SQL, {QUERIES[query_name](session, folder).count()} rows", flush=True)
            continue
        try:
            difference = compare(session, connection, folder, query_name)
        except Exception as error:
            difference = f"failed: {str(error)[:500]}"
        print(f"{query_name:24s} {time.time() - started:6.2f}s {'equal' if difference is None else difference[:1200]}", flush=True)
