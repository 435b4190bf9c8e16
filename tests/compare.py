"""Run registered queries beside their SQL in DuckDB and compare the rows."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6) + 0.0)
    if isinstance(value, (int, str)) or value is None:
        return repr(value)
    return repr(str(value))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def difference(spark, con, entry, sf: str) -> str | None:
    """None when both sides agree, else what differs."""
    df = entry.run(spark, sf)
    got = df.collect()
    if entry.sql is None:
        return None if got else "no rows"
    res = con.execute(entry.sql)
    names = [d[0] for d in res.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    a, b = rows_of(df.columns, got), rows_of(names, res.fetchall())
    if a == b:
        return None if a else "no rows"
    in_a, in_b = set(a), set(b)
    only_a, only_b = [r for r in a if r not in in_b], [r for r in b if r not in in_a]
    return f"{len(a)} vs {len(b)} rows; spark only {only_a[:2]}; sql only {only_b[:2]}"[:1500]


def main() -> int:
    from folioflow.plans.registry import load_all
    from folioflow.session import local_session, ship_package

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    entries = load_all()
    wanted = sys.argv[1:] or list(entries)
    spark, con, bad = local_session(8), connect(sf), 0
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    for name in wanted:
        start = time.time()
        try:
            diff = difference(spark, con, entries[name], sf)
        except Exception as e:  # report and go on
            diff = f"{type(e).__name__}: {str(e)[:900]}"
        bad += diff is not None
        print(f"{'ok ' if diff is None else 'BAD'} {time.time() - start:6.2f}s {name}"
              + (f"\n    {diff}" if diff else ""), flush=True)
    print(f"{len(wanted) - bad}/{len(wanted)} agree")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
