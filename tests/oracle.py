"""Compare registered queries with their SQL on DuckDB.

Run as a script to check all, or only the named, queries:
    python -m tests.oracle SF_DIR [key ...]
"""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import pandas as pd


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def canonical(frame):
    """Rows as sorted text, columns in name order."""
    frame = frame[sorted(frame.columns)]

    def cell(v):
        if v is None or v is pd.NA or v != v:
            return "null"
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return str(bool(v))
        if isinstance(v, (int,)) or "int" in type(v).__name__:
            return str(int(v))
        if isinstance(v, float) or "float" in type(v).__name__:
            return f"{float(v) + 0.0:.6f}"
        return str(v)

    rows = sorted(tuple(cell(v) for v in row) for row in frame.itertuples(index=False, name=None))
    return list(frame.columns), rows


def difference(spark, con, sf_dir, fn, sql) -> str | None:
    got_columns, got = canonical(fn(spark, sf_dir).toPandas())
    want_columns, want = canonical(con.execute(sql).df())
    if got_columns != want_columns:
        return f"columns {got_columns} != {want_columns}"
    if len(got) != len(want):
        return f"{len(got)} rows, expected {len(want)}"
    for a, b in zip(got, want):
        if a != b:
            return f"{a} != {b}"
    return None


def main(argv):
    from __spark_entry__ import oracle_sql, queries
    from turnwise.session import local_session, release

    sf_dir, only = argv[0], argv[1:]
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    sqls = oracle_sql()
    bad = 0
    for key, fn in queries().items():
        if only and key not in only:
            continue
        began = time.time()
        try:
            if key in sqls:
                said = difference(spark, con, sf_dir, fn, sqls[key])
            else:
                said = f"rows only: {fn(spark, sf_dir).count()}"
        except Exception as failure:  # noqa: BLE001
            said = f"FAILED {type(failure).__name__}: {str(failure)[:600]}"
        bad += said is not None
        release(spark)
        print(f"{'ok ' if said is None else 'BAD'} {key} {time.time() - began:.1f}s {said or ''}", flush=True)
    print(f"{bad} differ")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
