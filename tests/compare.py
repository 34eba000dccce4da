"""Compare queries with their DuckDB statements on one data folder: python -m tests.compare FOLDER [NAME...]"""

from __future__ import annotations

import os
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return con


def rows(frame: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or (isinstance(v, float) and v != v) or v is pd.NaT:
            return None
        if hasattr(v, "tolist"):
            v = v.tolist()
        if isinstance(v, float):
            return round(v, 6)
        if hasattr(v, "as_tuple"):
            return float(v)
        return v

    frame = frame[sorted(frame.columns)]
    return sorted((tuple(plain(v) for v in r) for r in frame.astype(object).itertuples(index=False)), key=repr)


def same(df, sql: str, con: duckdb.DuckDBPyConnection) -> tuple[bool, str]:
    got, want = df.toPandas(), con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return False, f"columns {sorted(got.columns)} / {sorted(want.columns)}"
    a, b = rows(got), rows(want)
    if a == b:
        return True, f"{len(a)} rows"
    extra, lost = sorted(set(a) - set(b), key=repr), sorted(set(b) - set(a), key=repr)
    return False, f"{len(a)} / {len(b)} rows; only here {extra[:3]}; only in SQL {lost[:3]}"


if __name__ == "__main__":
    import __spark_entry__ as entry
    from stratograph.session import local_session

    spark = local_session(os.environ.get("COMPARE_CPUS", "8"))
    folder, names = sys.argv[1], sys.argv[2:]
    con, sqls, bad = connect(folder), entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if names and not any(name.startswith(n) for n in names):
            continue
        began = time.time()
        if name in sqls:
            ok, what = same(query(spark, folder), sqls[name], con)
        else:
            ok, what = True, f"{query(spark, folder).count()} rows, no SQL"
        bad += not ok
        print("ok  " if ok else "DIFF", name, f"{time.time() - began:.1f}s", what, flush=True)
    sys.exit(bad > 0)
