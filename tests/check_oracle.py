"""Compare every named query with its SQL, by value. Run as a script: check_oracle.py [folder] [name ...]"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    return con


def _cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    return value


def sorted_rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def difference(spark_df, con, sql: str) -> str | None:
    """None when both sides hold the same rows, otherwise what differs."""
    cur = con.execute(sql)
    names, theirs = [d[0] for d in cur.description], cur.fetchall()
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} <> {sorted(names)}"
    ours = sorted_rows(spark_df.columns, spark_df.collect())
    theirs = sorted_rows(names, theirs)
    if len(ours) != len(theirs):
        return f"{len(ours)} rows <> {len(theirs)}"
    for a, b in zip(ours, theirs):
        if a != b:
            return f"{a} <> {b}"
    return None


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from tidewagon.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con, sqls = local_session(8), connect(folder), oracle_sql()
    wanted = sys.argv[2:] or list(queries())
    bad = 0
    for name in wanted:
        start = time.time()
        try:
            df = queries()[name](spark, folder)
            found = difference(df, con, sqls[name]) if name in sqls else f"no SQL, {df.count()} rows"
        except Exception as e:  # noqa: BLE001
            found = f"{type(e).__name__}: {str(e)[:600]}"
        bad += found is not None
        print(f"{'ok  ' if found is None else 'DIFF'} {name} {time.time() - start:.2f}s {found or ''}", flush=True)
    print("different:", bad, "of", len(wanted))


if __name__ == "__main__":
    main()
