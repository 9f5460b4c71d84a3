"""Runs queries next to their SQL and prints what differs: python tests/check_oracles.py [sf] [names]."""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402

TABLES = ["events", "embeddings", "pages", "documents", "benchmark"]


def duck(sf_dir: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    return con


def differences(spark_df, sql: str, con) -> str | None:
    """None when rows, columns and values agree; else what does not."""
    ours = spark_df.toPandas()
    theirs = con.execute(sql).df()
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(ours.columns)} / {sorted(theirs.columns)}"
    if len(ours) != len(theirs):
        return f"rows {len(ours)} / {len(theirs)}"
    names = sorted(ours.columns)
    tables = []
    for df in (ours, theirs):
        text = df[names].astype(object).where(df[names].notna(), None).map(
            lambda v: None if v is None else (f"{v:.9g}" if isinstance(v, float) else str(v))
        )
        tables.append(text.fillna("NULL").sort_values(names).reset_index(drop=True))
    kinds = [
        (n, str(ours[n].dtype), str(theirs[n].dtype)) for n in names
        if str(ours[n].dtype) != str(theirs[n].dtype)
    ]
    wrong = (tables[0] != tables[1]).any(axis=1)
    if wrong.any():
        return f"{wrong.sum()} rows\n{tables[0][wrong].head(3)}\n{tables[1][wrong].head(3)}"
    return f"types {kinds}" if kinds and len(ours) else None


def main() -> None:
    from tests.session import new_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    names = sys.argv[2:] or list(entry.queries())
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = new_session(), duck(sf_dir)
    pd.set_option("display.width", 200, "display.max_columns", 20)
    for name in names:
        begin = time.time()
        try:
            result = entry.queries()[name](spark, sf_dir)
            sql = entry.oracle_sql().get(name)
            if sql is None:
                found = f"no SQL, {result.count()} rows"
            else:
                found = differences(result, sql, con) or "ok"
        except Exception as error:  # noqa: BLE001
            found = f"FAILED {str(error)[:1500]}"
        print(f"{name:24} {time.time() - begin:6.1f}s  {found}", flush=True)


if __name__ == "__main__":
    main()
