"""Run every query with an oracle at a scale and compare rows. python tests/oracle.py [sf_dir] [name ...]"""

from __future__ import annotations

import datetime
import decimal
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(value):
    if isinstance(value, float):
        return round(value, 9)
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def rows(columns: list[str], data) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(canonical(r[i]) for i in order) for r in data)


def compare(spark, name: str, sf_dir: str, queries: dict, sql: dict) -> str:
    df = queries[name](spark, sf_dir)
    got = rows(df.columns, df.collect())
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    rel = con.sql(sql[name])
    want = rows(rel.columns, rel.fetchall())
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} / {sorted(rel.columns)}"
    if got != want:
        return f"{sum(got.values())} / {sum(want.values())} rows; only here {list((got - want).items())[:2]}; only there {list((want - got).items())[:2]}"
    return ""


if __name__ == "__main__":
    from conftest import session

    import __spark_entry__ as entry

    spark = session()
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    for name in sys.argv[2:] or entry.oracle_sql():
        began = time.time()
        try:
            said = compare(spark, name, sf_dir, entry.queries(), entry.oracle_sql())
        except Exception as e:  # noqa: BLE001
            said = f"{type(e).__name__}: {str(e)[:500]}"
        print(f"{'ok  ' if not said else 'DIFF'} {name} {time.time() - began:.1f}s {said}", flush=True)
