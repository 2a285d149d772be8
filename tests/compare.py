"""Runs queries and their SQL over the same tables and compares all rows.

By itself: ``python tests/compare.py FOLDER [QUERY ...]``.
"""

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def database(folder):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ""
    if isinstance(value, float):
        return f"{value:.6f}"
    return str(value)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_plain(row[i]) for i in order) for row in rows)


def difference(df, con, sql):
    """None if both agree, otherwise a short account of how they differ."""
    got = df.collect()
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    expected = _rows(names, found.fetchall())
    actual = _rows(df.columns, got)
    if actual == expected:
        return None
    only_a = sorted(set(actual) - set(expected))[:3]
    only_e = sorted(set(expected) - set(actual))[:3]
    return f"{len(actual)} rows and {len(expected)}; only Spark {only_a}; only SQL {only_e}"


def main():
    from __spark_entry__ import oracle_sql, queries
    from banterscope.session import local_session

    folder = sys.argv[1]
    spark = local_session()
    con = database(folder)
    sql = oracle_sql()
    chosen = sys.argv[2:] or list(queries())
    for name in chosen:
        start = time.time()
        try:
            df = queries()[name](spark, folder)
            told = difference(df, con, sql[name]) if name in sql else f"no SQL, {df.count()} rows"
        except Exception as error:  # shown, so that the others still run
            told = f"{type(error).__name__}: {str(error)[:1500]}"
        print(f"{time.time() - start:7.2f}s {name}: {told or 'same'}", flush=True)


if __name__ == "__main__":
    main()
