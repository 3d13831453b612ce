"""Compare registered queries with their SQL on the same tables."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {
    "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "DATE": "date",
    "BOOLEAN": "boolean", "TIMESTAMP": "timestamp_ntz", "TIMESTAMP WITH TIME ZONE": "timestamp",
}


def connection(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def canonical(value):
    if value is None:
        return "~"
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(value + 0.0)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canonical(r[i]) for i in order) for r in rows)


def check(spark, con, name, query, sql, folder):
    """(problem or None, rows, seconds of the query)."""
    start = time.time()
    df = query(spark, folder)
    got = [tuple(r) for r in df.collect()]
    seconds = time.time() - start
    if sql is None:
        return (None if got else "no rows"), len(got), seconds
    rel = con.execute(sql)
    columns = [d[0] for d in rel.description]
    want = rel.fetchall()
    types = {d[0]: KINDS.get(str(d[1]), str(d[1])) for d in con.execute(f"DESCRIBE {sql}").fetchall()}
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(columns)}", len(got), seconds
    kinds = dict(df.dtypes)
    off = {c: (kinds[c], types[c]) for c in columns if kinds[c] != types[c]}
    if off:
        return f"types {off}", len(got), seconds
    a, b = rows_of(df.columns, got), rows_of(columns, want)
    if a != b:
        only_a, only_b = sorted(set(a) - set(b)), sorted(set(b) - set(a))
        return f"rows {len(a)} against {len(b)}; only here {len(only_a)} {only_a[:3]}; only there {len(only_b)} {only_b[:3]}", len(got), seconds
    return None, len(got), seconds


def main():
    import __spark_entry__ as entry
    from tidemark.session import build_session

    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connection(folder)
    names = sys.argv[1:] or list(entry.queries())
    bad = 0
    for n in names:
        try:
            problem, rows, seconds = check(spark, con, n, entry.queries()[n], entry.oracle_sql().get(n), folder)
        except Exception as e:  # noqa: BLE001
            problem, rows, seconds = f"{type(e).__name__}: {str(e)[:900]}", 0, 0.0
        bad += problem is not None
        kind = "sql" if n in entry.oracle_sql() else "rows"
        print(f"{'BAD' if problem else 'ok '} {n:28s} {kind:4s} {rows:8d} {seconds:7.2f}s {problem or ''}", flush=True)
    print(f"{len(names) - bad} of {len(names)} fine")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
