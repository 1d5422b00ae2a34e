"""Run registered queries against their SQL: row count, column names and sorted values.

python tests/compare.py [folder] [query ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
]


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return con


def plain(value):
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.12g}")
    return value


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    values = sorted((tuple(plain(row[k]) for k in order) for row in rows), key=repr)
    return [columns[k] for k in order], values


def kind(name: str) -> str:
    name = name.lower()
    for ours, theirs in (("bigint", "bigint"), ("int", "integer"), ("string", "varchar"), ("timestamp_ntz", "timestamp")):
        if name == ours:
            return theirs
    return name


def compare(con, frame, sql: str) -> str | None:
    """The first difference, or nothing."""
    got = table_of(frame.columns, [tuple(row) for row in frame.collect()])
    result = con.execute(sql)
    described = {d[0]: str(d[1]).lower() for d in result.description}
    want = table_of([d[0] for d in result.description], result.fetchall())
    types = {name: kind(t) for name, t in frame.dtypes}
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} rows != {len(want[1])}"
    for mine, theirs in zip(got[1], want[1]):
        if mine != theirs:
            return f"{got[0]}: {mine} != {theirs}"
    other = {n: (types[n], described[n]) for n in types if types[n] != described[n] and described[n] != "number"}
    if other:
        return f"types differ: {other}"
    return None


def main() -> int:
    import __spark_entry__ as registered
    from skywake.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark, con = local_session(), connect(sf_dir)
    queries, oracles = registered.queries(), registered.oracle_sql()
    failed = 0
    for name, build in queries.items():
        if wanted and name not in wanted:
            continue
        started = time.monotonic()
        try:
            problem = compare(con, build(spark, sf_dir), oracles[name]) if name in oracles else "no SQL"
        except Exception as error:
            problem = str(error)[:1500]
        failed += problem is not None
        print(f"{name:28s} {time.monotonic() - started:6.2f}s {problem or 'ok'}", flush=True)
    print(f"{failed} failed, missing SQL: {sorted(set(queries) - set(oracles))}, extra: {sorted(set(oracles) - set(queries))}")
    return failed


if __name__ == "__main__":
    sys.exit(main())
