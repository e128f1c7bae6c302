"""Compare registered queries with their SQL oracle: ``python tests/compare.py [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, (int, float, str, bool)):
        return value
    return str(value)


def rows_of(columns: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(plain, key=repr)


def compare(spark, con, query, sql: str, sf_dir: str, allow_empty: bool = False) -> str | None:
    """None when equal, otherwise the first difference."""
    result = query(spark, sf_dir)
    plan = result._jdf.queryExecution().executedPlan().toString()
    for operator in ("CartesianProduct", "NestedLoopJoin", "EvalPython"):
        if operator in plan:
            return f"the plan contains {operator}"
    left_columns, left = rows_of(result.columns, [tuple(r) for r in result.collect()])
    cursor = con.execute(sql)
    right_columns, right = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    if left_columns != right_columns:
        return f"columns {left_columns} != {right_columns}"
    if len(left) != len(right):
        extra = [r for r in left if r not in set(right)][:2], [r for r in right if r not in set(left)][:2]
        return f"rows {len(left)} != {len(right)}: {extra}"
    if not left and not allow_empty:
        return "no rows"
    for a, b in zip(left, right, strict=True):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"{left_columns}\n  spark  {a}\n  oracle {b}"
    return None


if __name__ == "__main__":
    import __spark_entry__ as entry
    from logspark.session import build_session

    args = sys.argv[1:]
    sf = "/root/testdata/sf0.01"
    if args and args[0].startswith("/"):
        sf = args.pop(0)
    session = build_session("compare")
    connection = connect(sf)
    oracles, queries = entry.oracle_sql(), entry.queries()
    for name in args or queries:
        started = time.time()
        if name not in oracles:
            print(f"{name:26} rows-only {queries[name](session, sf).count()} {time.time() - started:.1f}s", flush=True)
            continue
        try:
            difference = compare(session, connection, queries[name], oracles[name], sf)
        except Exception as error:  # report and go on with the next query
            difference = f"{type(error).__name__}: {str(error)[:1500]}"
        print(f"{name:26} {'ok' if difference is None else 'DIFF ' + difference} {time.time() - started:.1f}s", flush=True)
