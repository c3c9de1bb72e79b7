"""Compare named queries with their SQL oracles, cell by cell.

``python tests/compare.py [folder] [query ...]`` prints one line per query.
"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from lotwatch import build_session  # noqa: E402
from lotwatch.plans.star_queries import ALL_TABLES  # noqa: E402


def _cell(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(x + 0.0)
    if hasattr(x, "isoformat"):
        return x.replace(tzinfo=None).isoformat()
    return repr(x)


def _bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_cell(r[i]) for i in order) for r in rows)


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in ALL_TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def compare(spark, con, folder: str, name: str) -> str:
    """Empty text when both sides agree, else what differs."""
    df = queries()[name](spark, folder)
    rows = df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    if "CartesianProduct" in plan or "NestedLoopJoin" in plan:
        return "the plan pairs all rows with all rows"
    result = con.execute(oracle_sql()[name])
    columns = [c[0] for c in result.description]
    expected = result.fetchall()
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} <> {sorted(columns)}"
    ours, theirs = _bag(df.columns, rows), _bag(columns, expected)
    if ours == theirs:
        return ""
    extra, lacking = list((ours - theirs).items()), list((theirs - ours).items())
    return f"rows {len(rows)} <> {len(expected)}; {len(extra)} extra, {len(lacking)} lacking\n  spark {str(extra[:2])[:900]}\n  duck  {str(lacking[:2])[:900]}"


def main(folder: str, names: list[str]) -> int:
    os.environ.setdefault("TZ", "UTC")
    spark = build_session(spark__master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    failed = 0
    for name in names or list(queries()):
        start = time.time()
        try:
            problem = compare(spark, con, folder, name) if name in oracle_sql() else f"rows only: {queries()[name](spark, folder).count()}"
        except Exception as e:  # report and go on with the next query
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
        failed += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {time.time() - start:6.1f}s {name} {problem}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    args = sys.argv[1:]
    sys.exit(bool(main(args[0] if args else "/root/testdata/sf0.01", args[1:])))
