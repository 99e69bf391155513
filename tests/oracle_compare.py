"""Compare a registered Spark query with its DuckDB oracle on the same parquet.

Usage as a script: ``python tests/oracle_compare.py [sf_dir] [name ...]``.
Rows are compared order-insensitively after sorting columns by name, which
is how the driver's value hash treats them.
"""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _canon(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NULL"
        return f"{v:.6g}"
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat(sep=" ", timespec="microseconds")
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_canon(x) for x in v) + "]"
    if hasattr(v, "tolist"):
        return _canon(v.tolist())
    return str(v)


def canon_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_canon(r[i]) for i in order) for r in rows), [columns[i] for i in order]


SPARK_TO_DUCK = {
    "StringType()": "VARCHAR",
    "LongType()": "BIGINT",
    "IntegerType()": "INTEGER",
    "BooleanType()": "BOOLEAN",
    "TimestampNTZType()": "TIMESTAMP",
    "TimestampType()": "TIMESTAMP WITH TIME ZONE",
    "DoubleType()": "DOUBLE",
}


def spark_rows(df):
    cols = df.columns
    return cols, [tuple(r) for r in df.collect()]


def type_mismatches(df, con, sql):
    duck_types = {r[0]: r[1] for r in con.execute(f"DESCRIBE ({sql})").fetchall()}
    out = []
    for f in df.schema.fields:
        mine = SPARK_TO_DUCK.get(repr(f.dataType), repr(f.dataType))
        if duck_types.get(f.name) != mine:
            out.append((f.name, mine, duck_types.get(f.name)))
    return out


# Plan nodes no registered query may contain: pairs of everything (cross
# joins) and row-at-a-time or Arrow Python evaluation.
FORBIDDEN_NODES = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython")


def plan_problems(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [node for node in FORBIDDEN_NODES if node in plan]


def duck_rows(con, sql):
    rel = con.execute(sql)
    cols = [d[0] for d in rel.description]
    return cols, rel.fetchall()


def compare(spark, sf_dir: str, name: str, con=None) -> tuple[bool, str]:
    from __spark_entry__ import oracle_sql, queries

    con = con or duck(sf_dir)
    t0 = time.time()
    df = queries()[name](spark, sf_dir)
    s_cols, s_rows = spark_rows(df)
    t1 = time.time()
    bad_nodes = plan_problems(df)
    if bad_nodes:
        return False, f"{name}: plan contains {bad_nodes}"
    sql = oracle_sql().get(name)
    if sql is None:
        return True, f"{name}: rows-only ({len(s_rows)} rows, {t1 - t0:.1f}s)"
    wrong = type_mismatches(df, con, sql)
    if wrong:
        return False, f"{name}: column types differ {wrong}"
    d_cols, d_rows = duck_rows(con, sql)
    a, ac = canon_rows(s_cols, s_rows)
    b, bc = canon_rows(d_cols, d_rows)
    if ac != bc:
        return False, f"{name}: columns differ spark={ac} duck={bc}"
    if a != b:
        sa, sb = set(a), set(b)
        only_s = sorted(sa - sb)[:3]
        only_d = sorted(sb - sa)[:3]
        return False, f"{name}: rows differ ({len(a)} vs {len(b)}); spark-only {only_s}; duck-only {only_d}"
    return True, f"{name}: OK {len(a)} rows ({t1 - t0:.1f}s)"


def main(argv):
    from rollcall.session import local_session

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    spark = local_session(8)
    from __spark_entry__ import queries

    con = duck(sf_dir)
    bad = 0
    for name in names or list(queries()):
        try:
            ok, msg = compare(spark, sf_dir, name, con)
        except Exception as exc:  # report and go on
            ok, msg = False, f"{name}: ERROR {type(exc).__name__}: {str(exc)[:400]}"
        bad += not ok
        print(("  " if ok else "XX") + " " + msg, flush=True)
    print(f"{bad} failing")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
