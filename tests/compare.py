"""Run registered queries beside their SQL on the same parquet tables, and compare all values."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def cell(value):
    if value is None:
        return ("null",)
    if isinstance(value, bool):
        return ("bool", value)
    if isinstance(value, decimal.Decimal):
        value = int(value) if value == value.to_integral_value() else float(value)
    if isinstance(value, float):
        return ("nan",) if math.isnan(value) else ("num", round(value, 5) + 0.0)
    if isinstance(value, int):
        return ("num", float(value))
    if isinstance(value, datetime.datetime):
        return ("time", value.replace(tzinfo=None).isoformat())
    if isinstance(value, (list, tuple)):
        return ("list", tuple(cell(v) for v in value))
    if isinstance(value, dict):
        return ("dict", tuple((k, cell(v)) for k, v in value.items()))
    return (type(value).__name__, str(value))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(cell(row[i]) for i in order) for row in rows), key=repr)


def close(a, b):
    if a == b:
        return True
    return a[0] == b[0] == "num" and abs(a[1] - b[1]) <= 1.1e-5 * max(1.0, abs(a[1]))


def compare(spark, con, fn, sql, folder):
    """None if equal, else what differs."""
    df = fn(spark, folder)
    got = df.collect()
    result = con.execute(sql)
    want_columns = [d[0] for d in result.description]
    if sorted(df.columns) != sorted(want_columns):
        return f"columns {sorted(df.columns)} != {sorted(want_columns)}"
    mine, theirs = rows_of(df.columns, got), rows_of(want_columns, result.fetchall())
    if len(mine) != len(theirs):
        return f"{len(mine)} rows != {len(theirs)}"
    bad = [(m, t) for m, t in zip(mine, theirs) if not all(close(a, b) for a, b in zip(m, t))]
    if bad:
        return f"{len(bad)} of {len(mine)} rows differ in {sorted(df.columns)}, such as\n  {bad[0][0]}\n  {bad[0][1]}"
    if not mine:
        return "no rows"
    return None


def main(argv):
    sys.path.insert(0, ".")
    from foretrace.session import build_session
    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.01"
    if argv and argv[0].startswith("/"):
        folder = argv.pop(0)
    spark = build_session("compare", "local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, oracles = connect(folder), entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not argv or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in argv)]
    failed = []
    for name in names:
        start = time.time()
        try:
            if name in oracles:
                problem = compare(spark, con, queries[name], oracles[name], folder)
            else:
                df = queries[name](spark, folder)
                n = len(df.collect())
                problem = None if n else "no rows"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        kind = "D" if name in oracles else "R"
        print(f"{'ok  ' if problem is None else 'FAIL'} {kind} {name} {time.time() - start:.1f}s", flush=True)
        if problem:
            failed.append(name)
            print("   ", problem, flush=True)
    print(f"{len(names) - len(failed)} of {len(names)} agree; failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
