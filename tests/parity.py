"""Compare registered queries with their SQL: python -m tests.parity [folder] [name ...]."""

from __future__ import annotations

import datetime
import decimal
import os
import sys
import time
import traceback

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
SAME_TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "date": "DATE", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP", "float": "FLOAT",
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float) and value == 0:
        return 0.0
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, datetime.datetime) and value.tzinfo is not None:
        return value.astimezone(datetime.timezone.utc).replace(tzinfo=None)
    return value


def ordered(names, rows):
    places = [i for _, i in sorted((n, i) for i, n in enumerate(names))]
    return sorted((tuple(plain(row[i]) for i in places) for row in rows), key=repr)


def differences(df, con, sql: str) -> list[str]:
    """What differs in names, types, row count or values; empty if nothing does."""
    con.execute(sql)
    names = [d[0] for d in con.description]
    types = {d[0]: str(d[1]) for d in con.description}
    rows = con.fetchall()
    found = []
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    for name, kind in df.dtypes:
        if SAME_TYPES.get(kind) != types[name]:
            found.append(f"type of {name}: {kind} != {types[name]}")
    got = [tuple(r) for r in df.collect()]
    if len(got) != len(rows):
        found.append(f"rows {len(got)} != {len(rows)}")
    left, right = ordered(df.columns, got), ordered(names, rows)
    wrong = [(a, b) for a, b in zip(left, right) if a != b]
    if wrong:
        found.append(f"{len(wrong)} rows differ, first: {str(wrong[0][0])[:300]} != {str(wrong[0][1])[:300]}")
    return found


def main(argv: list[str]) -> int:
    sys.path.insert(0, os.getcwd())
    import __spark_entry__ as entry_module
    from voxgrain.plans.session import get_session

    folder = argv[0] if argv else "/root/testdata/sf0.01"
    spark = get_session("parity", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "16g",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    queries, sql = entry_module.queries(), entry_module.oracle_sql()
    con = connect(folder)
    failed = 0
    for name in argv[1:] or queries:
        start = time.time()
        try:
            df = queries[name](spark, folder)
            if name in sql:
                found = differences(df, con, sql[name])
                note = "same" if not found else "; ".join(found)
            else:
                found, note = [], f"rows only: {len(df.collect())}"
        except Exception as error:
            found, note = ["error"], (str(error)[:1500] if len(argv) > 1 else str(error)[:500])
            if len(argv) > 1 and not str(error):
                traceback.print_exc()
        failed += bool(found)
        print(f"{'FAIL' if found else 'ok  '} {name} {time.time() - start:.1f}s {note}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
