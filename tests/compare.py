"""Run registered queries in Spark and DuckDB and compare the results."""

from __future__ import annotations

import datetime
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def canonical(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9) + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, (list, tuple)):
        return tuple(canonical(v) for v in value)
    return value


def kind(value) -> str:
    return type(value).__name__


def ordered(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    place = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(canonical(r[i]) for i in place) for r in rows]
    return sorted(columns), sorted(out, key=repr)


def difference(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """Null when both give the same rows, else a short description."""
    left_cols, left = ordered(spark_df.columns, spark_df.collect())
    cur = con.execute(sql)
    right_cols, right = ordered([c[0] for c in cur.description], cur.fetchall())
    if left_cols != right_cols:
        return f"columns {left_cols} != {right_cols}"
    if len(left) != len(right):
        return f"rows {len(left)} != {len(right)}"
    for a, b in zip(left, right):
        if a != b or [kind(x) for x in a] != [kind(x) for x in b]:
            return f"first difference:\n   spark  {a!r:.700}\n   duckdb {b!r:.700}"
    return None


def session(cores: str = "8"):
    from accordant.session import build_session

    spark = build_session(
        "compare",
        spark__master=f"local[{cores}]",
        spark__sql__shuffle__partitions="4",
        spark__driver__memory="8g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(argv: list[str]) -> int:
    import __spark_entry__ as contract

    sf = f"/root/testdata/{argv[0]}"
    wanted = argv[1:]
    spark, con = session(), duck(sf)
    queries, oracle = contract.queries(), contract.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            df = fn(spark, sf)
            if name in oracle:
                problem = difference(df, con, oracle[name])
            else:
                problem = None
                print(f"     {name}: {len(df.collect())} rows, no SQL")
        except Exception as error:  # report and go on to the next query
            problem = f"{type(error).__name__}: {str(error)[:900]}"
        bad += problem is not None
        print(f"{'BAD ' if problem else 'ok  '} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(min(main(sys.argv[1:]), 1))
