"""Run registered queries next to their SQL twins.

usage: python tests/compare.py SF_DIR [name-prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(int(value))
    if isinstance(value, float):
        return "NULL" if math.isnan(value) else f"{value:.6f}"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def difference(spark_df, con, sql) -> str | None:
    """None when equal, else a short description."""
    cursor = con.execute(sql)
    expected_columns = [d[0] for d in cursor.description]
    expected = rows_of(expected_columns, cursor.fetchall())
    actual = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if sorted(spark_df.columns) != sorted(expected_columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(expected_columns)}"
    if actual == expected:
        return None if actual else "both empty"
    a, b = set(actual), set(expected)
    return (
        f"{len(actual)} rows vs {len(expected)}; only ours: {sorted(a - b)[:3]}; "
        f"only SQL: {sorted(b - a)[:3]}"
    )


def main() -> int:
    import __spark_entry__ as entry
    from codeshoal.session import local_session

    sf_dir, prefixes = sys.argv[1], tuple(sys.argv[2:])
    spark = local_session()
    con = connect(sf_dir)
    oracle = entry.oracle_sql()
    bad = 0
    for name, query in entry.queries().items():
        if prefixes and not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            df = query(spark, sf_dir)
            if name in oracle:
                problem = difference(df, con, oracle[name])
            else:
                n = df.count()
                problem = None if n else "no rows"
        except Exception as error:  # noqa: BLE001
            problem = "".join(traceback.format_exception_only(error))[:1500]
        took = time.time() - start
        if problem:
            bad += 1
        kind = "" if name in oracle else "(rows only) "
        print(f"{'FAIL' if problem else 'ok  '} {took:6.2f}s {kind}{name} {problem or ''}",
              flush=True)
    print(f"{bad} failed")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
