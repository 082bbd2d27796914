"""Run queries and their expected-result SQL side by side and compare sorted rows.

Usage: python tests/compare.py [data folder] [query ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _rows(table) -> list[tuple]:
    names = sorted(table.column_names)
    columns = [table.column(n).to_pylist() for n in names]
    return sorted(zip(*columns), key=repr)


def _kind(t) -> str:
    text = str(t)
    return {"large_string": "string"}.get(text, text)


def difference(df, con, sql: str) -> str | None:
    got, want = df.toArrow(), con.execute(sql).to_arrow_table()
    if sorted(got.column_names) != sorted(want.column_names):
        return f"columns {sorted(got.column_names)} / {sorted(want.column_names)}"
    if got.num_rows != want.num_rows:
        return f"rows {got.num_rows} / {want.num_rows}"
    for name in got.column_names:
        a, b = _kind(got.schema.field(name).type), _kind(want.schema.field(name).type)
        if a != b:
            return f"type of {name}: {a} / {b}"
    for a, b in zip(_rows(got), _rows(want)):
        if a != b:
            return f"{sorted(got.column_names)}\n   got  {a}\n   want {b}"
    return None


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from docproof.session import build_session

    folder = argv[0] if argv else "/root/testdata/sf0.01"
    spark = build_session(
        "local[8]", **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g",
                       "spark.ui.showConsoleProgress": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, expected = connect(folder), entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if argv[1:] and name not in argv[1:]:
            continue
        started = time.time()
        try:
            if name in expected:
                problem = difference(fn(spark, folder), con, expected[name])
            else:
                problem = None
                print(f"rows only: {name} {fn(spark, folder).count()}")
        except Exception as error:  # noqa: BLE001 - report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:900]}"
        took = time.time() - started
        if problem:
            bad += 1
            print(f"DIFF {name} ({took:.1f}s): {problem}", flush=True)
        else:
            print(f"ok {name} ({took:.1f}s)", flush=True)
    for name in set(expected) - set(entry.queries()):
        print("no query for", name)
        bad += 1
    print("problems:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
