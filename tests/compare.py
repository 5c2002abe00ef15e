"""Run registered queries against their SQL twins and compare every value.

``python tests/compare.py [folder] [name ...]`` prints one line per query.
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("documents", "labels", "pages", "benchmark", "conversations", "embeddings")


def sql_rows(folder: str, sql: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    result = con.execute(sql)
    names = [column[0] for column in result.description]
    return names, result.fetchall()


def normal(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def value(x):
        if isinstance(x, bool) or x is None or isinstance(x, str):
            return str(x)
        return f"{float(x):.9g}"

    return [names[i] for i in order], sorted(tuple(value(row[i]) for i in order) for row in rows)


def differences(df, folder: str, sql: str) -> str:
    """Empty when both sides agree."""
    ours = normal(df.columns, [tuple(row) for row in df.collect()])
    theirs = normal(*sql_rows(folder, sql))
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} against {theirs[0]}"
    if len(ours[1]) != len(theirs[1]):
        return f"{len(ours[1])} rows against {len(theirs[1])}"
    off = [(a, b) for a, b in zip(ours[1], theirs[1]) if a != b]
    return f"{len(off)} of {len(ours[1])} rows differ, first {off[0]}" if off else ""


if __name__ == "__main__":
    import __spark_entry__ as entry
    from textassay.session import build

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build("compare", **{"spark.master": "local[8]", "spark.ui.enabled": "false", "spark.driver.memory": "16g",
                                "spark.sql.shuffle.partitions": "8", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracle = entry.queries(), entry.oracle_sql()
    for name in sys.argv[2:] or queries:
        start = time.time()
        try:
            df = queries[name](spark, folder)
            note = differences(df, folder, oracle[name]) if name in oracle else f"no SQL, {df.count()} rows"
            rows = ""
        except Exception as error:  # report and go on with the next query
            note = f"{type(error).__name__}: {str(error)[:600]}"
        print(f"{'ok  ' if not note or note.startswith('no SQL') else 'FAIL'} {name} {time.time() - start:.1f}s {note}", flush=True)
    spark.stop()
