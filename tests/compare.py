"""Run queries and their SQL checks side by side: ``python tests/compare.py module [names]``."""

from __future__ import annotations

import importlib
import math
import sys
import time
import traceback
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return con


def canonical(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return round(value, 6) + 0.0
    if hasattr(value, "as_tuple"):
        return float(value)
    return value


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    body = [tuple(canonical(row[i]) for i in order) for row in rows]
    return names, sorted(body, key=repr)


def difference(spark_df, con, sql) -> str | None:
    mine = table_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    answer = con.execute(sql)
    theirs = table_of([d[0] for d in answer.description], answer.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} / {theirs[0]}"
    if len(mine[1]) != len(theirs[1]):
        extra = [r for r in mine[1] if r not in set(theirs[1])][:2]
        lacking = [r for r in theirs[1] if r not in set(mine[1])][:2]
        return f"rows {len(mine[1])} / {len(theirs[1])}\n  only ours {extra}\n  only sql {lacking}"
    for a, b in zip(mine[1], theirs[1]):
        if a != b:
            return f"values\n  ours {a}\n  sql  {b}"
    return None


def main() -> int:
    from cueline.session import build_session

    module = importlib.import_module(f"cueline.catalog.{sys.argv[1]}")
    wanted = [a for a in sys.argv[2:] if not a.startswith("/")]
    sf = next((a for a in sys.argv[2:] if a.startswith("/")), "/root/testdata/sf0.01")
    spark = build_session(
        **{
            "spark.ui.enabled": "false",
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": "8g",
            "spark.ui.showConsoleProgress": "false",
        }
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    bad = 0
    for name, query in module.QUERIES.items():
        if wanted and name not in wanted:
            continue
        began = time.time()
        try:
            df = query(spark, sf)
            if name in module.ORACLE:
                problem = difference(df, con, module.ORACLE[name])
                note = "" if problem is None else f"DIFF {problem}"
                count = df.count() if wanted else ""
            else:
                rows = df.collect()
                note, count, problem = f"rows-only {rows[:1]}", len(rows), None
        except Exception:  # noqa: BLE001
            problem = note = traceback.format_exc()[-1500:]
            count = "ERROR"
        bad += problem is not None
        print(f"{'BAD' if problem else 'ok '} {name:32s} {time.time() - began:6.2f}s {count} {note[:1800]}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
