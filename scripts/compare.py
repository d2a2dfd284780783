"""Run queries next to their SQL and report differences.

    python scripts/compare.py [--sf 0.01] [--module manifest_queries] [name ...]
"""

from __future__ import annotations

import argparse
import importlib
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

from trackloom.plans.spec import REGISTRY
from trackloom.session import build_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=lambda t: tuple((v is None, str(v)) for v in t))


def compare(spark, con, folder: str, name: str) -> tuple[bool, str]:
    q = REGISTRY[name]
    start = time.time()
    frame = q.spark_frame(spark, folder)
    got = rows_of(frame.columns, frame.collect())
    spent = time.time() - start
    sql = q.oracle()
    if sql is None:
        return True, f"{len(got)} rows, no SQL, {spent:.2f}s"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    if sorted(names) != sorted(frame.columns):
        return False, f"columns {names} vs {frame.columns}"
    if got != want:
        odd = [(a, b) for a, b in zip(got, want) if a != b][:2]
        return False, f"{len(got)} vs {len(want)} rows; {odd}"
    return bool(got), f"{len(got)} rows equal, {spent:.2f}s" + ("" if got else "  EMPTY")


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("--module", default="catalogue")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    importlib.import_module(f"trackloom.plans.{args.module}")
    folder = f"/root/testdata/sf{args.sf}"
    spark = build_session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    failed = []
    for name in args.names or REGISTRY:
        try:
            ok, text = compare(spark, con, folder, name)
        except Exception as error:  # report and go on with the next query
            ok, text = False, f"{type(error).__name__}: {str(error)[:600]}"
        print("ok  " if ok else "FAIL", name, text, flush=True)
        if not ok:
            failed.append(name)
    print(f"{len(failed)} failed", failed)


if __name__ == "__main__":
    main()
