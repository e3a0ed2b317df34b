"""Run registered queries next to their SQL and report differences: ``compare.py [sf] [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if value is None:
        return "\0"
    return f"{type(value).__name__[:3]}:{value}"


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(_plain(r[i]) for i in order) for r in records)


def difference(spark_frame, relation) -> str | None:
    """None when both hold the same columns and the same rows, otherwise what differs first."""
    left = rows(spark_frame.columns, [tuple(r) for r in spark_frame.collect()])
    right = rows(relation.columns, relation.fetchall())
    if left[0] != right[0]:
        return f"columns {left[0]} != {right[0]}"
    if len(left[1]) != len(right[1]):
        return f"{len(left[1])} rows != {len(right[1])} rows"
    for a, b in zip(left[1], right[1]):
        if a != b:
            first = next(i for i, (x, y) in enumerate(zip(a, b)) if x != y)
            return f"{left[0][first]}: {a[first][:300]!r} != {b[first][:300]!r} (row {str(a)[:120]})"
    return None


def main(folder: str, names: list[str]) -> int:
    import __spark_entry__ as entry
    from tabloom.session import session

    spark = session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(folder)
    oracles, bad = entry.oracle_sql(), 0
    for name, build in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            frame = build(spark, folder)
            found = difference(frame, connection.sql(oracles[name])) if name in oracles else f"no SQL, {frame.count()} rows"
        except Exception as problem:  # noqa: BLE001
            found = f"{type(problem).__name__}: {str(problem)[:600]}"
        bad += found is not None
        print(f"{'ok  ' if found is None else 'DIFF'} {name} {time.time() - start:.2f}s {found or ''}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.001'}", sys.argv[2:]))
