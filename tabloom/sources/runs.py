"""Run records."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_run(record: DataFrame, path: str) -> None:
    """Append a run record; runs are told apart by their ``run_id`` column."""
    record.write.mode("append").json(path)
