"""User functions over batches of columns, for what no built-in expression can say."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tabloom.session import ship

Columns = Mapping[str, Sequence[Any]]


def map_batches(
    df: DataFrame, transform: Callable[[Columns], Columns], added: T.StructType, inputs: Sequence[str],
    remove: Sequence[str] = (), rows: int = 1_000,
) -> DataFrame:
    """Append the columns ``transform`` makes of lists of the ``inputs`` columns, and drop ``remove``.

    The function sees at most ``rows`` rows at a time and returns one value per row; columns it does
    not ask for pass by as Arrow data.
    """
    carried = [f for f in df.schema.fields if f.name not in remove]
    kinds = {f.name: to_arrow_type(f.dataType) for f in added.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, rows):
                batch = whole.slice(start, rows)
                made = transform({name: batch.column(name).to_pylist() for name in inputs})
                new = [pa.array(made[name], type=kind) for name, kind in kinds.items()]
                if any(len(column) != batch.num_rows for column in new):
                    raise ValueError("the function must return one value per row")
                old = [batch.column(f.name) for f in carried]
                yield pa.RecordBatch.from_arrays(old + new, names=[f.name for f in carried] + list(kinds))

    ship(df.sparkSession)
    return df.mapInArrow(run, T.StructType([*carried, *added.fields]))
