"""Taking the head of a table and splitting rows into kept and set aside."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions import fixed
from tabloom.functions.tokens import count_tokens

# Keys that a selection may sort at its end, the keys it samples per pass, and the ranges it counts.
SORTED_ROWS = 100_000
SAMPLED = 4_096
SPLITTERS = 64
_SPLIT = re.compile(r"^(\w+)(?:\[:(\d+)\])?$")


def parse_split(split: str) -> tuple[str, int | None]:
    """``name`` or ``name[:n]``; any other slice is refused."""
    found = _SPLIT.match(split)
    if not found:
        raise ValueError(f"unsupported split {split!r}: use name or name[:n]")
    return found[1], None if found[2] is None else int(found[2])


def _up_to(values: Sequence, schema: T.StructType, at: int = 0) -> Column:
    """Keys at or before the given one, column by column; nulls come first."""
    field, value, last = F.col(schema.fieldNames()[at]), values[at], at + 1 == len(values)
    if value is None:
        return field.isNull() if last else field.isNull() & _up_to(values, schema, at + 1)
    end = F.lit(value).cast(schema.fields[at].dataType)
    if last:
        return field.isNull() | (field <= end)
    return field.isNull() | (field < end) | ((field == end) & _up_to(values, schema, at + 1))


def _from_start(values: Sequence, schema: T.StructType) -> Column:
    """:func:`_up_to`, with a bound of the leading column on its own that reaches the scan."""
    return _up_to(values, schema) & _up_to(values[:1], schema)


def _range_of(splitters: Sequence[tuple], schema: T.StructType, first: int = 0) -> Column:
    """How many splitters lie before a key, by halving."""
    if not splitters:
        return F.lit(first)
    middle = len(splitters) // 2
    return F.when(_up_to(splitters[middle], schema), _range_of(splitters[:middle], schema, first)).otherwise(
        _range_of(splitters[middle + 1:], schema, first + middle + 1)
    )


def nth_key(keys: DataFrame, n: int) -> tuple | None:
    """The ``n``-th row of ``keys`` in their order, counting from 1; None if there are fewer.

    By selection: a sample of the range that holds it gives splitters, one pass counts exactly how many keys lie between any two,
    and one of these ranges is what is left, until it is small enough to sort. Keys are neither stored nor shuffled before that;
    what comes to the driver is the sample, of about ``SAMPLED`` keys, ``SPLITTERS`` counts per pass, and one key.
    """
    schema, names = keys.schema, keys.columns
    place, held = n, keys.count()
    if n < 1 or place > held:
        return None
    while held > SORTED_ROWS:
        sample = keys.sample(min(1.0, SAMPLED / held), seed=fixed.SEED).orderBy(*names).collect()
        splitters = list(dict.fromkeys(tuple(row) for row in sample[:: max(1, len(sample) // SPLITTERS)]))
        counted = keys.groupBy(_range_of(splitters, schema).alias("range")).count().orderBy("range").collect()
        before = 0
        for row in counted:
            if before + row["count"] >= place:
                break
            before += row["count"]
        if row["count"] == held:
            break
        if row["range"]:
            keys = keys.filter(~_up_to(splitters[row["range"] - 1], schema))
        if row["range"] < len(splitters):
            keys = keys.filter(_from_start(splitters[row["range"]], schema))
        place, held = place - before, row["count"]
    return tuple(keys.orderBy(*names).offset(place - 1).limit(1).first())


def head(df: DataFrame, n: int, key: Sequence[str]) -> DataFrame:
    """The first ``n`` rows in key order, as a filter; nulls come first.

    The key of the ``n``-th row is found by :func:`nth_key`; the wide rows are kept or dropped where they are. Keys must be unique:
    rows that share the last key all stay.
    """
    if n < 1:
        return df.filter(F.lit(False))
    keys = df.select(*key)
    last = nth_key(keys, n)
    return df if last is None else df.filter(_from_start(last, keys.schema))


def split_by(df: DataFrame, keep: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that pass and the rest; an undecided row is set aside."""
    passed = F.coalesce(keep, F.lit(False))
    return df.filter(passed), df.filter(~passed)


def split_missing(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with all the columns present, and rows missing at least one."""
    keep = F.lit(True)
    for name in columns:
        keep = keep & F.col(name).isNotNull()
    return split_by(df, keep)


def once(df: DataFrame, value: Column, name: str) -> DataFrame:
    """Adds a costly value that filters read rather than repeat.

    A filter on a plain projection is pushed below it together with a copy of the expression; it does
    not pass a one-element explode.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def split_too_long(df: DataFrame, text: str, limit: int) -> tuple[DataFrame, DataFrame]:
    """Prompts of at most ``limit`` tokens, and longer ones with their number of ``tokens``.

    A text of ``limit`` characters cannot have more tokens, so only longer ones are counted.
    """
    may_be_long = F.coalesce(F.length(text) > limit, F.lit(False))
    counted = once(df, F.when(may_be_long, count_tokens(F.col(text))).otherwise(0), "tokens")
    long = once(df.filter(may_be_long), count_tokens(F.col(text)), "tokens")
    return counted.filter(F.col("tokens") <= limit).drop("tokens"), long.filter(F.col("tokens") > limit)
