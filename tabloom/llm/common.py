"""What several of these operators share: words, null-safe keys, Arrow steps and lockstep lanes."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.session import ship

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Bytes to bytes: A-Z in lower case.
LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())
# Bytes to bytes: A-Z in lower case, and a blank for every ASCII character that is no letter or digit.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def blank_words(text: Column) -> Column:
    """The words between ASCII white space; none for null."""
    parts = F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+")
    return F.filter(parts, lambda w: w != "")


def plain_words(text: Column) -> Column:
    """The runs of ASCII letters, digits and other characters above ASCII, A-Z in lower case; none for null."""
    parts = F.split(ascii_lower(F.coalesce(text, F.lit(""))), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
    return F.filter(parts, lambda w: w != "")


def same(left: Column, right: Column) -> Column:
    """Equality under which null equals null."""
    return left.eqNullSafe(right)


def arrow_map(df: DataFrame, step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``df.mapInArrow`` with this package at hand in the workers."""
    ship(df.sparkSession)
    return df.mapInArrow(step, schema)


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def pieces(texts: list, size: int) -> Iterator[tuple[int, int]]:
    """Runs of neighbours with about ``size`` characters together, one text at least."""
    start, held = 0, 0
    for at, text in enumerate(texts):
        if held and held + len(text or "") > size:
            yield start, at
            start, held = at, 0
        held += len(text or "")
    if start < len(texts):
        yield start, len(texts)


def starts_of(lengths: Iterable[int]) -> np.ndarray:
    """Where each of several joined sequences starts, and where the last one ends."""
    return np.concatenate(([0], np.cumsum(np.fromiter(lengths, np.int64))))
