"""Text, time and number expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Part = str | Column


def text(*parts: Part) -> Column:
    """Concatenate literals and columns, folding neighbouring literals into one.

    The optimizer leaves adjacent literals inside ``concat`` alone, so they are joined here. NULL in
    any column makes the whole text NULL.
    """
    merged: list[Part] = []
    for part in parts:
        if isinstance(part, str) and merged and isinstance(merged[-1], str):
            merged[-1] += part
        elif not (isinstance(part, str) and part == ""):
            merged.append(part)
    columns = [F.lit(p) if isinstance(p, str) else p for p in merged]
    if not columns:
        return F.lit("")
    return columns[0] if len(columns) == 1 else F.concat(*columns)


def with_margin(template: str, old: int, new: int) -> str:
    """A template with another margin on all of its lines but the first, and those without the old one."""
    line = "\n" + " " * old if old else "\n(?!\n)"
    return re.sub(line, "\n" + " " * new, template)


def filled(template: str, *values: Part) -> Column:
    """Positional ``{}`` template, braces in the values are left as they are."""
    pieces = template.split("{}")
    if len(pieces) != len(values) + 1:
        raise ValueError(f"template has {len(pieces) - 1} slots, got {len(values)} values")
    parts: list[Part] = [pieces[0]]
    for value, piece in zip(values, pieces[1:]):
        parts += [value, piece]
    return text(*parts)


def has_text(column: Column) -> Column:
    """True for non-empty text; NULL counts as empty and blanks count as text."""
    return F.coalesce(column != "", F.lit(False))


def or_literal(column: Column, null_as: str | None) -> Column:
    """Put ``null_as`` where the column is NULL, or leave it when no replacement is given."""
    return column if null_as is None else F.coalesce(column, F.lit(null_as))


def cut_at_stop(column: Column, stops: Sequence[str]) -> Column:
    """Text before the earliest of the stop sequences, unchanged when none occurs."""
    if not stops:
        return column
    hits = [F.when(F.instr(column, stop) > 0, F.instr(column, stop)) for stop in stops]
    first = hits[0] if len(hits) == 1 else F.least(*hits)
    return F.when(first.isNull(), column).otherwise(F.substring(column, F.lit(1), first - 1))


def without_marks(column: Column, marks: Sequence[str]) -> Column:
    """Remove every occurrence of the given special marks."""
    for mark in marks:
        column = F.replace(column, F.lit(mark), F.lit(""))
    return column


def without_echo(column: Column, prompt: Column) -> Column:
    """Drop the prompt when the text starts by repeating it."""
    return F.when(F.startswith(column, prompt), F.substring(column, F.length(prompt) + 1, F.length(column))).otherwise(column)


def same_name(column: Column, name: str) -> Column:
    """Case-insensitive comparison with a name."""
    return F.lower(column) == name.lower()


def timestamp_text(column: Column) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def elapsed_us(start: Column, end: Column) -> Column:
    """Whole microseconds from ``start`` to ``end``."""
    return F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))


def scaled(column: Column, unit: int, digits: int) -> Column:
    """``column / unit`` rounded half-even."""
    return F.bround(column / F.lit(float(unit)), digits)


def mean_or_zero(column: Column) -> Column:
    """Mean of the non-NULL values, zero when there are none."""
    return F.coalesce(F.avg(column), F.lit(0.0))


def whole(column: Column, unit: int) -> Column:
    """Integer division, exact for any long."""
    return F.call_function("div", column, F.lit(unit))


def whole_up(column: Column, unit: int) -> Column:
    """Integer division rounding up."""
    return whole(column + (unit - 1), unit)


def at_most(column: Column, bound: int) -> Column:
    return F.least(column, F.lit(bound))


def json_text(*columns: Column | str, pretty: bool = False) -> Column:
    return F.to_json(F.struct(*columns), {"pretty": "true"} if pretty else {})
