"""Token arrays: splitting, truncating, padding, masking, labels."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabloom.functions import fixed
from tabloom.functions.text import whole_up

# Words of letters, digits and underscores, or single other visible characters.
TOKEN_PATTERN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"


@dataclass(frozen=True)
class SpecialIds:
    """Reserved ids; vocabulary ids start after them. Without a pad id the end id pads.

    ``markers`` are texts that stand for one id each wherever they occur, such as the end of a text.
    """

    unknown: int = 0
    begin: int = 1
    end: int = 2
    pad: int | None = None
    markers: tuple[tuple[str, int], ...] = ()

    @property
    def padding(self) -> int:
        return self.end if self.pad is None else self.pad

    @property
    def first_free(self) -> int:
        reserved = (self.unknown, self.begin, self.end, self.pad, *[number for _, number in self.markers])
        return 1 + max(i for i in reserved if i is not None)


def split_tokens(text: Column, markers: Sequence[tuple[str, int]] = (), spaced: bool = False) -> Column:
    """Words and single other characters; the texts of ``markers`` stay whole, longer ones first.

    ``spaced`` tokens take the blanks before them along, and blanks at the end are a token, so that they join to the text.
    """
    names = sorted((name for name, _ in markers), key=len, reverse=True)
    whole = [re.sub(r"([^\w\s])", r"\\\1", name) for name in names]
    ahead = f"(?!{'|'.join(whole)})" if whole else ""
    pattern = rf"\s*+{ahead}(?:{TOKEN_PATTERN})|\s++" if spaced else TOKEN_PATTERN
    return F.regexp_extract_all(text, F.lit("|".join([*whole, pattern])), F.lit(0))


def count_tokens(text: Column) -> Column:
    """How many tokens :func:`split_tokens` would give, without listing them."""
    return F.regexp_count(text, F.lit(TOKEN_PATTERN))


def first_tokens(text: Column, limit: int) -> Column:
    """The text up to the end of its ``limit``-th token, spacing as it is."""
    return F.regexp_extract(text, rf"^(?s:\s*(?:{TOKEN_PATTERN})){{0,{limit}}}", 0)


def truncated(ids: Column, max_length: int) -> Column:
    return F.slice(ids, 1, max_length)


def framed(ids: Column, special: SpecialIds) -> Column:
    """Begin and end ids around the sequence."""
    return F.concat(F.array(F.lit(special.begin)), ids, F.array(F.lit(special.end)))


def _width(length: Column | int) -> Column:
    return F.lit(length) if isinstance(length, int) else length


def padded(ids: Column, length: Column | int, pad: int) -> Column:
    """Exactly ``length`` ids: cut on the right or filled with ``pad``."""
    width = _width(length)
    missing = F.greatest(F.lit(0), width - F.size(ids)).cast("int")
    return F.concat(F.slice(ids, F.lit(1), width), F.array_repeat(F.lit(pad), missing))


def mask(ids: Column, length: Column | int) -> Column:
    """Ones over the kept ids, zeros over the padding."""
    width = _width(length)
    kept = F.least(F.size(ids), width).cast("int")
    return F.concat(F.array_repeat(F.lit(1), kept), F.array_repeat(F.lit(0), (width - kept).cast("int")))


def labels(ids: Column, pad: int) -> Column:
    """The ids with every pad id replaced by the ignored label, a real end id used as pad included."""
    return F.transform(ids, lambda i: F.when(i == pad, fixed.IGNORED_LABEL).otherwise(i))


def without_ids(ids: Column, dropped: Sequence[int]) -> Column:
    return F.filter(ids, lambda i: ~i.isin(list(dropped)))


def rounded_up(length: Column, multiple: int = fixed.PAD_MULTIPLE) -> Column:
    return (whole_up(length, multiple) * multiple).cast("int")
