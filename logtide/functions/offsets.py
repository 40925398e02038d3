"""Offsets: opaque text tokens outside, 64-bit positions inside.

``OLDEST`` reads from the start and ``NEWEST`` resolves to the tail.  A concrete
offset is a position padded with zeros to ``WIDTH`` digits; unpadded digits are
accepted on input.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OLDEST = ""
NEWEST = "$"
WIDTH = 20


class OffsetError(ValueError):
    """An offset that names no position."""


def format_offset(position: int) -> str:
    """Offset of a position."""
    return f"{position:0{WIDTH}d}"


def parse_offset(offset: str) -> int:
    """Position of a concrete offset; ``OLDEST`` is 0."""
    if offset == OLDEST:
        return 0
    if not (offset.isascii() and offset.isdigit()):
        raise OffsetError(f"not a concrete offset: {offset!r}")
    return int(offset)


def compare_offsets(a: str, b: str) -> int:
    """-1, 0 or 1; ``NEWEST`` cannot be compared."""
    x, y = parse_offset(a), parse_offset(b)
    return (x > y) - (x < y)


def format_column(position: Column) -> Column:
    return F.lpad(position.cast("string"), WIDTH, "0")


def parse_column(offset: Column, strict: bool = True) -> Column:
    """Positions of a column of offsets; anything else fails the query, or is null where not ``strict``."""
    parsed = F.when(offset == OLDEST, F.lit(0).cast("long")).otherwise(F.when(offset.rlike("^[0-9]+$"), offset.try_cast("long")))
    if not strict:
        return parsed
    message = F.concat(F.lit("not a concrete offset: "), offset)
    return F.when(offset.isNull() | parsed.isNotNull(), parsed).otherwise(F.raise_error(message).cast("long"))


def compare_columns(a: Column, b: Column) -> Column:
    return F.signum(parse_column(a) - parse_column(b)).cast("int")
