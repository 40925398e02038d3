"""Binding of names to values that are worked out once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body names it.  It must hold no Python function."""
    return F.element_at(F.transform(F.array(value), body), 1)


def bind(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column worked out once per row.

    Unlike ``withColumn`` the optimizer cannot copy the expression into filters and
    projections above, since the column comes out of a one-element generator.
    """
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c != name), F.explode(F.array(value)).alias(name))
