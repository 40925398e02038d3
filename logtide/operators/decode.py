"""Decoding of JSON payloads against a registered schema, with poison detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logtide.functions.binding import bind, let
from logtide.operators.registry import EventType

_CORRUPT = "__corrupt"


def zero_of(kind: T.DataType) -> Column:
    """The value that a missing field of this type takes."""
    if isinstance(kind, T.StringType):
        return F.lit("")
    if isinstance(kind, T.BooleanType):
        return F.lit(False)
    if isinstance(kind, T.NumericType):
        return F.lit(0).cast(kind)
    if isinstance(kind, T.StructType):
        return F.struct(*(zero_of(f.dataType).alias(f.name) for f in kind.fields))
    return F.lit(None).cast(kind)


def _filled(value: Column, kind: T.StructType) -> Column:
    fields = []
    for f in kind.fields:
        inner = value[f.name]
        inner = F.when(inner.isNotNull(), _filled(inner, f.dataType)) if isinstance(f.dataType, T.StructType) else inner
        fields.append(F.coalesce(inner, zero_of(f.dataType)).alias(f.name))
    return F.struct(*fields)


def decode_column(data: Column, event_type: EventType) -> Column:
    """Struct (value, poison).  A JSON ``null`` decodes to zeros; text that does not fit the schema is poison."""
    schema = T.StructType([*event_type.schema.fields, T.StructField(_CORRUPT, T.StringType())])

    def judged(parsed: Column) -> Column:
        poison = (F.trim(data) != "null") & (parsed.isNull() | parsed[_CORRUPT].isNotNull())
        poison = F.coalesce(poison, F.lit(True))
        bare = F.struct(*(parsed[f.name].alias(f.name) for f in event_type.schema.fields))
        value = _filled(bare, event_type.schema) if event_type.zero_fill else bare
        return F.struct(F.when(~poison, value).alias("value"), poison.alias("poison"))

    return let(F.from_json(data, schema, {"columnNameOfCorruptRecord": _CORRUPT}), judged)


def decode(log: DataFrame, event_type: EventType, into: str = "event") -> DataFrame:
    """Rows of the type, with the decoded payload as a struct column (null for poison) and a ``poison`` flag."""
    out = bind(log.where(F.col("type") == event_type.name), "__d", decode_column(F.col("data"), event_type))
    return out.select(*(c for c in log.columns if c not in (into, "poison")), F.col("__d.value").alias(into), F.col("__d.poison").alias("poison"))


def dead_letters(log: DataFrame, event_type: EventType) -> DataFrame:
    """Poison rows of the type: position, type, reason, data."""
    bad = decode(log, event_type).where("poison")
    return bad.select("position", "type", F.lit("undecodable").alias("reason"), "data")
