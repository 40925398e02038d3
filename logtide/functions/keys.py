"""Composite keys of state entities: "type/key", both parts with ``%`` and ``/`` escaped."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def encode_part(part: str) -> str:
    return part.replace("%", "%25").replace("/", "%2F")


def decode_part(part: str) -> str:
    return part.replace("%2F", "/").replace("%25", "%")


def composite_key(entity_type: str, key: str) -> str:
    return f"{encode_part(entity_type)}/{encode_part(key)}"


def split_key(composite: str) -> tuple[str, str]:
    """Type and key of a canonical composite key; ``ValueError`` for any other text."""
    left, slash, right = composite.partition("/")
    pair = decode_part(left), decode_part(right)
    if not slash or composite_key(*pair) != composite:
        raise ValueError(f"not a canonical composite key: {composite!r}")
    return pair


def encode_part_column(part: Column) -> Column:
    return F.replace(F.replace(part, F.lit("%"), F.lit("%25")), F.lit("/"), F.lit("%2F"))


def decode_part_column(part: Column) -> Column:
    return F.replace(F.replace(part, F.lit("%2F"), F.lit("/")), F.lit("%25"), F.lit("%"))


def composite_key_column(entity_type: Column, key: Column) -> Column:
    return F.concat(encode_part_column(entity_type), F.lit("/"), encode_part_column(key))


def in_collection(composite: Column, entity_type: str) -> Column:
    return F.startswith(composite, F.lit(encode_part(entity_type) + "/"))
