"""Envelope scalars: metadata maps, empty texts as null, nanosecond timestamps as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METADATA = "map<string,string>"


def null_if_empty(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def present_metadata(metadata: Column) -> Column:
    """A metadata map, null where it has no entries."""
    return F.when(F.size(metadata) > 0, metadata)


def metadata_to_json(metadata: Column) -> Column:
    return F.to_json(present_metadata(metadata))


def metadata_from_json(text: Column) -> Column:
    """A metadata map from its JSON; malformed text fails the query."""
    return F.when(null_if_empty(text).isNotNull(), F.from_json(text, METADATA, {"mode": "FAILFAST"}))


def format_time(timestamp: Column) -> Column:
    """UTC time as RFC 3339 with as many decimals as it has."""
    utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), timestamp.cast("timestamp").cast("timestamp_ntz"))
    whole = F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat(F.regexp_replace(whole, r"\.?0*$", ""), F.lit("Z"))


def parse_time(text: Column) -> Column:
    """Timestamp of an RFC 3339 text, null if it is none.  Decimals beyond microseconds are cut."""
    cut = F.regexp_replace(text, r"(\.\d{6})\d+", "$1")
    return F.when(text.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)$"), F.try_to_timestamp(cut))
