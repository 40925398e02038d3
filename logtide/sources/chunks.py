"""A chunked remote log: each chunk is a JSON array of events with a start and a next token.

Columns of a chunk: chunk_start, next_offset, up_to_date, body.  Members that do not
decode are reported and skipped.  A member's offset is its own if it carries one,
the chunk's next token if it is the last decodable member, else the chunk's start, so
that resuming from any saved offset may repeat events but never skips one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtide.functions.envelope import null_if_empty, parse_time

CHUNK_SCHEMA = "chunk_start string, next_offset string, up_to_date boolean, body string"
_MEMBER = "offset string, id string, origin string, type string, data variant, metadata map<string,string>, timestamp string, __corrupt string"


def _members(chunks: DataFrame) -> DataFrame:
    # variants keep a member's JSON as it is, whatever its kind
    body = F.try_parse_json("body")
    items = F.try_variant_get(body, "$", "array<variant>")
    rows = chunks.select("chunk_start", "next_offset", F.posexplode(items).alias("member", "item"))
    text = F.to_json(F.col("item"))
    kind = F.schema_of_variant(F.col("item"))
    parsed = F.from_json(text, _MEMBER, {"columnNameOfCorruptRecord": "__corrupt"})
    rows = rows.select("chunk_start", "next_offset", "member", text.alias("text"), kind.startswith("OBJECT").alias("object"), parsed.alias("e"))
    good = F.col("object") & F.col("e.__corrupt").isNull() & F.col("e").isNotNull()
    return rows.withColumn("good", F.coalesce(good, F.lit(False)))


def decode_chunks(chunks: DataFrame) -> DataFrame:
    """Events of chunks in log columns (position within the chunk as ``member``), each with its assigned offset."""
    rows = _members(chunks).where("good")
    last = rows.groupBy("chunk_start").agg(F.max("member").alias("last_member"))
    rows = rows.join(last, "chunk_start")
    own = null_if_empty(F.col("e.offset"))
    offset = F.when(own.isNotNull(), own).when(F.col("member") == F.col("last_member"), F.col("next_offset")).otherwise(F.col("chunk_start"))
    return rows.select(
        "chunk_start",
        "member",
        offset.alias("offset"),
        null_if_empty(F.col("e.id")).alias("id"),
        null_if_empty(F.col("e.origin")).alias("origin"),
        F.col("e.type").alias("type"),
        F.coalesce(F.to_json(F.col("e.data")), F.lit("null")).alias("data"),
        F.when(F.size("e.metadata") > 0, F.col("e.metadata")).alias("metadata"),
        parse_time(F.col("e.timestamp")).alias("timestamp"),
    )


def rejected(chunks: DataFrame) -> DataFrame:
    """Members that were skipped: chunk_start, member, text."""
    return _members(chunks).where("not good").select("chunk_start", "member", "text")


def next_offset(chunks: DataFrame, start: str = "") -> DataFrame:
    """Where a scan of these chunks ends (one row), past any number of empty ones.

    With a ``seq`` column that is the next token of the last chunk.  Without one it is
    the token that no chunk starts at, since tokens themselves have no order; a chunk
    that did not advance ends the scan at its own start.
    """
    if "seq" in chunks.columns:
        return chunks.agg(F.coalesce(F.max_by("next_offset", "seq"), F.lit(start)).alias("next_offset"))
    moved = chunks.where("chunk_start <> next_offset").select(F.col("chunk_start").alias("next_offset"))
    return chunks.select("next_offset").join(moved, "next_offset", "left_anti").agg(F.coalesce(F.max("next_offset"), F.lit(start)).alias("next_offset"))
