"""Shared helpers: tables in the shared folder, text splitting."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logtide.sources.paths import shared_dir

#: Characters that separate words, as a regular-expression class body and as plain characters.
SPACE_CLASS = r"\x20\x09-\x0D"
SPACES = " \t\n\x0b\x0c\r"

#: Groups up to this many are broadcast to the rows that look them up; keys of more rows than the second number are never shuffled.
FEW_GROUPS, LARGE_GROUP, FEW_BYTES = 200_000, 10_000, 32_000_000

_written: list[str] = []


def folder(spark: SparkSession, name: str) -> str:
    """Path of a new folder among the shared ones, to be deleted by ``release``."""
    path = f"{shared_dir(spark)}/logtide/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete the tables written by this process so far, once no result that reads them is needed any more; their number."""
    jvm, done = spark._jvm, 0
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        done += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return done


def join_by_count(rows: DataFrame, groups: DataFrame, key: str, few: int = FEW_GROUPS, large: int = LARGE_GROUP, size: Column | None = None) -> DataFrame:
    """``rows`` left-joined to ``groups``, a written table of one row per key.

    Groups are broadcast if there are up to ``few`` of them with up to ``FEW_BYTES`` (by ``size``, a
    group's bytes).  Otherwise the keys of more than ``large`` rows, or of more than a ``few``-th of
    all, are broadcast: they cannot be many.  With them gone no key left is hot, so the
    rest is an ordinary shuffled join.
    """
    total, weight = groups.agg(F.count(F.lit(1)), F.sum(size if size is not None else F.lit(0))).first()
    if total <= few and (weight or 0) <= FEW_BYTES:
        return rows.join(F.broadcast(groups), key, "left")
    counts = table(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n_of_key")).join(groups.select(key), key, "left_semi"), "key-counts")
    least = max(large, (counts.agg(F.sum("n_of_key")).first()[0] or 0) // few)
    hot = table(groups.join(counts.where(F.col("n_of_key") > least), key).drop("n_of_key").withColumn("hot_key_of_join", F.lit(True)), "hot-keys")
    tagged = rows.join(F.broadcast(hot), key, "left")
    first = tagged.where(F.col("hot_key_of_join")).drop("hot_key_of_join")
    rest = tagged.where(F.col("hot_key_of_join").isNull()).select(*rows.columns)
    return first.unionByName(rest.join(groups.join(F.broadcast(hot.select(key)), key, "left_anti"), key, "left"))


_held: dict = {}


def held(key, make):
    """The object under ``key`` in this worker process, made when another or none is held.

    Worker processes serve one operator after another; only one operator's tables and
    memories stay in such a process at a time.
    """
    if key not in _held:
        _held.clear()
        gc.collect()
        _held[key] = make()
    return _held[key]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text, split at ASCII white space."""
    return F.filter(F.split(text, f"[{SPACE_CLASS}]+"), lambda w: w != "")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
