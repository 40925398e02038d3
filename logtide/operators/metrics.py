"""Telemetry over event rows: counters, rates, explicit-bucket histograms and quantiles from buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

#: Upper bounds of the duration buckets, in milliseconds.
BOUNDS = (0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0, 1000.0, 2500.0)


def counters(rows: DataFrame, by: list[str], error: Column | None = None) -> DataFrame:
    """Events, and errors among them, by label."""
    out = [F.count(F.lit(1)).alias("events")]
    if error is not None:
        out.append(F.count_if(error).alias("errors"))
    return rows.groupBy(*by).agg(*out)


def rate(rows: DataFrame, by: list[str], minutes: int = 1, time: str = "timestamp", error: Column | None = None) -> DataFrame:
    """Events (and errors) per second in tumbling windows, by label."""
    seconds = 60.0 * minutes
    out = [(F.count(F.lit(1)) / seconds).alias("rate")]
    if error is not None:
        out.append((F.count_if(error) / seconds).alias("error_rate"))
    grouped = rows.groupBy(F.window(time, f"{minutes} minutes").alias("w"), *by).agg(*out)
    return grouped.select(F.col("w.start").alias("window_start"), *(c for c in grouped.columns if c != "w"))


def buckets(rows: DataFrame, value: Column, by: list[str], bounds: tuple[float, ...] = BOUNDS) -> DataFrame:
    """Cumulative counts by label and ``le`` (the last one infinite), one pass with one counter per bound."""
    counts = [F.count_if(value <= b).alias(f"b{i}") for i, b in enumerate(bounds)]
    # counted by a column even without labels, so that no rows give no series
    wide = rows.groupBy(*by).agg(*counts, F.count(value).alias("all_n"))
    les = [F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)]
    les.append(F.struct(F.lit(float("inf")).alias("le"), F.col("all_n").alias("n")))
    return wide.select(*by, F.explode(F.array(*les)).alias("b")).select(*by, "b.le", F.col("b.n").alias("n"))


def histogram_quantile(cells: DataFrame, q: float, by: list[str]) -> DataFrame:
    """Quantile by label from cumulative buckets: linear within a bucket, the highest finite bound beyond."""
    finite = F.col("le") < float("inf")
    labels = by or [F.lit(0).alias("__all")]
    grouped = cells.groupBy(*labels).agg(
        F.max("n").alias("total"),
        F.max(F.when(finite, F.col("le"))).alias("top"),
        F.sort_array(F.collect_list(F.struct("le", "n"))).alias("cells"),
    )
    ranked = grouped.withColumn("rank", F.col("total") * F.lit(q))
    hit = ranked.withColumn("hit", F.get(F.filter("cells", lambda c: c["n"] >= F.col("rank")), F.lit(0)))
    hit = hit.withColumn("under", F.filter("cells", lambda c: c["n"] < F.col("rank")))
    below = F.when(F.size("under") > 0, F.get("under", F.size("under") - 1))
    low, count = F.coalesce(below["le"], F.lit(0.0)), F.coalesce(below["n"], F.lit(0))
    inside = low + (F.col("hit.le") - low) * (F.col("rank") - count) / (F.col("hit.n") - count)
    value = F.when(F.col("total") == 0, F.lit(None).cast("double")).when(F.isnan("hit.le") | (F.col("hit.le") == float("inf")), F.col("top")).otherwise(inside)
    return hit.select(*by, value.alias("quantile"))


def label_values(rows: DataFrame, label: str) -> DataFrame:
    return rows.select(label).distinct()


def observed(rows: DataFrame, name: str | Observation, error: Column | None = None) -> DataFrame:
    """``rows`` with counters reported through Spark's observation mechanism under ``name``."""
    out = [F.count(F.lit(1)).alias("events")]
    if error is not None:
        out.append(F.count_if(error).alias("errors"))
    return rows.observe(name, *out)


def gaps(rows: DataFrame, by: list[str], time: str = "timestamp") -> DataFrame:
    """Milliseconds since the row before, by label: the input of duration histograms where rows carry times only."""
    w = Window.partitionBy(*by).orderBy("position")
    before = F.lag(time).over(w)
    return rows.withColumn("gap_ms", (F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(before.cast("timestamp"))) / 1000.0)
