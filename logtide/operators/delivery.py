"""Delivery: routing, filters, once, dedup, origin, poison policies and checkpoint values over a log DataFrame.

Operators run in the order dedup, origin, upcast, type, decode, filter; own-origin
rows still count for dedup.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtide.functions.offsets import format_column
from logtide.operators.decode import decode
from logtide.operators.registry import EventType
from logtide.operators.upcast import Upcasts

ABORT, SKIP = "abort", "skip"
DEDUP_WINDOW = 1024


def route(log: DataFrame, name: str) -> DataFrame:
    """Rows of one type."""
    return log.where(F.col("type") == name)


def of_types(log: DataFrame, names: list[str]) -> DataFrame:
    """Rows of any subscribed type; others are skipped."""
    return log.where(F.col("type").isin(names)) if names else log.limit(0)


def matching(log: DataFrame, predicate: Column | None) -> DataFrame:
    """Rows for which the predicate holds; null is no match."""
    return log if predicate is None else log.where(predicate)


def once(log: DataFrame, by: list[str]) -> DataFrame:
    """The first row by position of each handler (the values of ``by``), by one aggregate instead of a sort."""
    row = F.struct(*log.columns)
    return log.groupBy(*by).agg(F.min_by(row, F.col("position")).alias("__row")).select("__row.*")


def foreign(log: DataFrame, origin: str, include_own: bool = False) -> DataFrame:
    """Rows of other origins; rows without an origin stay."""
    return log if include_own else log.where(~F.col("origin").eqNullSafe(F.lit(origin)))


def _unique_ids(log: DataFrame) -> DataFrame:
    """The first row of each id; blank ids are never duplicates.

    Only ids and positions are aggregated; rows are compared with the ids that repeat,
    so that payloads are not shuffled where those are few enough to be broadcast.
    """
    seen = log.where("id <> ''").groupBy("id").agg(F.min("position").alias("__first"), F.count(F.lit(1)).alias("__n"))
    repeated = seen.where("__n > 1").select("id", "__first")
    kept = log.join(repeated, "id", "left").where("__first is null or position = __first")
    return kept.select(*(F.col(f"`{c}`") for c in log.columns))


class Ring:
    """The last ``size`` ids in order of first sight; a repeat does not refresh its place."""

    def __init__(self, size: int = DEDUP_WINDOW):
        self.size, self.order, self.ids = size, deque(), set()

    def first_sight(self, event_id: str | None) -> bool:
        if not event_id or self.size <= 0:
            return True
        if event_id in self.ids:
            return False
        if len(self.order) == self.size:
            gone = self.order.popleft()
            if gone is not None:
                self.ids.discard(gone)
        self.order.append(event_id)
        self.ids.add(event_id)
        return True

    def forget(self, event_id: str) -> None:
        """Blank the slot of an id whose delivery failed, so that its retry is no duplicate."""
        if event_id in self.ids:
            self.ids.discard(event_id)
            self.order[self.order.index(event_id)] = None


def dedup(log: DataFrame, window: int | None = DEDUP_WINDOW) -> DataFrame:
    """Drop repeated ids among the last ``window`` first-seen ones (None: among all; 0: keep everything).

    Where no more than ``window`` different ids occur nothing is ever evicted, and
    the order-free form gives the same rows.  Beyond that the ring depends on the
    order of the whole log: ids and positions alone pass through one sequential
    reader, which keeps no more than the ring, and repeats are removed by a join.
    """
    if window == 0:
        return log
    if window is None or log.select("id").where("id <> ''").distinct().limit(window + 1).count() <= window:
        return _unique_ids(log)

    def repeats(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ring = Ring(window)
        for pdf in batches:
            yield pdf.loc[[not ring.first_sight(x) for x in pdf["id"]], ["position"]]

    # only ids that repeat at all can be dropped, but all of them take slots
    ids = log.where("id <> ''").select("position", "id").repartition(1).sortWithinPartitions("position")
    return log.join(ids.mapInPandas(repeats, "position long"), "position", "left_anti")


@dataclass
class Delivery:
    """What a subscription gets: delivered events, poison rows, and the values a checkpoint could take."""

    events: DataFrame
    dead: DataFrame
    #: One row: ``delivered`` (last delivered offset), ``scanned`` (last offset that may be passed over), as text or null.
    checkpoint: DataFrame


def deliver(log: DataFrame, event_type: EventType, predicate: Column | None = None, policy: str = ABORT, upcasts: Upcasts | None = None) -> Delivery:
    """Decode and filter one type's rows.

    ``abort`` stops at the first row that cannot be upcast or decoded: rows before
    it are delivered, later ones are not.  ``skip`` reports such rows and goes on.
    A failed upcast of any type counts, as it does in the log itself.
    """
    rows = upcasts.apply(log) if upcasts else log.withColumn("upcast_error", F.lit(None).cast("string"))
    broken = rows.where("upcast_error is not null").select("position", "type", F.col("upcast_error").alias("reason"), "data")
    decoded = decode(rows.where("upcast_error is null"), event_type)
    poison = decoded.where("poison").select("position", "type", F.lit("undecodable").alias("reason"), "data")
    dead = broken.unionByName(poison)
    good = decoded.where("not poison").drop("poison", "upcast_error")
    reach = rows.select("position")
    if policy == ABORT:
        first = dead.agg(F.min("position").alias("__first"))
        before = F.col("__first").isNull() | (F.col("position") < F.col("__first"))
        good = good.join(F.broadcast(first), how="cross").where(before).drop("__first")
        reach = reach.join(F.broadcast(first), how="cross").where(before).drop("__first")
    elif policy != SKIP:
        raise ValueError(f"unknown policy {policy!r}")
    events = matching(good, predicate)
    passed = events.select("position") if policy == ABORT else events.select("position").unionByName(dead.select("position"))
    checkpoint = passed.agg(format_column(F.max("position")).alias("delivered")).join(reach.agg(format_column(F.max("position")).alias("scanned")), how="cross")
    return Delivery(events, dead, checkpoint)
