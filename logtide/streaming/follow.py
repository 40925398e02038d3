"""Structured Streaming consumers of the event log.

``subscribe`` and ``follow`` stream the log's manifest versions, the only thing that
an append commits, and let each micro-batch read the rows that the newest version
names between the offset saved last and its high-water mark.  So rows of appends that
are not committed, or lost their race, are never seen, truncated ones are not either,
and rows come in order of position however many files an append has.

Delivery is at least once: the handler runs in ``foreachBatch``, and the offset of
the last row passed is saved after it; a restart goes on from there.  The start of a
first run is saved before anything is read.

``read_stream`` is the plain file source over the data folders, for stateful
operators; it knows of no commits.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from logtide.functions.offsets import NEWEST, OLDEST, format_offset, parse_offset
from logtide.operators import delivery
from logtide.operators.decode import decode
from logtide.operators.registry import EventType, TypeRegistry
from logtide.operators.upcast import Upcasts
from logtide.sources.log import LOG_SCHEMA, Checkpoints, EventLog

POLL_MILLIS = 200
#: The name under which a follower's offset is saved in its checkpoint folder.
FOLLOWER = "follow"


def read_stream(log: EventLog, after: str = OLDEST, files_per_trigger: int | None = None) -> DataFrame:
    """The log's files as a stream of rows after a concrete offset, committed or not; ``subscribe`` and ``follow`` deliver committed rows alone."""
    spark = log.spark
    log._files.fs.mkdirs(log._files.path("data"))
    reader = spark.readStream.schema(LOG_SCHEMA).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(f"{log.path}/data").where(F.col("position") > parse_offset(after))


def _commits(log: EventLog) -> DataFrame:
    """The manifest versions as a stream; batches only need to know that there are new ones."""
    log._files.fs.mkdirs(log._files.path("manifest"))
    return log.spark.readStream.text(f"{log.path}/manifest")


def _start(log: EventLog, checkpoints: Checkpoints, name: str, start: str) -> str:
    """The offset saved under a name; on a first run the start, which is saved first."""
    saved, found = checkpoints.lookup(name)
    return saved if found else checkpoints.save(name, log.resolve(start))


def _slices(log: EventLog, checkpoints: Checkpoints, name: str, batch_rows: int) -> Iterator[tuple[DataFrame, int]]:
    """Committed rows behind the saved offset, at most ``batch_rows`` positions at a time (0: all), with the last position of each part."""
    passed, high = parse_offset(checkpoints.load(name)), log.manifest().high
    while passed < high:
        upto = min(high, passed + batch_rows) if batch_rows > 0 else high
        yield log.scan(passed, upto), upto
        passed = upto


def _trigger(writer, once: bool, poll_millis: int):
    return writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{poll_millis} milliseconds")


@dataclass
class Subscription:
    """A running consumer; ``stop`` ends it and frees its id."""

    query: StreamingQuery
    registry: TypeRegistry
    subscription_id: str

    def stop(self) -> None:
        try:
            self.query.stop()
        finally:
            self.registry.release(self.subscription_id)

    def wait(self, timeout: float | None = None) -> bool:
        """Wait for the end of a bounded run; True if it came, after which the id is free."""
        try:
            done = self.query.awaitTermination(timeout) if timeout else (self.query.awaitTermination() or True)
        except Exception:
            self.registry.release(self.subscription_id)
            raise
        if done:
            self.registry.release(self.subscription_id)
        return bool(done)


def subscribe(
    log: EventLog,
    checkpoints: Checkpoints,
    registry: TypeRegistry,
    subscription_id: str,
    event_type: EventType,
    handler: Callable[[DataFrame], None],
    predicate: Column | None = None,
    upcasts: Upcasts | None = None,
    policy: str = delivery.ABORT,
    on_dead: Callable[[DataFrame], None] | None = None,
    start: str = OLDEST,
    once: bool = False,
    poll_millis: int = POLL_MILLIS,
    batch_rows: int = 0,
) -> Subscription:
    """Replay, catch up and stay live on one type, resuming from the saved offset; the handler gets at most ``batch_rows`` rows at a time (0: all).

    A first run that starts live saves the tail before it reads anything, so a
    crash before the first batch does not move the start.  Under ``abort`` a row that
    cannot be decoded fails the query after the rows before it have been delivered
    and saved; under ``skip`` it is reported and passed over.  Rows whose migration fails
    also go to the error handler of ``upcasts``, again if the batch is repeated.
    """
    registry.own(subscription_id)
    try:
        _start(log, checkpoints, subscription_id, start)

        def part(rows: DataFrame) -> None:
            rows = rows.persist()
            try:
                if upcasts is not None:
                    upcasts.report(rows)
                out = delivery.deliver(rows, event_type, predicate, policy, upcasts)
                events = out.events.orderBy("position")
                if not events.isEmpty():
                    handler(events)
                last = out.checkpoint.first()["delivered"]
                if last is not None:
                    checkpoints.save(subscription_id, last)
                if policy == delivery.ABORT and not out.dead.isEmpty():
                    first = out.dead.orderBy("position").first()
                    raise RuntimeError(f"event at {format_offset(first['position'])} cannot be delivered: {first['reason']}")
                if on_dead and not out.dead.isEmpty():
                    on_dead(out.dead)
            finally:
                rows.unpersist()

        def batch(_: DataFrame, __: int) -> None:
            for rows, _ in _slices(log, checkpoints, subscription_id, batch_rows):
                part(rows)

        writer = _commits(log).writeStream.foreachBatch(batch).option("checkpointLocation", f"{checkpoints.path}/streams/{subscription_id.encode().hex()}")
        return Subscription(_trigger(writer, once, poll_millis).start(), registry, subscription_id)
    except Exception:
        registry.release(subscription_id)
        raise


def follow(
    log: EventLog,
    handler: Callable[[DataFrame, int], None],
    names: list[str],
    checkpoint: str,
    start: str = NEWEST,
    origin: str | None = None,
    include_own: bool = False,
    dedup_millis: int | None = None,
    once: bool = False,
    poll_millis: int = POLL_MILLIS,
    upcasts: Upcasts | None = None,
    batch_rows: int = 0,
) -> StreamingQuery:
    """Deliver rows of the subscribed types from other processes: dedup, origin, upcast, type, in that order.

    Live only unless told otherwise: the tail is saved under ``checkpoint`` before the
    stream starts, and a later run goes on behind the last row passed.
    ``dedup_millis`` drops a row if one of the same id and at most so much older stands
    before it in the log (blank ids are kept); as the log itself is asked, that holds
    across restarts.  With ``upcasts`` rows come migrated, with an ``upcast_error`` column that
    is null but where a migration failed; ``batch_rows`` bounds the rows of one call (0: no bound).
    """
    checkpoints = Checkpoints(log.spark, f"{checkpoint}/offsets")
    _start(log, checkpoints, FOLLOWER, start)

    def batch(_: DataFrame, n: int) -> None:
        for rows, upto in _slices(log, checkpoints, FOLLOWER, batch_rows):
            if dedup_millis:
                rows = _first_sights(log, rows, upto, dedup_millis)
            if origin is not None:
                rows = delivery.foreign(rows, origin, include_own)
            if upcasts is not None:
                upcasts.report(rows)
                rows = upcasts.apply(rows)
            handler(delivery.of_types(rows, names).orderBy("position"), n)
            checkpoints.save(FOLLOWER, format_offset(upto))

    writer = _commits(log).writeStream.foreachBatch(batch).option("checkpointLocation", f"{checkpoint}/stream")
    return _trigger(writer, once, poll_millis).start()


def _first_sights(log: EventLog, rows: DataFrame, high: int, millis: int) -> DataFrame:
    """``rows`` without those that repeat the id of an earlier row of the log at most ``millis`` older."""
    least = rows.agg(F.min("timestamp")).first()[0]
    if least is None:
        return rows
    span = F.expr(f"INTERVAL {int(millis)} MILLISECONDS")
    earlier = log.scan(0, high).where(F.col("timestamp") >= F.lit(least) - span).where("id <> ''")
    earlier = earlier.select(F.col("id").alias("their_id"), F.col("position").alias("their_position"), F.col("timestamp").alias("their_timestamp"))
    same = (F.col("id") == F.col("their_id")) & (F.col("their_position") < F.col("position")) & (F.col("their_timestamp") >= F.col("timestamp") - span)
    return rows.join(earlier, same, "left_anti")


def fold_stream(changes: DataFrame) -> DataFrame:
    """A stream of applied changes (classified rows) folded per key by a stateful operator; emits the state of every key that changed.

    Rows may arrive out of order: a change older than the one held is ignored.
    """
    schema = "composite_key string, value string, position long, deleted boolean"

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else (None, 0, True)
        value, position, deleted = held
        before = position
        for pdf in batches:
            last = pdf.loc[pdf["position"].idxmax()]
            if last["position"] > position:
                position, deleted = int(last["position"]), last["operation"] == "delete"
                value = None if deleted else last["value"]
        if position != before:
            state.update((value, position, deleted))
            yield pd.DataFrame([{"composite_key": key[0], "value": value, "position": position, "deleted": deleted}])

    return changes.groupBy("composite_key").applyInPandasWithState(update, schema, "value string, position long, deleted boolean", "update", "NoTimeout")


def run_with_retry(start: Callable[[], StreamingQuery], attempts: int = 5, least: float = 0.01, most: float = 1.0) -> StreamingQuery:
    """Run a bounded query to its end, starting it again after failures with capped doubling pauses."""
    pause = least
    for k in range(attempts):
        query = start()
        try:
            query.awaitTermination()
            return query
        except Exception:
            if k == attempts - 1:
                raise
            time.sleep(pause)
            pause = min(2 * pause, most)
    raise AssertionError("unreachable")


def decoded_stream(rows: DataFrame, event_type: EventType) -> DataFrame:
    """A stream decoded against a type, poison rows left out."""
    return decode(rows, event_type).where("not poison").drop("poison")


def collect_stream(spark: SparkSession, rows: DataFrame, checkpoint: str) -> list[Row]:
    """All rows a bounded run of the stream gives, in order of position.  For tests and tools."""
    out: list[Row] = []
    query = rows.writeStream.foreachBatch(lambda df, _: out.extend(df.orderBy("position").toLocalIterator())).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return out
