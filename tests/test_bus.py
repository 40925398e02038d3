import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logtide.bus import Bus
from logtide.functions.offsets import OLDEST, format_offset
from logtide.operators import metrics
from logtide.operators.registry import TypeRegistry
from logtide.operators.upcast import Upcasts
from logtide.sources.log import Checkpoints, EventLog
from logtide.streaming.follow import subscribe
from logtide.telemetry import HANDLE, PERSIST, PUBLISH, Recorder


@pytest.fixture
def log(spark, tmp_path):
    return EventLog(spark, f"file://{tmp_path}/log")


@pytest.fixture
def registry():
    r = TypeRegistry()
    r.register("t", T.StructType().add("n", T.LongType()))
    return r


def ended(query):
    query.awaitTermination()


def test_followed_once_handler_stays_until_its_event_succeeds(log, registry, tmp_path):
    Bus(log, registry, origin="them").publish_all("t", [{"n": 1}, {"n": 2}])
    bus, seen, broken = Bus(log, registry, origin="me", batch_rows=1), [], [True]
    bus.subscribe("t", lambda e: seen.append(("once", e["n"])), once=True)

    def flaky(e):
        if broken:
            broken.pop()
            raise ValueError("not yet")
        seen.append(("all", e["n"]))

    bus.subscribe("t", flaky, is_async=True)
    where = f"file://{tmp_path}/cp"
    with pytest.raises(Exception, match="not yet"):
        ended(bus.follow(where, OLDEST, once=True))
    assert seen == [("once", 1)] and bus.handler_count("t") == 2
    ended(bus.follow(where, OLDEST, once=True))
    # the failed attempt's id was forgotten, so its retry was no duplicate
    assert seen == [("once", 1), ("once", 1), ("all", 1), ("all", 2)] and bus.handler_count("t") == 1


def test_follow_passes_over_bad_own_and_repeated_rows(spark, log, registry, tmp_path):
    rows = [("a", "them", "t", '{"n": 1}'), ("b", "them", "t", "{"), ("c", "me", "t", '{"n": 3}'), ("a", "them", "t", '{"n": 4}'), ("d", "them", "other", "{}"), ("e", "them", "t", '{"n": 6}')]
    log.append(spark.createDataFrame(rows, "id string, origin string, type string, data string").coalesce(1))
    bus, seen, errors = Bus(log, registry, origin="me"), [], []
    bus.on_error = lambda env, e: errors.append(env.id)
    bus.subscribe("t", lambda e: seen.append(e["n"]))
    ended(bus.follow(f"file://{tmp_path}/cp", OLDEST, once=True))
    assert seen == [1, 6] and errors == ["b"]


def test_follow_migrates(log, registry, tmp_path):
    Bus(log, registry, origin="them").publish("t", {"n": 5})
    ups = Upcasts()
    ups.expression("t", "t2", lambda data: F.regexp_replace(data, '"n"', '"m"'))
    registry.register("t2", T.StructType().add("m", T.LongType()))
    bus, seen = Bus(log, registry, origin="me", upcasts=ups), []
    bus.subscribe("t2", lambda e: seen.append(e))
    ended(bus.follow(f"file://{tmp_path}/cp", OLDEST, once=True))
    assert seen == [{"m": 5}]


def test_log_delivery_dispatches_by_the_log_alone(log, registry, tmp_path):
    bus, seen = Bus(log, registry, log_delivery=True), []
    bus.subscribe("t", lambda e: seen.append(e["n"]))
    bus.publish("t", {"n": 1})
    assert seen == []
    ended(bus.follow(f"file://{tmp_path}/cp", once=True))
    assert seen == [1]


def test_persist_timeout(spark, registry):
    class Slow:
        def append(self, df):
            time.sleep(1)
            return 1, 1

    slow = Slow()
    slow.spark = spark
    errors, seen = [], []
    bus = Bus(slow, registry, persist_timeout=0.05)
    bus.on_persist_error = lambda env, e: errors.append(type(e))
    bus.subscribe("t", seen.append)
    assert bus.publish("t", {"n": 1}) is None and errors == [TimeoutError] and not seen
    bus.persist_timeout = None
    assert bus.publish("t", {"n": 1}).offset == format_offset(1) and seen == [{"n": 1}]


def test_publish_all_is_one_append(log, registry):
    envs = Bus(log, registry).publish_all("t", [{"n": k} for k in range(5)])
    assert [e.offset for e in envs] == [format_offset(k + 1) for k in range(5)] and len(log.manifest().batches) == 1
    assert [r["id"] for r in log.read().collect()] == [e.id for e in envs]
    assert Bus(log, registry).publish_all("t", []) == []


def test_recorder(spark, log, registry):
    recorder = Recorder({"t": lambda e: {"n": e["n"]}})
    bus = Bus(log, registry, listener=recorder)
    bus.subscribe("t", lambda e: 1 / e["n"])
    bus.publish("t", {"n": 0})
    bus.publish("t", {"n": 1})
    spans = recorder.spans(spark)
    got = {(r["kind"], r["events"], r["errors"]) for r in metrics.counters(spans, ["kind"], F.col("error").isNotNull()).collect()}
    assert got == {(PUBLISH, 2, 0), (PERSIST, 2, 0), (HANDLE, 2, 1)}
    rows = {r["span"]: r for r in spans.collect()}
    assert all(rows[r["parent"]]["kind"] == PUBLISH and r["millis"] > 0 for r in rows.values() if r["kind"] != PUBLISH)
    assert {r["attributes"] for r in rows.values() if r["kind"] == PUBLISH} == {'{"n": 0}', '{"n": 1}'}
    assert {r["offset"] for r in rows.values() if r["kind"] == PERSIST} == {format_offset(1), format_offset(2)}
    assert [r["n"] for r in metrics.buckets(spans.where("kind = 'handle'"), F.col("millis"), []).where("le > 1e9").collect()] == [2]


def test_batches_of_bounded_size(spark, log, registry, tmp_path):
    log.append(spark.createDataFrame([("t", f'{{"n": {k}}}') for k in range(7)], "type string, data string").coalesce(1))
    sizes, offsets = [], []
    sub = subscribe(log, Checkpoints(spark, f"file://{tmp_path}/cp"), registry, "s", registry.get("t"), lambda df: sizes.append(df.count()), once=True, batch_rows=3)
    sub.wait()
    assert sizes == [3, 3, 1]
    assert log.replay(lambda r: offsets.append(r["position"]), batch_rows=2) == format_offset(7) and offsets == list(range(1, 8))
