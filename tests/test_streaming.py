import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logtide.bus import Bus
from logtide.functions.offsets import NEWEST, format_offset
from logtide.operators import delivery
from logtide.operators.registry import RegistryError, TypeRegistry
from logtide.operators.upcast import Upcasts
from logtide.sources.log import Checkpoints, EventLog
from logtide.streaming import follow as fl

SCHEMA = T.StructType().add("ID", T.LongType())


@pytest.fixture
def parts(spark, tmp_path):
    registry = TypeRegistry()
    return EventLog(spark, f"file://{tmp_path}/log"), Checkpoints(spark, f"file://{tmp_path}/cp"), registry, registry.register("t", SCHEMA)


def append(log, *data, kind="t", **columns):
    df = log.spark.createDataFrame([(kind, d if isinstance(d, str) else json.dumps({"ID": d})) for d in data], "type string, data string")
    return log.append(df.coalesce(1).withColumns({k: F.lit(v) for k, v in columns.items()}))


def run(parts, seen, **options):
    log, checkpoints, registry, event_type = parts
    sub = fl.subscribe(log, checkpoints, registry, "s", event_type, lambda df: seen.extend(r["event"]["ID"] for r in df.collect()), once=True, **options)
    sub.wait()


def test_resume(parts):
    log, checkpoints, *_ = parts
    append(log, 1, 2, 3)
    seen = []
    run(parts, seen)
    assert seen == [1, 2, 3] and checkpoints.load("s") == format_offset(3)
    append(log, 4, 5, 6)
    run(parts, seen)
    run(parts, seen)
    append(log, 7)
    run(parts, seen)
    assert seen == [1, 2, 3, 4, 5, 6, 7]


def test_live_start_is_saved_before_reading(parts):
    log, checkpoints, *_ = parts
    append(log, 1, 2)
    seen = []
    run(parts, seen, start=NEWEST)
    assert seen == [] and checkpoints.lookup("s") == (format_offset(2), True)
    append(log, 3)
    run(parts, seen, start=NEWEST)
    assert seen == [3]


def test_policies(parts):
    log, checkpoints, *_ = parts
    append(log, 1, '{"ID": "unclosed', 3)
    seen, dead = [], []
    with pytest.raises(Exception, match="cannot be delivered"):
        run(parts, seen)
    assert seen == [1] and checkpoints.load("s") == format_offset(1)
    run(parts, seen, policy=delivery.SKIP, on_dead=lambda df: dead.extend(df.collect()))
    assert seen == [1, 3] and len(dead) == 1 and checkpoints.load("s") == format_offset(3)


def test_one_owner(parts):
    log, checkpoints, registry, event_type = parts
    registry.own("s")
    with pytest.raises(RegistryError):
        fl.subscribe(log, checkpoints, registry, "s", event_type, print, once=True)


def test_follow(parts, tmp_path):
    log = parts[0]
    append(log, 1, origin="me")
    append(log, 2, origin="you")
    append(log, 3, kind="other", origin="you")
    seen = []
    q = fl.follow(log, lambda df, _: seen.extend(r["position"] for r in df.collect()), ["t"], f"{tmp_path}/f", start="", origin="me", once=True)
    q.awaitTermination()
    assert seen == [2]
    q = fl.follow(log, lambda df, _: seen.extend(r["position"] for r in df.collect()), ["t"], f"{tmp_path}/g", once=True)
    q.awaitTermination()
    assert seen == [2]  # live only by default


def test_failed_migrations_reach_their_handler(parts):
    log, checkpoints, registry, event_type = parts
    old = registry.register("old", T.StructType().add("N", T.LongType()))
    failed, seen = [], []
    ups = Upcasts(on_error=lambda df: failed.extend(r["position"] for r in df.collect()))
    ups.typed(old, event_type, lambda v: {"ID": v["N"] * 10})
    append(log, '{"N": 4}', '{"N": "four"}', kind="old")
    append(log, 7)
    run(parts, seen, upcasts=ups, policy=delivery.SKIP)
    assert failed == [2] and seen == [40, 7]
    append(log, 8)
    run(parts, seen, upcasts=ups, policy=delivery.SKIP)
    assert failed == [2] and seen == [40, 7, 8]


def test_follow_loses_nothing_between_runs(parts, tmp_path):
    log, seen = parts[0], []

    def go():
        fl.follow(log, lambda df, _: seen.extend(r["position"] for r in df.collect()), ["t"], f"file://{tmp_path}/f", once=True).awaitTermination()

    append(log, 1)
    go()
    append(log, 2)
    go()
    go()
    append(log, 3)
    append(log, 4)
    go()
    assert seen == [2, 3, 4]


def test_only_committed_and_live_rows_are_delivered(parts, tmp_path, spark):
    log, seen = parts[0], []
    append(log, 1, 2, 3, 4)
    log.truncate("2")
    # an append that was never committed
    log.scan().withColumn("position", F.col("position") + 10).write.parquet(f"{log.path}/data/{format_offset(11)}-lost")
    run(parts, seen)
    assert seen == [3, 4]
    got = []
    fl.follow(log, lambda df, _: got.extend(r["position"] for r in df.collect()), ["t"], f"file://{tmp_path}/f", start="", once=True).awaitTermination()
    assert got == [3, 4]


def test_follow_drops_repeated_ids(parts, tmp_path):
    log, seen = parts[0], []

    def go():
        fl.follow(log, lambda df, _: seen.extend(r["position"] for r in df.collect()), ["t"], f"file://{tmp_path}/f", start="", dedup_millis=3_600_000, once=True).awaitTermination()

    append(log, 1, 2, id="x")
    append(log, 3, id="y")
    go()
    append(log, 4, id="x")
    append(log, 5, id="z")
    go()
    assert seen == [1, 3, 5]


def test_streamed_fold(parts, tmp_path, spark):
    log = parts[0]
    append(log, 1, 2, 3)
    rows = fl.read_stream(log)
    changes = rows.select(F.lit("user/1").alias("composite_key"), F.col("data").alias("value"), "position", F.when(F.col("position") == 3, F.lit("delete")).otherwise(F.lit("insert")).alias("operation"))
    out = []
    q = fl.fold_stream(changes).writeStream.outputMode("update").foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", f"{tmp_path}/x").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r["composite_key"], r["position"], r["deleted"]) for r in out][-1] == ("user/1", 3, True)


def test_stream_helpers(parts, tmp_path):
    log, _, _, event_type = parts
    append(log, 1, "broken", 3)
    rows = fl.collect_stream(log.spark, fl.decoded_stream(fl.read_stream(log), event_type), f"{tmp_path}/h")
    assert [r["event"]["ID"] for r in rows] == [1, 3]
    tries = []

    class Query:
        def awaitTermination(self):
            tries.append(1)
            if len(tries) < 3:
                raise RuntimeError("no")

    fl.run_with_retry(Query, least=0.0)
    assert len(tries) == 3
    with pytest.raises(RuntimeError):
        tries.clear()
        fl.run_with_retry(Query, attempts=2, least=0.0)


def test_bus(spark, parts):
    log, _, registry, _ = parts
    bus = Bus(log, registry, origin="me")
    seen, failed = [], []
    bus.on_error = lambda env, e: failed.append(str(e))
    h = bus.subscribe("t", lambda e, env: seen.append((e["ID"], env.offset)))
    bus.subscribe("t", lambda e: seen.append("once"), once=True)
    bus.subscribe("t", lambda e: seen.append("big"), predicate=lambda e: e["ID"] > 1)
    bus.subscribe("t", lambda e: 1 / 0)
    bus.subscribe("t", lambda e: seen.append("async"), is_async=True)
    bus.publish("t", {"ID": 1}, {"k": "v"})
    bus.publish("t", {"ID": 2})
    assert bus.wait(5)
    assert seen.count("once") == 1 and seen.count("big") == 1 and seen.count("async") == 2 and len(failed) == 2
    assert (1, format_offset(1)) in seen
    assert [r["metadata"] for r in log.read().collect()] == [{"k": "v"}, None]
    assert bus.handler_count("t") == 4 and h.unsubscribe() and not h.unsubscribe()
    with pytest.raises(RegistryError):
        bus.subscribe("unknown", print)
    bus.clear_all()
    assert not bus.has_handlers("t") and bus.is_persistent and bus.shutdown(1)
    with pytest.raises(RuntimeError):
        bus.try_publish("t", {})


def test_unstorable_events_reach_nobody(spark):
    class Broken:
        spark = None

    registry = TypeRegistry()
    registry.register("t", SCHEMA)
    errors, seen = [], []
    bus = Bus(Broken(), registry, on_persist_error=lambda env, e: errors.append(e))
    bus.subscribe("t", seen.append)
    assert bus.publish("t", {"ID": 1}) is None and errors and not seen
