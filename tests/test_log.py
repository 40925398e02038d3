import json

import pytest
from pyspark.sql import functions as F

from logtide.functions.offsets import NEWEST, OLDEST, OffsetError, format_offset
from logtide.sources.log import Checkpoints, Conflict, EventLog, Manifest, Snapshots


@pytest.fixture
def log(spark, tmp_path):
    return EventLog(spark, f"file://{tmp_path}/log")


def events(spark, n, start=0):
    return spark.range(start, start + n, numPartitions=3).select(F.lit("t").alias("type"), F.to_json(F.struct(F.col("id").alias("ID"))).alias("data"))


def ids(df):
    return [json.loads(r["data"])["ID"] for r in df.collect()]


def test_append_read_tail(spark, log):
    assert log.tail() == OLDEST and log.read().count() == 0
    assert log.append(events(spark, 150), order_by=["data"]) == (1, 150)
    rows = log.read().collect()
    assert [r["position"] for r in rows] == list(range(1, 151))
    assert all(r["offset"] == format_offset(r["position"]) and len(r["id"]) == 26 for r in rows)
    assert [r["data"] for r in rows] == sorted(r["data"] for r in rows)
    assert log.append(events(spark, 5)) == (151, 155) and log.tail() == format_offset(155)
    assert [r["position"] for r in log.read("2", 3).collect()] == [3, 4, 5]
    assert log.read(NEWEST).count() == 0 and log.read_batch(NEWEST)[1] == format_offset(155)
    assert log.read_batch("153")[1] == format_offset(155) and log.read_batch("155")[1] == "155"
    with pytest.raises(OffsetError):
        log.read("x")
    assert log.append(events(spark, 0)) == (0, 0)
    with pytest.raises(ValueError):
        log.append(events(spark, 1).drop("data"))


def test_replay_stops_at_the_first_failure(spark, log):
    log.append(events(spark, 5))
    seen = []
    assert log.replay(lambda r: seen.append(r["position"]), "2") == format_offset(5) and seen == [3, 4, 5]
    assert log.replay(seen.append, NEWEST) == format_offset(5) and len(seen) == 3

    def fail(row):
        if row["position"] == 2:
            raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        log.replay(fail)


def test_truncate(spark, log):
    log.append(events(spark, 8))
    log.append(events(spark, 7, 8))
    assert log.truncate(OLDEST) == 0
    assert log.truncate("10") == 10 and log.truncate("10") == 0
    assert log.read().count() == 5 and len(log.manifest().batches) == 1
    with pytest.raises(OffsetError):
        log.truncate(NEWEST)
    assert log.truncate("15") == 5 and log.tail() == OLDEST
    assert log.append(events(spark, 1)) == (16, 16)  # positions are not used again


def test_lost_race(spark, log):
    log.append(events(spark, 1))
    m = log.manifest()
    log._commit(Manifest(m.version + 1, m.high, 0, 4, m.batches))
    with pytest.raises(Conflict):
        log._commit(Manifest(m.version + 1, 99, 0, 4, m.batches))
    assert log.manifest().high == 1
    assert log.append_retrying(events(spark, 1)) == (2, 2)
    assert log.migrate() == 4


def test_range_reaches_the_files(spark, log):
    log.append(events(spark, 10))
    log.append(events(spark, 10))
    plan = log.scan(12)._jdf.queryExecution().toString()
    assert "GreaterThan(position,12)" in plan
    assert len(log.scan(12).inputFiles()) <= 3


def test_checkpoints(spark, log, tmp_path):
    c = Checkpoints(spark, f"file://{tmp_path}/c")
    assert c.lookup("a/b") == (OLDEST, False)
    c.save("a/b", OLDEST)
    assert c.lookup("a/b") == (OLDEST, True)
    for n in (1, 2, 3):
        c.save("a/b", str(n))
    log.append(events(spark, 4))
    c.save("z", NEWEST, log)
    assert c.load("a/b") == format_offset(3) and c.load("z") == format_offset(4)
    assert c.table().count() == 2
    with pytest.raises(OffsetError):
        c.save("z", NEWEST)


def test_snapshots(spark, tmp_path):
    s = Snapshots(spark, f"file://{tmp_path}/s")
    assert s.load("x") == (OLDEST, None)
    s.save("x", "5", "{}")
    s.save("x", "7", '{"a":1}')
    assert s.load("x") == ("7", '{"a":1}')
