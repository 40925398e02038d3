import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logtide.operators import state
from logtide.operators.registry import EventType
from logtide.sources.states import ParquetStates

USER = state.Collection(EventType("user", T.StructType().add("name", T.StringType())))
LOG = "position long, type string, data string"


def change(kind, key, op, value=None):
    return json.dumps({"type": kind, "key": key, "headers": {"operation": op}} | ({"value": value} if value is not None else {}))


def log(spark, data):
    return spark.createDataFrame([(i, *d) for i, d in enumerate(data, 1)], LOG)


RULES = [
    (state.CHANGE, change("user", "1", "insert", {"name": "a"}), state.APPLY, state.APPLY),
    (state.CHANGE, change("user", "1", "delete"), state.APPLY, state.APPLY),
    (state.CHANGE, "nonsense", state.UNDECODABLE, state.UNDECODABLE),
    (state.CHANGE, change("other", "1", "insert", {}), state.IGNORE, state.UNKNOWN_TYPE),
    (state.CHANGE, change("user", "1", "upsert", {}), state.UNDECODABLE, state.UNDECODABLE),
    (state.CHANGE, change("user", "1", "insert", [7, "seven"]), state.UNDECODABLE, state.UNDECODABLE),
    (state.CHANGE, change("user", "1", "insert"), state.UNDECODABLE, state.UNDECODABLE),
    (state.CONTROL, "[1]", state.UNDECODABLE, state.UNDECODABLE),
    (state.CONTROL, state.control(state.RESET), state.RESETS, state.RESETS),
    (state.CONTROL, state.control(state.SNAPSHOT_END, "5"), state.MARK, state.MARK),
    (state.CONTROL, '{"headers":{"control":"reload-all"}}', state.IGNORE, state.UNDECODABLE),
    ("probe", "not json", state.IGNORE, state.IGNORE),
    ("probe", '{"a":1}', state.IGNORE, state.IGNORE),
    ("probe", '{"probe":"/health","headers":{"X-Trace":"7f"},"type":12}', state.IGNORE, state.IGNORE),
    ("probe", '{"headers":{"control":"hush"}}', state.IGNORE, state.IGNORE),
    ("probe", state.control(state.RESET), state.RESETS, state.RESETS),
    ("vendor.feed", change("user", "1", "update", {"name": "b"}), state.APPLY, state.APPLY),
    ("vendor.feed", change("user", "1", "upsert", {}), state.UNDECODABLE, state.UNDECODABLE),
    ("vendor.feed", change("", "1", "insert", {}), state.IGNORE, state.IGNORE),
]


@pytest.mark.parametrize("strict", [False, True])
def test_rule_table(spark, strict):
    rows = log(spark, [r[:2] for r in RULES])
    got = [r["outcome"] for r in state.classify(rows, [USER], strict).orderBy("position").collect()]
    assert got == [r[3 if strict else 2] for r in RULES]


def test_messages(spark):
    df = spark.sql("select '1' k, '{\"name\":\"a\"}' v")
    made = df.select(
        state.insert("user", F.col("k"), F.col("v"), txid="t").alias("i"),
        state.update("user", F.col("k"), F.col("v"), F.col("v")).alias("u"),
        state.delete("user", F.col("k")).alias("d"),
    ).first()
    assert json.loads(made["i"]) == {"type": "user", "key": "1", "value": {"name": "a"}, "headers": {"operation": "insert", "txid": "t"}}
    assert json.loads(made["u"])["old_value"] == {"name": "a"}
    assert json.loads(made["d"]) == {"type": "user", "key": "1", "headers": {"operation": "delete"}}
    with pytest.raises(Exception, match="needs a key"):
        df.select(state.delete("user", F.lit(""))).collect()
    with pytest.raises(state.StateError):
        state.control("other")


def put(key, name):
    return (state.CHANGE, change("user", key, "insert", {"name": name}))


def test_fold_with_deletes_and_reset(spark):
    data = [put("1", "a"), put("2", "b"), put("1", "c"), (state.CHANGE, change("user", "2", "delete")), (state.CHANGE, change("user", "9", "delete"))]
    rows = state.classify(log(spark, data), [USER])
    assert [(r["key"], r["value"]) for r in state.fold(state.after_reset(rows)).collect()] == [("1", '{"name":"c"}')]
    rows = state.classify(log(spark, [*data, (state.CONTROL, state.control(state.RESET)), put("3", "d")]), [USER])
    assert [r["key"] for r in state.fold(state.after_reset(rows)).collect()] == ["3"]


def test_materializer(spark):
    m = state.Materializer(spark, [USER], policy="skip")
    with pytest.raises(state.StateError):
        m.snapshot()
    poison = (state.CHANGE, change("user", "1", "insert", [7, "seven"]))
    assert m.apply(log(spark, [put("1", "a"), poison, put("2", "b")])).count() == 1
    assert m.last_offset.endswith("3") and json.loads(m.get("user", "2")) == {"name": "b"}
    offset, blob = m.snapshot()
    again = state.Materializer(spark, [USER])
    assert again.restore(offset, blob) == offset
    assert sorted(r["key"] for r in again.all("user").collect()) == ["1", "2"]
    tail = spark.createDataFrame([(4, state.CHANGE, change("user", "1", "delete"))], LOG)
    again.apply(tail)
    assert [r["key"] for r in again.all("user").collect()] == ["2"]
    again.clear("user")
    assert again.all("user").count() == 0


def test_abort_and_strict(spark):
    poison = (state.CHANGE, change("user", "1", "insert", "x"))
    m = state.Materializer(spark, [USER])
    m.apply(log(spark, [put("1", "a"), poison, put("2", "b")]))
    assert m.last_offset.endswith("1") and m.all("user").count() == 1
    # an unknown type in strict mode is not passed over by skipping
    other = (state.CHANGE, change("other", "1", "insert", {}))
    m = state.Materializer(spark, [USER], policy="skip", strict=True)
    m.apply(log(spark, [put("1", "a"), other, put("2", "b")]))
    assert m.last_offset.endswith("1")


def test_reset_spares_other_types(spark):
    m = state.Materializer(spark, [USER])
    m.state = spark.createDataFrame([("admin", "1", "admin/1", "{}", 1)], m._STATE)
    seen = []
    m.on_reset = seen.append
    m.apply(log(spark, [put("1", "a"), (state.CONTROL, state.control(state.RESET))]))
    assert [r["entity_type"] for r in m.state.collect()] == ["admin"] and seen == [1]


@pytest.mark.parametrize(
    "blob",
    [
        "nonsense",
        "[]",
        '{"version":2,"key_codec":"percent-v1","collections":{"user":{}}}',
        '{"version":1,"key_codec":"other","collections":{"user":{}}}',
        '{"version":1,"key_codec":"percent-v1","collections":{"user":null}}',
        '{"version":1,"key_codec":"percent-v1","collections":{"admin":{}}}',
        '{"version":1,"key_codec":"percent-v1","collections":{"user":{"user/a/b":{}}}}',
        '{"version":1,"key_codec":"percent-v1","collections":{"user":{"admin/1":{}}}}',
        '{"version":1,"key_codec":"percent-v1","collections":{"user":{"user/1":"x"}}}',
        '{"user":{"user/%":{}}}',
    ],
)
def test_bad_snapshots_leave_nothing(spark, blob):
    m = state.Materializer(spark, [USER])
    m.apply(log(spark, [put("1", "a")]))
    with pytest.raises(state.StateError):
        m.restore("9", blob)
    assert m.last_offset == "" and m.state.count() == 0


def test_legacy_and_missing_snapshots(spark):
    m = state.Materializer(spark, [state.Collection(EventType("version", USER.event_type.schema))])
    m.restore("9", '{"version":{"version/1":{"name":"Legacy"}},"removed":{"removed/1":{}}}')
    assert json.loads(m.get("version", "1")) == {"name": "Legacy"}
    assert m.restore("", None) == "" and m.state.count() == 0


def test_state_is_kept_in_its_store(spark, tmp_path):
    store = ParquetStates(spark, f"file://{tmp_path}/states")
    m = state.Materializer(spark, [USER], store=store)
    m.apply(log(spark, [put("1", "a"), put("2", "b")]))
    m.apply(spark.createDataFrame([(3, *put("1", "c")), (4, state.CHANGE, change("user", "2", "delete"))], LOG))
    m.apply(spark.createDataFrame([(5, *put("4", "d"))], LOG))
    held = {r["key"]: json.loads(r["value"])["name"] for r in store.load().collect()}
    assert held == {"1": "c", "4": "d"} and m.state.count() == 2
    # rows of a state survive the next one
    before = m.all("user")
    m.apply(spark.createDataFrame([(6, *put("5", "e"))], LOG))
    assert before.count() == 2 and len(list((tmp_path / "states" / "data").iterdir())) == 2


def test_failing_store_moves_nothing(spark):
    class Full:
        def load(self): ...

        def replace(self, df):
            raise OSError("full")

    m = state.Materializer(spark, [USER], store=Full())
    with pytest.raises(OSError):
        m.apply(log(spark, [put("1", "a")]))
    assert m.last_offset == "" and m.state.count() == 0


def test_snapshot_folder(spark, tmp_path):
    path = f"file://{tmp_path}/snap"
    m = state.Materializer(spark, [USER])
    with pytest.raises(state.StateError):
        m.save(path)
    with pytest.raises(state.StateError):
        m.restore_from(path)
    m.apply(log(spark, [put("1", "a"), put("2", "b")]))
    offset = m.save(path)
    again = state.Materializer(spark, [USER])
    assert again.restore_from(path) == offset == again.last_offset
    assert sorted(map(tuple, again.state.collect())) == sorted(map(tuple, m.state.collect()))
    other = state.Materializer(spark, [state.Collection(EventType("other", USER.event_type.schema))])
    with pytest.raises(state.StateError, match="lacks"):
        other.restore_from(path)
    strict = state.Materializer(spark, [state.Collection(EventType("user", T.StructType().add("name", T.LongType())))])
    with pytest.raises(state.StateError, match="do not fit"):
        strict.restore_from(path)


def test_automatic_timestamp(spark):
    made = spark.range(1).select(state.delete("user", F.lit("1"), timestamp=True).alias("d")).first()["d"]
    assert json.loads(made)["headers"]["timestamp"].endswith("Z")
