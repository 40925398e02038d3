import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logtide.operators import delivery, metrics
from logtide.operators.decode import dead_letters, decode
from logtide.operators.registry import EventType, RegistryError, TypeRegistry
from logtide.operators.upcast import UpcastError, Upcasts
from logtide.sources import chunks

TEST = EventType("test", T.StructType().add("ID", T.LongType()).add("Value", T.StringType()))
LOG = "position long, offset string, id string, origin string, type string, data string"


def rows(spark, data, kind="test"):
    out = [(i, f"{i:020d}", f"id{i}", "me", *(d if isinstance(d, tuple) else (kind, d))) for i, d in enumerate(data, 1)]
    return spark.createDataFrame(out, LOG)


@pytest.mark.parametrize(
    ("data", "value"),
    [
        ('{"ID":1,"Value":"x"}', (1, "x")),
        ('{"ID":7,"extra":1}', (7, "")),
        ('{"ID":null}', (0, "")),
        ("null", (0, "")),
        ('{"ID":1,"ID":2}', (2, "")),
        ('{"ID":"poison"}', None),
        ('{"ID":1.5}', None),
        ("[1]", None),
        ('{"ID": "unclosed', None),
    ],
)
def test_decode(spark, data, value):
    row = decode(rows(spark, [data]), TEST).first()
    assert row["poison"] == (value is None)
    assert (row["event"] and tuple(row["event"])) == value


def test_poison_policies(spark):
    log = rows(spark, ['{"ID":1}', '{"ID": "unclosed', '{"ID":3}'])
    skip = delivery.deliver(log, TEST, policy=delivery.SKIP)
    assert [r["event"]["ID"] for r in skip.events.orderBy("position").collect()] == [1, 3]
    assert skip.dead.count() == 1 and skip.checkpoint.first()["delivered"].endswith("3")
    abort = delivery.deliver(log, TEST)
    assert [r["event"]["ID"] for r in abort.events.collect()] == [1]
    assert abort.checkpoint.first()["delivered"].endswith("1")
    with pytest.raises(ValueError):
        delivery.deliver(log, TEST, policy="other")


def test_filtered_rows_are_not_checkpointed(spark):
    log = rows(spark, ['{"ID":1}', '{"ID":2}', '{"ID":3}'])
    out = delivery.deliver(log, TEST, F.col("event.ID") < 3)
    assert tuple(out.checkpoint.first()) == ("0" * 19 + "2", "0" * 19 + "3")


def test_null_predicate_origin_once(spark):
    log = rows(spark, ['{"ID":1}', '{"ID":2}']).withColumn("origin", F.when(F.col("position") == 1, F.lit("me")))
    assert delivery.matching(log, F.lit(None).cast("boolean")).count() == 0
    assert [r["position"] for r in delivery.foreign(log, "me").collect()] == [2]
    assert delivery.foreign(log, "me", include_own=True).count() == 2
    assert [r["position"] for r in delivery.once(log, ["type"]).collect()] == [1]
    assert delivery.of_types(log, []).count() == 0


def ring(ids, window):
    r = delivery.Ring(window)
    return [i for i, x in enumerate(ids, 1) if r.first_sight(x)]


def test_ring_evicts_and_forgets():
    r = delivery.Ring(2)
    assert [r.first_sight(x) for x in "aba"] == [True, True, False]
    assert [r.first_sight(x) for x in "cda"] == [True, True, True]
    r = delivery.Ring(2)
    r.first_sight("a")
    r.forget("a")
    assert r.first_sight("a")
    assert delivery.Ring(0).first_sight("a") and delivery.Ring(0).first_sight(None)


@pytest.mark.parametrize("window", [0, 2, 3, 50, None])
def test_dedup_equals_the_ring(spark, window):
    rng = random.Random(3)
    ids = [rng.choice(["a", "b", "c", "d", "", None]) for _ in range(60)]
    log = spark.createDataFrame([(i, x) for i, x in enumerate(ids, 1)], "position long, id string")
    got = sorted(r["position"] for r in delivery.dedup(log, window).collect())
    assert got == ring(ids, 10**6 if window is None else window)


V1 = EventType("v1", T.StructType().add("Name", T.StringType()))
V2 = EventType("v2", T.StructType().add("First", T.StringType()).add("Last", T.StringType()))
V3 = EventType("v3", T.StructType([*V2.schema.fields, T.StructField("Email", T.StringType())]))


def upcasts():
    u = Upcasts()
    u.typed(V1, V2, lambda v: {"First": F.split(v["Name"], " ")[0], "Last": F.get(F.split(v["Name"], " "), F.lit(1))})
    u.typed(V2, V3, lambda v: {"First": v["First"], "Last": v["Last"], "Email": F.lower(F.concat(v["First"], F.lit("."), v["Last"]))})
    return u


def test_upcast_chain_keeps_the_envelope(spark):
    log = rows(spark, [("v1", '{"Name":"John Doe"}'), ("v2", '{"First":"A","Last":"B"}'), ("v3", '{"First":"x"}'), ("other", "{}")])
    out = upcasts().apply(log).orderBy("position").collect()
    assert [r["type"] for r in out] == ["v3", "v3", "v3", "other"]
    assert out[0]["data"] == '{"First":"John","Last":"Doe","Email":"john.doe"}'
    assert [(r["offset"], r["id"], r["origin"]) for r in out] == [(r["offset"], r["id"], r["origin"]) for r in log.orderBy("position").collect()]


def test_upcast_failures(spark):
    log = rows(spark, [("v3", '{"First":"x"}'), ("v1", "[]"), ("v3", '{"First":"y"}')])
    out = upcasts().apply(log).orderBy("position").collect()
    assert out[1]["type"] == "v1" and out[1]["data"] == "[]" and out[1]["upcast_error"]
    assert [r["event"]["First"] for r in delivery.deliver(log, V3, upcasts=upcasts()).events.collect()] == ["x"]
    skip = delivery.deliver(log, V3, policy=delivery.SKIP, upcasts=upcasts())
    assert skip.events.count() == 2 and skip.dead.count() == 1
    # a failing chain of another type aborts too, unless pruned
    assert upcasts().scan(log, "v2").where("upcast_error is not null").count() == 1


def test_raw_upcasts_must_return_the_declared_type(spark):
    u = Upcasts()
    u.raw("a", "b", lambda text: (text.upper(), "b" if "x" in text else "c"))
    out = u.apply(rows(spark, [("a", "x"), ("a", "y")])).orderBy("position").collect()
    assert [(r["type"], r["data"]) for r in out] == [("b", "X"), ("a", "y")]
    assert "not 'b'" in out[1]["upcast_error"]


def test_upcast_registration():
    u = upcasts()
    for bad in (("v1", "v9"), ("x", "x"), ("", "x"), ("v3", "v1")):
        with pytest.raises(UpcastError):
            u.expression(*bad, lambda c: c)
    with pytest.raises(UpcastError):
        u.raw("q", "r", None)
    assert u.terminal("v1") == "v3" and u.ancestors("v3") == {"v1", "v2"}
    u.clear("v2")
    assert u.terminal("v1") == "v2"
    u.clear()
    assert u.sources() == []


def test_registry():
    r = TypeRegistry()
    r.register("a", TEST.schema, owner="A")
    with pytest.raises(RegistryError):
        r.register("a", TEST.schema, owner="B")
    with pytest.raises(RegistryError):
        r.register("b", TEST.schema, owner="A")
    with pytest.raises(RegistryError):
        r.register("a", V1.schema, owner="A")
    r.reserve("c", "C")
    r.rollback("c")
    r.register("c", TEST.schema, owner="D")
    assert r.names() == ["a", "c"] and r.name_of(None) == "nil" and r.name_of("A") == "a"
    r.own("s")
    with pytest.raises(RegistryError):
        r.own("s")
    r.release("s")
    r.own("s")


def test_chunks(spark):
    data = [
        ("0", "3", False, '["garbage", 42]'),
        ("3", "5", False, "[]"),
        ("5", "9", False, '[{"type":"t","data":{"a":1}},{"type":"t","data":2,"offset":"7"},{"type":"t","data":"x","timestamp":"invalid-timestamp"}]'),
        ("9", "9x", True, "not json"),
    ]
    df = spark.createDataFrame(data, chunks.CHUNK_SCHEMA)
    got = [(r["member"], r["offset"], r["data"], r["timestamp"]) for r in chunks.decode_chunks(df).orderBy("chunk_start", "member").collect()]
    assert got == [(0, "5", '{"a":1}', None), (1, "7", "2", None), (2, "9", '"x"', None)]
    assert chunks.rejected(df).count() == 2
    assert chunks.next_offset(df.where("chunk_start < '5'")).first()[0] == "5"


def test_dead_letters_and_observation(spark):
    from pyspark.sql import Observation

    log = rows(spark, ['{"ID":1}', "[1]"])
    assert [(r["position"], r["reason"]) for r in dead_letters(log, TEST).collect()] == [(2, "undecodable")]
    seen = Observation("seen")
    metrics.observed(log, seen, F.col("data") == "[1]").collect()
    assert seen.get == {"events": 2, "errors": 1}


def test_histogram_quantile(spark):
    df = spark.createDataFrame([(0.2,), (0.3,), (4.0,), (9999.0,)], "v double")
    cells = metrics.buckets(df, F.col("v"), [])
    by = {r["le"]: r["n"] for r in cells.collect()}
    assert by[0.25] == 1 and by[0.5] == 2 and by[5.0] == 3 and by[2500.0] == 3 and by[float("inf")] == 4
    assert metrics.histogram_quantile(cells, 0.99, []).first()[0] == 2500.0
    assert metrics.histogram_quantile(cells, 0.5, []).first()[0] == pytest.approx(0.5)
    assert metrics.histogram_quantile(cells, 0.25, []).first()[0] == pytest.approx(0.25)
