import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logtide.functions import envelope, keys, offsets, ulid


def test_offsets_round_trip_and_order():
    assert offsets.format_offset(7) == "0" * 19 + "7"
    assert offsets.parse_offset("") == 0
    assert offsets.parse_offset("12") == 12 == offsets.parse_offset(offsets.format_offset(12))
    assert [offsets.compare_offsets(a, b) for a, b in (("", "1"), ("9", "10"), ("10", "9"), ("5", "05"))] == [-1, -1, 1, 0]
    for bad in ("$", "x", "-1", "1.5"):
        with pytest.raises(offsets.OffsetError):
            offsets.parse_offset(bad)


def test_offset_columns(spark):
    df = spark.createDataFrame([("", "1"), ("00000000000000000009", "10"), ("10", "9")], "a string, b string")
    assert [r[0] for r in df.select(offsets.compare_columns(F.col("a"), F.col("b"))).collect()] == [-1, -1, 1]
    bad = spark.createDataFrame([("$",), ("x",)], "a string")
    assert [r[0] for r in bad.select(offsets.parse_column(F.col("a"), strict=False)).collect()] == [None, None]
    with pytest.raises(Exception, match="not a concrete offset"):
        bad.select(offsets.parse_column(F.col("a"))).collect()


PARTS = ["", "/", "%", "%2F", "%25", "a/b", "a", "b", "größe%/", "x%2Fy/z"]


def test_composite_keys_never_collide(spark):
    pairs = [(t, k) for t in PARTS for k in PARTS]
    made = [keys.composite_key(t, k) for t, k in pairs]
    assert len(set(made)) == len(pairs)
    assert all(m.count("/") == 1 for m in made)
    assert [keys.split_key(m) for m in made] == pairs
    df = spark.createDataFrame(pairs, "t string, k string")
    assert [r[0] for r in df.select(keys.composite_key_column(F.col("t"), F.col("k"))).collect()] == made


@given(st.text(), st.text())
def test_composite_key_round_trip(t, k):
    assert keys.split_key(keys.composite_key(t, k)) == (t, k)


@pytest.mark.parametrize("bad", ["a", "a/b/c", "a%/b", "%2f/b"])
def test_forged_keys_are_rejected(bad):
    with pytest.raises(ValueError):
        keys.split_key(bad)


def test_ulid(spark):
    a, b = ulid.new_ulid(1_700_000_000_123), ulid.new_ulid(1_700_000_000_124)
    assert len(a) == 26 and set(a) <= set(ulid.ALPHABET) and a < b
    assert ulid.time_of(a) == 1_700_000_000_123
    df = spark.sql("select timestamp_millis(1700000000123) as t")
    row = df.select(ulid.ulid_column(F.col("t")).alias("u"), ulid.time_prefix(F.col("t")).alias("p")).first()
    assert row["p"] == a[:10] and len(row["u"]) == 26 and ulid.time_of(row["u"]) == 1_700_000_000_123


def test_envelope(spark):
    df = spark.sql("select map('a','1') m, cast(map() as map<string,string>) e, '' s")
    row = df.select(envelope.metadata_to_json(F.col("m")), envelope.metadata_to_json(F.col("e")), envelope.null_if_empty(F.col("s"))).first()
    assert tuple(row) == ('{"a":"1"}', None, None)
    bad = spark.sql("select '{\"a\"' t")
    with pytest.raises(Exception):
        bad.select(envelope.metadata_from_json(F.col("t"))).collect()


def test_times(spark):
    df = spark.createDataFrame([("2024-01-02T03:04:05.123456789Z",), ("2024-01-02T03:04:05+01:00",), ("invalid-timestamp",), (None,)], "t string")
    got = [r[0] for r in df.select(envelope.format_time(envelope.parse_time(F.col("t")))).collect()]
    assert got == ["2024-01-02T03:04:05.123456Z", "2024-01-02T02:04:05Z", None, None]
