"""The last offset of classified rows stops before the first failure."""

from logtide.operators import state


def test_last_offset_before_a_failure(spark):
    rows = [(1, state.APPLY), (2, state.IGNORE), (3, state.UNDECODABLE), (4, state.APPLY)]
    df = spark.createDataFrame(rows, "position long, outcome string")
    assert state.offsets(df).first()["last_offset"] == "2".rjust(20, "0")
    assert state.offsets(df.where("position <> 3")).first()["last_offset"] == "4".rjust(20, "0")
    assert state.offsets(df.where("position >= 3")).first()["last_offset"] == ""
