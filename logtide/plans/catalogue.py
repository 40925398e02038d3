"""Registered queries over the driver's tables and their DuckDB equivalents.

The ``events`` table is a valid log: position = event_id + 1, type = event_type, data =
props.  Derived logs (duplicates, poison, change messages, chunks) are made from it by
rules that SQL can state as well.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logtide.functions import envelope, keys, offsets, ulid
from logtide.operators import delivery, metrics, state
from logtide.operators.registry import TypeRegistry
from logtide.operators.upcast import Upcasts
from logtide.sources import chunks
from logtide.sources.log import Checkpoints, EventLog, Snapshots
from logtide.sources.paths import shared_dir
from logtide.streaming import follow as streams

OWN = "bus-1"
SNAPSHOT_AT = 400
TRUNCATE_AT = 500

_REGISTRY = TypeRegistry()
# built without a session, which a schema in text form would need
_KEY_LABEL = T.StructType().add("key", T.LongType()).add("label", T.StringType())
PROPS = {n: _REGISTRY.register(n, T.StructType().add("k", T.LongType())) for n in ("signup", "purchase", "error", "view", "click")}
CLICK_2 = _REGISTRY.register("click.v2", _KEY_LABEL)
CLICK_3 = _REGISTRY.register("click.v3", T.StructType([*_KEY_LABEL.fields, T.StructField("twice", T.LongType())]))
USER = _REGISTRY.register("user", T.StructType().add("event", T.LongType()))
ADMIN = _REGISTRY.register("user/admin", T.StructType().add("event", T.LongType()))


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    position = F.col("event_id") + 1
    return e.select(
        position.alias("position"),
        offsets.format_column(position).alias("offset"),
        F.concat(F.lit("ev-"), F.col("event_id").cast("string")).alias("id"),
        F.concat(F.lit("bus-"), (F.col("user_id") % 3).cast("string")).alias("origin"),
        F.col("event_type").alias("type"),
        F.col("props").alias("data"),
        F.col("ts").alias("timestamp"),
        "event_id",
        "user_id",
        "value",
    )


_LOG = """log AS (
  SELECT event_id + 1 AS position, lpad(CAST(event_id + 1 AS VARCHAR), 20, '0') AS "offset", 'ev-' || event_id AS id,
         'bus-' || (user_id % 3) AS origin, event_type AS type, props AS data, ts AS timestamp, event_id, user_id, value
  FROM events)"""


def _with(ctes: str, body: str) -> str:
    return f"WITH {ctes}\n{body}"


def _poisoned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log with a payload of the wrong type at every 997th event."""
    bad = F.when(F.col("event_id") % 997 == 600, F.lit('{"k": "poison"}')).otherwise(F.col("data"))
    return log(spark, sf_dir).withColumn("data", bad)


_POISON = "event_id % 997 = 600"
_K = "CAST(json_extract_string(data, '$.k') AS BIGINT)"


def _doubled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log with every tenth event once more behind all others."""
    rows = log(spark, sf_dir)
    again = rows.where("event_id % 10 = 0").withColumn("position", F.col("position") + 1_000_000)
    return rows.unionByName(again)


def _messages(spark: SparkSession, sf_dir: str, resets: bool) -> DataFrame:
    """The log as change messages of users, with resets at every 2500th event if asked for."""
    rows = log(spark, sf_dir)
    key = F.col("user_id").cast("string")
    value = F.to_json(F.struct(F.col("event_id").alias("event")))
    data = F.when(F.col("type") == "signup", state.insert("user", key, value)).when(F.col("type") == "error", state.delete("user", key)).otherwise(state.update("user", key, value))
    kind = F.lit(state.CHANGE)
    if resets:
        reset = F.col("event_id") % 2500 == 0
        data = F.when(reset, F.lit(state.control(state.RESET))).otherwise(data)
        kind = F.when(reset, F.lit(state.CONTROL)).otherwise(kind)
    return rows.select("position", "offset", kind.alias("type"), data.alias("data"), "event_id")


USERS = [state.Collection(USER)]


# ---- scans ----------------------------------------------------------------------------------------------


_written: dict[tuple, EventLog] = {}


def _log_table(rows: DataFrame) -> DataFrame:
    return rows.select("event_id", "id", "origin", "type", "data", F.create_map(F.lit("user"), F.col("user_id").cast("string")).alias("metadata"), "timestamp")


def _in_order(spark, sf_dir) -> EventLog:
    """All events appended to a log in the order of their ids; queries that only read share it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _written:
        written = EventLog(spark, f"{shared_dir(spark)}/logtide/log-{uuid.uuid4().hex}")
        written.append(_log_table(log(spark, sf_dir)), order_by=["event_id"])
        _written[key] = written
    return _written[key]


def log_scan_range(spark, sf_dir):
    return _in_order(spark, sf_dir).read(offsets.format_offset(250), 100).select("position", "offset", "type", "data")


def log_tail(spark, sf_dir):
    return spark.range(1).select(F.lit(_in_order(spark, sf_dir).tail()).alias("tail"))


def log_tail_empty(spark, sf_dir):
    empty = EventLog(spark, f"{shared_dir(spark)}/logtide/log-{uuid.uuid4().hex}")
    return spark.range(1).select(F.lit(empty.tail()).alias("tail"))


def log_replay_from(spark, sf_dir):
    return _in_order(spark, sf_dir).read(offsets.format_offset(700)).select("position", "offset", "id", "origin", "type", "data", "timestamp")


def log_keyset_page(spark, sf_dir):
    """The seventh page of fifty, each page read from where the one before it ended."""
    written, at = _in_order(spark, sf_dir), offsets.OLDEST
    for _ in range(7):
        page, at = written.read_batch(at, 50)
    return page.select("position", "offset", "type")


def offset_compare(spark, sf_dir):
    rows = log(spark, sf_dir)
    plain = F.col("user_id").cast("string")
    return rows.select("position", offsets.compare_columns(F.col("offset"), plain).alias("order"), offsets.parse_column(F.col("offset")).alias("parsed"))


def _stored(spark, sf_dir) -> EventLog:
    """The events appended to a new log in two batches, the later half first."""
    stored = EventLog(spark, f"{shared_dir(spark)}/logtide/log-{uuid.uuid4().hex}")
    rows = log(spark, sf_dir).select("event_id", "id", "origin", "type", "data", F.create_map(F.lit("user"), F.col("user_id").cast("string")).alias("metadata"), "timestamp")
    half = F.col("event_id") >= 500
    stored.append(rows.where(half), order_by=["event_id"])
    stored.append(rows.where(~half), order_by=["event_id"])
    return stored


def log_append_read(spark, sf_dir):
    rows = _stored(spark, sf_dir).read("00000000000000000100")
    return rows.select("position", "offset", "id", "origin", "type", "data", F.col("metadata")["user"].alias("user"))


def log_truncate_read(spark, sf_dir):
    stored = _stored(spark, sf_dir)
    deleted = stored.truncate("70")
    again = stored.truncate("70")
    return stored.read().agg(F.lit(deleted).cast("long").alias("deleted"), F.lit(again).cast("long").alias("again"), F.count(F.lit(1)).alias("left"), F.min("offset").alias("first"), F.lit(stored.tail()).alias("tail"))


# ---- delivery -------------------------------------------------------------------------------------------


def route_by_type(spark, sf_dir):
    return metrics.counters(log(spark, sf_dir), ["type"])


def filter_predicate(spark, sf_dir):
    rows = delivery.matching(delivery.route(log(spark, sf_dir), "purchase"), F.col("value") > 50)
    return rows.select("position", "value")


def unknown_type_skip(spark, sf_dir):
    return metrics.counters(delivery.of_types(log(spark, sf_dir), ["click", "view", "nothing"]), ["type", "origin"])


def once_per_handler(spark, sf_dir):
    rows = delivery.matching(log(spark, sf_dir), F.col("value") > 20)
    return delivery.once(rows, ["type"]).select("type", "position", "id")


def origin_skip(spark, sf_dir):
    return delivery.foreign(log(spark, sf_dir), OWN).groupBy("origin").agg(F.count(F.lit(1)).alias("events"), F.max("position").alias("last"))


def follow_dedup(spark, sf_dir):
    return delivery.dedup(_doubled(spark, sf_dir), None).select("id", "position", "type")


def follow_dedup_ring(spark, sf_dir):
    rows = log(spark, sf_dir).withColumn("id", F.concat(F.lit("user-"), F.col("user_id").cast("string")))
    return delivery.dedup(rows, 64).select("id", "position", "type")


def follow_pipeline(spark, sf_dir):
    rows = delivery.foreign(delivery.dedup(_doubled(spark, sf_dir), None), OWN)
    out = delivery.deliver(rows, PROPS["click"], policy=delivery.SKIP)
    return out.events.select("position", "id", "origin", F.col("event.k").alias("k"))


def decode_props(spark, sf_dir):
    out = delivery.deliver(log(spark, sf_dir), PROPS["view"], policy=delivery.SKIP)
    return out.events.select("position", F.col("event.k").alias("k"))


def poison_abort_prefix(spark, sf_dir):
    rows = _poisoned(spark, sf_dir).withColumn("type", F.lit("click"))
    return delivery.deliver(rows, PROPS["click"]).events.select("position", F.col("event.k").alias("k"))


def poison_skip_checkpoint(spark, sf_dir):
    rows = _poisoned(spark, sf_dir).withColumn("type", F.lit("click"))
    return delivery.deliver(rows, PROPS["click"], policy=delivery.SKIP).checkpoint


def poison_dead_letters(spark, sf_dir):
    rows = _poisoned(spark, sf_dir).withColumn("type", F.lit("click"))
    return delivery.deliver(rows, PROPS["click"], policy=delivery.SKIP).dead


def replay_checkpoint_filtered(spark, sf_dir):
    return delivery.deliver(log(spark, sf_dir), PROPS["click"], F.col("event.k") < 5).checkpoint


def follow_checkpoint(spark, sf_dir):
    saved = Checkpoints(spark, f"{shared_dir(spark)}/logtide/checkpoints-{uuid.uuid4().hex}")
    saved.save("follower", offsets.NEWEST, _in_order(spark, sf_dir))
    return saved.table().select(F.col("offset").alias("checkpoint"))


def follow_restart(spark, sf_dir):
    """Rows of one type that a follower delivers in two bounded runs on one checkpoint, half of the log appended between them."""
    base = f"{shared_dir(spark)}/logtide/follow-{uuid.uuid4().hex}"
    rows, half = _log_table(log(spark, sf_dir)), F.col("event_id") % 2 == 0
    followed = EventLog(spark, f"{base}/log")

    def deliver(df, _):
        df.select("position", "id").write.mode("append").parquet(f"{base}/out")

    for part in (half, ~half):
        followed.append(rows.where(part), order_by=["event_id"])
        streams.follow(followed, deliver, ["view"], f"{base}/checkpoint", start=offsets.OLDEST, once=True).awaitTermination()
    return spark.read.schema("position long, id string").parquet(f"{base}/out").select("id", "position")


def follow_live_only(spark, sf_dir):
    """What a follower delivers that started behind the first half of the log, and then ran again behind the second."""
    base = f"{shared_dir(spark)}/logtide/follow-{uuid.uuid4().hex}"
    rows, half = _log_table(log(spark, sf_dir)), F.col("event_id") % 2 == 0
    followed = EventLog(spark, f"{base}/log")

    def deliver(df, _):
        df.select("position", "id", "origin").write.mode("append").parquet(f"{base}/out")

    for part in (half, ~half):
        followed.append(rows.where(part), order_by=["event_id"])
        streams.follow(followed, deliver, ["view", "click"], f"{base}/checkpoint", origin=OWN, once=True).awaitTermination()
    return spark.read.schema("position long, id string, origin string").parquet(f"{base}/out").select("id", "position", "origin")


def subscription_resume(spark, sf_dir):
    """Events delivered by two bounded runs of one subscription, half of the log appended between them, with the offset saved in the end."""
    base = f"{shared_dir(spark)}/logtide/subscription-{uuid.uuid4().hex}"
    rows, half = _log_table(log(spark, sf_dir)), F.col("event_id") % 2 == 0
    written, saved, registry = EventLog(spark, f"{base}/log"), Checkpoints(spark, f"{base}/checkpoints"), TypeRegistry()

    def deliver(df):
        df.select("position", "id", F.col("event.k").alias("k")).write.mode("append").parquet(f"{base}/out")

    for part in (half, ~half):
        written.append(rows.where(part), order_by=["event_id"])
        streams.subscribe(written, saved, registry, "clicks", PROPS["click"], deliver, F.col("event.k") < 50, once=True).wait()
    out = spark.read.schema("position long, id string, k long").parquet(f"{base}/out")
    return out.select("position", "id", "k", F.lit(saved.lookup("clicks")[0]).alias("checkpoint"))


# ---- migration ------------------------------------------------------------------------------------------


def _upcasts() -> Upcasts:
    ups = Upcasts()
    ups.typed(PROPS["click"], CLICK_2, lambda v: {"key": v["k"], "label": F.concat(F.lit("k"), v["k"].cast("string"))})
    ups.typed(CLICK_2, CLICK_3, lambda v: {"key": v["key"], "label": v["label"], "twice": v["key"] * 2})
    return ups


def upcast_chain(spark, sf_dir):
    rows = _upcasts().scan(log(spark, sf_dir), CLICK_3.name)
    return rows.select("position", "offset", "id", "type", "data")


def upcast_terminal_types(spark, sf_dir):
    return metrics.counters(_upcasts().apply(log(spark, sf_dir)), ["type"])


def upcast_failure_abort(spark, sf_dir):
    rows = _poisoned(spark, sf_dir).withColumn("type", F.when(F.col("event_id") % 2 == 0, F.lit("click")).otherwise(F.col("type")))
    out = delivery.deliver(rows, PROPS["view"], upcasts=_upcasts())
    return out.events.select("position", F.col("event.k").alias("k"))


def upcast_raw(spark, sf_dir):
    """A step by a Python function, which refuses some payloads: those rows keep their type and say why."""
    ups = Upcasts()

    def widen(text: str) -> tuple[str, str]:
        if "poison" in text:
            raise ValueError("no number")
        return text.replace('"k"', '"key"'), "view.v2"

    ups.raw("view", "view.v2", widen)
    rows = ups.apply(_poisoned(spark, sf_dir).where("type = 'view'"))
    return rows.select("position", "id", "type", "data", F.col("upcast_error").alias("error"))


def upcast_ancestors(spark, sf_dir):
    """Rows of a type and of all that migrate into it, by a scan that reads no others."""
    return metrics.counters(_upcasts().scan(_poisoned(spark, sf_dir), CLICK_2.name, prune=True), ["type"], F.col("upcast_error").isNotNull())


# ---- state ----------------------------------------------------------------------------------------------


def state_fold_lww(spark, sf_dir):
    rows = state.classify(_messages(spark, sf_dir, False), USERS)
    return state.fold(rows.where(F.col("outcome") == state.APPLY))


def state_fold_reset(spark, sf_dir):
    return state.fold(state.after_reset(state.classify(_messages(spark, sf_dir, True), USERS)))


def state_last_offset(spark, sf_dir):
    return state.offsets(state.classify(_messages(spark, sf_dir, True), USERS))


def state_classify(spark, sf_dir):
    rows = _messages(spark, sf_dir, True)
    e = F.col("event_id") % 10
    data = (
        F.when(e == 1, F.lit('{"type":"user","key":"1","value":[7,"seven"],"headers":{"operation":"insert"}}'))
        .when(e == 2, F.lit('{"headers":{"control":"reload-all"}}'))
        .when(e == 3, F.lit('{"probe":"/health","headers":{"X-Trace":"7f"},"type":12}'))
        .when(e == 4, F.lit('{"type":"vendor","key":"1","value":{},"headers":{"operation":"insert"}}'))
        .otherwise(F.col("data"))
    )
    kind = F.when(e == 2, F.lit(state.CONTROL)).when(e == 3, F.lit("probe.Result")).otherwise(F.col("type"))
    return metrics.counters(state.classify(rows.withColumns({"data": data, "type": kind}), USERS, strict=True), ["outcome"])


def composite_keys(spark, sf_dir):
    rows = log(spark, sf_dir)
    kind = F.concat(F.lit("a/b%"), F.col("type"))
    key = F.concat((F.col("event_id") % 7).cast("string"), F.lit("%2F/"), F.col("user_id").cast("string"))
    full = keys.composite_key_column(kind, key)
    part = F.element_at(F.split(full, "/"), 2)
    return rows.select("position", full.alias("composite_key"), keys.decode_part_column(part).alias("key"), keys.in_collection(full, "a/b%click").alias("is_click"))


def state_collection(spark, sf_dir):
    return state.collection(state_fold_lww(spark, sf_dir), "user").agg(F.count(F.lit(1)).alias("entities"), F.max("position").alias("last"))


def snapshot_plus_tail(spark, sf_dir):
    rows = state.classify(_messages(spark, sf_dir, False), USERS).where(F.col("outcome") == state.APPLY)
    snapshot = state.fold(rows.where(F.col("position") <= SNAPSHOT_AT))
    tail = state.fold(rows.where(F.col("position") > SNAPSHOT_AT), keep_deletes=True)
    kept = snapshot.join(tail.select("composite_key"), "composite_key", "left_anti").select(*snapshot.columns)
    return kept.unionByName(tail.where(F.col("operation") != state.DELETE).drop("operation"))


def snapshot_restore(spark, sf_dir):
    """State saved as JSON at one offset, restored by another materializer, and carried on from there."""
    rows = _messages(spark, sf_dir, False)
    first = state.Materializer(spark, USERS)
    first.apply(rows.where(F.col("position") <= SNAPSHOT_AT))
    second = state.Materializer(spark, USERS)
    second.restore(*first.snapshot())
    second.apply(rows)
    return second.state


def _bad_messages(spark, sf_dir) -> DataFrame:
    """The users' messages, with a value that does not fit at every 997th event."""
    wrong = state.update("user", F.lit("1"), F.lit('{"event":"many"}'))
    return _messages(spark, sf_dir, False).withColumn("data", F.when(F.col("event_id") % 997 == 600, wrong).otherwise(F.col("data")))


def _applied(spark, sf_dir, policy: str) -> state.Materializer:
    m = state.Materializer(spark, USERS, policy=policy)
    m.apply(_bad_messages(spark, sf_dir))
    return m


def materializer_abort(spark, sf_dir):
    return _applied(spark, sf_dir, "abort").state


def materializer_skip(spark, sf_dir):
    return _applied(spark, sf_dir, "skip").state


def materializer_offsets(spark, sf_dir):
    ends = [F.lit(_applied(spark, sf_dir, p).last_offset).alias(p) for p in ("abort", "skip")]
    return spark.range(1).select(*ends)


def materializer_failures(spark, sf_dir):
    return state.Materializer(spark, USERS, policy="skip").apply(_bad_messages(spark, sf_dir)).select("position", "reason")


def state_shared_store(spark, sf_dir):
    """Entities of two types, the name of one beginning with that of the other and a separator, kept in one store and told apart by prefix."""
    even = F.col("event_id") % 2 == 0
    key, value = F.col("user_id").cast("string"), F.to_json(F.struct(F.col("event_id").alias("event")))
    data = F.when(even, state.insert("user", key, value)).otherwise(state.insert("user/admin", key, value))
    rows = log(spark, sf_dir).select("position", F.lit(state.CHANGE).alias("type"), data.alias("data"))
    m = state.Materializer(spark, [*USERS, state.Collection(ADMIN)])
    m.apply(rows)
    counts = [m.all(t).agg(F.lit(t).alias("collection"), F.count(F.lit(1)).alias("entities"), F.max("position").alias("last")) for t in ("user", "user/admin")]
    return counts[0].unionByName(counts[1])


def state_message_text(spark, sf_dir):
    """Change messages with a transaction, a time and the value before."""
    rows, value = log(spark, sf_dir), F.to_json(F.struct(F.col("event_id").alias("event")))
    key, tx = F.col("user_id").cast("string"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("tx-"), F.col("event_id").cast("string"))).otherwise(F.lit(""))
    return rows.select("position", state.update("user", key, value, value, txid=tx, timestamp=F.col("timestamp")).alias("message"))


def snapshot_truncate_resume(spark, sf_dir):
    """Messages stored in a log; state at one offset saved, the log cut there, and the fold resumed by another materializer from what is left."""
    base = f"{shared_dir(spark)}/logtide/resume-{uuid.uuid4().hex}"
    written, saved = EventLog(spark, f"{base}/log"), Snapshots(spark, f"{base}/snapshots")
    written.append(_messages(spark, sf_dir, False).select("event_id", "type", "data"), order_by=["event_id"])
    first = state.Materializer(spark, USERS)
    first.apply(written.scan(0, SNAPSHOT_AT))
    saved.save("users", *first.snapshot())
    written.truncate(first.last_offset)
    second = state.Materializer(spark, USERS)
    second.restore(*saved.load("users"))
    second.apply(written.read(second.last_offset))
    return second.state


def snapshot_folder_resume(spark, sf_dir):
    """State saved as a folder at one offset and carried on by another materializer."""
    rows, path = _messages(spark, sf_dir, True), f"{shared_dir(spark)}/logtide/snapshot-{uuid.uuid4().hex}"
    first = state.Materializer(spark, USERS)
    first.apply(rows.where(F.col("position") <= SNAPSHOT_AT))
    first.save(path)
    second = state.Materializer(spark, USERS)
    second.restore_from(path)
    second.apply(rows)
    return second.state


def truncate_survivors(spark, sf_dir):
    written = EventLog(spark, f"{shared_dir(spark)}/logtide/log-{uuid.uuid4().hex}")
    written.append(_log_table(log(spark, sf_dir)), order_by=["event_id"])
    deleted = written.truncate(offsets.format_offset(TRUNCATE_AT))
    return written.read().agg(F.lit(deleted).cast("long").alias("deleted"), F.count(F.lit(1)).alias("left"), F.lit(written.tail()).alias("tail"))


def account_balance(spark, sf_dir):
    cents = F.round(F.col("value") * 100).cast("long")
    signed = F.when(F.col("type") == "purchase", cents).when(F.col("type") == "error", -cents).otherwise(F.lit(0).cast("long"))
    return log(spark, sf_dir).groupBy("user_id").agg(F.sum(signed).alias("balance_cents"))


# ---- envelope -------------------------------------------------------------------------------------------


def chunk_offsets(spark, sf_dir):
    rows = log(spark, sf_dir)
    number = F.floor(F.col("event_id") / 100)
    member = F.struct(F.when(F.col("event_id") % 300 == 7, F.col("offset")).alias("offset"), F.col("id"), F.col("type"), F.struct(F.col("user_id").alias("u")).alias("data"))
    items = F.transform(F.sort_array(F.collect_list(F.struct("position", member.alias("m")))), lambda x: x["m"])
    made = rows.groupBy(number.alias("c")).agg(F.to_json(items).alias("body"))
    made = made.select(F.col("c").cast("string").alias("chunk_start"), (F.col("c") + 1).cast("string").alias("next_offset"), F.lit(False).alias("up_to_date"), "body")
    return chunks.decode_chunks(made).select("chunk_start", F.col("member").cast("long").alias("member"), "offset", "id", "type", "data")


def _spoilt_chunks(spark, sf_dir) -> DataFrame:
    """Chunks of ten events: every fourth is empty, and every seventh member is no event."""
    rows = log(spark, sf_dir)
    number = F.floor(F.col("event_id") / 10)
    good = F.to_json(F.struct("id", "type", F.struct(F.col("user_id").alias("u")).alias("data")))
    item = F.when(F.col("event_id") % 7 == 3, F.concat(F.lit("["), F.col("event_id").cast("string"), F.lit("]"))).otherwise(good)
    items = F.transform(F.sort_array(F.collect_list(F.struct("position", item.alias("m")))), lambda x: x["m"])
    body = F.when(F.col("c") % 4 == 2, F.lit("[]")).otherwise(F.concat(F.lit("["), F.array_join("items", ","), F.lit("]")))
    made = rows.groupBy(number.alias("c")).agg(items.alias("items"))
    return made.select(F.concat(F.lit("t"), F.col("c").cast("string")).alias("chunk_start"), F.concat(F.lit("t"), (F.col("c") + 1).cast("string")).alias("next_offset"), F.lit(False).alias("up_to_date"), body.alias("body"))


def chunk_rejected(spark, sf_dir):
    return chunks.rejected(_spoilt_chunks(spark, sf_dir)).select("chunk_start", F.col("member").cast("long").alias("member"), "text")


def chunk_scan_end(spark, sf_dir):
    return chunks.next_offset(_spoilt_chunks(spark, sf_dir))


def chunk_events(spark, sf_dir):
    return chunks.decode_chunks(_spoilt_chunks(spark, sf_dir)).select("chunk_start", "offset", "id", "data")


def ulid_time_prefix(spark, sf_dir):
    return log(spark, sf_dir).select("position", ulid.time_prefix(F.col("timestamp")).alias("prefix"))


def metadata_roundtrip(spark, sf_dir):
    m = F.when(F.col("event_id") % 3 > 0, F.create_map(F.lit("origin"), F.col("origin"), F.lit("user"), F.col("user_id").cast("string")))
    text = envelope.metadata_to_json(m)
    back = envelope.metadata_from_json(text)
    return log(spark, sf_dir).select("position", text.alias("metadata"), back["user"].alias("user"), envelope.null_if_empty(F.when(F.col("event_id") % 2 == 0, F.col("id")).otherwise(F.lit(""))).alias("id"))


def time_text(spark, sf_dir):
    text = envelope.format_time(F.col("timestamp"))
    return log(spark, sf_dir).select("position", text.alias("text"), (envelope.parse_time(text) == F.col("timestamp").cast("timestamp")).alias("same"), envelope.parse_time(F.col("data")).isNull().alias("bad_is_null"))


# ---- telemetry ------------------------------------------------------------------------------------------

_ERROR = "type = 'error'"


def metrics_rate_1m(spark, sf_dir):
    return metrics.rate(log(spark, sf_dir), ["type"], 1)


def metrics_rate_5m(spark, sf_dir):
    rows = log(spark, sf_dir).withColumn("async", F.col("user_id") % 2 == 0)
    return metrics.rate(rows, ["type", "async"], 5)


def metrics_error_rate(spark, sf_dir):
    return metrics.rate(log(spark, sf_dir), ["origin"], 5, error=F.expr(_ERROR))


def metrics_counters(spark, sf_dir):
    return metrics.counters(log(spark, sf_dir), ["origin"], F.expr(_ERROR))


def metrics_histogram(spark, sf_dir):
    cells = metrics.buckets(log(spark, sf_dir), F.col("value"), ["type"])
    return cells.select("type", F.when(F.col("le") < float("inf"), F.col("le")).alias("le"), "n")


def metrics_p95(spark, sf_dir):
    cells = metrics.buckets(log(spark, sf_dir), F.col("value"), [])
    return metrics.histogram_quantile(cells, 0.95, []).select(F.round("quantile", 6).alias("p95"))


def metrics_p95_by_type(spark, sf_dir):
    cells = metrics.buckets(log(spark, sf_dir), F.col("value"), ["type"])
    return metrics.histogram_quantile(cells, 0.95, ["type"]).select("type", F.round("quantile", 6).alias("p95"))


def metrics_p95_async(spark, sf_dir):
    rows = log(spark, sf_dir).where("user_id % 2 = 0")
    cells = metrics.buckets(rows, F.col("value"), ["type"])
    return metrics.histogram_quantile(cells, 0.95, ["type"]).select("type", F.round("quantile", 6).alias("p95"))


def metrics_gaps(spark, sf_dir):
    """Milliseconds between events of one type, as durations."""
    gaps = metrics.gaps(log(spark, sf_dir), ["type"])
    return gaps.groupBy("type").agg(F.count("gap_ms").alias("gaps"), F.round(F.sum("gap_ms"), 3).alias("total_ms"), F.max("gap_ms").alias("longest_ms"))


def metrics_label_values(spark, sf_dir):
    return metrics.label_values(log(spark, sf_dir), "type")


QUERIES = {
    f.__name__: f
    for f in (
        log_scan_range, log_tail, log_tail_empty, log_replay_from, log_keyset_page, offset_compare,
        route_by_type, filter_predicate, unknown_type_skip, once_per_handler, origin_skip, follow_dedup, follow_dedup_ring, follow_pipeline,
        decode_props, poison_abort_prefix, poison_skip_checkpoint, poison_dead_letters, replay_checkpoint_filtered, follow_checkpoint, follow_restart, follow_live_only, subscription_resume,
        upcast_chain, upcast_terminal_types, upcast_failure_abort, upcast_raw, upcast_ancestors,
        log_append_read, log_truncate_read, snapshot_restore, snapshot_truncate_resume, snapshot_folder_resume,
        materializer_abort, materializer_skip, materializer_offsets, materializer_failures, state_shared_store, state_message_text,
        state_fold_lww, state_fold_reset, state_last_offset, state_classify, composite_keys, state_collection, snapshot_plus_tail, truncate_survivors, account_balance,
        chunk_offsets, chunk_rejected, chunk_scan_end, chunk_events, ulid_time_prefix, metadata_roundtrip, time_text,
        metrics_rate_1m, metrics_rate_5m, metrics_error_rate, metrics_counters, metrics_histogram, metrics_p95, metrics_p95_by_type, metrics_p95_async, metrics_gaps, metrics_label_values,
    )
}

_ABORT = f"(SELECT min(position) FROM log WHERE {_POISON})"
_FOLD = """SELECT 'user' AS entity_type, CAST(user_id AS VARCHAR) AS key, 'user/' || user_id AS composite_key,
       '{"event":' || max(event_id) || '}' AS value, max(position) AS position
FROM log WHERE TRUE """
_ALIVE = " GROUP BY user_id HAVING arg_max(type, position) <> 'error'"
_RESET = " AND event_id % 2500 <> 0 AND position > coalesce((SELECT max(position) FROM log WHERE event_id % 2500 = 0), 0)"
_WRONG = "event_id % 997 = 600"
_BEFORE_WRONG = f"position < coalesce((SELECT min(position) FROM log WHERE {_WRONG}), 1 << 62)"
_HALVES = _LOG + ", n AS (SELECT *, row_number() OVER (ORDER BY event_id % 2, event_id) AS p FROM log)"
_SPOILT = _LOG + """,
m AS (SELECT *, event_id // 10 AS c, event_id % 10 AS m, event_id % 7 = 3 AS bad FROM log)"""
_AT_SNAPSHOT = f"SELECT * REPLACE (CASE WHEN position <= {SNAPSHOT_AT} THEN {SNAPSHOT_AT} ELSE position END AS position) FROM "
_BOUNDS = "(VALUES " + ", ".join(f"(CAST({b} AS DOUBLE))" for b in metrics.BOUNDS) + ", (NULL))"


def _quantile(where: str, by: str) -> str:
    label, group = (f"{by}, ", f"GROUP BY {by}, le") if by else ("", "GROUP BY le")
    part = f"PARTITION BY {by} " if by else ""
    return _with(
        _LOG
        + f""",
cells AS (SELECT {label}coalesce(le, 'inf'::DOUBLE) AS le, count(*) FILTER (le IS NULL OR value <= le) AS n
          FROM log, {_BOUNDS} b(le) WHERE {where} {group}),
steps AS (SELECT *, lag(le) OVER w AS low, lag(n) OVER w AS below, max(n) OVER ({part}) AS total FROM cells WINDOW w AS ({part}ORDER BY le)),
hit AS (SELECT *, row_number() OVER ({part}ORDER BY le) AS r FROM steps WHERE n >= 0.95 * total)""",
        f"""SELECT {label}round(CASE WHEN isinf(le) THEN {metrics.BOUNDS[-1]}
         ELSE coalesce(low, 0) + (le - coalesce(low, 0)) * (0.95 * total - coalesce(below, 0)) / (n - coalesce(below, 0)) END, 6) AS p95
FROM hit WHERE r = 1""",
    )


ORACLE_SQL = {
    "log_scan_range": _with(_LOG, 'SELECT position, "offset", type, data FROM log WHERE position > 250 ORDER BY position LIMIT 100'),
    "log_tail": _with(_LOG, "SELECT coalesce(lpad(CAST(max(position) AS VARCHAR), 20, '0'), '') AS tail FROM log"),
    "log_tail_empty": _with(_LOG, "SELECT coalesce(lpad(CAST(max(position) AS VARCHAR), 20, '0'), '') AS tail FROM log WHERE position < 0"),
    "log_replay_from": _with(_LOG, 'SELECT position, "offset", id, origin, type, data, timestamp FROM log WHERE position > 700'),
    "log_keyset_page": _with(_LOG, 'SELECT position, "offset", type FROM log WHERE position > 300 ORDER BY position LIMIT 50'),
    "offset_compare": _with(_LOG, 'SELECT position, CAST(sign(position - user_id) AS INTEGER) AS "order", position AS parsed FROM log'),
    "log_append_read": _with(
        _LOG + ", n AS (SELECT *, row_number() OVER (ORDER BY event_id < 500, event_id) AS p FROM log)",
        """SELECT p AS position, lpad(CAST(p AS VARCHAR), 20, '0') AS "offset", id, origin, type, data, CAST(user_id AS VARCHAR) AS "user" FROM n WHERE p > 100""",
    ),
    "log_truncate_read": _with(_LOG, """SELECT CAST(70 AS BIGINT) AS deleted, CAST(0 AS BIGINT) AS again, count(*) - 70 AS "left", lpad('71', 20, '0') AS "first", lpad(CAST(count(*) AS VARCHAR), 20, '0') AS tail FROM log"""),
    "route_by_type": _with(_LOG, "SELECT type, count(*) AS events FROM log GROUP BY type"),
    "filter_predicate": _with(_LOG, "SELECT position, value FROM log WHERE type = 'purchase' AND value > 50"),
    "unknown_type_skip": _with(_LOG, "SELECT type, origin, count(*) AS events FROM log WHERE type IN ('click', 'view', 'nothing') GROUP BY type, origin"),
    "once_per_handler": _with(_LOG, "SELECT type, min(position) AS position, arg_min(id, position) AS id FROM log WHERE value > 20 GROUP BY type"),
    "origin_skip": _with(_LOG, f"SELECT origin, count(*) AS events, max(position) AS last FROM log WHERE origin <> '{OWN}' GROUP BY origin"),
    "follow_dedup": _with(_LOG + ", twice AS (SELECT * FROM log UNION ALL SELECT * REPLACE (position + 1000000 AS position) FROM log WHERE event_id % 10 = 0)", "SELECT id, min(position) AS position, arg_min(type, position) AS type FROM twice GROUP BY id"),
    "follow_dedup_ring": f"""WITH RECURSIVE {_LOG.replace("'ev-' || event_id AS id", "'user-' || user_id AS id")},
ids AS MATERIALIZED (SELECT list(id ORDER BY position) AS ids FROM log),
r(position, ring, fresh) AS (
  SELECT CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), FALSE
  UNION ALL
  SELECT position + 1, CASE WHEN list_contains(ring, ids[position + 1]) THEN ring ELSE list_append(ring, ids[position + 1])[-64:] END, NOT list_contains(ring, ids[position + 1])
  FROM r, ids WHERE position < len(ids))
SELECT l.id, l.position, l.type FROM r JOIN log l USING (position) WHERE fresh""",
    "follow_pipeline": _with(_LOG, f"SELECT position, id, origin, {_K} AS k FROM log WHERE type = 'click' AND origin <> '{OWN}'"),
    "decode_props": _with(_LOG, f"SELECT position, {_K} AS k FROM log WHERE type = 'view'"),
    "poison_abort_prefix": _with(_LOG, f"SELECT position, {_K} AS k FROM log WHERE position < {_ABORT}"),
    "poison_skip_checkpoint": _with(_LOG, "SELECT lpad(CAST(max(position) AS VARCHAR), 20, '0') AS delivered, lpad(CAST(max(position) AS VARCHAR), 20, '0') AS scanned FROM log"),
    "poison_dead_letters": _with(_LOG, f"""SELECT position, 'click' AS type, 'undecodable' AS reason, '{{"k": "poison"}}' AS data FROM log WHERE {_POISON}"""),
    "replay_checkpoint_filtered": _with(_LOG, f"SELECT lpad(CAST(max(position) FILTER (type = 'click' AND {_K} < 5) AS VARCHAR), 20, '0') AS delivered, lpad(CAST(max(position) AS VARCHAR), 20, '0') AS scanned FROM log"),
    "follow_restart": _with(_LOG + ", n AS (SELECT *, row_number() OVER (ORDER BY event_id % 2, event_id) AS p FROM log)", "SELECT id, p AS position FROM n WHERE type = 'view'"),
    "follow_live_only": _with(_HALVES, f"SELECT id, p AS position, origin FROM n WHERE type IN ('view', 'click') AND origin <> '{OWN}' AND event_id % 2 = 1"),
    "subscription_resume": _with(_HALVES + f", c AS (SELECT *, {_K} AS k FROM n WHERE type = 'click' AND {_K} < 50)", "SELECT p AS position, id, k, lpad(CAST(max(p) OVER () AS VARCHAR), 20, '0') AS checkpoint FROM c"),
    "follow_checkpoint": _with(_LOG, "SELECT lpad(CAST(max(position) AS VARCHAR), 20, '0') AS checkpoint FROM log"),
    "upcast_chain": _with(_LOG, f"""SELECT position, "offset", id, 'click.v3' AS type, '{{"key":' || {_K} || ',"label":"k' || {_K} || '","twice":' || 2 * {_K} || '}}' AS data FROM log WHERE type = 'click'"""),
    "upcast_terminal_types": _with(_LOG, "SELECT CASE WHEN type = 'click' THEN 'click.v3' ELSE type END AS type, count(*) AS events FROM log GROUP BY 1"),
    "upcast_failure_abort": _with(_LOG, f"SELECT position, {_K} AS k FROM log WHERE event_id % 2 = 1 AND type = 'view' AND position < (SELECT min(position) FROM log WHERE {_POISON} AND (event_id % 2 = 0 OR type IN ('click', 'view')))"),
    "upcast_raw": _with(
        _LOG + f", r AS (SELECT *, {_POISON} AS bad FROM log WHERE type = 'view')",
        """SELECT position, id, CASE WHEN bad THEN 'view' ELSE 'view.v2' END AS type, CASE WHEN bad THEN '{"k": "poison"}' ELSE replace(data, '"k"', '"key"') END AS data,
           CASE WHEN bad THEN 'ValueError: no number' END AS error FROM r""",
    ),
    "upcast_ancestors": _with(_LOG, f"SELECT 'click' AS type, count(*) AS events, count(*) AS errors FROM log WHERE type = 'click' AND {_POISON} HAVING count(*) > 0"),
    "state_fold_lww": _with(_LOG, _FOLD + _ALIVE),
    "state_fold_reset": _with(_LOG, _FOLD + _RESET + _ALIVE),
    "state_last_offset": _with(_LOG, "SELECT lpad(CAST(max(position) AS VARCHAR), 20, '0') AS last_offset FROM log"),
    "state_classify": _with(
        _LOG,
        """SELECT CASE WHEN event_id % 10 IN (1, 2) THEN 'undecodable' WHEN event_id % 10 = 3 THEN 'ignored' WHEN event_id % 10 = 4 THEN 'unknown_type'
            WHEN event_id % 2500 = 0 THEN 'reset' ELSE 'change' END AS outcome, count(*) AS events FROM log GROUP BY 1""",
    ),
    "composite_keys": _with(
        _LOG + ", k AS (SELECT position, 'a/b%' || type AS t, (event_id % 7) || '%2F/' || user_id AS key FROM log)",
        """SELECT position, replace(replace(t, '%', '%25'), '/', '%2F') || '/' || replace(replace(key, '%', '%25'), '/', '%2F') AS composite_key, key, t = 'a/b%click' AS is_click FROM k""",
    ),
    "state_collection": _with(_LOG, f"SELECT count(*) AS entities, max(position) AS last FROM ({_FOLD}{_ALIVE})"),
    "snapshot_plus_tail": _with(_LOG, _FOLD + _ALIVE),
    "snapshot_restore": _with(_LOG, f"SELECT * REPLACE (CASE WHEN position <= {SNAPSHOT_AT} THEN {SNAPSHOT_AT} ELSE position END AS position) FROM ({_FOLD}{_ALIVE})"),
    "snapshot_truncate_resume": _with(_LOG, f"{_AT_SNAPSHOT}({_FOLD}{_ALIVE})"),
    "snapshot_folder_resume": _with(_LOG, _FOLD + _RESET + _ALIVE),
    "materializer_abort": _with(_LOG, f"{_FOLD} AND {_BEFORE_WRONG}{_ALIVE}"),
    "materializer_skip": _with(_LOG, f"{_FOLD} AND NOT {_WRONG}{_ALIVE}"),
    "materializer_offsets": _with(_LOG, f"SELECT lpad(CAST(max(position) FILTER ({_BEFORE_WRONG}) AS VARCHAR), 20, '0') AS abort, lpad(CAST(max(position) AS VARCHAR), 20, '0') AS skip FROM log"),
    "materializer_failures": _with(_LOG, f"SELECT position, 'undecodable' AS reason FROM log WHERE {_WRONG}"),
    "state_shared_store": _with(_LOG, "SELECT CASE WHEN event_id % 2 = 0 THEN 'user' ELSE 'user/admin' END AS collection, count(DISTINCT user_id) AS entities, max(position) AS last FROM log GROUP BY 1"),
    "state_message_text": _with(
        _LOG,
        """SELECT position, '{"type":"user","key":"' || user_id || '","value":{"event":' || event_id || '},"old_value":{"event":' || event_id || '},"headers":{"operation":"update"'
           || CASE WHEN event_id % 2 = 0 THEN ',"txid":"tx-' || event_id || '"' ELSE '' END
           || ',"timestamp":"' || regexp_replace(strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%f'), '\\.?0*$', '') || 'Z"}}' AS message FROM log""",
    ),
    "truncate_survivors": _with(_LOG, f"""SELECT count(*) FILTER (position <= {TRUNCATE_AT}) AS deleted, count(*) FILTER (position > {TRUNCATE_AT}) AS "left", lpad(CAST(max(position) AS VARCHAR), 20, '0') AS tail FROM log"""),
    "account_balance": _with(_LOG, "SELECT user_id, CAST(sum(CASE type WHEN 'purchase' THEN 1 WHEN 'error' THEN -1 ELSE 0 END * CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS balance_cents FROM log GROUP BY user_id"),
    "chunk_offsets": _with(
        _LOG + ", c AS (SELECT *, event_id // 100 AS c, event_id % 100 AS m FROM log)",
        """SELECT CAST(c AS VARCHAR) AS chunk_start, m AS member, CASE WHEN event_id % 300 = 7 THEN "offset" WHEN event_id = max(event_id) OVER (PARTITION BY c) THEN CAST(c + 1 AS VARCHAR) ELSE CAST(c AS VARCHAR) END AS "offset",
           id, type, '{"u":' || user_id || '}' AS data FROM c""",
    ),
    "chunk_rejected": _with(_SPOILT, "SELECT 't' || c AS chunk_start, m AS member, '[' || event_id || ']' AS text FROM m WHERE bad AND c % 4 <> 2"),
    "chunk_scan_end": _with(_SPOILT, "SELECT 't' || (max(c) + 1) AS next_offset FROM m"),
    "chunk_events": _with(_SPOILT + ", g AS (SELECT *, m = max(m) OVER (PARTITION BY c) AS last FROM m WHERE NOT bad AND c % 4 <> 2)", """SELECT 't' || c AS chunk_start, 't' || CASE WHEN last THEN c + 1 ELSE c END AS "offset", id, '{"u":' || user_id || '}' AS data FROM g"""),
    "ulid_time_prefix": _with(_LOG, "SELECT position, " + " || ".join(f"substr('{ulid.ALPHABET}', CAST((((epoch_us(timestamp) // 1000) >> {s}) & 31) AS INTEGER) + 1, 1)" for s in range(45, -1, -5)) + " AS prefix FROM log"),
    "metadata_roundtrip": _with(
        _LOG,
        """SELECT position, CASE WHEN event_id % 3 > 0 THEN '{"origin":"' || origin || '","user":"' || user_id || '"}' END AS metadata,
       CASE WHEN event_id % 3 > 0 THEN CAST(user_id AS VARCHAR) END AS "user", CASE WHEN event_id % 2 = 0 THEN id END AS id FROM log""",
    ),
    "time_text": _with(_LOG, "SELECT position, regexp_replace(strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%f'), '\\.?0*$', '') || 'Z' AS text, TRUE AS same, TRUE AS bad_is_null FROM log"),
    "metrics_rate_1m": _with(_LOG, "SELECT time_bucket(INTERVAL 1 MINUTE, timestamp) AS window_start, type, count(*) / 60.0::DOUBLE AS rate FROM log GROUP BY 1, 2"),
    "metrics_rate_5m": _with(_LOG, 'SELECT time_bucket(INTERVAL 5 MINUTE, timestamp) AS window_start, type, user_id % 2 = 0 AS "async", count(*) / 300.0::DOUBLE AS rate FROM log GROUP BY 1, 2, 3'),
    "metrics_error_rate": _with(_LOG, f"SELECT time_bucket(INTERVAL 5 MINUTE, timestamp) AS window_start, origin, count(*) / 300.0::DOUBLE AS rate, count(*) FILTER ({_ERROR}) / 300.0::DOUBLE AS error_rate FROM log GROUP BY 1, 2"),
    "metrics_counters": _with(_LOG, f"SELECT origin, count(*) AS events, count(*) FILTER ({_ERROR}) AS errors FROM log GROUP BY origin"),
    "metrics_histogram": _with(_LOG, f"SELECT type, le, count(*) FILTER (le IS NULL OR value <= le) AS n FROM log, {_BOUNDS} b(le) GROUP BY type, le"),
    "metrics_p95": _quantile("TRUE", ""),
    "metrics_p95_by_type": _quantile("TRUE", "type"),
    "metrics_p95_async": _quantile("user_id % 2 = 0", "type"),
    "metrics_gaps": _with(
        _LOG + ", g AS (SELECT type, (epoch_us(timestamp) - epoch_us(lag(timestamp) OVER (PARTITION BY type ORDER BY position))) / 1000.0 AS gap FROM log)",
        "SELECT type, count(gap) AS gaps, round(sum(gap), 3) AS total_ms, max(gap) AS longest_ms FROM g GROUP BY type",
    ),
    "metrics_label_values": _with(_LOG, "SELECT DISTINCT type FROM log"),
}
