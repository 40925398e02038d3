"""State protocol: change and control messages, their classification, the keyed fold, and snapshots.

A log of messages folds into collections: for every composite key the latest change
by position wins, a delete removes, and a reset clears the registered collections.
Once the last reset is known the fold is one aggregate per key.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtide.functions import keys
from logtide.functions.binding import bind
from logtide.functions.envelope import format_time, null_if_empty
from logtide.functions.offsets import format_column, format_offset, parse_offset
from logtide.operators.decode import decode_column
from logtide.operators.registry import EventType
from logtide.sources.log import _Files
from logtide.sources.paths import shared_dir
from logtide.sources.states import STATE_SCHEMA, ParquetStates, StateStore

# The protocol's names.
CHANGE, CONTROL = "state.ChangeMessage", "state.ControlMessage"
INSERT, UPDATE, DELETE = "insert", "update", "delete"
SNAPSHOT_START, SNAPSHOT_END, RESET = "snapshot-start", "snapshot-end", "reset"
SNAPSHOT_VERSION, KEY_CODEC = 1, "percent-v1"

# Outcomes of a row.
APPLY, RESETS, MARK, IGNORE, UNDECODABLE, UNKNOWN_TYPE = "change", "reset", "snapshot", "ignored", "undecodable", "unknown_type"

_STRICT = "type string, key string, value variant, old_value variant, headers struct<operation:string,txid:string,timestamp:string>, __corrupt string"
_HEADERS = "headers struct<control:string,offset:string>, __corrupt string"


class StateError(ValueError):
    """A message or snapshot that the protocol does not allow, or an apply that was aborted."""


# ---- messages -----------------------------------------------------------------------------------------


def _text(value: Column | str | None) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast("string")


def change(
    operation: str,
    entity_type: Column | str,
    key: Column,
    value: Column | None = None,
    old_value: Column | None = None,
    txid: Column | str | None = None,
    timestamp: Column | bool | None = None,
) -> Column:
    """JSON of a change message; ``value`` and ``old_value`` are JSON texts, ``timestamp`` True is the time of the query.  An empty key fails the query."""
    if operation not in (INSERT, UPDATE, DELETE):
        raise StateError(f"unknown operation {operation!r}")
    checked = F.when(F.coalesce(key, F.lit("")) == "", F.raise_error(F.lit("a change needs a key")).cast("string")).otherwise(key)
    timestamp = F.current_timestamp() if timestamp is True else timestamp
    headers = F.struct(
        F.lit(operation).alias("operation"),
        null_if_empty(_text(txid)).alias("txid"),
        (format_time(timestamp) if isinstance(timestamp, Column) else F.lit(None).cast("string")).alias("timestamp"),
    )
    fields = [_text(entity_type).alias("type"), checked.alias("key")]
    if value is not None:
        fields.append(F.parse_json(value).alias("value"))
    if old_value is not None:
        fields.append(F.parse_json(old_value).alias("old_value"))
    return F.to_json(F.struct(*fields, headers.alias("headers")))


def insert(entity_type, key: Column, value: Column, **options) -> Column:
    return change(INSERT, entity_type, key, value, **options)


def update(entity_type, key: Column, value: Column, old_value: Column | None = None, **options) -> Column:
    return change(UPDATE, entity_type, key, value, old_value, **options)


def delete(entity_type, key: Column, old_value: Column | None = None, **options) -> Column:
    return change(DELETE, entity_type, key, None, old_value, **options)


def control(kind: str, offset: str | None = None) -> str:
    """JSON of a control message."""
    if kind not in (SNAPSHOT_START, SNAPSHOT_END, RESET):
        raise StateError(f"unknown control {kind!r}")
    return json.dumps({"headers": {"control": kind} | ({"offset": offset} if offset else {})}, separators=(",", ":"))


# ---- classification -----------------------------------------------------------------------------------


@dataclass
class Collection:
    """A registered entity type, with the schema its values must have."""

    event_type: EventType

    @property
    def name(self) -> str:
        return self.event_type.name


def classify(log: DataFrame, collections: list[Collection], strict: bool = False) -> DataFrame:
    """``log`` with what each row does: ``outcome``, ``entity_type``, ``key``, ``composite_key``, ``operation``, ``value``.

    Rows typed as messages are held to their schema; others count by their shape
    and are ignored where they have none of the protocol's.  A row typed as a
    message is parsed once, by the schema of its type.
    """
    names = [c.name for c in collections]
    kind_is = F.coalesce(F.col("type"), F.lit(""))
    change_ = F.when(kind_is != CONTROL, F.from_json("data", _STRICT, {"columnNameOfCorruptRecord": "__corrupt"}))
    head = F.when(kind_is != CHANGE, F.from_json("data", _HEADERS, {"columnNameOfCorruptRecord": "__corrupt"}))
    rows = bind(bind(log, "__c", change_), "__h", head)
    c_ok = F.col("__c").isNotNull() & F.col("__c.__corrupt").isNull()
    h_ok = F.col("__h").isNotNull() & F.col("__h.__corrupt").isNull() & F.col("__h.headers").isNotNull()
    entity, key, op = (F.coalesce(F.col(x), F.lit("")) for x in ("__c.type", "__c.key", "__c.headers.operation"))
    registered = entity.isin(names) if names else F.lit(False)
    rows = bind(rows, "__v", F.when(registered & (op != DELETE), F.to_json(F.col("__c.value"))))
    value = F.col("__v")
    fits = F.lit(False)
    for c in collections:
        fits = F.when(entity == c.name, value.isNotNull() & ~decode_column(value, c.event_type)["poison"]).otherwise(fits)
    unknown = F.lit(UNKNOWN_TYPE if strict else IGNORE)
    as_change = (
        F.when(~registered, unknown)
        .when(op == DELETE, F.lit(APPLY))
        .when(op.isin(INSERT, UPDATE) & fits, F.lit(APPLY))
        .otherwise(F.lit(UNDECODABLE))
    )
    kind = F.coalesce(F.col("__h.headers.control"), F.lit(""))
    known_control = F.when(kind == RESET, F.lit(RESETS)).when(kind.isin(SNAPSHOT_START, SNAPSHOT_END), F.lit(MARK))
    typed_control = F.when(~h_ok, F.lit(UNDECODABLE)).otherwise(F.coalesce(known_control, F.lit(UNDECODABLE if strict else IGNORE)))
    shaped = c_ok & (entity != "") & (key != "") & (op != "")
    outcome = (
        F.when(F.col("type") == CHANGE, F.when(~c_ok, F.lit(UNDECODABLE)).otherwise(as_change))
        .when(F.col("type") == CONTROL, typed_control)
        .when(h_ok & known_control.isNotNull(), known_control)
        .when(shaped, as_change)
        .otherwise(F.lit(IGNORE))
    )
    rows = bind(rows, "outcome", F.coalesce(outcome, F.lit(IGNORE)))
    mine = F.col("outcome") == APPLY
    return rows.select(
        *log.columns,
        "outcome",
        F.when(mine, entity).alias("entity_type"),
        F.when(mine, key).alias("key"),
        F.when(mine, keys.composite_key_column(entity, key)).alias("composite_key"),
        F.when(mine, op).alias("operation"),
        F.when(mine & (op != DELETE), value).alias("value"),
    )


# ---- fold ---------------------------------------------------------------------------------------------


def fold(changes: DataFrame, keep_deletes: bool = False) -> DataFrame:
    """The latest change of each key: entity_type, key, composite_key, value, position.  Deleted keys are gone, or kept with null values."""
    last = F.max_by(F.struct("entity_type", "key", "operation", "value", "position"), F.col("position"))
    rows = changes.groupBy("composite_key").agg(last.alias("__l")).select("composite_key", "__l.*")
    if not keep_deletes:
        rows = rows.where(F.col("operation") != DELETE)
    return rows.select("entity_type", "key", "composite_key", "value", "position", *(["operation"] if keep_deletes else []))


def last_reset(classified: DataFrame) -> DataFrame:
    """One row: position of the last reset, 0 where there is none."""
    return classified.where(F.col("outcome") == RESETS).agg(F.coalesce(F.max("position"), F.lit(0).cast("long")).alias("reset_at"))


def after_reset(classified: DataFrame) -> DataFrame:
    """Applied changes that no later reset clears; the reset's position is one broadcast row.

    Resets are looked for only in rows whose text could hold one (the word, or an
    escape that may spell it) and which are not typed as changes: a filter that
    reaches the scan, so that the log is not parsed a second time.
    """
    changes = classified.where(F.col("outcome") == APPLY)
    text = F.col("data")
    possible = (F.coalesce(F.col("type"), F.lit("")) != CHANGE) & (text.contains(RESET) | text.contains("\\u"))
    return changes.join(F.broadcast(last_reset(classified.where(possible))), how="cross").where("position > reset_at").drop("reset_at")


def collection(state: DataFrame, entity_type: str) -> DataFrame:
    """Entities of one type; shared stores keep types apart by the prefix of the composite key."""
    return state.where(keys.in_collection(F.col("composite_key"), entity_type))


# ---- snapshots ----------------------------------------------------------------------------------------


def snapshot_blob(state: DataFrame, registered: list[str]) -> DataFrame:
    """One row with the snapshot's JSON: collections by type, each a map from composite key to entity."""
    by_type = state.groupBy("entity_type").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("composite_key").alias("k"), F.col("value").alias("v"))))).alias("entities"))
    named = state.sparkSession.createDataFrame([(n,) for n in registered], "entity_type string")
    by_type = named.join(by_type, "entity_type", "left")
    pairs = F.transform_values(F.coalesce("entities", F.create_map().cast("map<string,string>")), lambda k, v: F.parse_json(v))
    whole = by_type.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("entity_type", F.to_json(pairs).alias("j"))))).alias("m"))
    collections = F.transform_values("m", lambda k, v: F.parse_json(v))
    blob = F.to_json(F.struct(F.lit(SNAPSHOT_VERSION).alias("version"), F.lit(KEY_CODEC).alias("key_codec"), collections.alias("collections")))
    return whole.select(blob.alias("blob"))


def _plain(blob: str) -> dict[str, dict]:
    """Collections of a snapshot, after every check of its form; ``StateError`` for any other text."""
    try:
        whole = json.loads(blob)
    except ValueError as e:
        raise StateError(f"snapshot is not JSON: {e}") from None
    if not isinstance(whole, dict):
        raise StateError("snapshot is not an object")
    versioned = isinstance(whole.get("version"), int) and not isinstance(whole.get("version"), bool)
    if versioned:
        if whole["version"] != SNAPSHOT_VERSION:
            raise StateError(f"snapshot version {whole['version']} is unknown")
        if whole.get("key_codec") != KEY_CODEC:
            raise StateError(f"snapshot key codec {whole.get('key_codec')!r} is unknown")
        collections = whole.get("collections")
    else:
        collections = whole
    if not isinstance(collections, dict) or not all(isinstance(c, dict) for c in collections.values()):
        raise StateError("snapshot collections must be objects")
    for name, entities in collections.items():
        for composite in entities:
            if versioned:
                try:
                    owner, _ = keys.split_key(composite)
                except ValueError as e:
                    raise StateError(str(e)) from None
            else:
                owner, slash, key = composite.partition("/")
                if not slash or any(x in part for part in (owner, key) for x in "%/"):
                    raise StateError(f"unversioned snapshot with an ambiguous key {composite!r}")
            if owner != name:
                raise StateError(f"key {composite!r} is not of collection {name!r}")
    return collections


@dataclass
class Materializer:
    """Folds a log into collections, remembers how far it got, and saves and restores snapshots.

    Each fold is kept in ``store`` before the offset moves: the next one starts from
    rows, not from the plans and logs of all before it, and a store that fails leaves
    state and offset as they were.
    """

    spark: object
    collections: list[Collection]
    policy: str = "abort"
    strict: bool = False
    on_reset: Callable[[int], None] | None = None
    on_snapshot: Callable[[int], None] | None = None
    on_error: Callable[[DataFrame], None] | None = None
    last_offset: str = ""
    state: DataFrame = field(default=None)
    store: StateStore | None = None

    _STATE = STATE_SCHEMA

    def __post_init__(self):
        names = [c.name for c in self.collections]
        if len(set(names)) != len(names):
            raise StateError("a collection is registered twice")
        self.store = self.store or ParquetStates(self.spark, f"{shared_dir(self.spark)}/logtide/state-{uuid.uuid4().hex}")
        if self.state is None:
            self.state = self.spark.createDataFrame([], self._STATE)

    def _clear(self) -> None:
        self.state, self.last_offset = self.spark.createDataFrame([], self._STATE), ""

    def apply(self, log: DataFrame) -> DataFrame:
        """Fold the rows of ``log`` behind ``last_offset`` into the state and return the rows that failed.

        Under ``abort`` the rows before the first failure are applied and the offset
        stays there; under ``skip`` undecodable rows are passed over.  An unknown
        entity type in strict mode is no decoding failure and is never skipped.
        """
        classified = classify(log.where(F.col("position") > parse_offset(self.last_offset)), self.collections, self.strict)
        bad = F.col("outcome").isin(UNKNOWN_TYPE, UNDECODABLE)
        # parsed once for all that follows; a lost block is worked out again
        held = classified.select("position", "outcome", "entity_type", "key", "composite_key", "operation", "value", F.when(bad, F.struct("type", "data")).alias("bad")).persist()
        try:
            return self._apply(held, bad)
        finally:
            held.unpersist()

    def _apply(self, held: DataFrame, bad: Column) -> DataFrame:
        rows, failures = held, [UNKNOWN_TYPE] if self.policy == "skip" else [UNKNOWN_TYPE, UNDECODABLE]
        failed = rows.where(bad).select("position", "bad.type", F.col("outcome").alias("reason"), "bad.data")
        stop = rows.where(F.col("outcome").isin(failures)).agg(F.min("position")).first()[0]
        if stop is not None:
            rows = rows.where(F.col("position") < stop)
            failed = failed.where(F.col("position") <= stop)
        facts = rows.agg(
            F.max("position").alias("end"),
            F.max(F.when(F.col("outcome") == RESETS, F.col("position"))).alias("reset"),
            F.count_if(F.col("outcome") == RESETS).alias("resets"),
            F.count_if(F.col("outcome") == MARK).alias("marks"),
            F.count_if(F.col("outcome") == APPLY).alias("changes"),
        ).first()
        before, reset = self.state, facts["reset"] is not None
        if facts["changes"] or reset:
            changes = rows.where(F.col("outcome") == APPLY)
            if reset:
                changes = changes.where(F.col("position") > facts["reset"])
                before = before.where(~F.col("entity_type").isin([c.name for c in self.collections]))
            tail = fold(changes, keep_deletes=True)
            untouched = before.join(tail.select("composite_key"), "composite_key", "left_anti")
            alive = tail.where(F.col("operation") != DELETE).drop("operation")
            self.state = self.store.replace(untouched.select(*before.columns).unionByName(alive.select(*before.columns)))
        if facts["end"] is not None:
            self.last_offset = format_offset(facts["end"])
        if facts["resets"] and self.on_reset:
            self.on_reset(facts["resets"])
        if facts["marks"] and self.on_snapshot:
            self.on_snapshot(facts["marks"])
        if self.on_error:
            self.on_error(failed)
        return failed

    def get(self, entity_type: str, key: str) -> str | None:
        """JSON of one entity."""
        row = self.state.where(F.col("composite_key") == keys.composite_key(entity_type, key)).select("value").first()
        return None if row is None else row[0]

    def all(self, entity_type: str) -> DataFrame:
        return collection(self.state, entity_type)

    def clear(self, entity_type: str) -> None:
        self.state = self.store.replace(self.state.where(~keys.in_collection(F.col("composite_key"), entity_type)))

    def save(self, path: str) -> str:
        """Write the state as a snapshot folder: Parquet rows and, when they are complete, a file that says what they are.  For states too large for one text."""
        if not self.last_offset:
            raise StateError("nothing has been applied yet")
        names = [c.name for c in self.collections]
        self.state.where(F.col("entity_type").isin(names)).write.parquet(f"{path}/entities")
        about = {"version": SNAPSHOT_VERSION, "key_codec": KEY_CODEC, "offset": self.last_offset, "collections": names}
        if not _Files(self.spark, path).put(json.dumps(about), "snapshot.json"):
            raise StateError(f"there is a snapshot in {path} already")
        return self.last_offset

    def restore_from(self, path: str) -> str:
        """Replace the state by that of a snapshot folder, after the checks ``restore`` makes."""
        files = _Files(self.spark, path)
        try:
            if "snapshot.json" not in files.names():
                raise StateError(f"no complete snapshot in {path}")
            about = json.loads(files.read("snapshot.json"))
            if (about["version"], about["key_codec"]) != (SNAPSHOT_VERSION, KEY_CODEC):
                raise StateError(f"snapshot of version {about['version']} and key codec {about['key_codec']!r} is unknown")
            missing = sorted({c.name for c in self.collections} - set(about["collections"]))
            if missing:
                raise StateError(f"snapshot lacks registered collections {missing}")
            rows = self.spark.read.schema(self._STATE).parquet(f"{path}/entities").where(F.col("entity_type").isin([c.name for c in self.collections]))
            self._check(rows)
        except StateError:
            self._clear()
            raise
        self.state, self.last_offset = self.store.replace(rows), about["offset"]
        return self.last_offset

    def _check(self, rows: DataFrame) -> None:
        fits = F.lit(True)
        for c in self.collections:
            fits = F.when(F.col("entity_type") == c.name, ~decode_column(F.col("value"), c.event_type)["poison"]).otherwise(fits)
        wrong = rows.where(~fits).select("entity_type").first()
        if wrong is not None:
            raise StateError(f"snapshot has entities of {wrong[0]!r} that do not fit its schema")

    def snapshot(self) -> tuple[str, str]:
        """Offset and JSON of the state; refused where nothing has been applied."""
        if not self.last_offset:
            raise StateError("nothing has been applied yet")
        names = [c.name for c in self.collections]
        return self.last_offset, snapshot_blob(self.state.where(F.col("entity_type").isin(names)), names).first()[0]

    def restore(self, offset: str, blob: str | None) -> str:
        """Replace the state by a snapshot's, after it has passed every check.  On failure the materializer is empty and at the start."""
        try:
            rows = self._restored(offset, blob)
        except StateError:
            self._clear()
            raise
        self.state, self.last_offset = rows, offset if blob is not None else ""
        return self.last_offset

    def _restored(self, offset: str, blob: str | None) -> DataFrame:
        if blob is None:
            return self.spark.createDataFrame([], self._STATE)
        collections = _plain(blob)
        missing = sorted({c.name for c in self.collections} - set(collections))
        if missing:
            raise StateError(f"snapshot lacks registered collections {missing}")
        at = parse_offset(offset)
        rows = []
        for c in self.collections:
            for composite, entity in collections[c.name].items():
                name, key = keys.split_key(composite)
                rows.append((name, key, composite, json.dumps(entity), at))
        df = self.spark.createDataFrame(rows, self._STATE)
        self._check(df)
        return df


def offsets(classified: DataFrame) -> DataFrame:
    """One row: the last offset that was applied or passed over before the first row that failed."""
    first = classified.where(F.col("outcome").isin(UNDECODABLE, UNKNOWN_TYPE)).agg(F.min("position").alias("first_failed"))
    before = classified.select("position").join(F.broadcast(first), F.col("first_failed").isNull() | (F.col("position") < F.col("first_failed")))
    return before.agg(F.coalesce(format_column(F.max("position")), F.lit("")).alias("last_offset"))
