"""The event log: an append-only, position-ordered Parquet table with a manifest.

Layout under ``path``:

``data/N-U``             rows of one append: N the first position, U unique to the attempt
``manifest/V``           JSON of version V: high-water mark, truncation point, batches

A batch becomes visible when its manifest version is put in place by a rename that
fails if that version is there already; the loser of a race raises ``Conflict`` and
may try again.  Positions are never used twice, also after truncation.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtide.functions.offsets import NEWEST, OLDEST, OffsetError, format_column, format_offset, parse_offset
from logtide.functions.ulid import ulid_column

LOG_SCHEMA = "position long, offset string, id string, origin string, type string, data string, metadata map<string,string>, timestamp timestamp"
#: Columns an append may bring; only type and data must.
EVENT_COLUMNS = ("id", "origin", "type", "data", "metadata", "timestamp")
TABLE_VERSION = 4


class Conflict(RuntimeError):
    """Another writer has committed first."""


@dataclass
class Manifest:
    version: int = 0
    high: int = 0
    truncated: int = 0
    table_version: int = TABLE_VERSION
    #: First position, last position and folder of each live batch.
    batches: list[list] = field(default_factory=list)

    @property
    def tail(self) -> str:
        """Offset of the last live row; the start where there is none."""
        live = self.batches and self.batches[-1][1] > self.truncated
        return format_offset(self.batches[-1][1]) if live else OLDEST


class _Files:
    """Small files through the Hadoop file system of a path."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark._jvm
        self.fs = self.path().getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, *parts: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def names(self, *parts: str) -> list[str]:
        p = self.path(*parts)
        return [s.getPath().getName() for s in self.fs.listStatus(p)] if self.fs.exists(p) else []

    def read(self, *parts: str) -> str:
        stream = self.fs.open(self.path(*parts))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, text: str, *parts: str) -> bool:
        """Write a new file in one step; False if it is there already."""
        final, temp = self.path(*parts), self.path(*parts[:-1], f".{parts[-1]}.{uuid.uuid4().hex}")
        self.fs.mkdirs(final.getParent())
        stream = self.fs.create(temp, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        options = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(temp, final, options)  # unlike FileSystem.rename it never replaces a file
            return True
        except Exception:
            self.fs.delete(temp, False)
            if self.fs.exists(final):
                return False
            raise

    def delete(self, *parts: str) -> None:
        self.fs.delete(self.path(*parts), True)


class EventLog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._files = _Files(spark, path)

    # ---- reading

    def manifest(self) -> Manifest:
        versions = [n for n in self._files.names("manifest") if n.isdigit()]
        return Manifest(**json.loads(self._files.read("manifest", max(versions)))) if versions else Manifest()

    def tail(self) -> str:
        return self.manifest().tail

    def resolve(self, offset: str) -> str:
        """A concrete offset: that of the tail for ``NEWEST``."""
        if offset == NEWEST:
            return self.tail()
        parse_offset(offset)
        return offset

    def scan(self, after: int = 0, upto: int | None = None) -> DataFrame:
        """Rows with positions in (after, upto], unordered.  Batches outside are not opened; the rest is pushed to the files."""
        m = self.manifest()
        after = max(after, m.truncated)
        dirs = [f"{self.path}/data/{d}" for a, b, d in m.batches if b > after and (upto is None or a <= upto)]
        if not dirs:
            return self.spark.createDataFrame([], LOG_SCHEMA)
        rows = self.spark.read.schema(LOG_SCHEMA).parquet(*dirs).where(F.col("position") > after)
        return rows if upto is None else rows.where(F.col("position") <= upto)

    def read(self, offset: str = OLDEST, limit: int = 0) -> DataFrame:
        """Rows strictly after ``offset`` in order, at most ``limit`` where it is positive.  From the tail there are none."""
        if offset == NEWEST:
            return self.spark.createDataFrame([], LOG_SCHEMA)
        rows = self.scan(parse_offset(offset)).orderBy("position")
        return rows.limit(limit) if limit > 0 else rows

    def read_batch(self, offset: str = OLDEST, limit: int = 0) -> tuple[DataFrame, str]:
        """Rows after ``offset`` and the offset to go on from."""
        if offset == NEWEST:
            return self.read(NEWEST), self.tail()
        rows = self.read(offset, limit)
        last = rows.agg(F.max("position")).first()[0]
        return rows, offset if last is None else format_offset(last)

    def replay(self, callback, offset: str = OLDEST, batch_rows: int = 0) -> str:
        """Call back with every row up to the tail as it is now, in order, reading at most ``batch_rows`` at a time (0: all); the first failure ends the replay and is raised."""
        tail = self.tail()
        if offset == NEWEST:
            return tail
        at, end = parse_offset(offset), parse_offset(tail)
        while at < end:
            upto = min(end, at + batch_rows) if batch_rows > 0 else end
            for row in self.scan(at, upto).orderBy("position").toLocalIterator():
                callback(row)
                offset = row["offset"]
            at = upto
        return offset

    # ---- writing

    def append(self, events: DataFrame, order_by: list[str] | None = None, origin: str | None = None) -> tuple[int, int]:
        """Append events in the order of ``order_by`` (else as they come); first and last position, (0, 0) for none.

        Rows get consecutive positions without passing through one task: they are
        staged in range-partitioned order, counted by partition, and numbered from
        the sums.
        """
        missing = {"type", "data"} - set(events.columns)
        if missing:
            raise ValueError(f"events lack columns {sorted(missing)}")
        kinds = dict(x.split(" ", 1) for x in LOG_SCHEMA.split(", "))
        m = self.manifest()
        stage = f"{self.path}/staging/{uuid.uuid4().hex}"
        ordered = events.orderBy(*order_by) if order_by else events
        columns = [(F.col(c) if c in events.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in EVENT_COLUMNS]
        ids = F.monotonically_increasing_id()
        ordered.select(*columns, F.spark_partition_id().alias("__p"), ids.alias("__i")).write.parquet(stage)
        try:
            staged = self.spark.read.parquet(stage)
            sizes = {r["__p"]: (r["n"], r["lo"]) for r in staged.groupBy("__p").agg(F.count(F.lit(1)).alias("n"), F.min("__i").alias("lo")).collect()}
            total = sum(n for n, _ in sizes.values())
            if not total:
                return 0, 0
            starts, at = [], m.high
            for p in sorted(sizes):
                starts.append((p, at - sizes[p][1] + 1))
                at += sizes[p][0]
            # ids within a partition are consecutive, so one added number makes positions of them
            base = self.spark.createDataFrame(starts, "__p int, __base long")
            rows = staged.join(F.broadcast(base), "__p").withColumn("position", F.col("__i") + F.col("__base"))
            now = F.coalesce("timestamp", F.current_timestamp())
            rows = rows.select(
                "position",
                format_column(F.col("position")).alias("offset"),
                F.coalesce(F.nullif(F.col("id"), F.lit("")), ulid_column(now)).alias("id"),
                F.coalesce("origin", F.lit(origin)).alias("origin"),
                "type",
                "data",
                F.when(F.size("metadata") > 0, F.col("metadata")).alias("metadata"),
                now.alias("timestamp"),
            )
            first, last = m.high + 1, m.high + total
            folder = f"{format_offset(first)}-{uuid.uuid4().hex}"
            rows.sortWithinPartitions("position").write.parquet(f"{self.path}/data/{folder}")
            try:
                self._commit(Manifest(m.version + 1, last, m.truncated, m.table_version, [*m.batches, [first, last, folder]]))
            except Conflict:
                self._files.delete("data", folder)
                raise
            return first, last
        finally:
            self._files.delete("staging", stage.rsplit("/", 1)[1])

    def truncate(self, offset: str) -> int:
        """Drop rows up to ``offset``, whose number is returned.

        Batches wholly before it are deleted; the one it cuts is hidden up to it and
        goes with a later truncation.  Dropping to the start drops nothing.
        """
        if offset == NEWEST:
            raise OffsetError("truncation needs a concrete offset")
        upto = parse_offset(offset)
        m = self.manifest()
        if upto <= m.truncated:
            return 0
        gone = self.scan(0, upto).count()
        dead = [b for b in m.batches if b[1] <= upto]
        self._commit(Manifest(m.version + 1, m.high, upto, m.table_version, [b for b in m.batches if b[1] > upto]))
        for _, _, folder in dead:
            self._files.delete("data", folder)
        return gone

    def migrate(self) -> int:
        """Bring the manifest to the current table version; columns a batch lacks are read as null.  Idempotent."""
        m = self.manifest()
        if m.table_version < TABLE_VERSION:
            self._commit(Manifest(m.version + 1, m.high, m.truncated, TABLE_VERSION, m.batches))
        return TABLE_VERSION

    def _commit(self, m: Manifest) -> None:
        if not self._files.put(json.dumps(m.__dict__), "manifest", f"{m.version:020d}"):
            raise Conflict(f"version {m.version} of {self.path} was committed by another writer")

    def append_retrying(self, events: DataFrame, attempts: int = 3, pause: float = 0.1, **options) -> tuple[int, int]:
        """Append, and once more after a lost race, with doubling pauses."""
        import time

        for k in range(attempts):
            try:
                return self.append(events, **options)
            except Conflict:
                if k == attempts - 1:
                    raise
                time.sleep(pause * 2**k)
        raise AssertionError("unreachable")


class Checkpoints:
    """Last saved offset of each subscription, as versioned upserts: a save appends a row, the highest version counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._files = _Files(spark, path)

    def table(self) -> DataFrame:
        """subscription_id, offset."""
        rows = []
        for name in self._files.names():
            if name.startswith("id="):
                versions = [n for n in self._files.names(name) if n.isdigit()]
                if versions:
                    rows.append((bytes.fromhex(name[3:]).decode(), self._files.read(name, max(versions))))
        return self.spark.createDataFrame(rows, "subscription_id string, offset string")

    def save(self, subscription_id: str, offset: str, log: EventLog | None = None) -> str:
        """Save an offset; the newest is saved as the log's tail."""
        if offset == NEWEST:
            if log is None:
                raise OffsetError("the newest offset needs a log to resolve it")
            offset = log.tail()
        if offset != OLDEST:
            offset = format_offset(parse_offset(offset))
        name = f"id={subscription_id.encode().hex()}"
        while True:
            versions = [int(n) for n in self._files.names(name) if n.isdigit()]
            if self._files.put(offset, name, f"{max(versions, default=0) + 1:020d}"):
                for old in sorted(versions)[:-1]:
                    self._files.delete(name, f"{old:020d}")
                return offset

    def lookup(self, subscription_id: str) -> tuple[str, bool]:
        """Saved offset and whether there is one: a missing checkpoint is not one at the start."""
        name = f"id={subscription_id.encode().hex()}"
        versions = [n for n in self._files.names(name) if n.isdigit()]
        if not versions:
            return OLDEST, False
        offset = self._files.read(name, max(versions))
        if offset == NEWEST:
            raise OffsetError(f"checkpoint of {subscription_id!r} is not concrete")
        return offset, True

    def load(self, subscription_id: str) -> str:
        return self.lookup(subscription_id)[0]


class Snapshots:
    """State snapshots: by id the latest (offset, blob)."""

    def __init__(self, spark: SparkSession, path: str):
        self._files = _Files(spark, path)

    def save(self, snapshot_id: str, offset: str, blob: str) -> None:
        name = f"id={snapshot_id.encode().hex()}"
        while True:
            versions = [int(n) for n in self._files.names(name) if n.isdigit()]
            if self._files.put(json.dumps({"offset": offset, "blob": blob}), name, f"{max(versions, default=0) + 1:020d}"):
                return

    def load(self, snapshot_id: str) -> tuple[str, str | None]:
        """Offset and blob; the start and None where there is none."""
        name = f"id={snapshot_id.encode().hex()}"
        versions = [n for n in self._files.names(name) if n.isdigit()]
        if not versions:
            return OLDEST, None
        got = json.loads(self._files.read(name, max(versions)))
        return got["offset"], got["blob"]
