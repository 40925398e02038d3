"""Where a materializer keeps its state, and what it and a bus ask of stores of other kinds."""

from __future__ import annotations

import json
import uuid
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

from logtide.sources.log import _Files

STATE_SCHEMA = "entity_type string, key string, composite_key string, value string, position long"


class EventStore(Protocol):
    """What ``Bus`` needs of a log; ``EventLog`` is one.  ``follow`` takes an ``EventLog``, as it streams its manifest."""

    spark: SparkSession

    def append(self, events: DataFrame) -> tuple[int, int]:
        """Store rows in order; first and last position.  Raises if they were not stored."""

    def replay(self, callback, offset: str = "", batch_rows: int = 0) -> str:
        """Call back with every row after ``offset`` in order; the last offset passed."""


class StateStore(Protocol):
    """Holds one state, a frame of ``STATE_SCHEMA``.  A call that raises must leave the state before it in place."""

    def load(self) -> DataFrame:
        """The state; empty where there is none."""

    def replace(self, state: DataFrame) -> DataFrame:
        """Keep a new state, which may be derived from the one held, and return it as it is kept."""


class ParquetStates:
    """A state as Parquet under a folder that executors share.

    A state is written whole before a pointer names it, so a failure leaves the one
    before.  That one's files stay until the next replacement: frames drawn from a state
    can be read until the state after it has been replaced.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._files = _Files(spark, path)

    def _versions(self) -> list[str]:
        return sorted(n for n in self._files.names("current") if n.isdigit())

    def load(self) -> DataFrame:
        versions = self._versions()
        if not versions:
            return self.spark.createDataFrame([], STATE_SCHEMA)
        return self._read(json.loads(self._files.read("current", versions[-1]))["folder"])

    def _read(self, folder: str) -> DataFrame:
        return self.spark.read.schema(STATE_SCHEMA).parquet(f"{self.path}/data/{folder}")

    def replace(self, state: DataFrame) -> DataFrame:
        versions, folder = self._versions(), uuid.uuid4().hex
        state.write.parquet(f"{self.path}/data/{folder}")
        number = int(versions[-1]) + 1 if versions else 1
        if not self._files.put(json.dumps({"folder": folder}), "current", f"{number:020d}"):
            self._files.delete("data", folder)
            raise RuntimeError(f"another writer has replaced the state under {self.path}")
        for old in versions[:-1]:
            self._files.delete("data", json.loads(self._files.read("current", old))["folder"])
            self._files.delete("current", old)
        return self._read(folder)
