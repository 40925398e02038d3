"""What a bus tells about itself: a listener interface, and a recorder whose rows feed ``operators.metrics``."""

from __future__ import annotations

import json
import threading
from collections import deque
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

SPAN_SCHEMA = "span long, parent long, kind string, type string, async boolean, millis double, offset string, error string, attributes string"
PUBLISH, HANDLE, PERSIST = "publish", "handle", "persist"


class Listener:
    """Called around publishing, storing and handling.  What a ``started`` method returns goes to its ``ended``, and to what happens within."""

    def publish_started(self, name: str, event: dict) -> Any:
        return None

    def publish_ended(self, context: Any, name: str) -> None:
        """All synchronous handlers have run; asynchronous ones may not."""

    def handler_started(self, context: Any, name: str, is_async: bool) -> Any:
        return context

    def handler_ended(self, context: Any, name: str, millis: float, error: Exception | None) -> None: ...

    def persist_started(self, context: Any, name: str) -> Any:
        return context

    def persist_ended(self, context: Any, name: str, millis: float, offset: str, error: Exception | None) -> None:
        """``offset`` is empty where storing failed."""


class Recorder(Listener):
    """Keeps the last ``limit`` spans as rows; ``attributes`` gives a type's span attributes from its payload.

    Rows of kind ``handle`` and ``persist`` carry fractional milliseconds, an error or
    null, and the span of the publication they belong to.
    """

    def __init__(self, attributes: dict[str, Callable[[dict], dict]] | None = None, limit: int = 100_000):
        self._attributes = attributes or {}
        self._rows: deque[tuple] = deque(maxlen=limit)
        self._lock = threading.Lock()
        self._last = 0

    def _next(self) -> int:
        with self._lock:
            self._last += 1
            return self._last

    def _keep(self, *row) -> None:
        with self._lock:
            self._rows.append(row)

    def publish_started(self, name, event):
        give = self._attributes.get(name)
        return {"span": self._next(), "attributes": json.dumps(give(event)) if give else None}

    def publish_ended(self, context, name):
        self._keep(context["span"], None, PUBLISH, name, False, None, None, None, context["attributes"])

    def handler_started(self, context, name, is_async):
        return {"span": self._next(), "parent": context and context["span"], "async": is_async}

    def handler_ended(self, context, name, millis, error):
        self._keep(context["span"], context["parent"], HANDLE, name, context["async"], millis, None, None if error is None else str(error), None)

    def persist_started(self, context, name):
        return {"span": self._next(), "parent": context and context["span"]}

    def persist_ended(self, context, name, millis, offset, error):
        self._keep(context["span"], context["parent"], PERSIST, name, False, millis, offset or None, None if error is None else str(error), None)

    def spans(self, spark: SparkSession) -> DataFrame:
        with self._lock:
            rows = list(self._rows)
        return spark.createDataFrame(rows, SPAN_SCHEMA)
