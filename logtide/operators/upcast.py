"""Schema migration: registered steps from one type to its successor, flattened into one projection."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtide.functions.binding import bind, let
from logtide.operators.decode import decode_column
from logtide.operators.registry import EventType


class UpcastError(ValueError):
    """A step that cannot be registered."""


@dataclass(frozen=True)
class Step:
    source: str
    target: str
    #: From the JSON column of the source to a struct column (data: JSON of the target, error: why there is none, or null).
    apply: Callable[[Column], Column]


def _raw(fn: Callable[[str], tuple[str, str]], target: str) -> Callable[[Column], Column]:
    def both(data: pd.Series) -> pd.DataFrame:
        rows = []
        for text in data:
            try:
                new, kind = fn(text)
                rows.append((new, None) if kind == target else (None, f"upcast returned type {kind!r}, not {target!r}"))
            except Exception as e:  # noqa: BLE001  a user's function may fail in any way; the row carries why
                rows.append((None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(rows, columns=["data", "error"])

    return F.pandas_udf(both, "data string, error string")


class Upcasts:
    """A registry of steps.  Each source has one successor at most and there are no cycles."""

    def __init__(self, on_error: Callable[[DataFrame], None] | None = None):
        self._steps: dict[str, Step] = {}
        self.on_error = on_error

    def _add(self, step: Step) -> None:
        if not step.source or not step.target:
            raise UpcastError("a step needs a source and a target type")
        if step.source == step.target:
            raise UpcastError("a step must change the type")
        if step.source in self._steps:
            raise UpcastError(f"{step.source!r} already has a successor")
        seen, at = {step.source}, step.target
        while at is not None:
            if at in seen:
                raise UpcastError(f"a step from {step.source!r} to {step.target!r} would close a cycle")
            seen.add(at)
            at = self._steps[at].target if at in self._steps else None
        self._steps[step.source] = step

    def typed(self, source: EventType, target: EventType, fn: Callable[[Column], dict[str, Column]]) -> None:
        """A step on decoded payloads: ``fn`` maps the source struct to the target's fields, as columns."""
        if fn is None:
            raise UpcastError("a step needs a function")

        def migrated(decoded: Column) -> Column:
            fields = fn(decoded["value"])
            new = F.struct(*(fields[f.name].cast(f.dataType).alias(f.name) for f in target.schema.fields))
            error = F.when(decoded["poison"], F.lit(f"cannot decode {source.name}"))
            return F.struct(F.when(~decoded["poison"], F.to_json(new)).alias("data"), error.alias("error"))

        def apply(data: Column) -> Column:
            return let(decode_column(data, source), migrated)

        self._add(Step(source.name, target.name, apply))

    def expression(self, source: str, target: str, fn: Callable[[Column], Column]) -> None:
        """A step on the JSON text as a column expression."""
        if fn is None:
            raise UpcastError("a step needs a function")
        self._add(Step(source, target, lambda data: F.struct(fn(data).alias("data"), F.lit(None).cast("string").alias("error"))))

    def raw(self, source: str, target: str, fn: Callable[[str], tuple[str, str]]) -> None:
        """A step by a Python function from JSON to (JSON, type), run in Arrow batches."""
        if fn is None:
            raise UpcastError("a step needs a function")
        self._add(Step(source, target, _raw(fn, target)))

    def chain(self, source: str) -> list[Step]:
        out = []
        while source in self._steps:
            out.append(self._steps[source])
            source = out[-1].target
        return out

    def terminal(self, source: str) -> str:
        chain = self.chain(source)
        return chain[-1].target if chain else source

    def ancestors(self, target: str) -> set[str]:
        """Types whose chain passes through or ends in ``target``."""
        return {s for s in self._steps if any(step.target == target for step in self.chain(s))}

    def sources(self) -> list[str]:
        return sorted(self._steps)

    def clear(self, source: str | None = None) -> None:
        if source is None:
            self._steps.clear()
        else:
            self._steps.pop(source, None)

    def apply(self, log: DataFrame) -> DataFrame:
        """``log`` with type and data replaced by those of the end of each row's chain, and an ``upcast_error`` column.

        All types migrate together, one projection for each step of the longest chain;
        offset, id, origin, metadata and time are untouched.  A row whose chain fails
        keeps its type and data.
        """
        rows = log.withColumns({"__type": F.col("type"), "__data": F.col("data"), "upcast_error": F.lit(None).cast("string")})
        going = set(self._steps)
        for _ in range(max((len(self.chain(s)) for s in self._steps), default=0)):
            moved = F.lit(None).cast("struct<data:string,error:string>")
            for source in sorted(going):
                moved = F.when(F.col("__type") == source, self._steps[source].apply(F.col("__data"))).otherwise(moved)
            target = F.create_map(*(F.lit(x) for s in sorted(going) for x in (s, self._steps[s].target)))
            ok = F.col("__moved").isNotNull() & F.col("__moved.error").isNull() & F.col("upcast_error").isNull()
            rows = self._bound(rows, moved).withColumns(
                {
                    "__type": F.when(ok, F.try_element_at(target, F.col("__type"))).otherwise(F.col("__type")),
                    "__data": F.when(ok, F.col("__moved.data")).otherwise(F.col("__data")),
                    "upcast_error": F.coalesce("upcast_error", "__moved.error"),
                }
            )
            going = {self._steps[s].target for s in going} & set(self._steps)
        ok = F.col("upcast_error").isNull()
        rows = rows.withColumns({"type": F.when(ok, F.col("__type")).otherwise(F.col("type")), "data": F.when(ok, F.col("__data")).otherwise(F.col("data"))})
        return rows.drop("__type", "__data", "__moved")

    def report(self, log: DataFrame) -> bool:
        """Hand the rows of ``log`` whose chain fails to the error handler, if one is set; whether there were any."""
        if self.on_error is None:
            return False
        failed = self.apply(log).where(F.col("upcast_error").isNotNull())
        if failed.isEmpty():
            return False
        self.on_error(failed)
        return True

    @staticmethod
    def _bound(rows: DataFrame, moved: Column) -> DataFrame:
        # Python functions cannot feed a generator; their results are kept in a column of their own anyway
        try:
            return bind(rows, "__moved", moved)
        except AnalysisException:
            return rows.withColumn("__moved", moved)

    def scan(self, log: DataFrame, target: str, prune: bool = False) -> DataFrame:
        """Upcast rows of ``target``.  With ``prune`` only the target's ancestors are read, so that failing chains of other types go unnoticed."""
        if prune:
            log = log.where(F.col("type").isin(sorted(self.ancestors(target) | {target})))
        return self.apply(log).where((F.col("type") == target) | F.col("upcast_error").isNotNull())
