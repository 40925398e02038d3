"""Durable names and schemas of event types, one to one, and ownership of subscription ids."""

from __future__ import annotations

import threading
from dataclasses import dataclass

from pyspark.sql import types as T


class RegistryError(ValueError):
    """A name, schema or id that is already taken, or a type that cannot be registered."""


@dataclass(frozen=True)
class EventType:
    """A registered type: durable name, JSON schema, and whether missing fields take zero values."""

    name: str
    schema: T.StructType
    zero_fill: bool = True


class TypeRegistry:
    """Two-way unique map of durable names and owners (Python types or any hashable).

    A claim made with ``reserve`` blocks others but is not visible until
    ``commit``; ``rollback`` gives it up.
    """

    def __init__(self):
        self._lock = threading.RLock()
        self._types: dict[str, EventType] = {}
        self._owner: dict[str, object] = {}
        self._name: dict[object, str] = {}
        self._pending: dict[str, int] = {}
        self._subscriptions: set[str] = set()

    def reserve(self, name: str, owner: object) -> None:
        if not name:
            raise RegistryError("an event type needs a name")
        if isinstance(owner, type) and getattr(owner, "__abstractmethods__", None):
            raise RegistryError(f"{owner.__name__} is abstract; register concrete types")
        with self._lock:
            if self._owner.get(name, owner) != owner:
                raise RegistryError(f"type name {name!r} is taken")
            if self._name.get(owner, name) != name:
                raise RegistryError(f"the type of {name!r} is already named {self._name[owner]!r}")
            self._owner[name], self._name[owner] = owner, name
            self._pending[name] = self._pending.get(name, 0) + 1

    def commit(self, event_type: EventType) -> EventType:
        with self._lock:
            known = self._types.get(event_type.name)
            if known is not None and known != event_type:
                raise RegistryError(f"type {event_type.name!r} has another schema")
            self._types[event_type.name] = event_type
            self._pending.pop(event_type.name, None)
            return event_type

    def rollback(self, name: str) -> None:
        with self._lock:
            left = self._pending.get(name, 0) - 1
            if left > 0:
                self._pending[name] = left
            elif name in self._pending:
                del self._pending[name]
                if name not in self._types:
                    self._name.pop(self._owner.pop(name), None)

    def register(self, name: str, schema: T.StructType | str, owner: object = None, zero_fill: bool = True) -> EventType:
        parsed = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        if not isinstance(parsed, T.StructType):
            raise RegistryError("an event type needs a struct schema")
        self.reserve(name, name if owner is None else owner)
        try:
            return self.commit(EventType(name, parsed, zero_fill))
        except RegistryError:
            self.rollback(name)
            raise

    def get(self, name: str) -> EventType:
        try:
            return self._types[name]
        except KeyError:
            raise RegistryError(f"type {name!r} is not registered") from None

    def name_of(self, owner: object) -> str:
        """Durable name of an event's owner; "nil" for none."""
        if owner is None:
            return "nil"
        return self._name.get(owner) or getattr(owner, "__name__", str(owner))

    def names(self) -> list[str]:
        return sorted(self._types)

    def own(self, subscription_id: str) -> None:
        """Claim a subscription id for one live subscription."""
        with self._lock:
            if not subscription_id:
                raise RegistryError("a subscription needs an id")
            if subscription_id in self._subscriptions:
                raise RegistryError(f"subscription {subscription_id!r} is already active")
            self._subscriptions.add(subscription_id)

    def release(self, subscription_id: str) -> None:
        with self._lock:
            self._subscriptions.discard(subscription_id)
