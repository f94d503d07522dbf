"""Change tracking of materialised rows: states, identity, what to save and in which order."""

from __future__ import annotations

import datetime as dt
import json
from dataclasses import dataclass, field
from enum import Enum
from typing import Any

from sedge.errors import SedgeError
from sedge.model.converters import Converters
from sedge.model.snapshot import Entity, Snapshot


class State(Enum):
    DETACHED = "detached"
    ADDED = "added"
    UNCHANGED = "unchanged"
    MODIFIED = "modified"
    DELETED = "deleted"


def _mark(x) -> str:
    return json.dumps(x, sort_keys=True, default=lambda v: v.isoformat() if isinstance(v, (dt.date, dt.datetime)) else str(v))


def owned_columns(model: Snapshot, entity: Entity) -> dict[str, tuple[str, str]]:
    """Column -> (navigation, property) of the types owned as one."""
    return {p.column: (n.name, p.name) for n in entity.navigations if n.owned and not n.many for p in model.entity(n.target).properties}


@dataclass
class Entry:
    """One tracked object."""

    item: Any
    entity: Entity
    tracker: Tracker
    state: State = State.DETACHED
    original: dict[str, Any] = field(default_factory=dict)

    def values(self) -> dict[str, Any]:
        """Column values as they are stored now."""
        e, t = self.entity, self.tracker
        names = e.by_name or {k: None for k in vars(self.item) if not k.startswith("_")}
        out = {}
        for n in names:
            x = getattr(self.item, n, None)
            p = e.by_name.get(n)
            out[e.column(n)] = t.converters.stored(p.conversion if p else None, x)
        for column, (nav, prop) in owned_columns(t.model, e).items():
            inside = getattr(self.item, nav, None)
            x = inside.get(prop) if isinstance(inside, dict) else getattr(inside, prop, None)
            p = t.model.entity(e.navs[nav].target).by_name[prop]
            out[column] = t.converters.stored(p.conversion, x)
        if e.discriminator:
            out[e.discriminator.column] = e.discriminator.value
        return out

    def current_values(self) -> dict[str, Any]:
        return {n: getattr(self.item, n, None) for n in self.entity.by_name}

    def modified_properties(self) -> list[str]:
        now = self.values()
        by_column = {p.column: p.name for p in self.entity.properties}
        return sorted(by_column.get(c, c) for c in now if _mark(now[c]) != _mark(self.original.get(c)))

    def key(self) -> tuple:
        return tuple(getattr(self.item, k, None) for k in self.entity.key)


class Tracker:
    """The identity map: one object for each entity and key.  An entity without a key is never tracked."""

    def __init__(self, model: Snapshot, converters: Converters):
        self.model, self.converters = model, converters
        self.entries: dict[int, Entry] = {}
        self.by_key: dict[tuple[str, str], Entry] = {}

    def entry(self, item, entity: Entity) -> Entry:
        return self.entries.get(id(item)) or Entry(item, entity, self)

    def _at(self, e: Entry) -> tuple[str, str] | None:
        return (e.entity.name, _mark(e.key())) if e.entity.key and None not in e.key() else None

    def find(self, entity: Entity, key: tuple) -> Entry | None:
        return self.by_key.get((entity.name, _mark(key)))

    def set(self, item, entity: Entity, state: State, original: dict | None = None) -> Entry:
        """Puts an object into a state; for an unchanged one, original may say what is stored."""
        e = self.entry(item, entity)
        at = self._at(e)
        other = self.by_key.get(at) if at else None
        if other and other.item is not item and other.state != State.DETACHED:
            raise SedgeError(f"another {entity.name} with the key {e.key()} is tracked")
        e.state = state
        if state == State.DETACHED:
            self.entries.pop(id(item), None)
            if at:
                self.by_key.pop(at, None)
            return e
        if state == State.UNCHANGED:
            e.original = e.values() if original is None else original
        self.entries[id(item)] = e
        if at:
            self.by_key[at] = e
        return e

    def detect_changes(self) -> None:
        for e in self.entries.values():
            if e.state in (State.UNCHANGED, State.MODIFIED):
                e.state = State.MODIFIED if e.modified_properties() else State.UNCHANGED

    def pending(self) -> list[Entry]:
        """Additions principals first, then changes, then deletions dependents first."""
        rank = {n: i for i, n in enumerate(self.order())}
        of = lambda s: [e for e in self.entries.values() if e.state == s]
        at = lambda e: rank.get(e.entity.name, 0)
        return [*sorted(of(State.ADDED), key=at), *of(State.MODIFIED), *sorted(of(State.DELETED), key=lambda e: -at(e))]

    def order(self) -> list[str]:
        """Entities so that principals precede their dependents; a cycle is cut at its last link."""
        needs: dict[str, set[str]] = {e.name: set() for e in self.model.entities}
        for e in self.model.entities:
            for n in e.navigations:
                if n.owned or n.through or n.principal or not n.foreign_key:
                    continue
                dependent, principal = (n.target, e.name) if n.many else (e.name, n.target)
                if dependent != principal and dependent in needs:
                    needs[dependent].add(principal)
        out: list[str] = []
        state: dict[str, int] = {}

        def visit(name: str) -> None:
            if state.setdefault(name, 0):
                return
            state[name] = 1
            for p in sorted(needs.get(name, ())):
                visit(p)
            out.append(name)

        for name in sorted(needs):
            visit(name)
        return out

    def accept(self) -> None:
        for e in list(self.entries.values()):
            if e.state == State.DELETED:
                self.set(e.item, e.entity, State.DETACHED)
            else:
                self.set(e.item, e.entity, State.UNCHANGED)

    def snapshot(self) -> tuple:
        return {k: (e, e.state, dict(e.original)) for k, e in self.entries.items()}, dict(self.by_key)

    def restore(self, saved: tuple) -> None:
        """Back to an earlier snapshot(): after a transaction that failed."""
        entries, self.by_key = saved[0], dict(saved[1])
        self.entries = {}
        for k, (e, state, original) in entries.items():
            e.state, e.original = state, original
            self.entries[k] = e

    def clear(self) -> None:
        self.entries.clear()
        self.by_key.clear()
