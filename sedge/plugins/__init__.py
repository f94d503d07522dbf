"""Plugins: additions to the model, to every read and to every save."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from typing import TYPE_CHECKING

from sedge.errors import SedgeError
from sedge.functions import expr as X
from sedge.model.snapshot import Entity
from sedge.tracking import Entry, State

if TYPE_CHECKING:
    from sedge.model.build import ModelConfig
    from sedge.workspace import Workspace


class Plugin:
    """What a plugin may do; each method is optional."""

    #: Whether condition() also limits the rows that updates and deletions may touch.
    binds_writes = False

    def configure_model(self, model: ModelConfig) -> None:
        """Adds to the model before it is finished."""

    def condition(self, entity: Entity):
        """A condition node that every read of the entity carries, or None; asked anew for each query."""

    def saving(self, workspace: Workspace, entries: list[Entry]) -> None:
        """Sees, and may change, what a save is about to write."""

    def saved(self, workspace: Workspace, entries: list[Entry]) -> None:
        """Told after a save."""


class SoftDelete(Plugin):
    """Deleting marks rows; reads leave out rows unless the mark is false.  A model's own filters stay in force."""

    def __init__(self, property: str = "isDeleted", entities: list[str] | None = None):
        self.property, self.entities = property, entities

    def _has(self, entity: Entity) -> bool:
        return not entity.owned and (entity.name in self.entities if self.entities is not None else self.property in entity.by_name)

    def configure_model(self, model: ModelConfig) -> None:
        for e in list(model.entities.values()):
            if self.entities is None and not e.owned or self.entities is not None and e.name in self.entities:
                p = e.property(self.property)
                p.said.setdefault("type", "boolean")
                if "default" not in p.said:
                    p.default(False)

    def condition(self, entity: Entity):
        return X.Compare("eq", X.Field((self.property,)), X.Literal(False)) if self._has(entity) else None

    def saving(self, workspace: Workspace, entries: list[Entry]) -> None:
        for e in entries:
            if e.state == State.DELETED and self._has(e.entity):
                setattr(e.item, self.property, True)
                e.state = State.MODIFIED
            elif e.state == State.ADDED and self._has(e.entity) and getattr(e.item, self.property, None) is None:
                setattr(e.item, self.property, False)


class Timestamps(Plugin):
    """Stamps on insert and update, by a clock that can be given."""

    def __init__(self, created: str = "createdAt", updated: str = "updatedAt", clock: Callable[[], dt.datetime] | None = None):
        self.created, self.updated = created, updated
        self.clock = clock or (lambda: dt.datetime.now(dt.UTC).replace(tzinfo=None))

    def configure_model(self, model: ModelConfig) -> None:
        for e in list(model.entities.values()):
            for name in (self.created, self.updated):
                if not e.owned:
                    e.property(name).said.setdefault("type", "timestamp")

    def saving(self, workspace: Workspace, entries: list[Entry]) -> None:
        now = self.clock()
        for e in entries:
            if e.state == State.ADDED and self.created in e.entity.by_name:
                setattr(e.item, self.created, now)
            if e.state in (State.ADDED, State.MODIFIED) and self.updated in e.entity.by_name:
                setattr(e.item, self.updated, now)


class Tenancy(Plugin):
    """Every read, update and deletion sees one tenant's rows; inserts are stamped.  The tenant is asked for each time."""

    binds_writes = True

    def __init__(self, tenant: Callable[[], object], property: str = "tenantId"):
        self.tenant, self.property = tenant, property

    def configure_model(self, model: ModelConfig) -> None:
        for e in list(model.entities.values()):
            if not e.owned:
                e.property(self.property).said.setdefault("type", "string")

    def condition(self, entity: Entity):
        return X.Compare("eq", X.Field((self.property,)), X.Literal(self.tenant())) if self.property in entity.by_name else None

    def saving(self, workspace: Workspace, entries: list[Entry]) -> None:
        for e in entries:
            if self.property not in e.entity.by_name:
                continue
            if e.state == State.ADDED:
                setattr(e.item, self.property, self.tenant())
            elif e.state in (State.MODIFIED, State.DELETED) and getattr(e.item, self.property, None) != self.tenant():
                raise SedgeError(f"a {e.entity.name} of another tenant")
