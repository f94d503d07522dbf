"""The finished model: frozen, validated, and the same JSON every time."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, field
from functools import cached_property
from typing import Any

from sedge.errors import SedgeError, TranslationError
from sedge.model.conventions import plural

VERSION = 1


@dataclass(frozen=True)
class Property:
    name: str
    column: str
    type: str = "unknown"
    nullable: bool = False
    max_length: int | None = None
    default: Any = None
    default_sql: str | None = None
    token: bool = False
    generated: str = "never"
    conversion: str | None = None
    comment: str | None = None


@dataclass(frozen=True)
class Index:
    name: str
    properties: tuple[str, ...]
    unique: bool = False


@dataclass(frozen=True)
class Navigation:
    name: str
    target: str
    many: bool
    foreign_key: tuple[str, ...] = ()
    principal_key: tuple[str, ...] = ()
    inverse: str | None = None
    on_delete: str = "cascade"
    owned: bool = False
    through: str | None = None
    #: A one-to-one seen from the side without the foreign key: foreign_key then names own properties, principal_key the target's.
    principal: bool = False


@dataclass(frozen=True)
class Discriminator:
    column: str
    value: str
    property: str | None = None


@dataclass(frozen=True)
class Entity:
    name: str
    table: str
    namespace: str | None = None
    key: tuple[str, ...] = ()
    properties: tuple[Property, ...] = ()
    navigations: tuple[Navigation, ...] = ()
    indexes: tuple[Index, ...] = ()
    query_filter: Any = None
    seed: tuple = ()
    discriminator: Discriminator | None = None
    owned: bool = False

    @cached_property
    def by_name(self) -> dict[str, Property]:
        return {p.name: p for p in self.properties}

    @cached_property
    def navs(self) -> dict[str, Navigation]:
        return {n.name: n for n in self.navigations}

    def column(self, name: str) -> str:
        """A property's column; a name the model does not know is a column itself."""
        return self.by_name[name].column if name in self.by_name else name


@dataclass(frozen=True)
class Snapshot:
    entities: tuple[Entity, ...] = ()
    version: int = field(default=VERSION)

    @cached_property
    def by_name(self) -> dict[str, Entity]:
        return {e.name: e for e in self.entities}

    def entity(self, name: str) -> Entity:
        """An entity; one that was never declared has the plural as its table and the key id."""
        return self.by_name.get(name) or Entity(name, plural(name), key=("id",))

    def nav(self, entity: Entity, name: str) -> Navigation:
        if name not in entity.navs:
            raise TranslationError(f"'{entity.name}' has no navigation '{name}'")
        return entity.navs[name]

    def to_json(self) -> str:
        return json.dumps(_plain({"version": self.version, "entities": [asdict(e) for e in self.entities]}), sort_keys=True, indent=2, ensure_ascii=False) + "\n"

    @classmethod
    def from_json(cls, text: str) -> Snapshot:
        data = json.loads(text)
        if data.get("version") != VERSION:
            raise SedgeError(f"snapshot version {data.get('version')} is not {VERSION}")
        many = lambda kind, rows: tuple(kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in r.items()}) for r in rows)
        out = []
        for e in data["entities"]:
            e = dict(e)
            e |= {"key": tuple(e["key"]), "properties": many(Property, e["properties"]), "navigations": many(Navigation, e["navigations"]), "indexes": many(Index, e["indexes"]), "seed": tuple(e["seed"])}
            e["discriminator"] = Discriminator(**e["discriminator"]) if e["discriminator"] else None
            out.append(Entity(**e))
        return cls(tuple(out))


def _plain(x):
    if isinstance(x, dict):
        return {k: _plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [_plain(v) for v in x]
    if isinstance(x, float) and not math.isfinite(x):
        raise SedgeError("a model cannot hold numbers that are not finite")
    if x is None or isinstance(x, (str, int, float, bool)):
        return x
    raise SedgeError(f"a model cannot hold {x!r}")
