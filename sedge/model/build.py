"""Describing a model: fluent builders that only record, and the finishing pass that fills gaps and collects every fault."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from sedge.errors import ModelError
from sedge.functions.expr import record, record_path, to_json
from sedge.model.conventions import camel, capital, find_key, foreign_key_names, plural, type_of
from sedge.model.snapshot import Discriminator, Entity, Index, Navigation, Property, Snapshot

#: What each fault code means.
TITLES = {
    "SE1201": "Entity has no key",
    "SE1202": "Key property has the name of a navigation",
    "SE1203": "Entity declared more than once",
    "SE1204": "Two entities on one table",
    "SE1205": "Two properties on one column",
    "SE1206": "Length is not a positive integer",
    "SE1207": "Foreign key and principal key differ in length",
    "SE1208": "Foreign key cannot be resolved",
    "SE1209": "Discriminator value used twice",
    "SE1210": "Composite key names a property twice",
    "SE1211": "Seed row lacks a key value",
    "SE1212": "Seed row names an unknown property",
    "SE1213": "Index names an unknown property",
    "SE1214": "Index without properties",
    "SE1215": "Converter without a name",
    "SE1216": "Owned type with a key of its own",
    "SE1217": "Column without a name",
    "SE1218": "Key property as concurrency token",
    "SE1219": "Table without a name",
    "SE1220": "Join entity is not in the model",
    "SE1221": "Navigation has the name of a property",
    "SE1222": "Discriminator without a value",
    "SE1223": "Default value and default SQL together",
}


@dataclass(frozen=True)
class Diagnostic:
    code: str
    message: str
    entity: str | None = None
    member: str | None = None


def entity_name(x) -> str:
    return x if isinstance(x, str) else x.__name__


class PropertyConfig:
    """One property; every method returns the same object."""

    def __init__(self) -> None:
        self.said: dict[str, Any] = {}

    def _say(self, **kw) -> PropertyConfig:
        self.said |= kw
        return self

    def column(self, name: str) -> PropertyConfig:
        return self._say(column=name)

    def max_length(self, n: int) -> PropertyConfig:
        return self._say(max_length=n)

    def of_type(self, tag: str) -> PropertyConfig:
        """string, number, boolean, timestamp, bigint, or a Spark type such as double or decimal(12,2)."""
        return self._say(type=tag)

    def required(self, yes: bool = True) -> PropertyConfig:
        return self._say(nullable=not yes)

    def default(self, value) -> PropertyConfig:
        return self._say(default=value, has_default=True)

    def default_sql(self, text: str) -> PropertyConfig:
        return self._say(default_sql=text)

    def convert(self, name: str) -> PropertyConfig:
        return self._say(conversion=name)

    def concurrency_token(self) -> PropertyConfig:
        return self._say(token=True)

    def generated(self, when: str) -> PropertyConfig:
        """on_add, on_update or never."""
        return self._say(generated=when)

    def comment(self, text: str) -> PropertyConfig:
        return self._say(comment=text)


class NavConfig:
    """One navigation."""

    def __init__(self, name: str, target: str, many: bool, owned: bool = False):
        self.name, self.target, self.many, self.owned = name, target, many, owned
        self.inverse: str | None = None
        self.inverse_many: bool | None = None
        self.through: str | None = None
        self.fk: tuple[str, ...] = ()
        self.pk: tuple[str, ...] = ()
        self.behaviour: str | None = None
        self.is_required: bool | None = None

    def with_many(self, inverse=None, through=None) -> NavConfig:
        self.inverse, self.inverse_many = _member(inverse), True
        self.through = entity_name(through) if through else None
        return self

    def with_one(self, inverse=None) -> NavConfig:
        self.inverse, self.inverse_many = _member(inverse), False
        return self

    def foreign_key(self, *names) -> NavConfig:
        self.fk = tuple(map(_member, names))
        return self

    def principal_key(self, *names) -> NavConfig:
        self.pk = tuple(map(_member, names))
        return self

    def on_delete(self, behaviour: str) -> NavConfig:
        """cascade, set_null, restrict or no_action."""
        self.behaviour = behaviour
        return self

    def required(self, yes: bool = True) -> NavConfig:
        self.is_required = yes
        return self


class IndexConfig:
    def __init__(self, properties: tuple[str, ...]):
        self.properties, self.is_unique, self.said_name = properties, False, None

    def unique(self) -> IndexConfig:
        self.is_unique = True
        return self

    def named(self, name: str) -> IndexConfig:
        self.said_name = name
        return self


def _member(selector) -> str | None:
    return None if selector is None else ".".join(record_path(selector))


class EntityConfig:
    """One entity; selectors are names or lambdas."""

    def __init__(self, name: str):
        self.name = name
        self.said_table: str | None = None
        self.namespace: str | None = None
        self.said_key: tuple[str, ...] | None = None
        self.properties: dict[str, PropertyConfig] = {}
        self.navs: list[NavConfig] = []
        self.indexes: list[IndexConfig] = []
        self.filter: Any = None
        self.seed: list = []
        self.disc: dict | None = None
        self.owned = False

    def table(self, name: str, namespace: str | None = None) -> EntityConfig:
        self.said_table, self.namespace = name, namespace
        return self

    def key(self, *selectors) -> EntityConfig:
        self.said_key = tuple(map(_member, selectors))
        return self

    def property(self, selector) -> PropertyConfig:
        return self.properties.setdefault(_member(selector), PropertyConfig())

    def index(self, *selectors) -> IndexConfig:
        self.indexes.append(IndexConfig(tuple(map(_member, selectors))))
        return self.indexes[-1]

    def query_filter(self, predicate: Callable) -> EntityConfig:
        """A condition that every read of this entity carries; a further one replaces it."""
        self.filter = record(predicate)
        return self

    def data(self, *rows: dict) -> EntityConfig:
        self.seed += rows
        return self

    def discriminator(self, column: str, value: str | None = None, property: str | None = None) -> EntityConfig:
        self.disc = {"column": column, "value": value, "property": property}
        return self

    def _nav(self, selector, target, many: bool, owned: bool = False) -> NavConfig:
        self.navs.append(NavConfig(_member(selector), entity_name(target), many, owned))
        return self.navs[-1]

    def has_one(self, selector, target) -> NavConfig:
        return self._nav(selector, target, False)

    def has_many(self, selector, target) -> NavConfig:
        return self._nav(selector, target, True)

    def owns_one(self, selector, target) -> NavConfig:
        return self._nav(selector, target, False, True)

    def owns_many(self, selector, target) -> NavConfig:
        return self._nav(selector, target, True, True)


class ModelConfig:
    """The whole description.  entity() declares, configure() adds to what may be declared already."""

    def __init__(self) -> None:
        self.entities: dict[str, EntityConfig] = {}
        self.repeated: list[str] = []

    def entity(self, name) -> EntityConfig:
        name = entity_name(name)
        if name in self.entities:
            self.repeated.append(name)
        return self.entities.setdefault(name, EntityConfig(name))

    def configure(self, name) -> EntityConfig:
        return self.entities.setdefault(entity_name(name), EntityConfig(entity_name(name)))

    def finish(self) -> Snapshot:
        """The finished model; raises ModelError with all faults at once."""
        model, faults = _Finish(self).run()
        if faults:
            raise ModelError(faults)
        return model


@dataclass
class _Draft:
    """An entity on its way."""

    said: EntityConfig
    table: str = ""
    prefix: str = ""
    key: list[str] = field(default_factory=list)
    known: dict[str, None] = field(default_factory=dict)
    navs: list[Navigation] = field(default_factory=list)
    loose: set[str] = field(default_factory=set)

    @property
    def name(self) -> str:
        return self.said.name


class _Finish:
    def __init__(self, said: ModelConfig):
        self.said, self.faults = said, []
        self.drafts = {n: _Draft(e) for n, e in said.entities.items()}

    def fault(self, code: str, message: str, entity: str, member: str | None = None) -> None:
        self.faults.append(Diagnostic(code, f"{TITLES[code]}: {message}", entity, member))

    def run(self) -> tuple[Snapshot, list[Diagnostic]]:
        for n in self.said.repeated:
            self.fault("SE1203", n, n)
        inside = self._tables()
        for d in self.drafts.values():
            names = [*d.said.properties, *(d.said.said_key or ())]
            if d.said.disc and d.said.disc["property"]:
                names.append(d.said.disc["property"])
            d.known |= dict.fromkeys(names)
        for d in self.drafts.values():
            self._key(d)
        for d in self.drafts.values():
            for nav in d.said.navs:
                self._nav(d, nav)
        done = [self._entity(d) for d in self.drafts.values()]
        self._shared_tables(inside)
        return Snapshot(tuple(sorted(done, key=lambda e: e.name))), self.faults

    def _tables(self) -> set[str]:
        """Table names; a type owned as one lives in its owner's table.  Gives the names of such types."""
        inside = {v.target: (d, v) for d in self.drafts.values() for v in d.said.navs if v.owned and not v.many}
        for d in self.drafts.values():
            d.said.owned = d.said.owned or any(v.owned and v.target == d.name for o in self.drafts.values() for v in o.said.navs)
            if d.name not in inside:
                d.table = plural(d.name) if d.said.said_table is None else d.said.said_table
                if d.said.said_table == "":
                    self.fault("SE1219", d.name, d.name)
        for name, (owner, nav) in inside.items():
            if name in self.drafts:
                d = self.drafts[name]
                d.table, d.said.namespace, d.prefix = owner.table, owner.said.namespace, f"{nav.name}_"
        return set(inside)

    def _key(self, d: _Draft) -> None:
        said = d.said.said_key
        if said is not None:
            if len(set(said)) < len(said):
                self.fault("SE1210", ", ".join(said), d.name)
            for k in said:
                if k in {v.name for v in d.said.navs}:
                    self.fault("SE1202", k, d.name, k)
            if d.said.owned and said:
                self.fault("SE1216", d.name, d.name)
            d.key = list(said)
        elif not d.said.owned:
            found = find_key(d.name, list(d.known))
            if found is None:
                self.fault("SE1201", f"{d.name}; give it key(...) or a property id or {camel(d.name)}Id", d.name)
            d.key = [found] if found else []
        d.known |= dict.fromkeys(d.key)

    def _nav(self, d: _Draft, v: NavConfig) -> None:
        other = self.drafts.get(v.target)
        behaviour = v.behaviour or ("set_null" if v.is_required is False else "cascade")
        make = lambda **kw: Navigation(v.name, v.target, v.many, inverse=v.inverse, on_delete=behaviour, owned=v.owned, through=v.through, **kw)
        if v.owned:
            if v.many and other:
                fk = camel(d.name) + capital(d.key[0] if d.key else "id")
                other.known[fk] = None
                d.navs.append(make(foreign_key=(fk,), principal_key=tuple(d.key)))
            else:
                d.navs.append(make(principal_key=tuple(other.key) if other else ()))
            return
        if v.many and v.inverse_many:
            if v.through and v.through not in self.drafts:
                self.fault("SE1220", f"{v.through} for {d.name}.{v.name}", d.name, v.name)
            d.navs.append(make(principal_key=tuple(d.key)))
            if other and v.inverse:
                other.navs.append(Navigation(v.inverse, d.name, True, (), tuple(other.key), v.name, behaviour, False, v.through))
            return
        # one side holds the key: this one for a to-one navigation, the other for a to-many one
        holder, principal = (other, d) if v.many else (d, other)
        pk = list(v.pk) or (principal.key if principal else [])
        fk = self._foreign_key(v, v.inverse or camel(d.name) if v.many else v.name, holder, d.name if v.many else v.target, pk, d) if holder else []
        if holder:
            holder.known |= dict.fromkeys(fk)
            if v.is_required is False:
                holder.loose |= set(fk)
        d.navs.append(make(foreign_key=tuple(fk), principal_key=tuple(pk)))
        if other and v.inverse:
            back = not v.many and v.inverse_many is not False
            one = not v.many and not back
            other.navs.append(Navigation(v.inverse, d.name, back, tuple(pk if one else fk), tuple(fk if one else pk), v.name, behaviour, principal=one))

    def _foreign_key(self, v: NavConfig, stem: str, holder: _Draft, principal: str, pk: list[str], at: _Draft) -> list[str]:
        if v.fk:
            if pk and len(v.fk) != len(pk):
                self.fault("SE1207", f"{holder.name}.{v.name}: {len(v.fk)} and {len(pk)} columns", holder.name, v.name)
            return list(v.fk)
        if not pk:
            self.fault("SE1208", f"{at.name}.{v.name}: {principal} has no key", at.name, v.name)
            return []
        names = foreign_key_names(stem, principal, pk[0])
        first = next((n for n in names if n in holder.known), names[0])
        return [first, *(camel(principal) + capital(k) for k in pk[1:])]

    def _entity(self, d: _Draft) -> Entity:
        said, where = d.said, d.name
        props = [self._property(d, n) for n in d.known]
        by_column = defaultdict(list)
        for p in props:
            by_column[p.column].append(p.name)
        for column, names in by_column.items():
            if len(names) > 1:
                self.fault("SE1205", f"{', '.join(names)} on {column}", where)
        for nav in d.navs:
            if nav.name in said.properties:
                self.fault("SE1221", f"{where}.{nav.name}", where, nav.name)
        indexes = []
        for i in said.indexes:
            if not i.properties:
                self.fault("SE1214", where, where)
                continue
            for p in i.properties:
                if p not in d.known:
                    self.fault("SE1213", f"{where}.{p}", where, p)
            indexes.append(Index(i.said_name or f"IX_{d.table}_{'_'.join(i.properties)}", i.properties, i.is_unique))
        for row in said.seed:
            if not isinstance(row, dict):
                self.fault("SE1212", f"{where}: {row!r} is no mapping", where)
                continue
            for k in row:
                if k not in d.known:
                    self.fault("SE1212", f"{where}.{k}", where, k)
            for k in d.key:
                if k not in row:
                    self.fault("SE1211", f"{where}.{k}", where, k)
        disc = None
        if said.disc:
            if said.disc["value"] is None:
                self.fault("SE1222", where, where)
            disc = Discriminator(said.disc["column"], said.disc["value"] or "", said.disc["property"])
        by = lambda xs: tuple(sorted(xs, key=lambda x: x.name))
        stored = None if said.filter is None else to_json(said.filter)
        return Entity(where, d.table, said.namespace, tuple(d.key), by(props), by(d.navs), by(indexes), stored, tuple(r for r in said.seed if isinstance(r, dict)), disc, said.owned)

    def _property(self, d: _Draft, name: str) -> Property:
        said = d.said.properties[name].said if name in d.said.properties else {}
        where, is_key = f"{d.name}.{name}", name in d.key
        length = said.get("max_length")
        for bad, code in (
            (said.get("column") == "", "SE1217"),
            (length is not None and (not isinstance(length, int) or isinstance(length, bool) or length <= 0), "SE1206"),
            (said.get("conversion") == "", "SE1215"),
            (said.get("token") and is_key, "SE1218"),
            (said.get("has_default") and said.get("default_sql") is not None, "SE1223"),
        ):
            if bad:
                self.fault(code, where, d.name, name)
        kind = type_of(said.get("type"), length, said.get("default"))
        counted = is_key and len(d.key) == 1 and kind in ("number", "bigint", "unknown")
        return Property(
            name, d.prefix + said.get("column", name), kind, not is_key and said.get("nullable", name in d.loose), length,
            said.get("default"), said.get("default_sql"), bool(said.get("token")), said.get("generated", "on_add" if counted else "never"), said.get("conversion"), said.get("comment"),
        )

    def _shared_tables(self, inside: set[str]) -> None:
        groups = defaultdict(list)
        for d in self.drafts.values():
            if d.name not in inside:
                groups[d.said.namespace, d.table].append(d)
        for (_, table), group in groups.items():
            if len(group) < 2:
                continue
            values = [d.said.disc["value"] if d.said.disc else None for d in group]
            if not all(values):
                self.fault("SE1204", f"{', '.join(d.name for d in group)} on {table}", group[0].name)
            for value, n in Counter(v for v in values if v).items():
                if n > 1 and all(values):
                    self.fault("SE1209", f"'{value}' on {table}", group[-1].name)


def with_filter(entity: Entity, node) -> Entity:
    """The entity with another query filter."""
    return replace(entity, query_filter=None if node is None else to_json(node))
