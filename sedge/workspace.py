"""A workspace: one model, one set of tables, one tracker; where queries start and changes are saved."""

from __future__ import annotations

import contextlib
import warnings
from collections import Counter
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from sedge.errors import SedgeError, TranslationError
from sedge.functions import expr as X
from sedge.model.build import ModelConfig, entity_name
from sedge.model.converters import Converter, Converters
from sedge.model.snapshot import Entity, Navigation, Snapshot
from sedge.operators.query import Query, RawQuery
from sedge.operators.save import Saver
from sedge.plans.binder import Binder
from sedge.plans.spec import Include, Spec
from sedge.plugins import Plugin
from sedge.sources.tables import Tables
from sedge.tracking import Entry, State, Tracker, owned_columns

#: Explicit loads of one navigation after which a workspace warns once.
MANY_LOADS = 10


class ManyLoadsWarning(UserWarning):
    """One row's neighbours at a time: include() would load them together."""

    code = "SE2001"


class Record:
    """A row of an entity without a class."""

    def __init__(self, **values):
        self.__dict__.update(values)

    def __repr__(self) -> str:
        return f"Record({', '.join(f'{k}={v!r}' for k, v in vars(self).items())})"


class EntitySet(Query):
    """All rows of an entity, and the way into the tracker."""

    def __init__(self, workspace: Workspace, name: str, kind: type | None):
        super().__init__(workspace, Spec(name))
        self.kind = kind

    @property
    def entity(self) -> Entity:
        return self.workspace.model.entity(self.spec.entity)

    def _with(self, kind: type | None = None, cursor=None, **changes):
        out = Query(self.workspace, self.spec, self.cursor)
        return out._with(kind, cursor, **changes)

    def add(self, item) -> Any:
        self.workspace.tracker.set(item, self.entity, State.ADDED)
        return item

    def add_range(self, items) -> None:
        for x in items:
            self.add(x)

    def attach(self, item) -> Any:
        self.workspace.tracker.set(item, self.entity, State.UNCHANGED)
        return item

    def remove(self, item) -> None:
        t = self.workspace.tracker
        t.set(item, self.entity, State.DETACHED if t.entry(item, self.entity).state == State.ADDED else State.DELETED) if id(item) in t.entries else t.set(self.attach(item), self.entity, State.DELETED)

    def remove_range(self, items) -> None:
        for x in items:
            self.remove(x)

    def find(self, *key):
        """The row of a key: the tracked object if there is one, else a filtered read; None without."""
        entity = self.entity
        if len(key) != len(entity.key):
            raise TranslationError(f"the key of {entity.name} has {len(entity.key)} parts")
        e = self.workspace.tracker.find(entity, key)
        if e and e.state != State.DELETED:
            return e.item
        nodes = tuple(X.Compare("eq", X.Field((k,)), X.Literal(v)) for k, v in zip(entity.key, key, strict=True))
        return self._with(where=nodes).first_or_none()

    def from_sql(self, text: str, _frames: dict[str, DataFrame] | None = None, **args) -> RawQuery:
        """Rows of a SQL text with named :markers bound to args and {name} references bound to DataFrames; further
        steps compose on top, standing conditions do not apply."""
        spark = self.workspace.spark
        frame = spark.sql(text, args=args or None, **(_frames or {}))
        return RawQuery(self.workspace, self.spec, frame)


class EntryHandle:
    """A tracked object's state and neighbours."""

    def __init__(self, workspace: Workspace, entry: Entry):
        self.workspace, self.entry = workspace, entry

    @property
    def state(self) -> State:
        return self.entry.state

    @property
    def original(self) -> dict:
        return dict(self.entry.original)

    def modified_properties(self) -> list[str]:
        return self.entry.modified_properties()

    def current_values(self) -> dict:
        return self.entry.current_values()

    def reference(self, name: str) -> Lazy:
        return Lazy(self.workspace, self.entry.item, self.entry.entity, name, many=False)

    def collection(self, name: str) -> Lazy:
        return Lazy(self.workspace, self.entry.item, self.entry.entity, name, many=True)


class Lazy:
    """Rows behind one object's navigation: a query until load(), which also stores them on the object."""

    def __init__(self, workspace: Workspace, item, entity: Entity, name: str, many: bool):
        self.workspace, self.item, self.entity = workspace, item, entity
        self.nav: Navigation = workspace.model.nav(entity, name)
        if self.nav.many != many:
            raise TranslationError(f"'{entity.name}.{name}' is a {'collection' if self.nav.many else 'reference'}")
        self.loaded, self._value = False, [] if many else None

    def query(self) -> Query:
        n, target = self.nav, self.workspace.model.entity(self.nav.target)
        if n.through:
            link, to_parent, to_child = self.workspace.binder().link(self.entity, n)
            binder = self.workspace.binder()
            rows = binder.bind(Spec(link.name, tuple(X.Compare("eq", X.Field((f,)), X.Literal(getattr(self.item, p))) for f, p in to_parent)))
            values = [[r[link.column(f)] for f, _ in to_child] for r in rows.collect()]
            node = X.Junction("or", tuple(X.conjunction([X.Compare("eq", X.Field((p,)), X.Literal(v)) for (_, p), v in zip(to_child, vs, strict=True)]) for vs in values)) if values else X.Truth(False)
            return Query(self.workspace, Spec(target.name, (node,), tracked=False))
        theirs, ours = (n.foreign_key, n.principal_key) if n.many else (n.principal_key, n.foreign_key)
        nodes = tuple(X.Compare("eq", X.Field((t,)), X.Literal(getattr(self.item, o, None))) for t, o in zip(theirs, ours, strict=True))
        return Query(self.workspace, Spec(target.name, nodes, tracked=False))

    def load(self):
        if not self.loaded:
            self.workspace.count_load(f"{self.entity.name}.{self.nav.name}")
            if not self.nav.many and any(getattr(self.item, f, None) is None for f in self.nav.foreign_key):
                self._value = None
            else:
                self._value = self.query().to_list() if self.nav.many else self.query().first_or_none()
            setattr(self.item, self.nav.name, self._value)
            self.loaded = True
        return self._value

    @property
    def current(self):
        """What was loaded; nothing before."""
        return self._value


#: Types that reach Python the same through Arrow, column-wise, as through rows.
_FLAT = (T.StringType, T.LongType, T.IntegerType, T.ShortType, T.ByteType, T.DoubleType, T.FloatType, T.BooleanType, T.DateType, T.TimestampNTZType, T.DecimalType)


def _fetched(df: DataFrame) -> tuple[list[str], Any]:
    """A frame's column names and rows; flat frames come as Arrow columns."""
    if df.columns and all(isinstance(f.dataType, _FLAT) for f in df.schema.fields):
        table = df.toArrow()
        return df.columns, list(zip(*(c.to_pylist() for c in table.columns), strict=True))
    return df.columns, df.collect()


class Workspace:
    """A unit of work.  Subclasses may state their model in `describe`, or pass one.

    plugins add to the model, to every read and to every save; interceptors are called with (workspace, entries) under
    the names saving, saved, and with (workspace, table) as writing, written.
    """

    def __init__(self, spark: SparkSession, tables: Tables, model: ModelConfig | Snapshot | None = None, plugins: list[Plugin] | None = None, converters: list[Converter] | None = None, interceptors: list | None = None):
        self.spark, self.tables, self.plugins = spark, tables, plugins or []
        self.converters = Converters(converters)
        if isinstance(model, Snapshot):
            self.model, self.kinds = model, {}
        else:
            config = model or ModelConfig()
            self.describe(config)
            for p in self.plugins:
                p.configure_model(config)
            self.model = config.finish()
        self.kinds: dict[str, type] = {}
        for e in self.model.entities:
            for p in e.properties:
                self.converters.get(p.conversion)
        self.interceptors = [*(interceptors or []), *self.plugins]
        self.tracker = Tracker(self.model, self.converters)
        self._sets: dict[str, EntitySet] = {}
        self._loads: Counter[str] = Counter()
        self._depth = 0

    def describe(self, model: ModelConfig) -> None:
        """States the model; for subclasses."""

    # -- reading -----------------------------------------------------------------------------------------------------

    def set(self, kind) -> EntitySet:
        name = entity_name(kind)
        if isinstance(kind, type):
            self.kinds[name] = kind
        if name not in self._sets:
            self._sets[name] = EntitySet(self, name, self.kinds.get(name))
        return self._sets[name]

    def binder(self) -> Binder:
        return Binder(self.model, self.converters, self.tables.read, [p.condition for p in self.plugins])

    def scoped(self, entity: Entity, frame: DataFrame) -> DataFrame:
        """A table's rows that writes may touch: those that fulfil plugins' conditions that bind writes too."""
        nodes = [n for p in self.plugins if p.binds_writes and (n := p.condition(entity)) is not None]
        if not nodes:
            return frame
        binder = self.binder()
        binder.read = lambda e: frame
        scope = binder.scope(entity)
        return scope.frame.where(binder.condition(scope, X.conjunction(nodes))).select(*(scope.column(c).alias(c) for c in frame.columns))

    def materialise(self, spec: Spec, df: DataFrame) -> list:
        """A query's rows as objects, or as dicts for a projection."""
        entity = self.model.entity(spec.entity)
        names, rows = _fetched(df)
        if spec.project is not None:
            by_name = {n: v for n, v in spec.project}
            kinds = [self._conversion(entity, by_name[n]) for n in names]
            if not any(kinds):
                return [dict(zip(names, r, strict=True)) for r in rows]
            return [{n: self.converters.value(k, x) for n, k, x in zip(names, kinds, r, strict=True)} for r in rows]
        make = self._maker(entity, names, spec.includes, spec.tracked)
        return [make(r) for r in rows]

    @staticmethod
    def _conversion(entity: Entity, node) -> str | None:
        p = entity.by_name.get(node.path[0]) if isinstance(node, X.Field) and len(node.path) == 1 else None
        return p.conversion if p else None

    def _maker(self, entity: Entity, names: list[str], includes: tuple[Include, ...], tracked: bool) -> Callable[[tuple], Any]:
        """A function from a row to an object; what depends on the columns alone is worked out once."""
        kind = self.kinds.get(entity.name, Record)
        by_column = {p.column: p for p in entity.properties}
        owned = owned_columns(self.model, entity)
        loads = {i.name: i for i in includes}
        plain, parts, children, attributes, conversions = [], [], [], [], []
        for n, column in enumerate(names):
            if column in loads:
                children.append((n, column, self.model.entity(entity.navs[column].target), loads[column].children))
            elif column in owned:
                nav, prop = owned[column]
                parts.append((n, nav, prop, self.model.entity(entity.navs[nav].target).by_name[prop].conversion))
            else:
                p = by_column.get(column)
                plain.append(n)
                attributes.append(p.name if p else column)
                conversions.append(p.conversion if p else None)
        stored = [n for n, c in enumerate(names) if c not in loads]
        stored_names = [names[n] for n in stored]
        keyed = tracked and bool(entity.key)
        whole = len(plain) == len(names)
        convert = [(a, self.converters.get(c)) for a, c in zip(attributes, conversions, strict=True) if c]
        makers: dict[tuple, Callable] = {}

        def make(row: tuple):
            item = kind.__new__(kind)
            values = item.__dict__
            values.update(zip(attributes, row if whole else [row[n] for n in plain], strict=True))
            for name, c in convert:
                if values[name] is not None:
                    values[name] = c.to_value(values[name])
            inside: dict[str, dict] = {}
            for n, nav, prop, c in parts:
                inside.setdefault(nav, {})[prop] = self.converters.value(c, row[n])
            for nav, x in inside.items():
                part_kind = self.kinds.get(entity.navs[nav].target, Record)
                part = part_kind.__new__(part_kind)
                part.__dict__.update(x)
                values[nav] = None if all(v is None for v in x.values()) else part
            if keyed:
                have = self.tracker.find(entity, tuple(values.get(k) for k in entity.key))
                if have:
                    item = have.item
                else:
                    self.tracker.set(item, entity, State.UNCHANGED, dict(zip(stored_names, [row[n] for n in stored], strict=True)))
            for n, name, target, below in children:
                setattr(item, name, self._nested(row[n], target, below, makers))
            return item

        return make

    def _nested(self, x, target: Entity, below: tuple[Include, ...], makers: dict):
        """The objects in an included column; they are not tracked."""
        if x is None:
            return None
        if isinstance(x, list):
            return [self._nested(y, target, below, makers) for y in x]
        if target.name not in makers:
            makers[target.name] = self._maker(target, list(x.__fields__), below, False)
        return makers[target.name](tuple(x))

    def entry(self, item, kind=None) -> EntryHandle:
        e = self.tracker.entries.get(id(item))
        if e is None:
            e = Entry(item, self.model.entity(entity_name(kind or type(item))), self.tracker)
        return EntryHandle(self, e)

    def count_load(self, what: str) -> None:
        self._loads[what] += 1
        if self._loads[what] == MANY_LOADS:
            warnings.warn(f"{what} was loaded {MANY_LOADS} times, one row each; include() loads it with the rows", ManyLoadsWarning, stacklevel=3)

    # -- writing -----------------------------------------------------------------------------------------------------

    @contextlib.contextmanager
    def transaction(self) -> Iterator[None]:
        """Several saves as one; if it fails, tables and tracker are as before.  An inner one joins the outer."""
        if not self.tables.writable:
            raise SedgeError("these tables are read-only")
        if self._depth:
            yield
            return
        before = self.tracker.snapshot()
        self._depth += 1
        try:
            with self.tables.transaction():
                yield
        except BaseException:
            self.tracker.restore(before)
            raise
        finally:
            self._depth -= 1

    def _tell(self, name: str, *args) -> None:
        for i in self.interceptors:
            if f := getattr(i, name, None):
                f(self, *args)

    def save_changes(self) -> int:
        """Writes what changed, all or nothing; gives the number of objects, 0 if there was nothing to do."""
        self.tracker.detect_changes()
        self._tell("saving", self.tracker.pending())
        self.tracker.detect_changes()
        pending = self.tracker.pending()
        if not pending:
            return 0
        with self.transaction():
            self._tell("writing", pending)
            n = Saver(self).run()
            self._tell("written", pending)
            self.tracker.accept()
        self._tell("saved", pending)
        return n

    # -- life --------------------------------------------------------------------------------------------------------

    def close(self) -> None:
        self.tracker.clear()
        self._sets.clear()

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_) -> None:
        self.close()


class WorkspacePool:
    """Makes workspaces that share everything but their trackers; release() readies one for its next user."""

    def __init__(self, make: Callable[[], Workspace], size: int = 8):
        self.make, self.size = make, size
        self.idle: list[Workspace] = []

    def create(self) -> Workspace:
        return self.idle.pop() if self.idle else self.make()

    def release(self, w: Workspace) -> None:
        w.close()
        if len(self.idle) < self.size:
            self.idle.append(w)

    @contextlib.contextmanager
    def scope(self) -> Iterator[Workspace]:
        """A workspace for one request."""
        w = self.create()
        try:
            yield w
        finally:
            self.release(w)

