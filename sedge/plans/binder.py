"""From a query's spec to a DataFrame: names become columns, navigations become joins and subqueries, filters go in."""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedge.errors import TranslationError
from sedge.functions import expr as X
from sedge.model.converters import Converters
from sedge.model.snapshot import Entity, Navigation, Snapshot
from sedge.plans.spec import Include, Spec

_COMPARE: dict[str, Callable[[Column, Column], Column]] = {"eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "gt": lambda a, b: a > b, "ge": lambda a, b: a >= b, "lt": lambda a, b: a < b, "le": lambda a, b: a <= b}
_MATCH: dict[str, Callable[[Column, str], Column]] = {"starts": lambda c, p: c.startswith(p), "ends": lambda c, p: c.endswith(p), "contains": lambda c, p: c.contains(p), "like": lambda c, p: c.like(p)}


@dataclass
class Scope:
    """One entity's occurrence in a plan: its frame under an alias, and the to-one targets joined to it."""

    entity: Entity
    alias: str
    frame: DataFrame
    joined: dict[tuple[str, ...], Scope] = field(default_factory=dict)

    def column(self, name: str) -> Column:
        return F.col(f"`{self.alias}`.`{name}`")

    def type_of(self, name: str) -> T.DataType | None:
        return next((f.dataType for f in self.own.fields if f.name == name), None)

    own: T.StructType = field(default_factory=T.StructType)


class Binder:
    """model: the metadata; read: an entity's raw table; passes: plugins' conditions for an entity, asked anew for each query."""

    def __init__(self, model: Snapshot, converters: Converters, read: Callable[[Entity], DataFrame], passes: list[Callable[[Entity], object | None]] | None = None):
        self.model, self.converters, self.read, self.passes = model, converters, read, passes or []
        self.numbers = itertools.count()

    # -- scopes ------------------------------------------------------------------------------------------------------

    def scope(self, entity: Entity) -> Scope:
        alias, frame = f"t{next(self.numbers)}", self.read(entity)
        return Scope(entity, alias, frame.alias(alias), own=frame.schema)

    def standing(self, entity: Entity, ignore_filters: bool = False) -> list:
        """The conditions that hold on every read of an entity: discriminator, query filter, plugins' passes."""
        out = []
        if entity.discriminator:
            out.append(X.Compare("eq", X.Field((f"\0{entity.discriminator.column}",)), X.Literal(entity.discriminator.value)))
        if entity.query_filter is not None and not ignore_filters:
            out.append(X.from_json(entity.query_filter))
        return out + [n for p in self.passes if (n := p(entity)) is not None]

    def prepare(self, scope: Scope, nodes: list) -> None:
        """Joins the to-one targets that the nodes' paths go through; left joins, so no row is lost."""
        for node in nodes:
            for n in X.walk(node):
                if isinstance(n, X.Field):
                    self._reach(scope, n.path)
                elif isinstance(n, (X.Children, X.ChildCount)):
                    self._reach(scope, n.nav.path)

    def _reach(self, scope: Scope, path: tuple[str, ...]) -> tuple[Scope, tuple[str, ...]]:
        """The scope a path ends in and the path's rest there."""
        here, done = scope, ()
        while len(path) > 1 and (nav := here.entity.navs.get(path[0])) and not nav.owned:
            if nav.many:
                raise TranslationError(f"'{here.entity.name}.{nav.name}' holds many rows; use any(), all() or count()")
            done += (path[0],)
            if done not in scope.joined:
                target = self.scope(self.model.entity(nav.target))
                on = [here.column(here.entity.column(f)) == target.column(target.entity.column(p)) for f, p in zip(nav.foreign_key, nav.principal_key, strict=True)]
                standing = self.standing(target.entity)
                self.prepare(target, standing)
                on += [self.condition(target, n) for n in standing]
                scope.frame = scope.frame.join(target.frame, reduce(Column.__and__, on), "left")
                scope.joined[done] = target
            here, path = scope.joined[done], path[1:]
        return here, path

    # -- values and conditions ---------------------------------------------------------------------------------------

    def physical(self, scope: Scope, path: tuple[str, ...]) -> tuple[Scope, str, str | None]:
        """Where a path's value lies: scope, column, converter."""
        here, path = self._reach(scope, path)
        if path and path[0].startswith("\0"):
            return here, path[0][1:], None
        nav = here.entity.navs.get(path[0]) if path else None
        if nav and nav.owned and not nav.many and len(path) == 2:
            p = self.model.entity(nav.target).by_name.get(path[1])
            return here, p.column if p else "_".join(path), p.conversion if p else None
        if not path or nav:
            raise TranslationError(f"'{'.'.join((here.entity.name, *path))}' is no single value")
        p = here.entity.by_name.get(path[0])
        column = p.column if p else path[0]
        if len(path) > 1 and not isinstance(here.type_of(column), T.StructType):
            return here, "_".join(path), None
        return here, column if len(path) == 1 else f"{column}`.`" + "`.`".join(path[1:]), p.conversion if p else None

    def value(self, scope: Scope, node) -> Column:
        if isinstance(node, X.Field):
            here, column, _ = self.physical(scope, node.path)
            return here.column(column)
        if isinstance(node, X.Cased):
            self._text(scope, node.of, node.name)
            return (F.lower if node.name == "lower" else F.upper)(self.value(scope, node.of))
        if isinstance(node, X.ChildCount):
            child = self._child(scope, node.nav, None)
            return child.select(F.count("*")).scalar()
        if isinstance(node, X.Literal):
            return F.lit(node.value)
        raise TranslationError(f"not a value: {node}")

    def _kind(self, scope: Scope, node) -> T.DataType | None:
        if isinstance(node, X.Field):
            here, column, conversion = self.physical(scope, node.path)
            return None if conversion else here.type_of(column)
        return T.StringType() if isinstance(node, X.Cased) else T.LongType() if isinstance(node, X.ChildCount) else None

    def _text(self, scope: Scope, node, what: str) -> None:
        kind = self._kind(scope, node)
        if kind is not None and not isinstance(kind, (T.StringType, T.VarcharType, T.CharType)):
            raise TranslationError(f"{what} needs a string, not {kind.simpleString()}")

    def _stored(self, scope: Scope, other, value):
        """A constant as the other side stores it."""
        if isinstance(other, X.Field):
            return self.converters.stored(self.physical(scope, other.path)[2], value)
        return value

    def condition(self, scope: Scope, node) -> Column:
        if isinstance(node, X.Truth):
            return F.lit(node.value)
        if isinstance(node, X.Compare):
            sides = []
            for side, other in ((node.left, node.right), (node.right, node.left)):
                if isinstance(side, X.Literal):
                    sides.append(F.lit(self._stored(scope, other, side.value)))
                else:
                    if node.op not in ("eq", "ne") and isinstance(self._kind(scope, side), T.BooleanType):
                        raise TranslationError("booleans have no order")
                    sides.append(self.value(scope, side))
            return _COMPARE[node.op](*sides)
        if isinstance(node, X.Junction):
            return reduce(Column.__and__ if node.op == "and" else Column.__or__, [self.condition(scope, p) for p in node.parts])
        if isinstance(node, X.Negation):
            return ~self.condition(scope, node.of)
        if isinstance(node, X.NullTest):
            c = self.value(scope, node.of)
            return c.isNotNull() if node.negated else c.isNull()
        if isinstance(node, X.Match):
            self._text(scope, node.of, node.kind)
            return _MATCH[node.kind](self.value(scope, node.of), node.pattern)
        if isinstance(node, X.Member):
            return self.value(scope, node.of).isin([self._stored(scope, node.of, v) for v in node.values])
        if isinstance(node, X.Children):
            if node.mode == "any":
                return self._child(scope, node.nav, node.predicate).exists()
            return ~self._child(scope, node.nav, X.Negation(node.predicate)).exists()
        raise TranslationError(f"not a condition: {node}")

    def _child(self, scope: Scope, at: X.Field, predicate) -> DataFrame:
        """The rows behind a to-many navigation of the enclosing scope's row, as a correlated subquery."""
        here, rest = self._reach(scope, at.path)
        if len(rest) != 1:
            raise TranslationError(f"'{'.'.join(at.path)}' is no navigation")
        nav = self.model.nav(here.entity, rest[0])
        if not nav.many:
            raise TranslationError(f"'{here.entity.name}.{nav.name}' holds one row; use its members")
        child = self.scope(self.model.entity(nav.target))
        parent = lambda names: [here.column(here.entity.column(n)).outer() for n in names]
        nodes = [*self.standing(child.entity), *([predicate] if predicate is not None else [])]
        self.prepare(child, nodes)
        if nav.through:
            link, to_parent, to_child = self.link(here.entity, nav)
            join = self.scope(link)
            child.frame = child.frame.join(join.frame, reduce(Column.__and__, [join.column(link.column(f)) == child.column(child.entity.column(p)) for f, p in to_child]), "inner")
            on = [join.column(link.column(f)) == c for (f, _), c in zip(to_parent, parent([p for _, p in to_parent]), strict=True)]
        else:
            on = [child.column(child.entity.column(f)) == c for f, c in zip(nav.foreign_key, parent(nav.principal_key), strict=True)]
        return child.frame.where(reduce(Column.__and__, [*on, *(self.condition(child, n) for n in nodes)]))

    def link(self, owner: Entity, nav: Navigation) -> tuple[Entity, list[tuple[str, str]], list[tuple[str, str]]]:
        """A many-to-many's join entity, its (foreign, principal) names to the owner and to the target."""
        link = self.model.entity(nav.through)

        def names(to: Entity) -> list[tuple[str, str]]:
            ref = next((v for v in link.navigations if v.target == to.name and not v.many and v.foreign_key), None)
            if ref:
                return list(zip(ref.foreign_key, ref.principal_key, strict=True))
            stem = to.name[:1].lower() + to.name[1:]
            return [(next((n for n in (stem + k[:1].upper() + k[1:], stem + "Id", k) if n in link.by_name), stem + k[:1].upper() + k[1:]), k) for k in to.key]

        return link, names(owner), names(self.model.entity(nav.target))

    # -- whole queries -----------------------------------------------------------------------------------------------

    def rows(self, spec: Spec, extra: list | None = None) -> tuple[Scope, list]:
        """The filtered scope of a spec."""
        scope = self.scope(self.model.entity(spec.entity))
        nodes = [*self.standing(scope.entity, spec.ignore_filters), *spec.where]
        self.prepare(scope, [*nodes, *(extra or [])])
        if nodes:
            scope.frame = scope.frame.where(self.condition(scope, X.conjunction(nodes)))
        return scope, nodes

    def loaded(self, spec: Spec) -> DataFrame:
        """The rows of a spec with its includes.  Joins keep no order, so the sort keys travel along and sort again."""
        entity = self.model.entity(spec.entity)
        if not spec.includes:
            return self.bind(spec)
        df = self.with_includes(self.bind(spec, keys=True), entity, spec.includes)
        if not spec.order:
            return df
        marks = [f"\0key{n}" for n in range(len(spec.order))]
        order = [(F.desc_nulls_last if down else F.asc_nulls_first)(F.col(f"`{m}`")) for m, (_, down) in zip(marks, spec.order, strict=True)]
        return df.orderBy(*order).drop(*marks)

    def bind(self, spec: Spec, keys: bool = False) -> DataFrame:
        """The rows of a spec: filter, project, distinct, order, offset, limit.  Without a projection all the table's
        columns under their own names; with keys, the sort keys too."""
        kept = [f"\0key{n}" for n in range(len(spec.order))] if keys else []
        order = [X.Field(path) for path, _ in spec.order]
        values = [v for _, v in spec.project or ()]
        scope, _ = self.rows(spec, order + values)
        by = [self.value(scope, f) for f in order]
        sort = lambda cs: [(F.desc_nulls_last if down else F.asc_nulls_first)(c) for c, (_, down) in zip(cs, spec.order, strict=True)]
        if spec.project is None:
            df = scope.frame.select(*(scope.column(n).alias(n) for n in scope.own.names)) if spec.distinct else scope.frame
            if spec.distinct:
                df = df.distinct()
                by = [F.col(f"`{self.physical(scope, f.path)[1]}`") for f in order]
            df = df.orderBy(*sort(by)) if by else df
            marks = [c.alias(m) for c, m in zip(by, kept, strict=False)]
            df = df.select("*", *marks) if spec.distinct else df.select(*(scope.column(n).alias(n) for n in scope.own.names), *marks)
        else:
            named = [self.value(scope, v).alias(n) for n, v in spec.project]
            if spec.distinct:
                by_value = {v: n for n, v in spec.project}
                if any(f not in by_value for f in order):
                    raise TranslationError("a distinct projection can be ordered by its own values alone")
                df = scope.frame.select(*named).distinct()
                df = df.orderBy(*sort([F.col(f"`{by_value[f]}`") for f in order])) if order else df
            else:
                hidden = [c.alias(f"\0{n}") for n, c in enumerate(by)]
                df = scope.frame.select(*named, *hidden)
                if by:
                    df = df.orderBy(*sort([F.col(f"`\0{n}`") for n in range(len(by))]))
                df = df.select(*(F.col(f"`{n}`") for n, _ in spec.project))
        if spec.skip:
            df = df.offset(spec.skip)
        return df if spec.take is None else df.limit(spec.take)

    def aggregate(self, spec: Spec, name: str, path: tuple[str, ...] | None) -> DataFrame:
        """One row, one column `value`: count, sum, avg, min or max.  Paging and order play no part; distinct rows are
        made before."""
        if spec.distinct:
            df = self.bind(spec.with_(order=(), skip=None, take=None, includes=()))
            scope = None
            if path is None:
                column = None
            elif spec.project is not None:
                names = [n for n, v in spec.project if isinstance(v, X.Field) and v.path == path]
                if not names:
                    raise TranslationError("an aggregate over a distinct projection can use its own values alone")
                column = F.col(f"`{names[0]}`")
            else:
                column = F.col(f"`{self.physical(self.scope(self.model.entity(spec.entity)), path)[1]}`")
        else:
            scope, _ = self.rows(spec, [X.Field(path)] if path else None)
            df, column = scope.frame, self.value(scope, X.Field(path)) if path else None
        return df.agg((F.count("*") if name == "count" else {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[name](column)).alias("value"))

    # -- includes ----------------------------------------------------------------------------------------------------

    def with_includes(self, df: DataFrame, entity: Entity, includes: tuple[Include, ...]) -> DataFrame:
        """df (an entity's table columns) with one column for each include: a struct for a to-one navigation (null if
        nothing is there), an array of structs, ordered by key, for a to-many one (empty if nothing is there).

        Children are grouped by their foreign key before the join, so several includes never multiply rows; deeper
        ones are built bottom-up.  The target's standing conditions always apply."""
        for inc in includes:
            nav = self.model.nav(entity, inc.name)
            if nav.owned and not nav.many:
                continue
            target = self.model.entity(nav.target)
            spec = Spec(target.name, where=(inc.where,) if inc.where is not None else ())
            child = self.with_includes(self.bind(spec), target, inc.children)
            row = F.struct(*(F.col(f"`{c}`") for c in child.columns))
            marks = [f"\0{n}" for n in range(len(nav.foreign_key) or len(entity.key))]
            if nav.through:
                link, to_parent, to_child = self.link(entity, nav)
                via = self.bind(Spec(link.name)).select(*(F.col(f"`{link.column(f)}`").alias(m) for (f, _), m in zip(to_parent, marks, strict=True)), *(F.col(f"`{link.column(f)}`").alias(f"\0to{n}") for n, (f, _) in enumerate(to_child)))
                on = reduce(Column.__and__, [F.col(f"`\0to{n}`") == F.col(f"`{target.column(p)}`") for n, (_, p) in enumerate(to_child)])
                child = child.join(via, on)
                own = [p for _, p in to_parent]
            elif nav.many:
                child = child.select("*", *(F.col(f"`{target.column(f)}`").alias(m) for f, m in zip(nav.foreign_key, marks, strict=True)))
                own = list(nav.principal_key)
            else:
                child = child.select("*", *(F.col(f"`{target.column(p)}`").alias(m) for p, m in zip(nav.principal_key, marks, strict=True)))
                own = list(nav.foreign_key)
            if nav.many:
                keys = F.struct(*(F.col(f"`{target.column(k)}`") for k in target.key)) if target.key else F.lit(None)
                got = child.groupBy(*(F.col(f"`{m}`") for m in marks)).agg(F.transform(F.array_sort(F.collect_list(F.struct(keys.alias("k"), row.alias("r")))), lambda x: x["r"]).alias("\0rows"))
            else:
                got = child.select(*(F.col(f"`{m}`") for m in marks), row.alias("\0rows"))
            on = reduce(Column.__and__, [F.col(f"`{entity.column(o)}`") == F.col(f"`{m}`") for o, m in zip(own, marks, strict=True)])
            kind = got.schema["\0rows"].dataType.simpleString()
            found = F.coalesce(F.col("`\0rows`"), F.array().cast(kind)) if nav.many else F.col("`\0rows`")
            df = df.join(got, on, "left").select(*(F.col(f"`{c}`") for c in df.columns), found.alias(inc.name))
        return df
