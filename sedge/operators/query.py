"""Queries: immutable, chainable; steps are lazy, results run them."""

from __future__ import annotations

import copy
from collections.abc import Callable
from dataclasses import dataclass
from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedge.errors import NotFoundError, TranslationError
from sedge.functions.expr import Field, conjunction, record, record_path, record_value
from sedge.plans.spec import Spec, add_include

if TYPE_CHECKING:
    from sedge.workspace import Workspace


@dataclass(frozen=True)
class Page:
    items: list
    total: int
    page: int
    page_size: int


class Query:
    """A query over one entity."""

    def __init__(self, workspace: Workspace, spec: Spec, cursor: tuple[str, ...] = ()):
        self.workspace, self.spec, self.cursor = workspace, spec, cursor

    def _with(self, kind: type | None = None, cursor: tuple[str, ...] | None = None, **changes) -> Any:
        out = copy.copy(self)
        out.__class__ = kind or type(self)
        out.spec = self.spec.with_(**changes)
        out.cursor = self.cursor if cursor is None else cursor
        return out

    # -- lazy steps --------------------------------------------------------------------------------------------------

    def where(self, predicate: Callable) -> Query:
        return self._with(where=(*self.spec.where, record(predicate)))

    def order_by(self, selector) -> SortedQuery:
        """A further ascending key, nulls first."""
        return self._with(SortedQuery, order=(*self.spec.order, (record_path(selector), False)))

    def order_by_desc(self, selector) -> SortedQuery:
        """A further descending key, nulls last."""
        return self._with(SortedQuery, order=(*self.spec.order, (record_path(selector), True)))

    def skip(self, n: int) -> Query:
        return self._with(skip=_whole(n))

    def take(self, n: int) -> Query:
        return self._with(take=_whole(n))

    def distinct(self) -> Query:
        return self._with(distinct=True)

    def select(self, values: Callable | dict) -> Query:
        """Named values: members, lower/upper of them, counts of navigations.  Rows come untracked."""
        if self.spec.includes:
            raise TranslationError("a projection has no place for included rows")
        named = record_value(values) if callable(values) else {k: record_value(v) if callable(v) else Field(record_path(v)) for k, v in values.items()}
        if not isinstance(named, dict):
            named = {named.path[-1] if isinstance(named, Field) else "value": named}
        return self._with(project=tuple(named.items()), tracked=False)

    def include(self, selector, where: Callable | None = None) -> Query:
        if self.spec.project is not None:
            raise TranslationError("a projection has no place for included rows")
        path = record_path(selector)
        return self._with(cursor=path, includes=add_include(self.spec.includes, path, record(where) if where else None))

    def then_include(self, selector, where: Callable | None = None) -> Query:
        if not self.cursor:
            raise TranslationError("then_include() follows include()")
        path = (*self.cursor, *record_path(selector))
        return self._with(cursor=path, includes=add_include(self.spec.includes, path, record(where) if where else None))

    def as_no_tracking(self) -> Query:
        return self._with(tracked=False)

    def ignore_query_filters(self) -> Query:
        """Reads without the entity's query filter; plugins' conditions and included rows' filters stay."""
        return self._with(ignore_filters=True)

    # -- results -----------------------------------------------------------------------------------------------------

    def to_df(self, converted: bool = False) -> DataFrame:
        """The lazy DataFrame: physical columns, or the projection's names; included rows nested.  converted also reads
        the entity's columns through those converters that work on Columns."""
        df = self.workspace.binder().loaded(self.spec)
        if converted and self.spec.project is None:
            for p in self.workspace.model.entity(self.spec.entity).properties:
                c = self.workspace.converters.get(p.conversion)
                if c and c.read:
                    df = df.withColumn(p.column, c.read(F.col(f"`{p.column}`")))
        return df

    def to_list(self) -> list:
        """All rows as objects, tracked unless said otherwise; projections as dicts."""
        return self.workspace.materialise(self.spec, self.to_df())

    def first_or_none(self):
        got = self.take(1).to_list()
        return got[0] if got else None

    def first(self):
        return _there(self.first_or_none(), self.spec.entity)

    def single_or_none(self):
        got = self.take(2).to_list()
        if len(got) > 1:
            raise NotFoundError(f"more than one {self.spec.entity}")
        return got[0] if got else None

    def single(self):
        return _there(self.single_or_none(), self.spec.entity)

    def any(self) -> bool:
        return not self._with(includes=()).take(1).to_df().isEmpty()

    def agg_df(self, name: str, selector=None) -> DataFrame:
        """One row with the column `value`; null over nothing."""
        return self.workspace.binder().aggregate(self.spec, name, None if selector is None else record_path(selector))

    def count(self) -> int:
        """Rows that match; skip and take play no part (to_df().count() minds them)."""
        return self.agg_df("count").first()["value"]

    def _number(self, name: str, selector):
        value = self.agg_df(name, selector).first()["value"]
        return 0 if value is None else value

    def sum(self, selector):
        return self._number("sum", selector)

    def avg(self, selector):
        return self._number("avg", selector)

    def min(self, selector):
        return self._number("min", selector)

    def max(self, selector):
        return self._number("max", selector)

    def to_page(self, page: int, page_size: int) -> Page:
        """One page, counted from 1, and the number of rows on all."""
        if page < 1 or page_size < 1:
            raise TranslationError("pages and their sizes start at 1")
        total = self._with(skip=None, take=None).count()
        return Page(self.skip((page - 1) * page_size).take(page_size).to_list(), total, page, page_size)

    # -- whole tables after a change, lazily -------------------------------------------------------------------------

    def _marked(self) -> DataFrame:
        """The entity's whole raw table with whether this query's conditions hold (null counts as not)."""
        self._only_conditions()
        binder = self.workspace.binder()
        spec = self.spec
        scope = binder.scope(binder.model.entity(spec.entity))
        nodes = [*binder.standing(scope.entity, spec.ignore_filters), *spec.where]
        binder.prepare(scope, nodes)
        hit = F.coalesce(binder.condition(scope, conjunction(nodes)), F.lit(False))
        return scope.frame.select(*(scope.column(c).alias(c) for c in scope.own.names), hit.alias("\0hit"))

    def _only_conditions(self) -> None:
        """Whole tables change by conditions alone; any other step would change rows that the query does not give."""
        s = self.spec
        if s.skip is not None or s.take is not None or s.distinct or s.project is not None:
            raise TranslationError("update and delete need a query of conditions alone: no skip, take, distinct or select")

    def remaining_df(self) -> DataFrame:
        """The table without the rows that match: what deleting them leaves."""
        return self._marked().where(~F.col("`\0hit`")).drop("\0hit")

    def updated_df(self, values: dict[str, Any]) -> DataFrame:
        """The table with properties set in the rows that match."""
        df, entity = self._marked(), self.workspace.model.entity(self.spec.entity)
        stored = {}
        for n, v in values.items():
            p = entity.by_name.get(n)
            stored[entity.column(n)] = F.lit(self.workspace.converters.stored(p.conversion if p else None, v))
        if unknown := set(stored) - set(df.columns):
            raise TranslationError(f"no columns {sorted(unknown)}")
        kinds = dict(df.dtypes)
        return df.select(*(F.when(F.col("`\0hit`"), stored[c].cast(kinds[c])).otherwise(F.col(f"`{c}`")).alias(c) if c in stored else F.col(f"`{c}`") for c in df.columns if c != "\0hit"))

    def delete(self) -> int:
        """Deletes the matching rows in the store, without tracking; gives their number.

        Rows that point to them stay as they are, and plugins are not asked: for delete behaviours and soft deletes
        remove the objects and save."""
        self._only_conditions()
        n = self.count()
        if n:
            self.workspace.tables.replace(self.workspace.model.entity(self.spec.entity), self.remaining_df())
        return n

    def update(self, values: dict[str, Any]) -> int:
        """Sets properties of the matching rows in the store, without tracking; gives their number."""
        self._only_conditions()
        n = self.count()
        if n:
            self.workspace.tables.replace(self.workspace.model.entity(self.spec.entity), self.updated_df(values))
        return n

    def explain(self) -> str:
        """The plan Spark makes of it."""
        return self.to_df()._jdf.queryExecution().toString()


class SortedQuery(Query):
    """A query with an order, which then_by refines."""

    def then_by(self, selector) -> SortedQuery:
        return self.order_by(selector)

    def then_by_desc(self, selector) -> SortedQuery:
        return self.order_by_desc(selector)


class RawQuery(SortedQuery):
    """A query over SQL text; steps go on top of it, standing conditions do not apply."""

    def __init__(self, workspace: Workspace, spec: Spec, frame: DataFrame):
        super().__init__(workspace, spec)
        self.frame = frame

    def _with(self, kind: type | None = None, cursor: tuple[str, ...] | None = None, **changes) -> Any:
        return super()._with(None, cursor, **changes)

    def _only_conditions(self) -> None:
        raise TranslationError("update and delete cannot follow SQL text")

    def _binder(self):
        binder = self.workspace.binder()
        read, name = binder.read, self.spec.entity
        binder.read = lambda e: self.frame if e.name == name else read(e)
        standing = binder.standing
        binder.standing = lambda e, ignore=False: [] if e.name == name else standing(e, ignore)
        return binder

    def to_df(self, converted: bool = False) -> DataFrame:
        return self._binder().loaded(self.spec)

    def agg_df(self, name: str, selector=None) -> DataFrame:
        return self._binder().aggregate(self.spec, name, None if selector is None else record_path(selector))


def _whole(n: int) -> int:
    if not isinstance(n, int) or isinstance(n, bool) or n < 0:
        raise TranslationError("skip and take need whole numbers from 0 on")
    return n


def _there(found, entity: str):
    if found is None:
        raise NotFoundError(f"no {entity} found")
    return found
