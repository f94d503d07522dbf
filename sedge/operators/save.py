"""Saving: tracked changes become one new version of each touched table."""

from __future__ import annotations

from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedge.errors import ConcurrencyError, SedgeError
from sedge.model.snapshot import Entity
from sedge.sources.tables import table_schema
from sedge.tracking import Entry, State

if TYPE_CHECKING:
    from sedge.workspace import Workspace


def _same(df: DataFrame, keys: DataFrame, names: list[str]) -> Column:
    return reduce(Column.__and__, [df[n].eqNullSafe(keys[f"\0{n}"]) for n in names])


class Saver:
    """One save: assigns keys, checks what it touches, writes batches table by table."""

    def __init__(self, workspace: Workspace):
        self.w = workspace
        self.tables, self.model, self.tracker = workspace.tables, workspace.model, workspace.tracker
        self.frames: dict[str, tuple[Entity, DataFrame]] = {}

    def frame(self, entity: Entity) -> DataFrame:
        if entity.table not in self.frames:
            self.frames[entity.table] = (entity, self.tables.read(entity))
        return self.frames[entity.table][1]

    def put(self, entity: Entity, df: DataFrame) -> None:
        self.frames[entity.table] = (entity, df)

    def rows(self, entity: Entity, rows: list[dict], columns: list[str]) -> DataFrame:
        have = {f.name: f for f in self.frame(entity).schema.fields} | {f.name: f for f in table_schema(self.model, entity).fields if f.name not in self.frame(entity).columns}
        schema = T.StructType([T.StructField(c, have[c].dataType if c in have else T.StringType()) for c in columns])
        return self.w.spark.createDataFrame([tuple(_fit(r.get(c), schema[c].dataType) for c in columns) for r in rows], schema)

    def run(self) -> int:
        pending = self.tracker.pending()
        groups: dict[tuple[State, str], list[Entry]] = {}
        for e in pending:
            groups.setdefault((e.state, e.entity.name), []).append(e)
        for (state, _), entries in groups.items():
            {State.ADDED: self.insert, State.MODIFIED: self.update, State.DELETED: self.delete}[state](entries[0].entity, entries)
        for entity, df in self.frames.values():
            self.tables.replace(entity, df)
        return len(pending)

    def insert(self, entity: Entity, entries: list[Entry]) -> None:
        for e in entries:
            for k in entity.key:
                p = entity.by_name.get(k)
                if p and p.generated == "on_add" and getattr(e.item, k, None) is None:
                    setattr(e.item, k, self.tables.next_key(entity, p.column))
            self._fix_links(e)
            for p in entity.properties:
                if p.default is not None and getattr(e.item, p.name, None) is None:
                    setattr(e.item, p.name, p.default)
            for p in entity.properties:
                if not p.nullable and p.name in entity.key and getattr(e.item, p.name, None) is None:
                    raise SedgeError(f"{entity.name}.{p.name} needs a value")
        rows = [e.values() for e in entries]
        old = self.frame(entity)
        columns = list(dict.fromkeys([*old.columns, *(c for r in rows for c in r)]))
        new = self.rows(entity, rows, columns)
        names = [entity.column(k) for k in entity.key]
        if names:
            if len({tuple(r[c] for c in names) for r in rows}) < len(rows):
                raise SedgeError(f"duplicate key among the new rows of {entity.name}")
            keys = self._keys(entity, rows, names)
            if set(names) <= set(old.columns) and not old.join(keys, _same(old, keys, names), "left_semi").isEmpty():
                raise SedgeError(f"duplicate key in {entity.name}")
        self.put(entity, old.unionByName(new, allowMissingColumns=True) if old.columns else new)

    def _fix_links(self, e: Entry) -> None:
        """A foreign key follows the object its navigation holds."""
        for n in e.entity.navigations:
            other = getattr(e.item, n.name, None)
            if not n.many and not n.owned and not n.principal and n.foreign_key and other is not None and id(other) in self.tracker.entries:
                for f, p in zip(n.foreign_key, n.principal_key, strict=True):
                    setattr(e.item, f, getattr(other, p, None))

    def _keys(self, entity: Entity, rows: list[dict], names: list[str]) -> DataFrame:
        return self.rows(entity, rows, names).withColumnsRenamed({n: f"\0{n}" for n in names})

    def _touch(self, entity: Entity, entries: list[Entry]) -> list[str]:
        """The columns that identify the stored rows: key, concurrency token, tenant; raises if a row is not there."""
        names = [entity.column(k) for k in entity.key] + [p.column for p in entity.properties if p.token]
        if not entity.key:
            raise SedgeError(f"{entity.name} has no key, its rows cannot be saved")
        old = self.w.scoped(entity, self.frame(entity))
        keys = self._keys(entity, [e.original for e in entries], names)
        found = {tuple(r) for r in old.join(keys, _same(old, keys, names), "left_semi").select(*(old[n] for n in names)).distinct().collect()}
        gone = [e for e in entries if tuple(e.original.get(n) for n in names) not in found]
        if gone:
            raise ConcurrencyError(f"{len(gone)} row(s) of {entity.name} were changed or removed meanwhile", gone)
        return names

    def update(self, entity: Entity, entries: list[Entry]) -> None:
        names = self._touch(entity, entries)
        old = self.frame(entity)
        key = [entity.column(k) for k in entity.key]
        rows = []
        for e in entries:
            now = e.values()
            if any(now[k] != e.original.get(k) for k in key):
                raise SedgeError(f"the key of a tracked {entity.name} was changed")
            rows.append({k: e.original.get(k) for k in names} | {f"\1{c}": now.get(c) for c in old.columns} | {f"\2{c}": c in now and now[c] != e.original.get(c) for c in old.columns})
        schema = T.StructType([T.StructField(f"\0{k}", old.schema[k].dataType) for k in names] + [T.StructField(f"\1{c}", old.schema[c].dataType) for c in old.columns] + [T.StructField(f"\2{c}", T.BooleanType()) for c in old.columns])
        new = self.w.spark.createDataFrame([tuple(_fit(v, f.dataType) for v, f in zip(r.values(), schema.fields, strict=True)) for r in rows], schema)
        out = old.join(new, _same(old, new, names), "left")
        self.put(entity, out.select(*(F.when(out[f"`\2{c}`"], out[f"`\1{c}`"]).otherwise(old[f"`{c}`"]).alias(c) for c in old.columns)))

    def delete(self, entity: Entity, entries: list[Entry]) -> None:
        names = self._touch(entity, entries)
        old = self.frame(entity)
        keys = self._keys(entity, [e.original for e in entries], names)
        gone = old.join(keys, _same(old, keys, names), "left_semi")
        self._follow(entity, gone, set())
        old = self.frame(entity)
        self.put(entity, old.join(keys, _same(old, keys, names), "left_anti"))

    def _follow(self, entity: Entity, gone: DataFrame, seen: set) -> None:
        """What deleting rows does to those that point at them, by each to-many navigation's behaviour, all the way down."""
        for n in entity.navigations:
            if not (n.many or n.principal) or n.through or not n.foreign_key or n.on_delete == "no_action" or (entity.name, n.name) in seen:
                continue
            target = self.model.entity(n.target)
            child = self.frame(target)
            ours, theirs = (n.foreign_key, n.principal_key) if n.principal else (n.principal_key, n.foreign_key)
            fks = [target.column(f) for f in theirs]
            if not set(fks) <= set(child.columns):
                continue
            keys = gone.select(*(gone[entity.column(p)].alias(f"\0{f}") for p, f in zip(ours, fks, strict=True))).distinct()
            on = reduce(Column.__and__, [child[f] == keys[f"\0{f}"] for f in fks])
            hit = child.join(keys, on, "left_semi")
            if n.on_delete == "restrict":
                deleted = {e.key() for e in self.tracker.entries.values() if e.state == State.DELETED and e.entity.name == target.name}
                left = hit if not deleted else hit.where(~reduce(Column.__or__, [reduce(Column.__and__, [F.col(target.column(k)) == v for k, v in zip(target.key, d, strict=True)]) for d in deleted]))
                if not left.isEmpty():
                    raise SedgeError(f"{target.name} rows still point at the deleted {entity.name}")
            elif n.on_delete == "cascade":
                self._follow(target, hit, seen | {(entity.name, n.name)})
                self.put(target, self.frame(target).join(keys, on, "left_anti"))
            else:
                mark = keys.withColumn("\1hit", F.lit(True))
                out = child.join(mark, reduce(Column.__and__, [child[f] == mark[f"\0{f}"] for f in fks]), "left")
                self.put(target, out.select(*((F.when(out["`\1hit`"], F.lit(None)).otherwise(child[c]) if c in fks else child[c]).alias(c) for c in child.columns)))


def _fit(x, kind: T.DataType):
    """A Python value as createDataFrame wants it for a type."""
    if x is None:
        return None
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return float(x)
    if isinstance(kind, T.TimestampNTZType) and getattr(x, "tzinfo", None) is not None:
        return x.replace(tzinfo=None)
    return x
