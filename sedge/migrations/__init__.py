"""Migrations: differences between model snapshots as operations, files that hold them, and a runner with a history."""

from __future__ import annotations

import datetime as dt
import json
import re
from collections.abc import Callable
from dataclasses import asdict, dataclass
from pathlib import Path

from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedge.errors import SedgeError
from sedge.model.snapshot import Entity, Property, Snapshot
from sedge.sources.tables import VersionedTables, spark_type

#: Table with one row for each applied migration.
HISTORY = "__sedge_history"
DESTRUCTIVE = ("drop_table", "drop_column")


@dataclass(frozen=True)
class Operation:
    """create_table, drop_table, add_column, drop_column, alter_column, create_index, drop_index or insert_rows."""

    kind: str
    table: str
    namespace: str | None = None
    name: str | None = None
    columns: tuple = ()
    key: tuple = ()
    unique: bool = False
    rows: tuple = ()

    @property
    def destructive(self) -> bool:
        return self.kind in DESTRUCTIVE

    def to_json(self) -> dict:
        return {k: v for k, v in asdict(self).items() if v not in (None, (), False)}

    @classmethod
    def from_json(cls, x: dict) -> Operation:
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in x.items()})


@dataclass(frozen=True)
class _Table:
    """A physical table: the entities on it taken together."""

    name: str
    namespace: str | None
    columns: dict
    key: tuple
    indexes: dict
    rows: tuple


def _column(p: Property, is_key: bool) -> dict:
    return {"name": p.column, "type": spark_type(p, is_key).simpleString(), "nullable": p.nullable, "max_length": p.max_length, "default": p.default, "default_sql": p.default_sql}


def _tables(s: Snapshot) -> dict[tuple, _Table]:
    out: dict[tuple, list[Entity]] = {}
    for e in s.entities:
        out.setdefault((e.namespace, e.table), []).append(e)
    tables = {}
    for (ns, name), group in out.items():
        columns, indexes, rows, key = {}, {}, [], ()
        for e in group:
            key = key or tuple(e.column(k) for k in e.key)
            for p in e.properties:
                columns.setdefault(p.column, _column(p, p.name in e.key))
            if e.discriminator:
                columns.setdefault(e.discriminator.column, {"name": e.discriminator.column, "type": "string", "nullable": False, "max_length": None, "default": None, "default_sql": None})
            for i in e.indexes:
                indexes[i.name] = (tuple(e.column(p) for p in i.properties), i.unique)
            for r in e.seed:
                rows.append({e.column(k): v for k, v in r.items()} | ({e.discriminator.column: e.discriminator.value} if e.discriminator else {}))
        tables[ns, name] = _Table(name, ns, columns, key, indexes, tuple(rows))
    return tables


def diff(old: Snapshot, new: Snapshot) -> list[Operation]:
    """What turns old into new: tables first made, then columns, then indexes, then seed rows; dropping comes last."""
    a, b = _tables(old), _tables(new)
    made, columns, indexes, rows, gone = [], [], [], [], []
    for at in sorted(b, key=str):
        t = b[at]
        where = {"table": t.name, "namespace": t.namespace}
        have = a.get(at)
        if have is None:
            made.append(Operation("create_table", **where, columns=tuple(t.columns[c] for c in sorted(t.columns)), key=t.key))
        else:
            if have.key != t.key:
                raise SedgeError(f"the key of {t.name} changed; a migration cannot do that")
            for c in sorted(t.columns):
                if c not in have.columns:
                    columns.append(Operation("add_column", **where, columns=(t.columns[c],)))
                elif have.columns[c] != t.columns[c]:
                    columns.append(Operation("alter_column", **where, columns=(t.columns[c],)))
            gone += [Operation("drop_column", **where, columns=(have.columns[c],)) for c in sorted(have.columns) if c not in t.columns]
        before = have.indexes if have else {}
        for i in sorted(before):
            if t.indexes.get(i) != before[i]:
                indexes.append(Operation("drop_index", **where, name=i, columns=before[i][0], unique=before[i][1]))
        for i in sorted(t.indexes):
            if before.get(i) != t.indexes[i]:
                indexes.append(Operation("create_index", **where, name=i, columns=t.indexes[i][0], unique=t.indexes[i][1]))
        new_rows = tuple(r for r in t.rows if r not in (have.rows if have else ()))
        if new_rows:
            rows.append(Operation("insert_rows", **where, rows=new_rows))
    gone += [Operation("drop_table", table=a[at].name, namespace=a[at].namespace) for at in sorted(a, key=str) if at not in b]
    return [*made, *columns, *indexes, *rows, *gone]


def diff_both(old: Snapshot, new: Snapshot) -> tuple[list[Operation], list[Operation]]:
    """Operations up, and those down."""
    down = [o for o in diff(new, old) if o.kind != "insert_rows"]
    return diff(old, new), down


@dataclass(frozen=True)
class Migration:
    id: str
    up: tuple[Operation, ...]
    down: tuple[Operation, ...]

    def to_json(self) -> str:
        return json.dumps({"id": self.id, "up": [o.to_json() for o in self.up], "down": [o.to_json() for o in self.down]}, indent=2, sort_keys=True) + "\n"

    @classmethod
    def from_json(cls, text: str) -> Migration:
        x = json.loads(text)
        return cls(x["id"], tuple(map(Operation.from_json, x["up"])), tuple(map(Operation.from_json, x["down"])))


def migration_id(name: str, now: dt.datetime) -> str:
    """YYYYMMDDHHMMSS_name, in lower case with underscores."""
    slug = re.sub(r"[^a-z0-9]+", "_", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower()).strip("_")
    if not slug:
        raise SedgeError("a migration needs a name")
    return f"{now:%Y%m%d%H%M%S}_{slug}"


class Runner:
    """Applies migrations to a versioned store; each is one commit together with its row of history."""

    def __init__(self, tables: VersionedTables, migrations: list[Migration], clock: Callable[[], dt.datetime] | None = None):
        self.tables, self.migrations = tables, sorted(migrations, key=lambda m: m.id)
        self.clock = clock or (lambda: dt.datetime.now(dt.UTC).replace(tzinfo=None))
        self.history = Entity(HISTORY, HISTORY, properties=(Property("id", "id", "string"), Property("applied_at", "applied_at", "timestamp")))

    def applied(self) -> list[str]:
        if HISTORY not in self.tables.manifest()["tables"]:
            return []
        return sorted(r["id"] for r in self.tables.read(self.history).collect())

    def pending(self) -> list[Migration]:
        done = set(self.applied())
        return [m for m in self.migrations if m.id not in done]

    def _note(self, ids: list[str]) -> None:
        schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("applied_at", T.TimestampNTZType())])
        old = self.tables.read(self.history).collect() if HISTORY in self.tables.manifest()["tables"] else []
        times = {r["id"]: r["applied_at"] for r in old}
        self.tables.replace(self.history, self.tables.spark.createDataFrame([(i, times.get(i) or self.clock()) for i in ids], schema))

    def up(self, to: str | None = None) -> list[str]:
        """Applies what is pending, in the order of ids; gives what it applied."""
        out = []
        for m in self.pending():
            if to is not None and m.id > to:
                break
            with self.tables.transaction():
                for o in m.up:
                    self._run(o)
                self._note([*self.applied(), m.id])
            out.append(m.id)
        return out

    def down(self, steps: int = 1) -> list[str]:
        """Takes back the last ones."""
        by_id, out = {m.id: m for m in self.migrations}, []
        for i in list(reversed(self.applied()))[:steps]:
            if i not in by_id:
                raise SedgeError(f"migration {i} is applied but not here")
            with self.tables.transaction():
                for o in by_id[i].down:
                    self._run(o)
                self._note([x for x in self.applied() if x != i])
            out.append(i)
        return out

    def _run(self, o: Operation) -> None:
        entity = Entity(o.table, o.table, o.namespace)
        t = self.tables
        kind = lambda c: T.DataType.fromDDL(c["type"])
        if o.kind == "create_table":
            if t._name(entity) in t.manifest()["tables"]:
                raise SedgeError(f"table {o.table} exists")
            t.replace(entity, t.spark.createDataFrame([], T.StructType([T.StructField(c["name"], kind(c)) for c in o.columns])))
        elif o.kind == "drop_table":
            t.drop(entity)
        elif o.kind == "add_column":
            c = o.columns[0]
            fill = F.expr(c["default_sql"]) if c["default_sql"] else F.lit(c["default"])
            t.replace(entity, t.read(entity).withColumn(c["name"], fill.cast(kind(c))))
        elif o.kind == "alter_column":
            c = o.columns[0]
            t.replace(entity, t.read(entity).withColumn(c["name"], F.col(f"`{c['name']}`").cast(kind(c))))
        elif o.kind == "drop_column":
            t.replace(entity, t.read(entity).drop(o.columns[0]["name"]))
        elif o.kind == "insert_rows":
            old = t.read(entity)
            schema = T.StructType([old.schema[c] for c in old.columns])
            new = t.spark.createDataFrame([tuple(float(r[c]) if isinstance(old.schema[c].dataType, T.DoubleType) and r.get(c) is not None else r.get(c) for c in old.columns) for r in o.rows], schema)
            t.replace(entity, old.unionByName(new))
        elif o.kind not in ("create_index", "drop_index"):  # Spark has no secondary indexes; they stay metadata
            raise SedgeError(f"unknown operation {o.kind}")


def script(operations: list[Operation]) -> str:
    """The operations as SQL for reading, not for running."""
    out = []
    for o in operations:
        name = ".".join(f"`{x}`" for x in (o.namespace, o.table) if x)
        col = lambda c: f"`{c['name']}` {c['type'].upper()}{'' if c['nullable'] else ' NOT NULL'}"
        if o.kind == "create_table":
            out.append(f"CREATE TABLE {name} ({', '.join(map(col, o.columns))});")
        elif o.kind == "drop_table":
            out.append(f"DROP TABLE {name};")
        elif o.kind in ("add_column", "alter_column"):
            out.append(f"ALTER TABLE {name} {'ADD' if o.kind == 'add_column' else 'ALTER'} COLUMN {col(o.columns[0])};")
        elif o.kind == "drop_column":
            out.append(f"ALTER TABLE {name} DROP COLUMN `{o.columns[0]['name']}`;")
        elif o.kind == "insert_rows":
            for r in o.rows:
                out.append(f"INSERT INTO {name} ({', '.join(f'`{k}`' for k in r)}) VALUES ({', '.join(map(_literal, r.values()))});")
        else:
            out.append(f"-- {o.kind.replace('_', ' ')} {o.name} on {name} ({', '.join(o.columns)})")
    return "\n".join(out) + ("\n" if out else "")


def _literal(x) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x).upper() if isinstance(x, bool) else str(x)


@dataclass
class Project:
    """Where a project keeps its migrations: a folder of JSON files and the snapshot they lead to."""

    model: Snapshot
    folder: Path
    tables: VersionedTables | None = None
    clock: Callable[[], dt.datetime] = lambda: dt.datetime.now(dt.UTC).replace(tzinfo=None)

    @property
    def snapshot_path(self) -> Path:
        return self.folder / "snapshot.json"

    def committed(self) -> Snapshot:
        return Snapshot.from_json(self.snapshot_path.read_text()) if self.snapshot_path.exists() else Snapshot()

    def migrations(self) -> list[Migration]:
        return [Migration.from_json(p.read_text()) for p in sorted(self.folder.glob("[0-9]*.json"))]

    def has_pending_changes(self) -> bool:
        return bool(diff(self.committed(), self.model))

    def add(self, name: str) -> Migration | None:
        """Writes a migration to the present model; None if nothing changed."""
        up, down = diff_both(self.committed(), self.model)
        if not up:
            return None
        m = Migration(migration_id(name, self.clock()), tuple(up), tuple(down))
        self.folder.mkdir(parents=True, exist_ok=True)
        if any(x.id >= m.id for x in self.migrations()):
            raise SedgeError("a migration with a later id exists")
        (self.folder / f"{m.id}.json").write_text(m.to_json())
        previous = self.committed().to_json()
        (self.folder / f"before-{m.id}.snapshot").write_text(previous)
        self.snapshot_path.write_text(self.model.to_json())
        return m

    def remove(self) -> str | None:
        """Takes back the last migration file, unless it is applied."""
        have = self.migrations()
        if not have:
            return None
        last = have[-1].id
        if self.tables and last in Runner(self.tables, have).applied():
            raise SedgeError(f"{last} is applied; revert it first")
        before = self.folder / f"before-{last}.snapshot"
        self.snapshot_path.write_text(before.read_text())
        before.unlink()
        (self.folder / f"{last}.json").unlink()
        return last

    def repair(self) -> bool:
        """Writes the snapshot anew from the model, conflict marks or not; says whether it had drifted."""
        text = self.snapshot_path.read_text() if self.snapshot_path.exists() else ""
        ours = re.sub(r"<{7}[^\n]*\n(.*?)={7}\n.*?>{7}[^\n]*\n", r"\1", text, flags=re.S)
        new = self.model.to_json()
        self.folder.mkdir(parents=True, exist_ok=True)
        self.snapshot_path.write_text(new)
        return ours != new

    def runner(self) -> Runner:
        if self.tables is None:
            raise SedgeError("no tables are configured")
        return Runner(self.tables, self.migrations(), self.clock)

    def list(self) -> list[tuple[str, bool]]:
        done = set(self.runner().applied()) if self.tables else set()
        return [(m.id, m.id in done) for m in self.migrations()]

    def script(self) -> str:
        return "\n".join(f"-- {m.id}\n{script(list(m.up))}" for m in self.migrations())
