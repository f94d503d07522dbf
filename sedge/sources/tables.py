"""Where tables live: read-only Parquet folders, tables in memory, JDBC, and a versioned Parquet store that can be written."""

from __future__ import annotations

import contextlib
import json
import os
import shutil
import uuid
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedge.errors import ConcurrencyError, SedgeError
from sedge.model.snapshot import Entity, Property, Snapshot

# fixed values: type tags and their Spark types
TYPES = {"string": T.StringType(), "number": T.LongType(), "bigint": T.LongType(), "boolean": T.BooleanType(), "timestamp": T.TimestampNTZType()}


def spark_type(p: Property, is_key: bool) -> T.DataType:
    """The Spark type of a property: its tag's, or one said in Spark's own words."""
    if p.type == "unknown":
        return T.LongType() if is_key or p.column.lower().endswith("id") else T.StringType()
    return TYPES.get(p.type) or T.DataType.fromDDL(p.type)


def table_schema(model: Snapshot, entity: Entity) -> T.StructType:
    """The schema of an entity's table, with those that share it and the types it owns; property order is by name."""
    fields: dict[str, T.StructField] = {}
    for e in model.entities:
        if (e.table, e.namespace) == (entity.table, entity.namespace):
            for p in e.properties:
                meta = {k: v for k, v in (("max_length", p.max_length), ("comment", p.comment)) if v is not None}
                fields.setdefault(p.column, T.StructField(p.column, spark_type(p, p.name in e.key), True, meta))
            if e.discriminator:
                fields.setdefault(e.discriminator.column, T.StructField(e.discriminator.column, T.StringType()))
    return T.StructType(list(fields.values()))


class Tables:
    """What a workspace reads from.  writable says whether save_changes() works."""

    writable = False

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def read(self, entity: Entity) -> DataFrame:
        raise NotImplementedError


class ParquetTables(Tables):
    """<folder>[/<namespace>]/<table>.parquet, read only; pushdown and pruning are Spark's."""

    def __init__(self, spark: SparkSession, folder: str):
        super().__init__(spark)
        self.folder = folder

    def read(self, entity: Entity) -> DataFrame:
        return self.spark.read.parquet("/".join(x for x in (self.folder, entity.namespace, f"{entity.table}.parquet") if x))


class CatalogTables(Tables):
    """Tables of the session's catalog."""

    def read(self, entity: Entity) -> DataFrame:
        return self.spark.table(".".join(f"`{x}`" for x in (entity.namespace, entity.table) if x))


class JdbcTables(Tables):
    """Tables of another database; needs its driver on Spark's class path.  Filters and columns are pushed to it."""

    def __init__(self, spark: SparkSession, url: str, **options: str):
        super().__init__(spark)
        self.url, self.options = url, options

    def read(self, entity: Entity) -> DataFrame:
        name = ".".join(x for x in (entity.namespace, entity.table) if x)
        return self.spark.read.format("jdbc").options(url=self.url, dbtable=name, **self.options).load()


class MemoryTables(Tables):
    """Tables given as rows or DataFrames."""

    def __init__(self, spark: SparkSession):
        super().__init__(spark)
        self.frames: dict[str, DataFrame] = {}

    def seed(self, table: str, rows, schema=None) -> MemoryTables:
        if isinstance(rows, DataFrame):
            self.frames[table] = rows
        else:
            self.frames[table] = self.spark.createDataFrame([tuple(r.values()) for r in rows] if rows and isinstance(rows[0], dict) else rows, schema or (list(rows[0]) if rows and isinstance(rows[0], dict) else None))
        return self

    def rows(self, table: str) -> list[dict]:
        return [r.asDict(True) for r in self.frames[table].collect()]

    def read(self, entity: Entity) -> DataFrame:
        if entity.table not in self.frames:
            raise SedgeError(f"no table '{entity.table}'")
        return self.frames[entity.table]


class VersionedTables(Tables):
    """Parquet folders under one manifest: a commit writes the touched tables anew and swaps the manifest in one rename.

    A reader sees one version of all tables; a writer that started from an older manifest fails with ConcurrencyError,
    and a lock file keeps two writers apart.  `folder` must be shared by driver and executors.
    """

    writable = True

    def __init__(self, spark: SparkSession, folder: str, model: Snapshot):
        super().__init__(spark)
        self.folder, self.model = Path(folder), model
        self.folder.mkdir(parents=True, exist_ok=True)
        self.staged: dict | None = None

    def _name(self, entity: Entity) -> str:
        return f"{entity.namespace}.{entity.table}" if entity.namespace else entity.table

    def manifest(self) -> dict:
        if self.staged is not None:
            return self.staged
        at = self.folder / "manifest.json"
        return json.loads(at.read_text()) if at.exists() else {"version": 0, "tables": {}, "keys": {}}

    def read(self, entity: Entity) -> DataFrame:
        have = self.manifest()["tables"].get(self._name(entity))
        schema = table_schema(self.model, entity)
        if have is None:
            return self.spark.createDataFrame([], schema if schema.fields else "id long")
        found = T.StructType.fromJson(have["schema"])
        return self.spark.read.schema(found).parquet(str(self.folder / have["path"]))

    def next_key(self, entity: Entity, column: str) -> int:
        """A new value for a counted key."""
        m = self.manifest()
        name = self._name(entity)
        if name not in m["keys"]:
            top = self.read(entity).agg(F.max(F.col(f"`{column}`"))).first()[0] if name in m["tables"] else None
            m["keys"][name] = top or 0
        m["keys"][name] += 1
        if self.staged is None:
            raise SedgeError("keys are given out inside a transaction")
        return m["keys"][name]

    @contextlib.contextmanager
    def transaction(self) -> Iterator[None]:
        """Everything written inside becomes visible at once, or not at all; an inner one joins the outer."""
        if self.staged is not None:
            yield
            return
        lock = self.folder / "lock"
        try:
            handle = os.open(lock, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
        except FileExistsError:
            raise ConcurrencyError(f"{lock} is held by another writer") from None
        os.write(handle, str(os.getpid()).encode())
        os.close(handle)
        try:
            before = self.manifest()["version"]
            self.staged = json.loads(json.dumps(self.manifest()))
            yield
            staged, self.staged = self.staged, None
            if self.manifest()["version"] != before:
                raise ConcurrencyError("the tables were changed meanwhile")
            staged["version"] = before + 1
            new = self.folder / f"manifest-{uuid.uuid4().hex}.json"
            new.write_text(json.dumps(staged, indent=1, sort_keys=True))
            os.replace(new, self.folder / "manifest.json")
        finally:
            self.staged = None
            lock.unlink(missing_ok=True)

    def replace(self, entity: Entity, df: DataFrame) -> None:
        """A new version of one table."""
        with self.transaction():
            path = f"{self._name(entity)}/{uuid.uuid4().hex}"
            df.write.parquet(str(self.folder / path))
            self.staged["tables"][self._name(entity)] = {"path": path, "schema": json.loads(df.schema.json())}

    def drop(self, entity: Entity) -> None:
        with self.transaction():
            self.staged["tables"].pop(self._name(entity), None)

    def vacuum(self) -> int:
        """Deletes versions no manifest names; gives their number."""
        live, gone = {t["path"] for t in self.manifest()["tables"].values()}, 0
        for at in [p for t in self.folder.iterdir() if t.is_dir() for p in t.iterdir()]:
            if str(at.relative_to(self.folder)) not in live:
                shutil.rmtree(at)
                gone += 1
        return gone
