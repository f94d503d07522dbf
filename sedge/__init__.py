"""Entity-style analytics on Spark: describe tables as entities, query them with typed expressions, save what changed."""

from sedge.errors import ConcurrencyError, ModelError, NotFoundError, SedgeError, TranslationError
from sedge.model.build import ModelConfig
from sedge.model.converters import Converter
from sedge.model.snapshot import Snapshot
from sedge.sources.tables import CatalogTables, JdbcTables, MemoryTables, ParquetTables, VersionedTables
from sedge.workspace import Record, Workspace, WorkspacePool

__all__ = ["CatalogTables", "ConcurrencyError", "Converter", "JdbcTables", "MemoryTables", "ModelConfig", "ModelError", "NotFoundError", "ParquetTables", "Record", "SedgeError", "Snapshot", "TranslationError", "VersionedTables", "Workspace", "WorkspacePool"]
