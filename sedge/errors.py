"""Errors a user of the package can meet."""

from __future__ import annotations


class SedgeError(Exception):
    """Base of all; `code` is stable."""

    code = "SE1000"


class TranslationError(SedgeError):
    """An expression or a query that has no meaning as a plan."""

    code = "SE1001"


class NotFoundError(SedgeError):
    """No row, or more than one, where exactly one was asked for."""

    code = "SE1002"


class ConcurrencyError(SedgeError):
    """A tracked row was changed or removed by someone else; `entries` holds what failed."""

    code = "SE1003"

    def __init__(self, message: str, entries: list | None = None):
        super().__init__(message)
        self.entries = entries or []


class ModelError(SedgeError):
    """All diagnostics of an invalid model."""

    code = "SE1200"

    def __init__(self, diagnostics: list):
        super().__init__("\n".join(f"{d.code} {d.message}" for d in diagnostics))
        self.diagnostics = diagnostics
