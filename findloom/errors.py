"""Errors that the library raises on bad input."""

from __future__ import annotations


class EngineError(Exception):
    """Any error of this library."""


class EngineIOError(EngineError):
    """A file is missing or can't be read."""


class InvalidDatabaseError(EngineError):
    """A file isn't a database, or is a damaged one."""

    def __init__(self, what: str) -> None:
        super().__init__(f"invalid database: {what}")


class ManifestError(EngineError):
    """A manifest has no shape that can be built from."""


class UsageError(EngineError):
    """Arguments that don't fit together."""
