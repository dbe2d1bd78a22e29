"""Expected errors; each carries a message and, where one helps, a hint."""

from __future__ import annotations


class GraphError(Exception):
    def __init__(self, message: str, hint: str | None = None):
        super().__init__(message)
        self.message, self.hint = message, hint

    def __str__(self) -> str:
        return f"ERROR: {self.message}" + (f"\nHINT: {self.hint}" if self.hint else "")


class SchemaError(GraphError):
    pass


class NotFoundError(GraphError):
    pass


class ReadOnlyViolation(GraphError):
    pass


class CypherError(GraphError):
    pass


class ConfigurationError(GraphError):
    pass
