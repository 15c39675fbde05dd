"""The errors users see. Entry and format errors are ValueErrors."""

from __future__ import annotations

from typing import Any


class InvalidEntryError(ValueError):
    """A value does not fit its field; ``field_spec`` names the field where it is known."""

    field_spec: Any = None


class InvalidSchemaError(ValueError):
    """A part of a linkage schema is wrong; ``json_field_spec`` and ``field_spec_index`` place it where known."""

    json_field_spec: Any = None
    field_spec_index: int | None = None


class EntryError(ValueError):
    """The first invalid entry of a table: ``row_index`` from 0 and ``field_spec``."""

    def __init__(self, message: str, row_index: int | None = None, field_spec: Any = None) -> None:
        super().__init__(message)
        self.row_index, self.field_spec = row_index, field_spec


class FormatError(ValueError):
    """The table's shape is wrong: its header, or the length of a row (``row_index``)."""

    def __init__(self, message: str, row_index: int | None = None) -> None:
        super().__init__(message)
        self.row_index = row_index


class SchemaError(Exception):
    """A linkage schema is not valid; ``errors`` lists what is wrong with single features."""

    def __init__(self, message: str, errors: list[Exception] | None = None) -> None:
        super().__init__(message)
        self.errors = list(errors or [])

    def __str__(self) -> str:
        found = "".join(f"\n  feature {getattr(e, 'field_spec_index', '?')}: {e}" for e in self.errors)
        return super().__str__() + found


class MasterSchemaError(Exception):
    """There is no rule set for a schema version."""


class DescribeError(Exception):
    """Encodings cannot be described."""
