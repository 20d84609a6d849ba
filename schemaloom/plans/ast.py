"""The schema tree. Types are plain objects; a named type's body is shared by all its uses, so trees may be cyclic."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

SCALARS = ("null", "boolean", "int", "long", "float", "double", "bytes", "string")
PRIMITIVES = (*SCALARS, "any")

#: What a primitive may be widened to.
WIDENINGS = {
    "int": ("long", "float", "double"),
    "long": ("float", "double"),
    "float": ("double",),
    "string": ("bytes",),
    "bytes": ("string",),
}

#: Stands for "no default given", which is not the same as a null default.
ABSENT: Any = type("Absent", (), {"__repr__": lambda self: "ABSENT", "__bool__": lambda self: False, "__reduce__": lambda self: "ABSENT"})()


@dataclass(eq=False)
class Body:
    """What a record, enum or fixed is, whoever refers to it."""

    name: str
    kind: str | None = None
    aliases: list[str] | None = None
    fields: list[Field] = field(default_factory=list)
    symbols: list[str] = field(default_factory=list)
    size: int = 0
    extra: dict[str, Any] = field(default_factory=dict)


@dataclass(eq=False)
class Type:
    """A use of a type. kind: a primitive, array, map, union, or that of its body."""

    name_or_kind: str
    nullable: bool = False
    body: Body | None = None
    items: Type | None = None  # of arrays and maps
    branches: list[Type] = field(default_factory=list)
    extra: dict[str, Any] = field(default_factory=dict)

    @property
    def kind(self) -> str:
        return (self.body.kind or "unknown") if self.body else self.name_or_kind

    @property
    def fields(self) -> list[Field]:
        return self.body.fields if self.body else []

    @property
    def label(self) -> str:
        """How messages call the type."""
        return self.body.name if self.body else self.kind

    @property
    def tag(self) -> str:
        """The key of this branch in a union's objects."""
        return self.body.name if self.body else self.kind

    @property
    def is_scalar(self) -> bool:
        return self.kind in SCALARS

    def branch(self, tag: str) -> int | None:
        return next((i for i, b in enumerate(self.branches) if b.tag == tag), None)


@dataclass(eq=False)
class Field:
    name: str
    type: Type
    default: Any = ABSENT
    aliases: list[str] | None = None
    hidden: bool = False
    extra: dict[str, Any] = field(default_factory=dict)

    @property
    def has_default(self) -> bool:
        return self.default is not ABSENT


class SchemaError(ValueError):
    """A definition, pair of schemas or option that can't be used; str() is location and message."""


class DataError(ValueError):
    """A value that doesn't suit its schema; str() is location and message."""


def shown(value: Any) -> str:
    """A value as messages print it."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        return f"{value:.14g}"
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).decode("utf-8", "replace")
    return str(value)
