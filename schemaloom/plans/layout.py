"""The flat layout of a type: names, types, widths. The one place that knows how objects become cells."""

from __future__ import annotations

from schemaloom.plans.ast import SchemaError, Type

SERVICE, TAG = "$service_field$", "$type$"


def width(t: Type) -> int:
    """Cells that a value takes where it stands in a tuple."""
    if t.kind == "union":
        return 2
    return inner_width(t) if t.kind == "record" and not t.nullable else 1


def inner_width(t: Type) -> int:
    """Cells of a record's own array."""
    return sum(width(f.type) for f in t.fields)


def cells(t: Type, path: str = "") -> list[tuple[str, str]]:
    """(name, type) of each cell."""
    star = "*" if t.nullable else ""
    if t.kind == "union":
        return [(f"{path}.{TAG}" if path else TAG, "union_type"), (path, "union_value")]
    if t.kind == "record" and not t.nullable:
        return [c for f in t.fields for c in cells(f.type, f"{path}.{f.name}" if path else f.name)]
    return [(path, t.kind + star)]


def layout(t: Type, service: list[Type] = ()) -> list[tuple[str, str]]:
    if t.kind != "record" or t.nullable:
        raise SchemaError("The schema of a flat layout must be a record, not nullable")
    return [(SERVICE, s.kind + "*" * s.nullable) for s in service] + cells(t)


def recursive(t: Type, open_: frozenset[int] = frozenset()) -> bool:
    """Whether a type contains itself."""
    if t.body is not None:
        if id(t.body) in open_:
            return True
        open_ = open_ | {id(t.body)}
    return any(recursive(x, open_) for x in [*(f.type for f in t.fields), *t.branches, *([t.items] if t.items else [])])


def holds_any(t: Type, seen: set[int] | None = None) -> bool:
    seen = set() if seen is None else seen
    if t.kind == "any":
        return True
    if t.body is not None:
        if id(t.body) in seen:
            return False
        seen.add(id(t.body))
    return any(holds_any(x, seen) for x in [*(f.type for f in t.fields), *t.branches, *([t.items] if t.items else [])])
