"""Export and fingerprint: the canonical form of a schema, as plain data, as JSON and as a digest."""

from __future__ import annotations

import copy
import hashlib
import json
from typing import Any

from schemaloom.plans.ast import SchemaError, Type

#: The order of attributes in the text that is hashed.
HASHED = ("name", "type", "fields", "symbols", "items", "values", "size")


def export(t: Type, seen: set[str] | None = None) -> Any:
    """Plain data that defines the schema: a named type is defined where it is first used and referred to later."""
    seen = set() if seen is None else seen
    star = "*" if t.nullable else ""
    if t.kind == "union":
        return [export(b, seen) for b in t.branches]
    if t.body is None:
        if t.items is not None:
            return {"type": t.kind + star, ("items" if t.kind == "array" else "values"): export(t.items, seen)} | copy.deepcopy(t.extra)
        return {"type": t.kind + star} | copy.deepcopy(t.extra) if t.extra else t.kind + star
    body = t.body
    if body.name in seen:
        return body.name + star
    seen.add(body.name)
    out: dict[str, Any] = {"type": t.kind + star, "name": body.name}
    if body.aliases is not None:
        out["aliases"] = list(body.aliases)
    if t.kind == "record":
        out["fields"] = [export_field(f, seen) for f in body.fields]
    elif t.kind == "enum":
        out["symbols"] = list(body.symbols)
    else:
        out["size"] = body.size
    return out | copy.deepcopy(body.extra)


def export_field(f, seen: set[str]) -> dict[str, Any]:
    out: dict[str, Any] = {"name": f.name, "type": export(f.type, seen)}
    if f.has_default:
        out["default"] = copy.deepcopy(f.default)
    if f.aliases is not None:
        out["aliases"] = list(f.aliases)
    if f.hidden:
        out["hidden"] = True
    return out | copy.deepcopy(f.extra)


def canonical_json(data: Any, extra: tuple[str, ...] = ()) -> str:
    """The text that a fingerprint is of: attributes that matter, in fixed order, then the extra ones sorted."""
    if isinstance(data, list):
        return "[" + ",".join(canonical_json(x, extra) for x in data) + "]"
    if isinstance(data, dict):
        return "{" + ",".join(f"{json.dumps(k)}:{canonical_json(data[k], extra)}" for k in (*HASHED, *sorted(extra)) if data.get(k) is not None) + "}"
    return json.dumps(data, ensure_ascii=False)


def fingerprint(t: Type, algorithm: str = "sha256", size: int = 8, extra: tuple[str, ...] = ()) -> bytes:
    if algorithm not in hashlib.algorithms_available:
        raise SchemaError(f"The hash function {algorithm} is not supported")
    return hashlib.new(algorithm, canonical_json(export(t), extra).encode()).digest()[:size]
