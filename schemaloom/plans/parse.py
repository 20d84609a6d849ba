"""Definitions, as decoded JSON, to schema trees, with every check that a definition must pass."""

from __future__ import annotations

import copy
import json
import re
from typing import Any

from schemaloom.plans import objects
from schemaloom.plans.ast import ABSENT, PRIMITIVES, SCALARS, Body, DataError, Field, SchemaError, Type, shown

NAME = re.compile(r"[_A-Za-z][_0-9A-Za-z]*(\.[_A-Za-z][_0-9A-Za-z]*)*")
SIMPLE = re.compile(r"[_A-Za-z][_0-9A-Za-z]*")
#: Attributes that the parser itself understands; preserving them needs no option.
KNOWN = {"type", "name", "namespace", "aliases", "fields", "symbols", "size", "items", "values", "default", "hidden"}


class Parser:
    """Reads one definition. `where` is the location so far, one label a level."""

    def __init__(self, keep: list[str], utf8_enums: bool, forward_reference: bool):
        self.keep, self.utf8_enums, self.forward = [k for k in keep if k not in KNOWN - {"aliases"}], utf8_enums, forward_reference
        self.types: dict[str, Body] = {}
        self.waiting: dict[str, list[str]] = {}
        self.where: list[str] = []
        self.open: set[int] = set()
        self.late: list[tuple[list[str], Field]] = []

    def fail(self, message: str) -> SchemaError:
        return SchemaError(f"{'/'.join(self.where)}: {message}" if self.where else message)

    # Names

    def full(self, name: str, space: str | None) -> str:
        return name if "." in name or not space else f"{space}.{name}"

    def named(self, raw: dict, space: str | None) -> tuple[str, str | None]:
        """The full name that a definition gives, and the namespace within it."""
        if "name" not in raw or raw["name"] is None:
            raise self.fail('Must have a "name"')
        name = raw["name"]
        if not isinstance(name, str):
            raise self.fail(f"Bad type name: {shown(name)}")
        if "." not in name and raw.get("namespace") is not None:
            space = raw["namespace"]
            if not isinstance(space, str) or space and not NAME.fullmatch(space):
                raise self.fail(f"Bad type name: {shown(space)}.{name}")
        name = self.full(name, space)
        if not NAME.fullmatch(name):
            raise self.fail(f"Bad type name: {name}")
        if name in PRIMITIVES:
            raise self.fail(f"Redefining primitive type name: {name}")
        return name, name.rpartition(".")[0] or None

    def define(self, name: str, kind: str) -> Body:
        body = self.types.get(name)
        if body and body.kind:
            raise self.fail(f"Type name already defined: {name}")
        body = body or self.types.setdefault(name, Body(name))
        body.kind = kind
        self.waiting.pop(name, None)
        return body

    def aliases(self, raw: dict, space: str | None) -> list[str] | None:
        given = raw.get("aliases")
        if given is None:
            return None
        if not isinstance(given, list):
            raise self.fail('Property "aliases" must be a list')
        out = []
        for alias in given:
            if not isinstance(alias, str) or not NAME.fullmatch(self.full(alias, space)):
                raise self.fail(f"Bad type name: {shown(alias)}")
            alias = self.full(alias, space)
            if alias in self.types and self.types[alias].kind:
                raise self.fail(f"Alias type name already defined: {alias}")
            self.types[alias] = Body(alias, "alias")
            out.append(alias)
        return out

    # Types

    def type(self, raw: Any, space: str | None = None, records: tuple[str, ...] = (), path: tuple[str, ...] = ()) -> Type:
        """records, path: the records that contain what is read here directly, without a union, array or map between, and the fields on the way."""
        if isinstance(raw, (dict, list)):
            if id(raw) in self.open:
                raise self.fail("Infinite loop detected in the data")
            self.open.add(id(raw))
            try:
                return self.union(raw, space) if isinstance(raw, list) else self.complex(raw, space, records, path)
            finally:
                self.open.discard(id(raw))
        if not isinstance(raw, str):
            raise self.fail(f"Unknown Avro type: {shown(raw)}")
        return self.reference(raw, space, records, path)

    def reference(self, raw: str, space: str | None, records: tuple[str, ...], path: tuple[str, ...]) -> Type:
        name, nullable = (raw[:-1], True) if raw.endswith("*") else (raw, False)
        if name in PRIMITIVES:
            return Type(name, nullable)
        body = self.types.get(self.full(name, space)) or self.types.get(name)
        if body is None or body.kind == "alias":
            if not self.forward or not NAME.fullmatch(name):
                raise self.fail(f"Unknown Avro type: {raw}")
            body = self.types.setdefault(self.full(name, space), Body(self.full(name, space)))
            self.waiting.setdefault(body.name, list(self.where))
        if body.name in records and not nullable:
            names = list(path)
            raise SchemaError(f"Record {body.name} contains itself via {'/'.join(names[records.index(body.name):])}")
        return Type(body.name, nullable, body)

    def union(self, raw: list, space: str | None) -> Type:
        if not raw:
            raise self.fail("Union type must have at least one branch")
        out = Type("union")
        self.where.append("<union>")
        for k, one in enumerate(raw, 1):
            self.where.append(f"<branch-{k}>")
            if isinstance(one, list):
                raise self.fail("Union may not immediately contain other unions")
            branch = self.type(one, space)
            if out.branch(branch.tag) is not None:
                raise self.fail(f"Union contains {branch.tag} twice")
            out.branches.append(branch)
            self.where.pop()
        self.where.pop()
        return out

    def extras(self, raw: dict) -> dict[str, Any]:
        return {k: copy.deepcopy(raw[k]) for k in self.keep if k in raw}

    def complex(self, raw: dict, space: str | None, records: tuple[str, ...], path: tuple[str, ...]) -> Type:
        if not raw:
            raise self.fail("Union type must have at least one branch")
        if raw.get("type") is None:
            raise self.fail('Must have a "type"')
        kind = raw["type"]
        if isinstance(kind, (dict, list)):
            raise self.fail(f"Unknown Avro type: {json.dumps(kind)}")
        kind, nullable = shown(kind), False
        if kind.endswith("*"):
            kind, nullable = kind[:-1], True
        if kind in PRIMITIVES:
            return Type(kind, nullable, extra=self.extras(raw))
        reader = {"record": self.record, "enum": self.enum, "fixed": self.fixed}.get(kind)
        self.where.append(f"<{kind}>" if reader or kind in ("array", "map") else "")
        if kind in ("array", "map"):
            key = "items" if kind == "array" else "values"
            if raw.get(key) is None:
                raise self.fail(f'{kind.capitalize()} type must have "{key}"')
            out = Type(kind, nullable, items=self.type(raw[key], space), extra=self.extras(raw))
        elif reader:
            name, inner = self.named(raw, space)
            body = self.define(name, kind)
            self.where[-1] = name
            body.aliases = self.aliases(raw, inner)
            body.extra = self.extras(raw)
            if kind == "record":
                self.record(raw, body, inner, records if nullable else records + (name,), path)
            else:
                reader(raw, body)
            out = Type(name, nullable, body)
        else:
            self.where.pop()
            try:
                return self.reference(kind + "*" * nullable, space, records, path)
            except SchemaError as e:
                if "contains itself" in str(e):
                    raise
                raise self.fail(f"Unknown Avro type: {kind}") from None
        self.where.pop()
        return out

    def record(self, raw: dict, body: Body, space: str | None, records: tuple[str, ...], path: tuple[str, ...]) -> None:
        given = raw.get("fields")
        if given is None:
            raise self.fail('Record type must have "fields"')
        if not isinstance(given, list) and given != {}:
            raise self.fail('Record "fields" must be a list')
        if not given:
            raise self.fail("Record type must have at least one field")
        names: dict[str, int] = {}
        for k, one in enumerate(given, 1):
            self.where.append(f"<field-{k}>")
            if not isinstance(one, dict):
                raise self.fail("Record field must be a list")
            if one.get("name") is None:
                raise self.fail('Record field must have a "name"')
            name = one["name"]
            if not isinstance(name, str) or not SIMPLE.fullmatch(name):
                raise self.fail(f"Bad record field name: {shown(name)}")
            if name in names:
                raise self.fail(f"Record contains field {name} twice")
            names[name] = k
            self.where[-1] = name
            if one.get("type") is None:
                raise self.fail('Record field must have a "type"')
            depth = path if len(records) else ()
            made = Field(name, self.type(one["type"], space, records, (*depth, name)), aliases=None, hidden=bool(one.get("hidden")), extra=self.extras(one))
            body.fields.append(made)
            if "default" in one:
                made.default = copy.deepcopy(one["default"])
                self.late.append((list(self.where), made))
            if (aliases := one.get("aliases")) is not None:
                if not isinstance(aliases, list):
                    raise self.fail('Property "aliases" must be a list')
                for alias in aliases:
                    if not isinstance(alias, str) or not SIMPLE.fullmatch(alias):
                        raise self.fail(f"Bad field alias name: {shown(alias)}")
                    if alias in names:
                        raise self.fail(f"Alias field name already defined: {alias}")
                    names[alias] = k
                made.aliases = list(aliases)
            self.where.pop()

    def enum(self, raw: dict, body: Body) -> None:
        given = raw.get("symbols")
        if given is None:
            raise self.fail('Enum type must have "symbols"')
        if not isinstance(given, list) and given != {}:
            raise self.fail('Enum "symbols" must be a list')
        if not given:
            raise self.fail("Enum type must contain at least one symbol")
        for symbol in given:
            if not isinstance(symbol, str) or not (self.utf8_enums or SIMPLE.fullmatch(symbol)):
                raise self.fail(f"Bad enum symbol name: {shown(symbol)}")
            if symbol in body.symbols:
                raise self.fail(f"Enum contains symbol {symbol} twice")
            body.symbols.append(symbol)

    def fixed(self, raw: dict, body: Body) -> None:
        size = raw.get("size")
        if size is None:
            raise self.fail('Fixed type must have "size"')
        if isinstance(size, bool) or not isinstance(size, (int, float)) or size != int(size) or size < 1:
            raise self.fail(f"Bad fixed type size: {shown(size)}")
        body.size = int(size)

    def finish(self) -> None:
        """Checks what had to wait for the end: forward references and defaults."""
        for name, where in self.waiting.items():
            self.where = where
            raise self.fail(f"Unknown Avro type: {name}")
        for where, field in self.late:
            self.where = where
            try:
                field.default = objects.default_value(field.type, field.default)
            except DataError as e:
                raise self.fail(f"Default value not valid ({e})") from None


def augment(t: Type, seen: frozenset[int] = frozenset()) -> Any:
    """The zero value of a type, for defaults='auto'; fields without a default get theirs on the way."""
    zero = {"null": None, "boolean": False, "int": 0, "long": 0, "float": 0.0, "double": 0.0, "bytes": "", "string": "", "array": [], "map": {}, "any": None}
    if t.kind == "union":
        first = t.branches[0]
        return None if first.kind == "null" else {first.tag: augment(first, seen)}
    if t.kind == "enum":
        return t.body.symbols[0]
    if t.kind == "fixed":
        return "\0" * t.body.size
    if t.kind != "record":
        return zero[t.kind]
    if id(t.body) in seen:
        return ABSENT
    out = {}
    for f in t.fields:
        value = f.default if f.has_default else (None if f.type.nullable else augment(f.type, seen | {id(t.body)}))
        if value is ABSENT:
            return ABSENT
        if not f.has_default:
            f.default = value
        out[f.name] = value
    return out


def parse(raw: Any, preserve: list[str] = (), utf8_enums: bool = False, forward_reference: bool = False, defaults: str | None = None) -> Type:
    parser = Parser(list(preserve), utf8_enums, forward_reference)
    out = parser.type(raw)
    parser.finish()
    if defaults == "auto":
        augment(out)
    return out


def scalars_of(names: list[str]) -> list[Type]:
    """Service fields: scalar types by name."""
    out = []
    for name in names:
        if not isinstance(name, str) or name.rstrip("*") not in SCALARS or name.rstrip("*") == "null":
            raise SchemaError(f"Invalid service field type: {shown(name)}")
        out.append(Type(name.rstrip("*"), name.endswith("*")))
    return out
