"""Whether, and how, data of one schema becomes data of another: a tree of Map beside the two schema trees."""

from __future__ import annotations

from dataclasses import dataclass, field

from schemaloom.plans.ast import ABSENT, WIDENINGS, SchemaError, Type


@dataclass(eq=False)
class Map:
    """How `source` values become `target` values.

    parts: one Map for each source field or branch, or the one of items; None for a branch that has no place.
    places: for each source field, branch or symbol its number in the target, None if it has none.
    union: whether either side is a union; the other one then counts as a union of one branch.
    """

    source: Type
    target: Type
    parts: list[Map | None] = field(default_factory=list)
    places: list[int | None] = field(default_factory=list)
    union: bool = False


class Matcher:
    """Builds Maps. downgrade: aliases of the source are looked at instead of the target's."""

    def __init__(self, downgrade: bool):
        self.downgrade = downgrade
        self.made: dict[tuple, Map] = {}
        self.where: list[str] = []

    def fail(self, message: str) -> SchemaError:
        return SchemaError(f"{'/'.join(self.where)}: {message}" if self.where else message)

    @staticmethod
    def called(a: str, b: str) -> str:
        return a if a == b else f"({a} aka {b})"

    def same_name(self, source: Type, target: Type) -> bool:
        if source.body.name == target.body.name:
            return True
        other = source.body.aliases if self.downgrade else target.body.aliases
        return (target.body.name if self.downgrade else source.body.name) in (other or [])

    def may_match(self, source: Type, target: Type) -> bool:
        """Whether two types that aren't both plain primitives could be one another's revisions."""
        if source.nullable and not target.nullable or source.kind != target.kind:
            return False
        return source.body is None or self.same_name(source, target)

    def fits(self, source: Type, target: Type) -> bool:
        """Whether a primitive is, or widens to, another."""
        if source.kind not in WIDENINGS and not source.is_scalar or not target.is_scalar:
            return False
        if source.nullable:
            return target.nullable and source.kind == target.kind
        return source.kind == target.kind or target.kind in WIDENINGS.get(source.kind, ())

    def map(self, source: Type, target: Type) -> Map:
        if "union" in (source.kind, target.kind):
            return self.union(source, target)
        if source.is_scalar or source.kind == "any":
            if not (self.fits(source, target) or source.kind == "any" == target.kind):
                raise self.fail(f"Types incompatible: {source.label} and {target.label}")
            return Map(source, target)
        if not self.may_match(source, target):
            raise self.fail(f"Types incompatible: {source.label} and {target.label}")
        label = f"<{source.kind}>" if source.body is None else self.called(source.body.name, target.body.name)
        self.where.append(label)
        try:
            rule = {"array": self.items, "map": self.items, "fixed": self.fixed, "enum": self.enum, "record": self.record}[source.kind]
            return rule(source, target)
        finally:
            self.where.pop()

    def items(self, source: Type, target: Type) -> Map:
        return Map(source, target, [self.map(source.items, target.items)])

    def fixed(self, source: Type, target: Type) -> Map:
        if source.body.size != target.body.size:
            raise self.fail(f"Size mismatch: {source.body.size} vs {target.body.size}")
        return Map(source, target)

    def enum(self, source: Type, target: Type) -> Map:
        places = [target.body.symbols.index(s) if s in target.body.symbols else None for s in source.body.symbols]
        if all(p is None for p in places):
            raise self.fail("No common symbols")
        return Map(source, target, places=places)

    def record(self, source: Type, target: Type) -> Map:
        key = (id(source.body), id(target.body), source.nullable, target.nullable)
        if key in self.made:
            return self.made[key]
        out = self.made[key] = Map(source, target)
        try:
            self.fields(out)
        except SchemaError:
            del self.made[key]
            raise
        return out

    def fields(self, out: Map) -> None:
        source, target = out.source.fields, out.target.fields
        if self.downgrade:
            names = {a: i for i, f in enumerate(source) for a in reversed(f.aliases or [])} | {f.name: i for i, f in enumerate(source)}
            back = {names[t.name]: o for o, t in enumerate(target) if t.name in names}
        else:
            names = {a: o for o, f in enumerate(target) for a in reversed(f.aliases or [])} | {f.name: o for o, f in enumerate(target)}
            back = {i: names[s.name] for i, s in enumerate(source) if s.name in names}
        out.places = [back.get(i) for i in range(len(source))]
        for i, f in enumerate(source):
            o = out.places[i]
            if o is None:  # a dropped field's values are still checked
                out.parts.append(Matcher(False).map(f.type, f.type))
                continue
            to = target[o]
            self.where.append(self.called(f.name, to.name))
            out.parts.append(self.map(f.type, to.type))
            if f.default not in (ABSENT, None, False) and to.default in (ABSENT, None, False):
                raise self.fail("Default value defined in source schema but missing in target schema")
            self.where.pop()
        for o, f in enumerate(target):
            if o not in out.places and (not f.has_default or f.default is None):
                raise self.fail(f"Field {f.name} is missing in source schema, and no default value was provided")

    def union(self, source: Type, target: Type) -> Map:
        left = source.branches if source.kind == "union" else [source]
        right = target.branches if target.kind == "union" else [target]
        out, error = Map(source, target, union=True), None
        self.where.append("<union>" if source.kind == "union" else f"<{source.kind}>" if source.body is None else self.called(source.body.name, target.body.name if target.body else source.body.name))
        depth = len(self.where)
        for s in left:
            part = place = None
            for o, t in enumerate(right):
                if s.is_scalar and not self.fits(s, t) or not s.is_scalar and not self.may_match(s, t):
                    continue
                try:
                    part, place = self.map(s, t), o
                    break
                except SchemaError as e:
                    error = e
                    del self.where[depth:]
            out.parts.append(part)
            out.places.append(place)
        if all(p is None for p in out.places):
            error = error or self.fail("No common types")
            self.where.pop()
            raise error
        self.where.pop()
        return out


def map_schemas(source: Type, target: Type, downgrade: bool = False) -> Map:
    return Matcher(downgrade).map(source, target)


def describe(m: Map, name: str = "", depth: int = 0, seen: frozenset[int] = frozenset()) -> list[str]:
    """A mapping as indented lines: what becomes of each field, branch and symbol."""
    s, t = m.source, m.target
    star = lambda x: x.label + "*" * x.nullable
    out = ["  " * depth + f"{name + ': ' if name else ''}{star(s)} -> {star(t)}"]
    if id(m) in seen:
        return [out[0] + " (as above)"]
    seen = seen | {id(m)}
    deeper = "  " * (depth + 1)
    if s.kind == "enum" and not m.union:
        out += [f"{deeper}{symbol}: {i} -> {p if p is not None else 'refused'}" for i, (symbol, p) in enumerate(zip(s.body.symbols, m.places, strict=True))]
    elif s.kind == "record" and not m.union:
        for f, part, p in zip(s.fields, m.parts, m.places, strict=True):
            out += describe(part, f.name if p is None else Matcher.called(f.name, t.fields[p].name), depth + 1, seen)
            if p is None:
                out.append(f"{deeper}  (checked and dropped)")
        out += [f"{deeper}{f.name}: default" for o, f in enumerate(t.fields) if o not in m.places]
    elif m.union:
        left = s.branches if s.kind == "union" else [s]
        for i, (b, part, p) in enumerate(zip(left, m.parts, m.places, strict=True)):
            out += [f"{deeper}branch {i} {star(b)}: refused"] if part is None else describe(part, f"branch {i} -> {p}", depth + 1, seen)
    elif m.parts:
        out += describe(m.parts[0], "items", depth + 1, seen)
    return out
