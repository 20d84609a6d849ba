"""Conversions of typed columns: every operator is a projection of built-in expressions that Catalyst can fold and prune.

A record is a struct column whose fields are the schema's; a union is a struct with `$type$`, the branch's number, and
a column for each branch that isn't null. NULL means absent: where the target has a default, it takes its place. With
strict=True a value that doesn't suit the schema (a missing required field, an unknown symbol, a wrong length) ends the
query with the message that the exact path gives; otherwise it becomes NULL. As pruned columns aren't computed, they
aren't checked either, unless strict expressions are kept in the result. problems() gives the same messages, with paths,
as texts, so that a row can carry its error.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from schemaloom.operators.paths import below, first_of, located
from schemaloom.plans.ast import SchemaError, Type
from schemaloom.plans.layout import TAG, holds_any, recursive, width
from schemaloom.plans.mapping import Map

SCALAR_TYPES = {"null": T.NullType(), "boolean": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "bytes": T.BinaryType(), "string": T.StringType()}


def check_typed(t: Type) -> None:
    if holds_any(t):
        raise SchemaError("any can't be compiled")
    if recursive(t):
        raise SchemaError("A recursive schema has no Spark type; use the object methods")


def object_type(t: Type) -> T.DataType:
    """The Spark type of a schema's objects."""
    if t.is_scalar:
        return SCALAR_TYPES[t.kind]
    if t.kind == "fixed":
        return T.BinaryType()
    if t.kind == "enum":
        return T.StringType()
    if t.kind == "any":
        return T.VariantType()
    if t.kind == "array":
        return T.ArrayType(object_type(t.items), t.items.nullable)
    if t.kind == "map":
        return T.MapType(T.StringType(), object_type(t.items), t.items.nullable)
    if t.kind == "union":
        return T.StructType([T.StructField(TAG, T.IntegerType()), *(T.StructField(b.tag, object_type(b)) for b in t.branches if b.kind != "null")])
    return T.StructType([T.StructField(f.name, object_type(f.type), True, dict(f.extra)) for f in t.fields])


def cell_type(t: Type) -> T.DataType:
    """The Spark type of a value in one cell of a tuple."""
    if t.kind == "enum":
        return T.IntegerType()
    if t.kind == "array":
        return T.ArrayType(cell_type(t.items))
    if t.kind == "map":
        return T.MapType(T.StringType(), cell_type(t.items))
    if t.kind == "union":
        return T.StructType([T.StructField(TAG, T.IntegerType()), T.StructField("value", union_cell_type(t))])
    if t.kind == "record":
        return T.StructType([T.StructField(f"c{i}", x) for i, x in enumerate(cell_types(t))])
    return object_type(t)


def union_cell_type(t: Type) -> T.DataType:
    return T.StructType([T.StructField(b.tag, cell_type(b)) for b in t.branches if b.kind != "null"])


def cell_types(t: Type) -> list[T.DataType]:
    """One type for each cell of an inlined record."""
    out = []
    for f in t.fields:
        if f.type.kind == "union":
            out += [T.IntegerType(), union_cell_type(f.type)]
        elif f.type.kind == "record" and not f.type.nullable:
            out += cell_types(f.type)
        else:
            out.append(cell_type(f.type))
    return out


def literal(value: Any, kind: T.DataType) -> Column:
    """A default, as an expression of a Spark type."""
    if value is None:
        return F.lit(None).cast(kind)
    if isinstance(kind, T.ArrayType):
        return F.array(*[literal(v, kind.elementType) for v in value]).cast(kind)
    if isinstance(kind, T.MapType):
        return F.create_map(*[x for k, v in value.items() for x in (F.lit(k), literal(v, kind.valueType))]).cast(kind)
    if isinstance(kind, T.StructType):
        return F.struct(*[literal(value.get(f.name), f.dataType).alias(f.name) for f in kind])
    if isinstance(kind, T.BinaryType):
        return F.lit(bytearray(value.encode() if isinstance(value, str) else value))
    return F.lit(value).cast(kind)


def default_object(t: Type, value: Any) -> Column:
    """A default in a type's object form."""
    if t.kind == "union":
        at = t.branch("null") if value is None else t.branch(next(iter(value)))
        return F.struct(F.lit(at).cast("int").alias(TAG), *[(default_object(b, value[b.tag]) if value is not None and b.tag in value else F.lit(None).cast(object_type(b))).alias(b.tag) for b in t.branches if b.kind != "null"])
    if t.kind == "record" and value is not None:
        return F.struct(*[default_object(f.type, value.get(f.name)).alias(f.name) for f in t.fields])
    if t.kind == "array" and value:
        return F.array(*[default_object(t.items, v) for v in value])
    if t.kind == "map" and value:
        return F.create_map(*[x for k, v in value.items() for x in (F.lit(k), default_object(t.items, v))])
    return literal(value, object_type(t))


class Compiler:
    """Turns Maps into Columns."""

    def __init__(self, strict: bool = False):
        self.strict = strict

    def refuse(self, bad: Column, message: Column | str, value: Column, kind: str | T.DataType) -> Column:
        """value, but where bad: an error if strict, NULL if not."""
        message = F.lit(message) if isinstance(message, str) else message
        other = F.raise_error(message).cast(kind) if self.strict else F.lit(None).cast(kind)
        return F.when(bad, other).otherwise(value)

    # Values that stay objects: evolution and validation

    def convert(self, m: Map, c: Column) -> Column:
        """An object of the source as an object of the target."""
        s, t = m.source, m.target
        if m.union:
            return self._convert_union(m, c)
        if s.is_scalar:
            return c if s.kind == t.kind else c.cast(SCALAR_TYPES[t.kind])
        if s.kind == "fixed":
            return self.refuse(c.isNotNull() & (F.octet_length(c) != s.body.size), F.concat(F.lit(f"Expecting BIN of length {s.body.size}. Encountered BIN of length "), F.octet_length(c).cast("string"), F.lit(".")), c, "binary")
        if s.kind == "enum":
            common = [x for x, p in zip(s.body.symbols, m.places, strict=True) if p is not None]
            late = F.when(c.isin(*s.body.symbols), F.lit(" (schema versioning)")).otherwise("")
            return self.refuse(c.isNotNull() & ~c.isin(*common), F.concat(F.lit('Bad value: "'), c, F.lit('"'), late), c, "string")
        if s.kind == "array":
            return F.transform(c, lambda x: self.convert(m.parts[0], x))
        if s.kind == "map":
            return F.transform_values(c, lambda _, x: self.convert(m.parts[0], x))
        out = F.struct(*[x.alias(f.name) for f, x in self.fields(m, c.__getitem__)])
        return F.when(c.isNotNull(), out) if s.nullable or t.nullable else out

    def fields(self, m: Map, at: Callable[[str], Column]):
        """(target field, Column) for the fields of a record, defaults filled in; `at` gives the source's field of a name."""
        back = {p: i for i, p in enumerate(m.places) if p is not None}
        for o, f in enumerate(m.target.fields):
            if o not in back:
                yield f, default_object(f.type, f.default)
                continue
            i = back[o]
            source = m.source.fields[i]
            given = at(source.name)
            value = self.convert(m.parts[i], given)
            if f.has_default and f.default is not None:
                value = F.when(given.isNull(), default_object(f.type, f.default)).otherwise(value)
            elif self.strict and not f.type.nullable and f.type.kind not in ("null", "union"):
                value = self.refuse(given.isNull(), f'Key missing: "{source.name}"', value, object_type(f.type))
            yield f, value

    def _convert_union(self, m: Map, c: Column) -> Column:
        s, t = m.source, m.target
        if s.kind != "union":
            at, part = m.places[0], m.parts[0]
            value = self.convert(part, c)
            tag = F.when(c.isNull(), F.lit(t.branch("null"))).otherwise(F.lit(at)).cast("int") if t.branch("null") is not None and s.kind != "null" else F.lit(at).cast("int")
            return F.struct(tag.alias(TAG), *[(value if o == at else F.lit(None).cast(object_type(b))).alias(b.tag) for o, b in enumerate(t.branches) if b.kind != "null"])
        tag = c[TAG]
        lost = [i for i, p in enumerate(m.places) if p is None]
        left = self.branch(s, lost, tag)
        if t.kind != "union":
            i = next(i for i, p in enumerate(m.places) if p is not None)
            value = self.convert(m.parts[i], c[s.branches[i].tag]) if s.branches[i].kind != "null" else F.lit(None)
            return self.refuse(left, self.versioning(s, tag), value, object_type(t)) if lost else value
        places = F.get(F.array(*[F.lit(p).cast("int") for p in m.places]), tag)
        places = self.refuse(left, self.versioning(s, tag), places, "int") if lost else places
        made: dict[int, list[Column]] = {}
        for i, p in enumerate(m.places):
            if p is not None and s.branches[i].kind != "null":
                made.setdefault(p, []).append(F.when(tag == i, self.convert(m.parts[i], c[s.branches[i].tag])))
        return F.struct(places.alias(TAG), *[(F.coalesce(*made[o]) if o in made else F.lit(None).cast(object_type(b))).alias(b.tag) for o, b in enumerate(t.branches) if b.kind != "null"])

    @staticmethod
    def branch(s: Type, lost: list[int], tag: Column) -> Column:
        return tag.isin(*lost) if lost else F.lit(False)

    @staticmethod
    def versioning(s: Type, tag: Column) -> Column:
        return F.concat(F.lit('Unknown key: "'), F.get(F.array(*[F.lit(b.tag) for b in s.branches]), tag), F.lit('" (schema versioning)'))

    # What doesn't suit, as texts

    def problems(self, m: Map, c: Column, path: Column | None) -> list[Column]:
        """Texts that are NULL where nothing is wrong with an object of the source, in schema order; none if nothing can be."""
        s = m.source
        if m.union:
            return self._union_problems(m, c, path) if s.kind == "union" else self.problems(m.parts[0], c, path)
        if s.kind == "fixed":
            n = F.octet_length(c)
            return [F.when(n != s.body.size, located(path, F.concat(F.lit(f"Expecting BIN of length {s.body.size}. Encountered BIN of length "), n.cast("string"), F.lit("."))))]
        if s.kind == "enum":
            common = [x for x, p in zip(s.body.symbols, m.places, strict=True) if p is not None]
            late = F.when(c.isin(*s.body.symbols), F.lit(" (schema versioning)")).otherwise("")
            return [F.when(~c.isin(*common), located(path, F.concat(F.lit('Bad value: "'), c, F.lit('"'), late)))]
        if s.kind in ("array", "map") and self.problems(m.parts[0], F.lit(None), path):
            if s.kind == "array":
                return [first_of(F.transform(c, lambda x, i: F.coalesce(*self.problems(m.parts[0], x, below(path, (i + 1).cast("string"))))))]
            return [first_of(F.transform(F.map_entries(c), lambda e: F.coalesce(*self.problems(m.parts[0], e["value"], below(path, e["key"])))))]
        if s.kind == "record":
            return [F.when(c.isNotNull(), x) for x in self.field_problems(m, c.__getitem__, path)]
        return []

    def _union_problems(self, m: Map, c: Column, path: Column | None) -> list[Column]:
        lost, out = [i for i, p in enumerate(m.places) if p is None], []
        if lost:
            out.append(F.when(self.branch(m.source, lost, c[TAG]), located(path, self.versioning(m.source, c[TAG]))))
        for i, (b, part) in enumerate(zip(m.source.branches, m.parts, strict=True)):
            if part is not None and b.kind != "null":
                out += [F.when(c[TAG] == i, x) for x in self.problems(part, c[b.tag], below(path, b.tag))]
        return out

    def field_problems(self, m: Map, at: Callable[[str], Column], path: Column | None) -> list[Column]:
        """Those of a record's fields, and then of the ones that are missing; `at` gives the source's field of a name."""
        out = [x for f, part in zip(m.source.fields, m.parts, strict=True) for x in self.problems(part, at(f.name), below(path, f.name))]
        back = {p: i for i, p in enumerate(m.places) if p is not None}
        for o, f in enumerate(m.target.fields):
            if o in back and not (f.has_default and f.default is not None) and not f.type.nullable and f.type.kind not in ("null", "union"):
                name = m.source.fields[back[o]].name
                out.append(F.when(at(name).isNull(), located(path, f'Key missing: "{name}"')))
        return out

    # Objects of the target to tuples

    def cell(self, t: Type, c: Column) -> Column:
        """An object of a type as one cell."""
        if t.kind == "enum":
            return F.when(c.isNotNull(), F.nullif(F.array_position(F.array(*[F.lit(x) for x in t.body.symbols]), c), F.lit(0).cast("bigint")) - 1).cast("int")
        if t.kind == "array":
            return c if same_cells(t.items) else F.transform(c, lambda x: self.cell(t.items, x))
        if t.kind == "map":
            return c if same_cells(t.items) else F.transform_values(c, lambda _, x: self.cell(t.items, x))
        if t.kind == "union":
            tag, value = self.union_cells(t, c)
            return F.struct(tag.alias(TAG), value.alias("value"))
        if t.kind == "record":
            return F.when(c.isNotNull(), F.struct(*[x.alias(f"c{i}") for i, x in enumerate(self.cells(t, c.__getitem__))]))
        return c

    def union_cells(self, t: Type, c: Column) -> tuple[Column, Column]:
        return c[TAG], F.struct(*[self.cell(b, c[b.tag]).alias(b.tag) for b in t.branches if b.kind != "null"])

    def cells(self, t: Type, at: Callable[[str], Column]) -> list[Column]:
        """The cells of an inlined record, `at` giving its field of a name."""
        out: list[Column] = []
        for f in t.fields:
            x = at(f.name)
            if f.type.kind == "union":
                out += self.union_cells(f.type, x)
            elif f.type.kind == "record" and not f.type.nullable:
                out += self.cells(f.type, x.__getitem__)
            else:
                out.append(self.cell(f.type, x))
        return out

    # Tuples to objects of their own type

    def uncell(self, t: Type, c: Column) -> Column:
        if t.kind == "enum":
            bad = c.isNotNull() & ~c.between(0, len(t.body.symbols) - 1)
            return self.refuse(bad, F.concat(F.lit("Bad value: "), c.cast("string")), F.get(F.array(*[F.lit(x) for x in t.body.symbols]), c), "string")
        if t.kind == "array":
            return c if same_cells(t.items) else F.transform(c, lambda x: self.uncell(t.items, x))
        if t.kind == "map":
            return c if same_cells(t.items) else F.transform_values(c, lambda _, x: self.uncell(t.items, x))
        if t.kind == "union":
            return self.ununion(t, c[TAG], c["value"])
        if t.kind == "record":
            many = len(cell_types(t))
            return F.when(c.isNotNull(), F.struct(*self.uncells(t, [c[f"c{i}"] for i in range(many)])))
        return c

    def ununion(self, t: Type, tag: Column, value: Column) -> Column:
        tag = self.refuse(~tag.between(0, len(t.branches) - 1), F.concat(F.lit("Bad value: "), tag.cast("string")), tag, "int")
        return F.struct(tag.alias(TAG), *[self.uncell(b, value[b.tag]).alias(b.tag) for b in t.branches if b.kind != "null"])

    def uncells(self, t: Type, columns: list[Column]) -> list[Column]:
        """The fields of an inlined record from its cells."""
        out, at = [], 0
        for f in t.fields:
            n = width(f.type)
            own = columns[at : at + n]
            if f.type.kind == "union":
                made = self.ununion(f.type, own[0], own[1])
            elif f.type.kind == "record" and not f.type.nullable:
                made = F.struct(*self.uncells(f.type, own))
            else:
                made = self.uncell(f.type, own[0])
            out.append(made.alias(f.name))
            at += n
        return out

    # Update lists

    def updates(self, m: Map, get: Callable[[str], Column], first: int, nullable_records: bool) -> list[Column]:
        """For each cell that may be present a Column: struct(op, pos, value variant), NULL if it isn't. Source order."""
        s, t = m.source, m.target
        starts, at = [], first
        for f in t.fields:
            starts.append(at)
            at += width(f.type)
        out: list[Column] = []
        for i, f in enumerate(s.fields):
            if m.places[i] is None:
                continue
            to, x, start = t.fields[m.places[i]].type, get(f.name), starts[m.places[i]]
            if to.kind == "union":
                tag, value = self.union_cells(to, self.convert(m.parts[i], x))
                present = x.isNotNull() & (x[TAG].isNotNull() if f.type.kind == "union" else F.lit(True))
                named = F.coalesce(*[variant(b, value[b.tag]) for b in to.branches if b.kind != "null"])
                out += [F.when(present, update(start, tag.cast("variant"))), F.when(present, update(start + 1, named))]
            elif to.kind == "record" and not to.nullable:
                out += self.updates(m.parts[i], x.__getitem__, start, nullable_records)
            else:
                if to.kind == "record" and not nullable_records:
                    raise SchemaError("Nullable record xflatten needs alpha_nullable_record_xflatten")
                out.append(F.when(x.isNotNull(), update(start, variant(to, self.cell(to, self.convert(m.parts[i], x))))))
        return out


def update(place: int, value: Column) -> Column:
    return F.struct(F.lit("=").alias("op"), F.lit(place).alias("pos"), value.alias("value"))


def variant(t: Type, c: Column) -> Column:
    """A cell as a variant; records within become objects."""
    return c.cast("variant") if t.is_scalar or t.kind in ("fixed", "enum") else F.to_variant_object(c)


def same_cells(t: Type) -> bool:
    """Whether a type's cells are its objects."""
    return t.is_scalar or t.kind == "fixed" or t.kind in ("array", "map") and same_cells(t.items)
