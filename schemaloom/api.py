"""The public face: schemas, their checks and their compiled converters."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemaloom.functions import canonical
from schemaloom.operators import exact, variant
from schemaloom.operators.typed import Compiler, check_typed, object_type
from schemaloom.plans import layout, objects
from schemaloom.plans.ast import DataError, SchemaError, Type, shown
from schemaloom.plans.mapping import Map, describe, map_schemas
from schemaloom.plans.parse import parse, scalars_of


class Schema:
    """A checked definition."""

    def __init__(self, raw: Any, preserve_in_ast: list[str] = (), preserve_in_fingerprint: list[str] = (), utf8_enums: bool = False, forward_reference: bool = False, defaults: str | None = None):
        if not set(preserve_in_fingerprint) <= set(preserve_in_ast):
            raise SchemaError("fingerprint should contain only fields from AST")
        if defaults not in (None, "auto"):
            raise SchemaError(f"Unknown value of defaults: {shown(defaults)}")
        self.type: Type = parse(raw, list(preserve_in_ast), utf8_enums, forward_reference, defaults)
        self.preserved = tuple(preserve_in_fingerprint)

    def __repr__(self) -> str:
        t = self.type
        return f"Schema ({t.label if t.kind != 'union' else 'union'})"

    def export(self) -> Any:
        return canonical.export(self.type)

    def fingerprint(self, algorithm: str = "sha256", size: int = 8) -> bytes:
        return canonical.fingerprint(self.type, algorithm, size, self.preserved)

    def spark_type(self):
        """The Spark type of the schema's objects."""
        check_typed(self.type)
        return object_type(self.type)

    def validate(self, data: Any) -> Any:
        """A normalised copy of one object, or DataError."""
        return objects.validate(self.type, data)

    def validate_json(self, df: DataFrame, column: str) -> DataFrame:
        """df with is_valid, error and value: the JSON text in the column, checked and normalised within the JVM. Recursive schemas and any are checked in Python, their value is JSON text."""
        if layout.recursive(self.type) or layout.holds_any(self.type):
            keep = list(df.columns)
            t = self.type
            out = exact.apply(df.withColumn("__json", F.col(column)), "__json", lambda x: objects.validate(t, x), "json", "json", keep)
            return out.withColumnRenamed("ok", "is_valid")
        out = df.withColumn("__c", variant.checked(self.type, F.col(column).cast("string")))
        return out.withColumn("error", F.col("__c.error")).withColumn("is_valid", F.col("error").isNull()).withColumn("value", F.col("__c.value")).drop("__c")

    def names(self, service_fields: list[str] = ()) -> list[str]:
        return [n for n, _ in layout.layout(self.type, scalars_of(list(service_fields)))]

    def types(self, service_fields: list[str] = ()) -> list[str]:
        return [t for _, t in layout.layout(self.type, scalars_of(list(service_fields)))]


def create(raw: Any, **options) -> tuple[bool, Schema | str]:
    """(True, schema) or (False, message); bad definitions don't raise."""
    try:
        return True, Schema(raw, **options)
    except SchemaError as e:
        return False, str(e)


def is_schema(x: Any) -> bool:
    return isinstance(x, Schema)


def _schema(x: Any) -> Schema:
    if not isinstance(x, Schema):
        raise SchemaError(f"Not a schema: {shown(x)}")
    return x


def validate(schema: Schema, data: Any) -> tuple[bool, Any]:
    try:
        return True, _schema(schema).validate(data)
    except DataError as e:
        return False, str(e)


def are_compatible(source: Schema, target: Schema, mode: str | None = None) -> tuple[bool, str | None]:
    """Whether data of one schema can become data of the other; mode "downgrade" looks at the source's aliases."""
    if mode not in (None, "downgrade"):
        raise SchemaError(f"Unknown mode: {shown(mode)}")
    try:
        map_schemas(_schema(source).type, _schema(target).type, mode == "downgrade")
        return True, None
    except SchemaError as e:
        return False, str(e)


def export(schema: Schema) -> Any:
    return _schema(schema).export()


def fingerprint(schema: Schema, algorithm: str = "sha256", size: int = 8) -> bytes:
    return _schema(schema).fingerprint(algorithm, size)


def get_names(schema: Schema, service_fields: list[str] = ()) -> list[str]:
    return _schema(schema).names(service_fields)


def get_types(schema: Schema, service_fields: list[str] = ()) -> list[str]:
    return _schema(schema).types(service_fields)


def place_of(t: Type) -> Callable[[str], Column]:
    """The way from a root field's name to its column in a staged frame."""
    number = {f.name: i for i, f in enumerate(t.fields)}
    return lambda name: F.col(f"__f{number[name]}")


@dataclass
class Compiled:
    """Converters of one schema, or from one to another.

    The plain methods take and give DataFrames of typed columns and run inside the JVM; they keep streaming frames
    streaming. The *_object methods convert one decoded object exactly; *_json and *_msgpack do so for a column.
    """

    source: Schema
    target: Schema
    maps: list[Map]
    service: list[Type]
    strict: bool = False
    nullable_records: bool = False

    # Typed columns

    def _staged(self, df: DataFrame, kept: list[Column] = (), checked: bool = False) -> tuple[DataFrame, Type, Callable[[str], Column]]:
        """kept as __k0, __k1 ... and the root's fields converted along all maps; their type, and a way to a field's column. If checked, __k0 is what is wrong with the row.

        Each step is a projection of its own over the root's columns, so expressions grow with the schema's width only;
        Catalyst folds the steps into one and prunes the fields that nothing asks for.
        """
        check_typed(self.source.type)
        check_typed(self.target.type)
        if self.source.type.kind != "record" or self.target.type.kind != "record":
            raise SchemaError("The columns of a frame are the fields of a record; the root isn't one")
        kept = [F.lit(None).cast("string"), *kept] if checked else kept
        names = [f"__k{i}" for i in range(len(kept))]
        df = df.select(*[c.alias(n) for c, n in zip(kept, names, strict=True)], *[F.col(f"`{f.name}`").alias(f"__f{i}") for i, f in enumerate(self.source.type.fields)])
        now = self.source.type
        for m in self.maps:
            wrong = [F.coalesce("__k0", *Compiler().field_problems(m, place_of(now), None)).alias("__k0")] if checked else []
            df = df.select(*wrong, *names[len(wrong) :], *[x.alias(f"__f{o}") for o, (_, x) in enumerate(Compiler(self.strict).fields(m, place_of(now)))])
            now = m.target
        return df, now, place_of(now)

    def convert(self, df: DataFrame) -> DataFrame:
        """Fields of the source to fields of the target: evolution without flattening."""
        out, t, at = self._staged(df)
        return out.select(*[at(f.name).alias(f.name) for f in t.fields if not f.hidden])

    def flatten_checked(self, df: DataFrame, keep: list[str] = ()) -> DataFrame:
        """The columns `keep`, ok boolean, error string, and tuple, a struct of the cells as names() says; NULL where the row has an error. The first error in schema order is told, with its path; no row ends the query."""
        source = Compiled(self.source, self.target, self.maps, [])
        out, t, at = source._staged(df, [F.col(f"`{k}`") for k in keep], checked=True)
        cells, names = Compiler().cells(t, at), [n for n, _ in layout.cells(replace(t, nullable=False))]
        made = F.struct(*[x.alias(n) for x, n in zip(cells, names, strict=True)])
        return out.select(*[F.col(f"__k{i}").alias(k) for i, k in enumerate(keep, 1)], F.col("__k0").isNull().alias("ok"), F.col("__k0").alias("error"), F.when(F.col("__k0").isNull(), made).alias("tuple"))

    def flatten(self, df: DataFrame, service: list[str | Column] = ()) -> DataFrame:
        """Service columns, then a column for each cell, named as names() says but for the service ones, which keep theirs."""
        if len(service) != len(self.service):
            raise SchemaError(f"Expecting {len(self.service)} service fields, got {len(service)}")
        kept = [F.col(s) if isinstance(s, str) else s for s in service]
        called = df.select(*kept).columns if kept else []
        out, t, at = self._staged(df, kept)
        cells, names = Compiler(self.strict).cells(t, at), [n for n, _ in layout.cells(replace(t, nullable=False))]
        return out.select(*[F.col(f"__k{i}").alias(n) for i, n in enumerate(called)], *[x.alias(n) for x, n in zip(cells, names, strict=True)])

    def unflatten(self, df: DataFrame, service: list[str] = ()) -> DataFrame:
        """Service columns, then the target's fields, from a frame with the source's cells under their names."""
        s = self.source.type
        check_typed(s)
        compiler = Compiler(self.strict)
        df = df.select(*service, *[x.alias(f"__f{i}") for i, x in enumerate(compiler.uncells(s, [F.col(f"`{n}`") for n in self.source.names()]))])
        for m in self.maps:
            df = df.select(*service, *[x.alias(f"__f{o}") for o, (_, x) in enumerate(compiler.fields(m, place_of(m.source)))])
        at = place_of(self.target.type)
        return df.select(*service, *[at(f.name).alias(f.name) for f in self._target_order() if not f.hidden])

    def _target_order(self) -> list:
        """Target fields as objects show them: those of the source in its order, then the new ones."""
        t = self.target.type.fields
        if len(self.maps) != 1:
            return t
        old = [p for p in self.maps[0].places if p is not None]
        return [t[p] for p in old] + [f for o, f in enumerate(t) if o not in set(old)]

    def xflatten(self, df: DataFrame, keep: list[str | Column] = ()) -> DataFrame:
        """The columns `keep` and updates, array<struct<op, pos, value variant>>: an entry for each cell that is present (not NULL) in the row."""
        check_typed(self.source.type)
        ops = Compiler(self.strict).updates(self._one_map(), lambda name: F.col(f"`{name}`"), 1 + len(self.service), self.nullable_records)
        return df.select(*keep, F.filter(F.array(*ops), lambda x: x.isNotNull()).alias("updates"))

    def xflatten_rows(self, df: DataFrame, keep: list[str]) -> DataFrame:
        """A row for each update: keep, op, pos, value string."""
        out = self.xflatten(df, keep).select(*keep, F.inline("updates"))
        return out.withColumn("value", F.try_variant_get("value", "$", "string"))

    def _one_map(self) -> Map:
        if len(self.maps) != 1:
            raise SchemaError("xflatten works along one pair of schemas")
        return self.maps[0]

    # One object

    def flatten_object(self, x: Any, *service: Any) -> list:
        head = self._service(service)
        for m in self.maps[:-1]:
            x = evolve(m, x)
        return head + objects.flatten(self.maps[-1], x)

    def unflatten_object(self, cells: list) -> tuple[Any, list]:
        """The object, and the service values."""
        if not isinstance(cells, (list, tuple)):
            raise objects.expecting([], "ARRAY", cells)
        n, s = len(self.service), self.source.type
        want = n + layout.width(s)
        if len(cells) != want:
            raise DataError(f"Expecting ARRAY of length {want}. Encountered ARRAY of length {len(cells)}.")
        head = [self._check(t, v, [i]) for i, (t, v) in enumerate(zip(self.service, cells, strict=False), 1)]
        out, _ = objects.unflatten(self.maps[0], list(cells), n, [])
        for m in self.maps[1:]:
            out = evolve(m, out)
        return out, head

    def xflatten_object(self, x: Any) -> list[list]:
        return objects.xflatten(self._one_map(), x, 1 + len(self.service), self.nullable_records)

    def _check(self, t: Type, v: Any, path: list) -> Any:
        return None if v is None and t.nullable else objects.scalar(t.kind, v, path)

    def _service(self, values: tuple) -> list:
        if len(values) != len(self.service):
            raise DataError(f"Expecting {len(self.service)} service fields, got {len(values)}")
        return [self._check(t, v, [i]) for i, (t, v) in enumerate(zip(self.service, values, strict=True), 1)]

    # Columns of JSON or MessagePack, exactly

    def _apply(self, df: DataFrame, column: str, what: str, source: str, sink: str, keep: list[str] | None) -> DataFrame:
        work = {"flatten": self.flatten_object, "unflatten": lambda x: self.unflatten_object(x)[0], "xflatten": self.xflatten_object}[what]
        return exact.apply(df, column, work, source, sink, keep)

    def flatten_json(self, df: DataFrame, column: str, keep: list[str] | None = None) -> DataFrame:
        return self._apply(df, column, "flatten", "json", "json", keep)

    def unflatten_json(self, df: DataFrame, column: str, keep: list[str] | None = None) -> DataFrame:
        return self._apply(df, column, "unflatten", "json", "json", keep)

    def xflatten_json(self, df: DataFrame, column: str, keep: list[str] | None = None) -> DataFrame:
        return self._apply(df, column, "xflatten", "json", "json", keep)

    def flatten_msgpack(self, df: DataFrame, column: str, keep: list[str] | None = None, source: str = "msgpack") -> DataFrame:
        return self._apply(df, column, "flatten", source, "msgpack", keep)

    def unflatten_msgpack(self, df: DataFrame, column: str, keep: list[str] | None = None, source: str = "msgpack") -> DataFrame:
        return self._apply(df, column, "unflatten", source, "msgpack", keep)

    def xflatten_msgpack(self, df: DataFrame, column: str, keep: list[str] | None = None, source: str = "msgpack") -> DataFrame:
        return self._apply(df, column, "xflatten", source, "msgpack", keep)

    def describe(self) -> str:
        """What the converters do, as text: the mapping between each pair of revisions."""
        return "\n\n".join("\n".join(describe(m)) for m in self.maps)

    def names(self) -> list[str]:
        return self.target.names([t.kind + "*" * t.nullable for t in self.service])

    def types(self) -> list[str]:
        return self.target.types([t.kind + "*" * t.nullable for t in self.service])


def evolve(m: Map, x: Any) -> Any:
    """One object of the source as one of the target, by way of the source's cells."""
    same = map_schemas(m.source, m.source)
    return objects.unflatten(m, objects.flatten(same, x), 0, [])[0]


def compile(*schemas: Schema, downgrade: bool = False, service_fields: list[str] = (), strict: bool = False, alpha_nullable_record_xflatten: bool = False) -> Compiled:
    """Converters of one schema, from one to another, or along a chain of revisions."""
    if not schemas:
        raise SchemaError("Expecting a schema")
    types = [_schema(s).type for s in schemas]
    for t in types:
        if layout.holds_any(t):
            raise SchemaError("any can't be compiled")
    pairs = list(zip(types, types[1:], strict=False)) or [(types[0], types[0])]
    return Compiled(schemas[0], schemas[-1], [map_schemas(a, b, downgrade) for a, b in pairs], scalars_of(list(service_fields)), strict, alpha_nullable_record_xflatten)


__all__ = ["Compiled", "DataError", "Schema", "SchemaError", "are_compatible", "compile", "create", "export", "fingerprint", "get_names", "get_types", "is_schema", "validate"]
