"""Validation of JSON text inside the JVM: error texts and normalised values as built-in expressions over VARIANT.

A scalar's kind is read from schema_of_variant before any cast, as casts of variants are lenient; objects and arrays are
taken apart once, and what is looked at often is bound to a lambda's variable, so that the text is parsed once a row and
each value is decoded once. The JSON parser sorts keys and has no place for duplicate ones, so of several unknown keys
the first in sorted order is named, and text with a duplicate key counts as no JSON. Recursive schemas and `any` take
the exact object path instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from schemaloom.operators.paths import below, first_of, located
from schemaloom.operators.typed import default_object, object_type
from schemaloom.plans.ast import Type
from schemaloom.plans.layout import TAG
from schemaloom.plans.objects import INT, LONG, takes_null


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def kind_of(v: Column) -> Column:
    """VOID, BOOLEAN, BIGINT, DECIMAL(..), DOUBLE, STRING, OBJECT<..>, ARRAY<..>."""
    return F.schema_of_variant(v)


def is_null(v: Column) -> Column:
    """Absent, or null."""
    return v.isNull() | F.is_variant_null(v)


def entries(v: Column) -> Column:
    """An object as a map, NULL for anything else."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def items(v: Column) -> Column:
    """An array's values, NULL for anything else."""
    return F.try_variant_get(v, "$", "array<variant>")


def as_text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def text(v: Column) -> Column:
    """A value as messages print it."""
    k = kind_of(v)
    return F.when(is_null(v), F.lit("null")).when(k.startswith("OBJECT") | k.startswith("ARRAY"), F.to_json(v)).otherwise(as_text(v))


def is_number(k: Column) -> Column:
    return (k == "BIGINT") | k.startswith("DECIMAL") | (k == "DOUBLE")


def integral(v: Column, k: Column, low: int, high: int) -> Column:
    """Whether a number is whole and in the range, each kind by its own digits."""
    double = F.try_variant_get(v, "$", "double")
    # The next whole number after `high` is a power of two, so it is the same number as a double.
    as_double = (double == F.floor(double)) & (double >= F.lit(float(low))) & (double < F.lit(float(high + 1)))
    whole = F.try_variant_get(v, "$", "decimal(38,0)").between(F.lit(low).cast("decimal(38,0)"), F.lit(high).cast("decimal(38,0)"))
    return F.when(k == "DOUBLE", as_double).when(k == "BIGINT", whole).otherwise(whole & ~as_text(v).rlike(r"\.\d*[1-9]"))


def scalar_bad(t: Type, v: Column, k: Column) -> Column:
    kind = t.kind
    if kind == "null":
        return ~is_null(v)
    if kind == "boolean":
        return k != "BOOLEAN"
    if kind in ("int", "long"):
        return ~(is_number(k) & F.coalesce(integral(v, k, *(INT if kind == "int" else LONG)), F.lit(False)))
    if kind in ("float", "double"):
        return ~is_number(k)
    if kind == "enum":
        return (k != "STRING") | ~as_text(v).isin(*t.body.symbols)
    if kind == "fixed":
        return (k != "STRING") | (F.octet_length(as_text(v)) != t.body.size)
    return k != "STRING"


def error(t: Type, v: Column, path: Column | None = None) -> Column:
    """What is wrong with a variant, NULL if nothing is."""
    bad = located(path, F.concat(F.lit(f"Not a {t.label}: "), text(v)))
    if t.kind == "union":
        found = _union_error(t, v, path)
    elif t.kind == "record":
        found = bound(entries(v), lambda m: F.when(m.isNull(), bad).otherwise(_record_error(t, m, path)))
    elif t.kind == "array":
        found = bound(items(v), lambda a: F.when(a.isNull(), bad).otherwise(first_of(F.transform(a, lambda x, i: error(t.items, x, below(path, (i + 1).cast("string")))))))
    elif t.kind == "map":
        found = bound(entries(v), lambda m: F.when(m.isNull(), bad).otherwise(first_of(F.transform(F.map_entries(m), lambda e: error(t.items, e["value"], below(path, e["key"]))))))
    else:
        found = F.when(bound(kind_of(v), lambda k: scalar_bad(t, v, k)), bad)
    return F.when(is_null(v), F.lit(None).cast("string")).otherwise(found) if t.nullable else found


def _union_error(t: Type, v: Column, path: Column | None) -> Column:
    def of(m: Column) -> Column:
        keys = F.map_keys(m)
        first, inner = F.get(keys, 0), F.lit(None).cast("string")
        for b in t.branches:
            if b.kind != "null":
                inner = F.when(first == b.tag, error(b, F.try_element_at(m, F.lit(b.tag)), below(path, b.tag))).otherwise(inner)
        unknown = ~first.isin(*[b.tag for b in t.branches])
        return (
            F.when(m.isNull() | (F.size(m) == 0), located(path, F.concat(F.lit("Not a union: "), text(v))))
            .when(unknown, located(below(path, first), "Unexpected key in union"))
            .otherwise(F.coalesce(inner, F.when(F.size(m) > 1, located(below(path, F.get(keys, 1)), "Unexpected key in union"))))
        )

    on_null = F.lit(None).cast("string") if t.branch("null") is not None else located(path, "Unexpected type in union: null")
    return F.when(is_null(v), on_null).otherwise(bound(entries(v), of))


def _field_error(f, path: Column | None) -> Callable[[Column], Column]:
    optional = f.has_default and (f.default is not None or f.type.kind == "null") or takes_null(f.type)
    missing = F.lit(None).cast("string") if optional else located(path, f"Field {f.name} missing")
    return lambda x: F.when(is_null(x), missing).otherwise(error(f.type, x, below(path, f.name)))


def _record_error(t: Type, m: Column, path: Column | None) -> Column:
    unknown = F.get(F.array_except(F.map_keys(m), F.array(*[F.lit(f.name) for f in t.fields])), 0)
    found = [F.when(F.size(m) > F.size(F.map_filter(m, lambda k, _: k.isin(*[f.name for f in t.fields]))), located(below(path, unknown), "Unknown field"))]
    for f in t.fields:
        found.append(bound(F.try_element_at(m, F.lit(f.name)), _field_error(f, path)))
    return F.coalesce(*found)


def value(t: Type, v: Column) -> Column:
    """The normalised value, in the schema's object type; only meaningful where error() is NULL."""
    kind = object_type(t)
    if t.kind in ("int", "long"):
        # A double's digits are exact as a decimal only up to 2 ** 53; beyond it is cast as what it is.
        out = F.when(kind_of(v) == "DOUBLE", F.try_variant_get(v, "$", "double").try_cast(kind)).otherwise(F.try_variant_get(v, "$", "decimal(38,0)").try_cast(kind))
    elif t.kind == "float" or t.kind == "double" or t.kind == "boolean":
        out = F.try_variant_get(v, "$", kind.simpleString())
    elif t.kind in ("bytes", "fixed"):
        out = as_text(v).cast("binary")
    elif t.kind in ("string", "enum"):
        out = as_text(v)
    elif t.kind == "null":
        out = F.lit(None)
    elif t.kind == "array":
        out = F.transform(items(v), lambda x: value(t.items, x))
    elif t.kind == "map":
        out = F.transform_values(entries(v), lambda _, x: value(t.items, x))
    elif t.kind == "union":

        def branch(m: Column) -> Column:
            first = F.get(F.map_keys(m), 0)
            tag = F.when(is_null(v), F.lit(t.branch("null"))).otherwise(F.array_position(F.array(*[F.lit(b.tag) for b in t.branches]), first) - 1).cast("int")
            return F.struct(tag.alias(TAG), *[value(b, F.try_element_at(m, F.lit(b.tag))).alias(b.tag) for b in t.branches if b.kind != "null"])

        return bound(entries(v), branch)
    else:

        def fields(m: Column) -> Column:
            made = []
            for f in t.fields:
                x = F.try_element_at(m, F.lit(f.name))
                one = value(f.type, x)
                if f.has_default and f.default is not None:
                    one = F.when(is_null(x), default_object(f.type, f.default)).otherwise(one)
                made.append(one.alias(f.name))
            return F.struct(*made)

        out = bound(entries(v), fields)
    return F.when(~is_null(v), out) if t.nullable else out


def checked(t: Type, column: Column) -> Column:
    """A struct of error string and value for JSON text; the text is parsed once. A NULL text has neither."""

    def of(v: Column) -> Column:
        wrong = F.when(v.isNull(), F.lit("Invalid data")).otherwise(error(t, v))
        return bound(wrong, lambda e: F.struct(e.alias("error"), F.when(e.isNull(), value(t, v)).alias("value")))

    return F.when(column.isNotNull(), bound(F.try_parse_json(column), of))
