"""Small cases of every rule of definitions, compatibility, validation and conversion, with the answers they must have.

The queries of catalogue.py run them through the engine and state the answers as SQL values; the tests use them too.
"""

from __future__ import annotations

from typing import Any


def parcel(*fields: Any, **more: Any) -> dict:
    """A record."""
    return {"type": "record", "name": "Parcel", "fields": list(fields)} | more


def has(name: Any, kind: Any = "long", **more: Any) -> dict:
    """A field."""
    return {"name": name, "type": kind, **more}


def crate(size: Any = 6, **more: Any) -> dict:
    return {"type": "fixed", "name": "Crate", "size": size} | more


def colour(*symbols: Any, **more: Any) -> dict:
    return {"type": "enum", "name": "Colour", "symbols": list(symbols)} | more


def many(kind: Any) -> dict:
    return {"type": "array", "items": kind}


def keyed(kind: Any) -> dict:
    return {"type": "map", "values": kind}


def leave(made: dict, *keys: str) -> dict:
    return {k: v for k, v in made.items() if k not in keys}


#: By rule: a definition and why it is refused. The messages are fixed values.
REFUSED: list[tuple[str, Any, str]] = [
    ("unknown type", "weight", "Unknown Avro type: weight"),
    ("unknown type", {"type": "tonne"}, "Unknown Avro type: tonne"),
    ("unknown type", 7.5, "Unknown Avro type: 7.5"),
    ("unknown type", parcel(has("to", "Address")), "Parcel/to: Unknown Avro type: Address"),
    ("unknown type", many(True), "<array>: Unknown Avro type: true"),
    ("union in union", ["long", ["string", "null"]], "<union>/<branch-2>: Union may not immediately contain other unions"),
    ("duplicate branch", ["null", "string", "string"], "<union>/<branch-3>: Union contains string twice"),
    ("duplicate branch", [keyed("long"), keyed("string")], "<union>/<branch-2>: Union contains map twice"),
    ("empty union", parcel(has("u", [])), "Parcel/u: Union type must have at least one branch"),
    ("missing type", {"size": 3}, 'Must have a "type"'),
    ("missing type", parcel({"name": "w", "type": {"items": "long"}}), 'Parcel/w: Must have a "type"'),
    ("missing name", leave(crate(), "name"), '<fixed>: Must have a "name"'),
    ("missing name", leave(colour("RED"), "name"), '<enum>: Must have a "name"'),
    ("missing name", leave(parcel(has("w")), "name"), '<record>: Must have a "name"'),
    ("bad type name", crate(name="3rd"), "<fixed>: Bad type name: 3rd"),
    ("bad type name", colour("RED", name="a-b"), "<enum>: Bad type name: a-b"),
    ("bad type name", parcel(has("w"), name=False), "<record>: Bad type name: false"),
    ("primitive type name", crate(name="bytes"), "<fixed>: Redefining primitive type name: bytes"),
    ("duplicate type name", parcel(has("a", crate()), has("b", crate(9))), "Parcel/b/<fixed>: Type name already defined: Crate"),
    ("duplicate type name", parcel(has("inner", parcel(has("w")))), "Parcel/inner/<record>: Type name already defined: Parcel"),
    ("aliases", crate(aliases="Box"), 'Crate: Property "aliases" must be a list'),
    ("aliases", colour("RED", aliases=["Hue", "?"]), "Colour: Bad type name: ?"),
    ("aliases", parcel(has("w"), aliases=["Box", "Parcel"]), "Parcel: Alias type name already defined: Parcel"),
    ("record fields", leave(parcel(), "fields"), 'Parcel: Record type must have "fields"'),
    ("record fields", parcel(fields="w"), 'Parcel: Record "fields" must be a list'),
    ("record fields", parcel(), "Parcel: Record type must have at least one field"),
    ("field shape", parcel(has("w"), "w"), "Parcel/<field-2>: Record field must be a list"),
    ("field shape", parcel({"type": "long"}), 'Parcel/<field-1>: Record field must have a "name"'),
    ("field shape", parcel(has("w"), has("two words")), "Parcel/<field-2>: Bad record field name: two words"),
    ("field shape", parcel(has("w"), has("to", "string"), has("w", "string")), "Parcel/<field-3>: Record contains field w twice"),
    ("field shape", parcel(has("w"), {"name": "to"}), 'Parcel/to: Record field must have a "type"'),
    ("self containment", parcel(has("w"), has("inside", "Parcel")), "Record Parcel contains itself via inside"),
    ("self containment", parcel(has("pallet", parcel(has("top", "Parcel"), name="Pallet"))), "Record Parcel contains itself via pallet/top"),
    ("bad default", parcel(has("w", default="heavy")), "Parcel/w: Default value not valid (Not a long: heavy)"),
    ("bad default", parcel(has("c", colour("RED"), default="BLUE")), "Parcel/c: Default value not valid (Not a Colour: BLUE)"),
    ("bad default", parcel(has("l", many("long"), default=[1, "x"])), "Parcel/l: Default value not valid (2: Not a long: x)"),
    ("field aliases", parcel(has("w", aliases="mass")), 'Parcel/w: Property "aliases" must be a list'),
    ("field aliases", parcel(has("w", aliases=["1"])), "Parcel/w: Bad field alias name: 1"),
    ("field aliases", parcel(has("w"), has("v", aliases=["w"])), "Parcel/v: Alias field name already defined: w"),
    ("enum symbols", leave(colour(), "symbols"), 'Colour: Enum type must have "symbols"'),
    ("enum symbols", colour(symbols="RED"), 'Colour: Enum "symbols" must be a list'),
    ("enum symbols", colour(), "Colour: Enum type must contain at least one symbol"),
    ("enum symbols", colour("RED", "sea blue"), "Colour: Bad enum symbol name: sea blue"),
    ("enum symbols", colour("RED", "BLUE", "GREEN", "BLUE"), "Colour: Enum contains symbol BLUE twice"),
    ("items and values", {"type": "array"}, '<array>: Array type must have "items"'),
    ("items and values", parcel(has("m", {"type": "map"})), 'Parcel/m/<map>: Map type must have "values"'),
    ("fixed size", leave(crate(), "size"), 'Crate: Fixed type must have "size"'),
    ("fixed size", crate("big"), "Crate: Bad fixed type size: big"),
    ("fixed size", crate(2.5), "Crate: Bad fixed type size: 2.5"),
    ("fixed size", crate(-1), "Crate: Bad fixed type size: -1"),
]

#: By rule: source, target, mode and why data of the one can't become data of the other, None if it can.
PAIRS: list[tuple[str, Any, Any, str | None, str | None]] = [
    ("I6 to nullable", "int", "double*", None, None),
    ("I7 nullable stays", "string*", "string*", None, None),
    ("I7 nullable isn't widened", "float*", "double*", None, "Types incompatible: float and double"),
    ("I8 nullable to plain", "string*", "string", None, "Types incompatible: string and string"),
    ("I8 nullable to plain", crate() | {"type": "fixed*"}, crate(), None, "Types incompatible: Crate and Crate"),
    ("I9 fixed", crate(6), crate(6, name="Box", aliases=["Crate"]), None, None),
    ("I9 fixed", crate(6), crate(7), None, "Crate: Size mismatch: 6 vs 7"),
    ("I9 fixed", crate(6), crate(6, name="Box"), None, "Types incompatible: Crate and Box"),
    ("I10 items", many("long"), many("string"), None, "<array>: Types incompatible: long and string"),
    ("I10 values", keyed(many("int")), keyed(many("long")), None, None),
    ("I11 enum", colour("RED", "BLUE"), colour("GREEN"), None, "Colour: No common symbols"),
    ("I13 union", ["int", "string"], ["boolean", "long"], None, None),
    ("I13 union", ["boolean", "null"], ["string"], None, "<union>: No common types"),
    ("I14 downgrade", parcel(has("mass", aliases=["w"])), parcel(has("w")), "downgrade", None),
    ("I14 upgrade only", parcel(has("mass", aliases=["w"])), parcel(has("w")), None, "Parcel: Field w is missing in source schema, and no default value was provided"),
    ("I15 no default", parcel(has("w")), parcel(has("w"), has("to", "string")), None, "Parcel: Field to is missing in source schema, and no default value was provided"),
    ("I15 default", parcel(has("w")), parcel(has("w"), has("to", "string", default="depot")), None, None),
    ("I16 lost default", parcel(has("w", default=5)), parcel(has("w")), None, "Parcel/w: Default value defined in source schema but missing in target schema"),
    ("I17 recursion", parcel(has("next", ["null", "Parcel"])), parcel(has("next", ["Parcel", "null"])), None, None),
    ("I18 path", parcel(has("dim", parcel(has("h", "int"), name="Dim"))), parcel(has("size", parcel(has("h", "string"), name="Dim"), aliases=["dim"])), None, "Parcel/(dim aka size)/Dim/h: Types incompatible: int and string"),
    ("I18 path", parcel(has("w", "string")), parcel(has("w", "long"), name="Box", aliases=["Parcel"]), None, "(Parcel aka Box)/w: Types incompatible: string and long"),
]

LINKED = parcel(has("next", ["null", "Parcel"]), has("w", "int"))
#: By rule: schema, value and why it isn't valid, None if it is; the value comes out as it is.
VALID: list[tuple[str, Any, Any, str | None]] = [
    ("V1 nullable", "long*", None, None),
    ("V1 nullable", "long", None, "Not a long: null"),
    ("V2 int", "int", -2147483648, None),
    ("V2 int", "int", -2147483649, "Not a int: -2147483649"),
    ("V2 int", "int", 3.0, None),
    ("V2 int", "int", 3.25, "Not a int: 3.25"),
    ("V2 long", "long", "3", "Not a long: 3"),
    ("V2 double", "double", 3, None),
    ("V2 double", "double", True, "Not a double: true"),
    ("V2 boolean", "boolean", 0, "Not a boolean: 0"),
    ("V2 string", "string", 0, "Not a string: 0"),
    ("V2 null", "null", "x", "Not a null: x"),
    ("V2 fixed", crate(4), "abc", "Not a Crate: abc"),
    ("V2 enum", colour("RED"), "red", "Not a Colour: red"),
    ("V3 unknown field", parcel(has("w")), {"w": 1, "v": 2}, "v: Unknown field"),
    ("V4 missing field", parcel(has("w"), has("to", "string*")), {"to": None}, "Field w missing"),
    ("V5 array", many("long"), [4, 5, "six"], "3: Not a long: six"),
    ("V6 map", keyed("long"), {"a": 4, "b": "five"}, "b: Not a long: five"),
    ("V7 union", ["long", "string"], None, "Unexpected type in union: null"),
    ("V7 union", ["long", "null"], None, None),
    ("V7 union", ["long", "string"], 5, "Not a union: 5"),
    ("V7 union", ["long", "string"], {"double": 5}, "double: Unexpected key in union"),
    ("V7 union", many(["long", "string"]), [{"long": 5}, None], "2: Unexpected type in union: null"),
    ("V7 union", ["long", "string"], {"long": 5, "string": "x"}, "string: Unexpected key in union"),
    ("V8 any", parcel(has("x", "any")), {"x": {"deep": [1, None, {"k": "v"}]}}, None),
    ("V10 path", parcel(has("l", many(parcel(has("m", keyed("int")), name="Inner")))), {"l": [{"m": {}}, {"m": {"k": "z"}}]}, "l/2/m/k: Not a int: z"),
    ("recursion", LINKED, {"w": 1, "next": {"Parcel": {"w": 2, "next": {"Parcel": {"w": "z", "next": None}}}}}, "next/Parcel/next/Parcel/w: Not a int: z"),
]

SHIPPED = parcel(has("w", "int"), has("dim", parcel(has("h", "double"), has("tags", many("string")), name="Dim")), has("c", colour("RED", "BLUE")), has("u", ["null", "long", "string"]))
#: By rule: operation, schemas, options, input and output; an output that is a text is the error's. The templates are fixed values.
CONVERTED: list[tuple[str, str, list, dict, Any, Any]] = [
    ("flatten", "flatten", [SHIPPED], {}, {"c": "BLUE", "u": {"long": 9}, "w": 1, "dim": {"tags": ["a"], "h": 2}}, [1, 2.0, ["a"], 1, 1, 9]),
    ("unflatten", "unflatten", [SHIPPED], {}, [1, 2.0, ["a"], 1, 2, "x"], {"w": 1, "dim": {"h": 2.0, "tags": ["a"]}, "c": "BLUE", "u": {"string": "x"}}),
    ("U4 length", "unflatten", [SHIPPED], {}, [1, 2.0, ["a"], 1, 2], "Expecting ARRAY of length 6. Encountered ARRAY of length 5."),
    ("U4 length", "unflatten", [parcel(has("w", "int"))], {"service_fields": ["string"]}, ["s", 1, 2], "Expecting ARRAY of length 2. Encountered ARRAY of length 3."),
    ("U4 length", "unflatten", [parcel(has("l", many(parcel(has("a"), has("b"), name="Two"))))], {}, [[[1, 2], [3]]], "1/2: Expecting ARRAY of length 2. Encountered ARRAY of length 1."),
    ("X7 input order", "xflatten", [SHIPPED], {}, {"c": "RED", "w": 4, "dim": {"tags": [], "h": 1.5}}, [["=", 4, 0], ["=", 1, 4], ["=", 3, []], ["=", 2, 1.5]]),
    ("X3 union", "xflatten", [SHIPPED], {}, {"u": {"string": "y"}}, [["=", 5, 2], ["=", 6, "y"]]),
    ("S1 service fields", "xflatten", [SHIPPED], {"service_fields": ["int", "string"]}, {"w": 4}, [["=", 3, 4]]),
    ("template: wrong type", "flatten", [SHIPPED], {}, {"w": "1"}, "w: Expecting INT, encountered STR"),
    ("template: wrong type", "flatten", [many("string")], {}, ["a", None], "2: Expecting STR, encountered NIL"),
    ("template: container", "flatten", [keyed("long")], {}, [1], "Expecting MAP, encountered ARRAY"),
    ("template: int range", "flatten", ["int"], {}, 2147483648, "Value exceeds INT range: 2147483648LL"),
    ("template: unsigned", "flatten", ["long"], {}, 9223372036854775808, "Expecting LONG, encountered ULONG"),
    ("template: missing key", "flatten", [SHIPPED], {}, {"w": 1}, 'Key missing: "dim"'),
    ("template: unknown key", "flatten", [SHIPPED], {}, {"dim": {"depth": 1}}, 'dim: Unknown key: "depth"'),
    ("template: bad symbol", "flatten", [colour("RED")], {}, "GREEN", 'Bad value: "GREEN"'),
    ("template: bad symbol of versions", "flatten", [colour("RED", "GREEN"), colour("RED")], {}, "GREEN", 'Bad value: "GREEN" (schema versioning)'),
    ("template: bad number", "unflatten", [colour("RED")], {}, [3], "1: Bad value: 3"),
    ("template: union size", "flatten", [["long", "string"]], {}, {"long": 1, "string": "x"}, "Expecting MAP of length 1. Encountered MAP of length 2."),
    ("template: union key", "flatten", [["long", "string"]], {}, {"bytes": "x"}, 'Unknown key: "bytes"'),
    ("template: union of versions", "flatten", [["long", "string"], ["string"]], {}, {"long": 1}, 'Unknown key: "long" (schema versioning)'),
    ("template: null or map", "flatten", [["null", "string"]], {}, 5, "Expecting NIL or MAP, encountered LONG"),
    ("template: fixed length", "flatten", [crate(3)], {}, {"$binary": "0102"}, "Expecting BIN of length 3. Encountered BIN of length 2."),
    ("F5 recursion", "flatten", [LINKED], {}, {"w": 1, "next": {"Parcel": {"w": 2, "next": None}}}, [1, [0, None, 2], 1]),
    ("U5 recursion", "unflatten", [LINKED], {}, [1, [0, None, 2], 1], {"next": {"Parcel": {"next": None, "w": 2}}, "w": 1}),
    ("I17 recursion of versions", "flatten", [LINKED, parcel(has("w", "long"), has("next", ["Parcel", "null"]))], {}, {"w": 1, "next": {"Parcel": {"w": 2, "next": None}}}, [1, 0, [2, 1, None]]),
    ("A12 chain", "flatten", [parcel(has("w", "int")), parcel(has("w", "long"), has("to", "string", default="x")), parcel(has("to", "string", default="y"), has("mass", "double", aliases=["w"]))], {}, {"w": 3}, ["x", 3.0]),
    ("A5 downgrade", "flatten", [parcel(has("mass", aliases=["w"])), parcel(has("w"))], {"downgrade": True}, {"mass": 3}, [3]),
    ("exact: bad hex", "flatten", ["bytes"], {}, {"$binary": "zz"}, "Invalid data"),
]
