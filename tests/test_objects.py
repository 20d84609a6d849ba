"""One object at a time: validation, flattening and back, updates, evolution, MessagePack."""

import sys
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from schemaloom import api
from schemaloom.api import DataError, Schema, SchemaError
from schemaloom.operators import exact
from schemaloom.plans.objects import Single
from schemaloom.sources import msgpack
from tests.test_definitions import f, rec

ARRAY, MAP = (lambda t: {"type": "array", "items": t}), (lambda t: {"type": "map", "values": t})
FOO = rec(f("X", "string"), name="foo")
VALIDATED = [
    ("null", None, None), ("null", 42, "Not a null: 42"), ("boolean", False, None), ("boolean", 100500, "Not a boolean: 100500"), ("boolean", "100500", "Not a boolean: 100500"),
    ("int", 42, None), ("int", 42.0, None), ("int", 42.1, "Not a int: 42.1"), ("int", 2147483648, "Not a int: 2147483648"), ("int", "XXX", "Not a int: XXX"), ("int", True, "Not a int: true"),
    ("long", -(2**63), None), ("long", 42.1, "Not a long: 42.1"), ("float", 1.5, None), ("double", "Hello!", "Not a double: Hello!"), ("string", "", None), ("string", 42, "Not a string: 42"), ("bytes", 42, "Not a bytes: 42"),
    (ARRAY("int"), [1, 2, 3, 4, 5, "XXX"], "6: Not a int: XXX"), (ARRAY("int"), 42, "Not a array: 42"), (MAP("int"), 42, "Not a map: 42"), (MAP("int"), {"a": "b"}, "a: Not a int: b"),
    (["string", "null"], None, None), (["string"], None, "Unexpected type in union: null"), (["string"], {"string": 42}, "string: Not a string: 42"), (["string"], {"XXX": 42}, "XXX: Unexpected key in union"),
    (["string", "int"], {"int": 1, "string": "a"}, "string: Unexpected key in union"), ({"type": "fixed", "name": "fixed16", "size": 16}, "Hello, world!", "Not a fixed16: Hello, world!"),
    ({"type": "enum", "name": "foo", "symbols": ["A"]}, "X", "Not a foo: X"), (FOO, {"X": 42}, "X: Not a string: 42"), (FOO, {}, "Field X missing"), (FOO, 42, "Not a foo: 42"), (FOO, {"X": "a", "Y": 1}, "Y: Unknown field"), ("any", {"a": [1, None]}, None), ("int*", None, None),
]


@pytest.mark.parametrize("raw,data,error", VALIDATED)
def test_validate(raw, data, error):
    assert api.validate(Schema(raw), data) == ((False, error) if error else (True, data))


def test_validate_fills_in():
    s = Schema(rec(f("a", "int", default=7), f("b", "int*"), f("c", ["null", "int"]), f("d", rec(f("e", "int", default=1), f("g", "int"), name="In"), default={"g": 2}), f("h", MAP("int"), default={"k": 1})))
    assert s.validate({}) == {"a": 7, "b": None, "c": None, "d": {"e": 1, "g": 2}, "h": {"k": 1}}
    assert s.validate({"a": None})["a"] == 7


CARD = {"type": "enum", "name": "face", "symbols": ["SPADES", "HEARTS"]}
FLAT = [
    ("boolean", True, [True]), ("float", 42, [42.0]), ("double*", None, [None]), (CARD, "HEARTS", [1]), (ARRAY(ARRAY("string")), [["a"], []], [[["a"], []]]), (MAP("int*"), {"b": 1, "a": None}, [{"b": 1, "a": None}]),
    (["int", "string", "null"], {"string": "x"}, [1, "x"]), (["int", "null"], None, [1, None]), (ARRAY(["null", "int"]), [None, {"int": 7}], [[[0, None], [1, 7]]]),
    (rec(f("A", "string"), f("B", ["null", "string"]), f("C")), {"C": 42, "A": "Hello", "B": {"string": "O"}}, ["Hello", 1, "O", 42]),
    (ARRAY(rec(f("A", default=1), f("B", default=2), f("C", default=3))), [{}, {"A": 100}], [[[1, 2, 3], [100, 2, 3]]]),
    (rec(f("v", "int"), f("r", {"type": "record*", "name": "tr", "fields": [f("a"), f("b", "string")]}), f("s", "tr*"), f("t", "tr")), {"v": 1, "r": {"a": 2, "b": "x"}, "s": None, "t": {"a": 3, "b": "y"}}, [1, [2, "x"], None, 3, "y"]),
    (rec(f("next", ["null", "node"]), f("label", "string"), name="node"), {"label": "L1", "next": {"node": {"label": "L2", "next": None}}}, [1, [0, None, "L2"], "L1"]),
]


@pytest.mark.parametrize("raw,data,cells", FLAT)
def test_flatten_and_back(raw, data, cells):
    c = api.compile(Schema(raw))
    assert c.flatten_object(data) == cells
    assert c.unflatten_object(cells)[0] == Schema(raw).validate(data)


WRONG = [
    ("int", 2147483648, "Value exceeds INT range: 2147483648LL"), ("int", 1.0, "Expecting INT, encountered DOUBLE"), ("long", 42.0, "Expecting LONG, encountered DOUBLE"), ("null", "x", "Expecting NIL, encountered STR"), ("bytes", "x", "Expecting BIN, encountered STR"),
    ({"type": "fixed", "name": "q", "size": 8}, b"ab", "Expecting BIN of length 8. Encountered BIN of length 2."), (CARD, "CLUBS", 'Bad value: "CLUBS"'), (ARRAY(ARRAY("string")), [[], ["a", 1]], "2/2: Expecting STR, encountered LONG"), (MAP(MAP("int")), {"e": {"f": None}}, "e/f: Expecting INT, encountered NIL"),
    (["int"], {}, "Expecting MAP of length 1. Encountered MAP of length 0."), (FOO, {}, 'Key missing: "X"'), (FOO, {"Y": 1}, 'Unknown key: "Y"'),
]


@pytest.mark.parametrize("raw,data,error", WRONG)
def test_flatten_errors(raw, data, error):
    with pytest.raises(DataError) as e:
        api.compile(Schema(raw)).flatten_object(data)
    assert str(e.value) == error


@pytest.mark.parametrize("raw,cells,error", [(CARD, [4], "1: Bad value: 4"), (CARD, [3.14], "1: Expecting INT, encountered DOUBLE"), (["int", "string"], [123, 42], "1: Bad value: 123")])
def test_unflatten_errors(raw, cells, error):
    with pytest.raises(DataError) as e:
        api.compile(Schema(raw)).unflatten_object(cells)
    assert str(e.value) == error


def test_defaults_differ_for_absent_and_null():
    s = Schema(rec(f("a", "int*", default=5), f("b", rec(f("c", "int", default=1), f("d", "int", default=2), name="In"), default={"c": 9})))
    c = api.compile(s)
    assert c.flatten_object({}) == [5, 9, 2] and c.flatten_object({"a": None, "b": {}}) == [None, 1, 2]


def test_hidden_fields_keep_their_cells():
    c = api.compile(Schema(rec(f("a"), f("b", hidden=True), f("c"))))
    assert c.unflatten_object([1, 2, 3])[0] == {"a": 1, "c": 3} and c.flatten_object({"a": 1, "b": 2, "c": 3}) == [1, 2, 3]


def test_service_fields():
    c = api.compile(Schema(rec(f("A", "string", default="Simple"), f("B", "int", default=1234))), service_fields=["long", "string*"])
    assert c.flatten_object({}, 7, None) == [7, None, "Simple", 1234]
    assert c.unflatten_object([7, "s", "x", 1]) == ({"A": "x", "B": 1}, [7, "s"])
    assert c.xflatten_object({"B": 5}) == [["=", 4, 5]]
    assert c.names()[:3] == ["$service_field$", "$service_field$", "A"]
    with pytest.raises(DataError):
        c.flatten_object({}, "x", None)
    with pytest.raises(SchemaError):
        api.compile(Schema("int"), service_fields=["record"])


def test_xflatten():
    user = rec(f("uid", "long"), f("p1", "long"), f("p2", "long"), f("nested", rec(f("x", "long"), f("y", "long"), f("points", ARRAY(rec(f("x", "long"), f("y", "long"), name="point"))), name="nested")), name="user")
    c = api.compile(Schema(user))
    assert c.xflatten_object({"nested": {"y": 1, "x": 2}, "p1": 3}) == [["=", 5, 1], ["=", 4, 2], ["=", 2, 3]]
    u = api.compile(Schema(rec(f("A", "string"), f("B", ["null", "string"]), f("C"))))
    assert u.xflatten_object({"B": {"string": "x"}, "C": 1}) == [["=", 2, 1], ["=", 3, "x"], ["=", 4, 1]]
    n = Schema(rec(f("a", {"type": "record*", "name": "R", "fields": [f("b")]})))
    with pytest.raises(DataError):
        api.compile(n).xflatten_object({"a": {"b": 1}})
    assert api.compile(n, alpha_nullable_record_xflatten=True).xflatten_object({"a": {"b": 1}}) == [["=", 1, [1]]]


def test_evolution():
    old, new = rec(f("A"), f("B"), f("C"), f("D"), name="foo"), rec(f("D"), f("C"), f("B"), f("A"), f("E", "int", default=1005), name="foo")
    c = api.compile(Schema(old), Schema(new))
    assert c.flatten_object({"A": 1, "B": 2, "C": 3, "D": 4}) == [4, 3, 2, 1, 1005]
    assert c.unflatten_object([1, 2, 3, 4])[0] == {"A": 1, "B": 2, "C": 3, "D": 4, "E": 1005}
    assert c.xflatten_object({"A": 1, "C": 3}) == [["=", 4, 1], ["=", 2, 3]]
    less = api.compile(Schema(old), Schema(rec(f("B"), name="foo")))
    assert less.flatten_object({"A": 1, "B": 2, "C": 3, "D": 4}) == [2]
    with pytest.raises(DataError):
        less.flatten_object({"A": "bad", "B": 2, "C": 3, "D": 4})
    chain = api.compile(Schema(rec(f("A"), name="foo")), Schema(rec(f("A", "long"), name="foo")), Schema(rec(f("A", "double"), f("Z", "int", default=3), name="foo")))
    assert chain.flatten_object({"A": 1}) == [1.0, 3]


def test_enum_and_union_versions():
    v = lambda *s: {"type": "enum", "name": "vehicle", "symbols": list(s)}
    c = api.compile(Schema(v("CAR", "BUS", "TRICYCLE", "TRUCK")), Schema(v("CAR", "BUS", "TRUCK", "SCOOTER")))
    assert c.flatten_object("TRUCK") == [2] and c.unflatten_object([3])[0] == "TRUCK"
    with pytest.raises(DataError, match=r'Bad value: "TRICYCLE" \(schema versioning\)'):
        c.flatten_object("TRICYCLE")
    u = api.compile(Schema(["null", "int", "double"]), Schema(["null", "string", "int"]))
    assert u.flatten_object({"int": 42}) == [2, 42] and u.flatten_object(None) == [0, None]
    with pytest.raises(DataError, match="schema versioning"):
        u.flatten_object({"double": 1.0})
    assert api.compile(Schema("int"), Schema(["string", "int"])).flatten_object(42) == [1, 42]
    assert api.compile(Schema(["string", "int"]), Schema("int")).flatten_object({"int": 42}) == [42]


def test_widening():
    for source, target, x, y in (("int", "long", 7, 7), ("int", "float", 2147483647, 2147483648.0), ("long", "double", 9999, 9999.0), ("float", "double", 42, 42.0), ("bytes", "string", b"Hi", "Hi"), ("string", "bytes", "Hi", b"Hi")):
        assert api.compile(Schema(source), Schema(target)).flatten_object(x) == [y]


MISMATCHED = [
    ("double", "float", "Types incompatible: double and float"), ("string", FOO, "Types incompatible: string and foo"), (FOO, "string", "Types incompatible: foo and string"), (rec(f("A"), name="foo"), rec(f("A"), name="xfoo"), "Types incompatible: foo and xfoo"),
    (rec(f("A"), name="foo"), rec(f("A"), f("B"), name="foo"), "foo: Field B is missing in source schema, and no default value was provided"), (rec(f("A"), name="foo"), rec(f("A", "string"), name="foo"), "foo/A: Types incompatible: int and string"),
    (rec(f("A"), name="foo"), rec(f("B", "string", aliases=["A"]), name="foo"), "foo/(A aka B): Types incompatible: int and string"), (["int"], ["string"], "<union>: No common types"), ("int*", "int", "Types incompatible: int and int"), ("int*", "long*", "Types incompatible: int and long"),
    ({"type": "fixed", "name": "blob", "size": 16}, {"type": "fixed", "name": "blob", "size": 17}, "blob: Size mismatch: 16 vs 17"), ({"type": "enum", "name": "foo", "symbols": ["A"]}, {"type": "enum", "name": "foo", "symbols": ["B"]}, "foo: No common symbols"),
    (rec(f("A", default=1), name="foo"), rec(f("A"), name="foo"), "foo/A: Default value defined in source schema but missing in target schema"),
]


@pytest.mark.parametrize("a,b,error", MISMATCHED)
def test_incompatible(a, b, error):
    assert api.are_compatible(Schema(a), Schema(b)) == (False, error)


def test_aliases_and_downgrade():
    a, b = Schema(rec(f("A"), name="foo")), Schema(rec(f("B", aliases=["A"]), name="bar", aliases=["foo"]))
    assert api.are_compatible(a, b) == (True, None) and api.are_compatible(b, a)[0] is False
    assert api.are_compatible(b, a, "downgrade") == (True, None)
    assert api.compile(b, a, downgrade=True).flatten_object({"B": 5}) == [5]
    assert api.compile(a, b).unflatten_object([5])[0] == {"B": 5}


def test_compatibility_of_types():
    kinds = ["null", "boolean", "int", "long", "float", "double", "bytes", "string", FOO, ARRAY("int"), MAP("int")]
    fits = {(i, i) for i in range(11)} | {(2, 3), (2, 4), (2, 5), (3, 4), (3, 5), (4, 5), (6, 7), (7, 6)}
    for i, a in enumerate(kinds):
        for j, b in enumerate(kinds):
            assert api.are_compatible(Schema(a), Schema(b))[0] == ((i, j) in fits), (a, b)
            assert api.are_compatible(Schema(a), Schema([b]))[0] == ((i, j) in fits)


JSONISH = st.recursive(st.none() | st.booleans() | st.integers(-(2**63), 2**64 - 1) | st.floats(allow_nan=False) | st.text() | st.binary(), lambda x: st.lists(x) | st.dictionaries(st.text(), x), max_leaves=20)


@settings(max_examples=200, deadline=None)
@given(JSONISH)
def test_msgpack_round_trip(x):
    assert msgpack.decode(msgpack.encode(x)) == x


def test_msgpack_forms():
    for x, head in ((0, "00"), (127, "7f"), (128, "cc80"), (-1, "ff"), (-33, "d0df"), (65535, "cdffff"), (2**32, "cf0000000100000000"), (None, "c0"), (True, "c3"), ("a", "a161"), (b"a", "c40161"), ([], "90"), ({}, "80"), (Single(1.5), "ca3fc00000")):
        assert msgpack.encode(x).hex() == head
    assert len(msgpack.encode("x" * 65400)) == 65403 and msgpack.decode(msgpack.encode({"k": ["x" * 260] * 20})) == {"k": ["x" * 260] * 20}
    for data in (b"\xc1", b"\x92\x01", b"\xa5ab", b"\x01\x02", b"\xdd\xff\xff\xff\xff"):
        with pytest.raises(DataError):
            msgpack.decode(data)
    with pytest.raises(DataError, match="Duplicate Key"):
        msgpack.decode(bytes.fromhex("82a16101a16102"))


PERSON = rec(f("name", "string"), f("age"), f("face", CARD), f("tags", ARRAY("string")), f("opt", "long*"), f("u", ["null", "int", "string"]), f("in", rec(f("x", "double"), f("m", MAP("int")), name="In")), name="Person")
PEOPLE = st.fixed_dictionaries({"name": st.text(), "age": st.integers(-(2**31), 2**31 - 1), "face": st.sampled_from(["SPADES", "HEARTS"]), "tags": st.lists(st.text()), "opt": st.none() | st.integers(-(2**63), 2**63 - 1), "u": st.none() | st.fixed_dictionaries({"int": st.integers(0, 9)}) | st.fixed_dictionaries({"string": st.text()}), "in": st.fixed_dictionaries({"x": st.floats(allow_nan=False), "m": st.dictionaries(st.text(), st.integers(0, 5))})})


@settings(max_examples=100, deadline=None)
@given(PEOPLE)
def test_unflatten_undoes_flatten(x):
    s = Schema(PERSON)
    c = api.compile(s)
    cells = c.flatten_object(x)
    assert len(cells) == len(c.names()) and c.unflatten_object(cells)[0] == s.validate(x)
    assert c.unflatten_object(msgpack.decode(msgpack.encode(cells)))[0] == x


def test_descriptions():
    old, new = rec(f("A"), f("E", CARD), f("U", ["null", "int"]), f("gone"), f("n", ["null", "foo"]), name="foo"), rec(f("B", "long", aliases=["A"]), f("E", CARD | {"symbols": ["HEARTS"]}), f("U", ["int", "string"]), f("new", "string", default=""), f("n", ["null", "foo"]), name="foo")
    text = api.compile(Schema(old), Schema(new)).describe()
    for line in ("foo -> foo", "  (A aka B): int -> long", "    SPADES: 0 -> refused", "    HEARTS: 1 -> 0", "    branch 0 null: refused", "    branch 1 -> 0: int -> int", "    (checked and dropped)", "  new: default", "(as above)"):
        assert line in text
    assert msgpack.dump(msgpack.encode({"a": [1, None, "x"]})) == [". MAP 1", "a ARRAY 3", "a/1 LONG 1", "a/2 NIL null", "a/3 STR x"]


N = exact.SURE_LEVELS
DEEP = [
    ("[" * N, True), ("[" * N + "]" * N, True), ('{"k":' * N + "1" + "}" * N, True), ('[ {"k" :\n' * N, True), ('{"b": null, "k": ' + "[" * N, True), ('[{"a": [1]}, "é😀", ' + "[" * N, True), ('["' + "x" * N + '", ' + "[" * N, True), ("[[1]," * N + "[" * N, False),
    ('[{"k": 1, "k": 2}, ' + "[" * N, False), ("[1" + "[" * N, False), ("[NaN, " + "[" * N, False), ("null" + "[" * N, False), ('["' + "[" * N + '"]', False), ('{"a"' + "[" * N, False), ("-" + "[" * N, False), ("[" * 99 + "]" * 99, False), ("[" + "[[]]," * N + "1]", False), ('["' + "x" * N + '"]', False),
]


@pytest.mark.parametrize("text,early", DEEP)
def test_deep_text_is_found_early_and_read_the_same(monkeypatch, text, early):
    def read():
        try:
            return exact.loads(text)
        except (DataError, RecursionError) as e:
            return type(e), str(e) if isinstance(e, DataError) else ""

    said, sinks = [], exact.sinks
    monkeypatch.setattr(exact, "sinks", lambda *x: said.append(sinks(*x)) or said[-1])
    found = read()
    assert said == [early and exact.ends_early(sys.getrecursionlimit())]
    monkeypatch.setattr(exact, "sinks", lambda *_: False)
    assert found == read()


def test_deep_text_takes_less_than_reading_it(monkeypatch):
    """Most of the time of rows nested too deeply."""

    def seconds(text):
        best = 9.0
        for _ in range(9):
            began = time.process_time()
            with pytest.raises(RecursionError):
                exact.loads(text)
            best = min(best, time.process_time() - began)
        return best

    if exact.ends_early(sys.getrecursionlimit()):
        fast = seconds("[" * 20_000)
        monkeypatch.setattr(exact, "sinks", lambda *_: False)
        assert fast < seconds("[" * 20_000) / 2
