"""The converters over Spark: typed, JSON and MessagePack columns, plans and streams; and the catalogue against DuckDB."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from schemaloom import api, cases, catalogue
from schemaloom.api import Schema
from schemaloom.plans import objects
from schemaloom.plans.ast import DataError
from tests.test_definitions import f, rec
from tests.test_objects import ARRAY, CARD, MAP, VALIDATED, WRONG

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def as_rows(rows):
    return sorted([tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows], key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_catalogue(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    found = duck.execute(catalogue.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    assert as_rows(tuple(r[c] for c in names) for r in df.collect()) == as_rows(found.fetchall())


@pytest.mark.parametrize("name", ["broken_rows", "flatten_json_exact", "msgpack_roundtrip", "xflatten_msgpack"])
def test_exact_queries_use_all_cores(spark, name):
    """A file of one row group is one task's; the rows' work isn't."""
    tasks = catalogue.QUERIES[name](spark, SF).groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) >= spark.sparkContext.defaultParallelism
    rows = [r["count"] for r in tasks]
    assert max(rows) < sum(rows) / 4


def test_every_query_is_registered(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("raw,data,error", VALIDATED)
def test_validation_in_the_jvm_says_the_same(spark, raw, data, error):
    if isinstance(data, (dict, list)) and raw != "any" and not error:
        assert Schema(raw).validate(data) == data
    row = Schema(raw).validate_json(spark.createDataFrame([(json.dumps(data),)], "doc string"), "doc").select("is_valid", "error").first()
    assert (row.is_valid, row.error) == (error is None, error)


@pytest.mark.parametrize("rule,raw,data,error", [c for c in cases.VALID if "any" not in json.dumps(c[1]) and c[0] != "recursion" and not (c[2] is None or isinstance(c[2], str) and c[0] == "V2 null")])
def test_cases_in_the_jvm_say_the_same(spark, rule, raw, data, error):
    row = Schema(raw).validate_json(spark.createDataFrame([(json.dumps(data),)], "doc string"), "doc").select("is_valid", "error").first()
    assert (row.is_valid, row.error) == (error is None, error)


def test_text_is_parsed_once_a_row(spark):
    plan = catalogue.validate_ok(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") + plan.count("try_parse_json") <= 2


def test_validated_value_has_defaults(spark):
    s = Schema(rec(f("a", "int", default=7), f("b", "int*"), f("c", ["null", "int"]), f("d", rec(f("e", "int", default=1), f("g", "int"), name="In"), default={"g": 2}), f("h", MAP("int"), default={"k": 1})))
    v = s.validate_json(spark.createDataFrame([("{}",), ('{"a": 3, "c": {"int": 4}, "h": {}}',), (None,)], "doc string"), "doc").select("value").collect()
    assert v[0].value.asDict(True) == {"a": 7, "b": None, "c": {"$type$": 0, "int": None}, "d": {"e": 1, "g": 2}, "h": {"k": 1}}
    assert v[1].value.a == 3 and v[1].value.c["int"] == 4 and v[1].value.h == {} and v[2].value is None


def test_duplicate_keys(spark):
    df = spark.createDataFrame([('{"a": 1, "a": 2}',)], "doc string")
    s = Schema(rec(f("a")))
    assert s.validate_json(df, "doc").first().error == "Invalid data"
    assert api.compile(s).flatten_json(df, "doc").first().error == "a: Duplicate Key"


@pytest.mark.parametrize("raw,data,error", [w for w in WRONG if not isinstance(w[1], bytes)])
def test_json_column_errors(spark, raw, data, error):
    row = api.compile(Schema(raw)).flatten_json(spark.createDataFrame([(1, json.dumps(data))], "id int, doc string"), "doc").first()
    assert (row.id, row.ok, row.error, row.value) == (1, False, error, None)


EVERYTHING = rec(
    f("s", "string"), f("b", "bytes"), f("n", "int*"), f("card", CARD), f("cards", ARRAY("face")), f("by", MAP("face")), f("u", ["null", "int", {"type": "enum", "name": "e2", "symbols": ["P", "Q"]}]), f("us", ARRAY(["int", "string"])),
    f("r", rec(f("x", "double"), f("q", {"type": "record*", "name": "Q", "fields": [f("c", CARD["name"]), f("m", "float")]}), name="R")), f("rs", ARRAY("Q")), f("fx", {"type": "fixed", "name": "F2", "size": 2}), name="All",
)


def rows_of(spark, s):
    tag = lambda t, **v: {"$type$": t, **v}
    data = [
        ("a", bytearray(b"\x00\xff"), 1, "HEARTS", ["SPADES", "HEARTS"], {"k": "HEARTS"}, tag(1, int=5, e2=None), [tag(0, int=1, string=None), tag(1, int=None, string="z")], {"x": 1.5, "q": {"c": "SPADES", "m": 0.5}}, [{"c": "HEARTS", "m": 2.0}], bytearray(b"ab")),
        ("", bytearray(), None, "SPADES", [], {}, tag(0, int=None, e2=None), [], {"x": -0.0, "q": None}, [], bytearray(b"cd")),
        ("é", bytearray(b"x"), -5, "SPADES", ["HEARTS"], {"a": "SPADES", "b": "HEARTS"}, tag(2, int=None, e2="Q"), [], {"x": 2.0, "q": None}, [{"c": "SPADES", "m": 1.0}], bytearray(b"ef")),
    ]
    return spark.createDataFrame(data, s.spark_type())


def test_typed_round_trip(spark):
    s = Schema(EVERYTHING)
    c = api.compile(s, strict=True)
    df = rows_of(spark, s)
    flat = c.flatten(df)
    assert flat.columns == c.names() == s.names()
    assert sorted(map(repr, c.unflatten(flat).collect())) == sorted(map(repr, df.collect()))
    row = flat.where("s = 'a'").first()
    assert row["card"] == 1 and row["cards"] == [0, 1] and row["by"] == {"k": 1} and row["u.$type$"] == 1 and row["r.q"]["c0"] == 0 and row["rs"][0]["c0"] == 1


def test_flat_plan_is_one_projection(spark):
    df = catalogue.customers(spark, SF).where("acct.segment = 'BUILDING'")
    plan = api.compile(catalogue.CUSTOMER).flatten(df).select("key")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "ReadSchema: struct<c_custkey:bigint,c_mktsegment:string>" in plan and "EqualTo(c_mktsegment,BUILDING)" in plan


def test_strict_refuses(spark):
    s = Schema(rec(f("a", "int"), f("e", CARD)))
    df = spark.createDataFrame([(None, "HEARTS")], "a int, e string")
    assert api.compile(s).flatten(df).first().a is None
    with pytest.raises(Exception, match="Key missing"):
        api.compile(s, strict=True).flatten(df).collect()
    with pytest.raises(Exception, match="Bad value"):
        api.compile(s, strict=True).flatten(spark.createDataFrame([(1, "CLUBS")], "a int, e string")).collect()
    with pytest.raises(Exception, match="Bad value"):
        api.compile(s, strict=True).unflatten(spark.createDataFrame([(1, 9)], "a int, e int")).collect()


def test_rows_carry_their_errors(spark):
    """flatten_checked says of each row what the exact path says of its object."""
    hue = lambda *x: {"type": "enum", "name": "hue", "symbols": list(x)}
    fields = lambda h, u: rec(f("k"), f("h", h), f("l", ARRAY(rec(f("x", "hue"), f("b", {"type": "fixed", "name": "two", "size": 2}), name="In"))), f("m", MAP("hue")), f("u", u), f("r", "In*"), name="foo")
    a, b = Schema(fields(hue("RED", "BLUE", "TAN"), ["null", "hue", "string"])), Schema(fields(hue("BLUE", "RED"), ["null", "hue"]))
    one = lambda x="RED", b=b"ab": {"x": x, "b": b}
    good = {"k": 1, "h": "RED", "l": [one()], "m": {"a": "BLUE"}, "u": {"hue": "RED"}, "r": None}
    data = [good, good | {"h": "TAN"}, good | {"h": "PINK"}, good | {"l": [one(), one(b=b"abc")]}, good | {"l": [one("TAN")]}, good | {"m": {"a": "RED", "z": "GREY"}}, good | {"u": {"string": "x"}}, good | {"u": {"hue": "TAN"}}, good | {"r": one("TAN")}, good | {"u": None, "r": one()}]
    typed = [(d["k"], d["h"], d["l"], d["m"], {"$type$": 0 if d["u"] is None else 1 if "hue" in d["u"] else 2, "hue": (d["u"] or {}).get("hue"), "string": (d["u"] or {}).get("string")}, d["r"]) for d in data]
    c = api.compile(a, b)
    out = c.flatten_checked(spark.createDataFrame(typed, a.spark_type()).coalesce(1), ["k"]).collect()
    for r, d in zip(out, data, strict=True):
        try:
            c.flatten_object(d)
            want = None
        except DataError as e:
            want = str(e)
        assert (r.ok, r.error, r.tuple is None) == (want is None, want, want is not None), d
    missing = c.flatten_checked(spark.createDataFrame([(None, "RED", [], {}, None, None)], a.spark_type())).first()
    assert missing.error == 'Key missing: "k"'


def test_typed_agrees_with_objects(spark):
    """A pair of revisions, typed and one by one."""
    a = Schema(rec(f("A"), f("E", {"type": "enum", "name": "v", "symbols": ["X", "Y", "Z"]}), f("U", ["null", "int", "string"]), f("N", rec(f("p", "float"), name="N")), name="foo"))
    b = Schema(rec(f("N", rec(f("p", "double"), f("new", "string", default="d"), name="N")), f("U", ["string", "long", "null"]), f("E", {"type": "enum", "name": "v", "symbols": ["Z", "X", "W"]}), f("B", "long", aliases=["A"]), name="foo"))
    c = api.compile(a, b)
    data = [{"A": 1, "E": "X", "U": {"int": 5}, "N": {"p": 0.5}}, {"A": 2, "E": "Z", "U": {"string": "s"}, "N": {"p": 1.5}}, {"A": 3, "E": "X", "U": None, "N": {"p": 2.0}}]
    typed = spark.createDataFrame([(d["A"], d["E"], {"$type$": 0 if d["U"] is None else 1 if "int" in d["U"] else 2, **(d["U"] or {})}, d["N"]) for d in data], a.spark_type())
    got = []
    for r in c.flatten(typed).collect():
        cells = list(r)
        cells[3] = next((v for v in cells[3] if v is not None), None)
        got.append(cells)
    assert sorted(got, key=repr) == sorted((c.flatten_object(d) for d in data), key=repr)


def test_msgpack_columns(spark):
    from schemaloom.sources import msgpack

    c = api.compile(Schema(rec(f("a"), f("b", "string*"))))
    packed = [(1, bytearray(msgpack.encode({"a": 5, "b": "x"}))), (2, bytearray(msgpack.encode({"a": 1.5, "b": None}))), (3, bytearray(b"\x82\x01")), (4, None)]
    out = {r.id: r for r in c.flatten_msgpack(spark.createDataFrame(packed, "id int, m binary"), "m").collect()}
    assert msgpack.decode(bytes(out[1].value)) == [5, "x"] and out[2].error == "a: Expecting INT, encountered DOUBLE" and out[3].error == "Truncated data" and out[4].ok and out[4].value is None
    x = c.xflatten_msgpack(spark.createDataFrame(packed[:1], "id int, m binary"), "m").first()
    assert msgpack.decode(bytes(x.value)) == [["=", 1, 5], ["=", 2, "x"]]


def test_recursive_schemas_take_the_exact_path(spark):
    s = Schema(rec(f("next", ["null", "node"]), f("label", "string"), name="node"))
    with pytest.raises(api.SchemaError):
        s.spark_type()
    df = spark.createDataFrame([('{"next": {"node": {"next": null, "label": 1}}, "label": "a"}',), ('{"next": null, "label": "a"}',)], "doc string")
    assert [r.error for r in s.validate_json(df, "doc").collect()] == ["next/node/label: Not a string: 1", None]


def test_empty_frames(spark):
    s = Schema(EVERYTHING)
    empty = spark.createDataFrame([], s.spark_type())
    c = api.compile(s)
    assert c.flatten(empty).count() == 0 and c.unflatten(c.flatten(empty)).count() == 0
    assert c.flatten_json(spark.createDataFrame([], "doc string"), "doc").count() == 0


def test_stream_equals_batch(spark, tmp_path):
    from schemaloom.streaming import run_available

    c = api.compile(catalogue.CUSTOMER)
    batch = catalogue.customers(spark, SF)
    batch.write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).json(str(tmp_path / "in"))
    assert c.flatten(stream).isStreaming
    run_available(stream, lambda df: catalogue.plain(c.flatten(df)), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert as_rows(spark.read.parquet(str(tmp_path / "out")).collect()) == as_rows(catalogue.plain(c.flatten(batch)).collect())
    with pytest.raises(ValueError):
        run_available(batch, c.flatten, "x", "y")


def test_errors_are_values_not_exceptions():
    with pytest.raises(DataError):
        objects.validate(Schema("int").type, "x")
    with pytest.raises(api.SchemaError):
        api.compile(Schema("any"))
    with pytest.raises(api.SchemaError):
        api.compile("int")
    with pytest.raises(api.SchemaError):
        api.are_compatible(Schema("int"), Schema("int"), "upgrade")


def test_wide_records(spark):
    s = Schema(rec(*[f(f"f{i}", "int", default=1000 + i) for i in range(150)]))
    df = spark.range(3).select(*[F.lit(None).cast("int").alias(f"f{i}") for i in range(150)])
    assert list(api.compile(s).flatten(df).first()) == [1000 + i for i in range(150)]


def test_threads_hold_all_turns(spark, tmp_path):
    turns = [(1, k, "user" if k % 2 else "bot", f'text {k} "é" \\ \n') for k in range(399)] + [(2, 5, None, None), (2, 3, "user", "x"), (None, 1, "user", "y")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    docs = {r.id: r.doc for r in catalogue.thread_docs(spark, str(tmp_path)).collect()}
    assert docs[2] == '{"next":{"node":{"next":null,"label":"-: "}},"label":"user: x"}'
    node, found = json.loads(docs[1]), []
    while node:
        found.append(node["label"])
        node = node["next"] and node["next"]["node"]
    assert found == [f"{t[2]}: {t[3]}" for t in turns[:399]]
    assert sorted(tuple(r) for r in catalogue.recursive_thread(spark, str(tmp_path)).collect()) == [(1, True, True), (2, True, True)]
