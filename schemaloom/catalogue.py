"""Queries of the schema operators over the driver's tables, each with the same in SQL."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaloom import api, cases
from schemaloom.api import Schema
from schemaloom.operators import exact
from schemaloom.plans.layout import TAG

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, key: str) -> DataFrame:
    """The rows dealt over all cores by a unique key: few bytes can hold much work for the exact path, and a scan has one task for some MB or a row group."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, key)


def rec(name: str, *fields: dict, **more) -> dict:
    return {"type": "record", "name": name, "fields": list(fields), **more}


def fld(name: str, kind, **more) -> dict:
    return {"name": name, "type": kind, **more}


def arr(items) -> dict:
    return {"type": "array", "items": items}


def enum(name: str, *symbols: str) -> dict:
    return {"type": "enum", "name": name, "symbols": list(symbols)}


def listed(symbols) -> str:
    return "[" + ", ".join(f"'{s}'" for s in symbols) + "]"


def literal(x) -> str:
    """A value as SQL says it."""
    if x is None:
        return "NULL"
    return str(x).upper() if isinstance(x, bool) else str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"


def stated(rows: list[tuple], names: str) -> str:
    """SQL that gives these rows."""
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) t({names})"


SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
KINDS = ("click", "error", "purchase", "signup", "view")
CUSTOMER = Schema(rec("Customer", fld("key", "long"), fld("name", "string"), fld("geo", rec("Geo", fld("nation", "int"))), fld("acct", rec("Account", fld("bal", "double"), fld("segment", enum("Segment", *SEGMENTS))))))
FLAT_CUSTOMER = f"SELECT c_custkey AS key, c_name AS name, c_nationkey AS geo_nation, c_acctbal AS acct_bal, CAST(list_position({listed(SEGMENTS)}, c_mktsegment) - 1 AS INTEGER) AS acct_segment FROM customer"


def plain(df: DataFrame) -> DataFrame:
    """Dots and the like out of column names."""
    return df.toDF(*[c.replace(".$type$", "_tag").replace(".", "_") for c in df.columns])


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.struct(F.col("c_nationkey").alias("nation")).alias("geo"), F.struct(F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("segment")).alias("acct"))


# Flattening and back


@query(FLAT_CUSTOMER)
def flatten_customer(spark, sf_dir):
    return plain(api.compile(CUSTOMER).flatten(customers(spark, sf_dir)))


@query("SELECT c_custkey AS key, c_name AS name, c_nationkey AS nation, c_acctbal AS bal, c_mktsegment AS segment FROM customer")
def unflatten_customer(spark, sf_dir):
    c = api.compile(CUSTOMER)
    out = c.unflatten(c.flatten(customers(spark, sf_dir)))
    return out.select("key", "name", F.col("geo.nation").alias("nation"), F.col("acct.bal").alias("bal"), F.col("acct.segment").alias("segment"))


@query("SELECT c_custkey AS key, c_acctbal AS bal FROM customer WHERE c_mktsegment = 'BUILDING'")
def flatten_pruned_and_filtered(spark, sf_dir):
    flat = api.compile(CUSTOMER).flatten(customers(spark, sf_dir).where("acct.segment = 'BUILDING'"))
    return plain(flat).select("key", F.col("acct_bal").alias("bal"))


ORDER = Schema(rec("Order", fld("key", "long"), fld("cust", "long"), fld("status", enum("Status", "F", "O", "P")), fld("total", "double"), fld("info", rec("Info", fld("priority", "string"), fld("cust2", "long*")))))


@query("SELECT o_orderkey AS key, o_custkey AS cust, o_orderstatus AS status, o_totalprice AS total, o_orderpriority AS priority, CASE WHEN o_custkey % 2 = 0 THEN o_custkey END AS cust2 FROM orders")
def roundtrip_orders(spark, sf_dir):
    c = api.compile(ORDER)
    return c.unflatten(c.flatten(orders(spark, sf_dir))).select("key", "cust", "status", "total", "info.priority", "info.cust2")


def orders(spark, sf_dir) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("cust"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total"), F.struct(F.col("o_orderpriority").alias("priority"), F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey")).alias("cust2")).alias("info"))


DEFAULTS = Schema(rec("D", fld("key", "long"), fld("status", enum("St", "F", "O", "P"), default="P"), fld("total", "double", default=-1.5), fld("note", "string", default="none"), fld("list", arr("int"), default=[1, 2]), fld("in", rec("Din", fld("a", "int", default=7), fld("b", "string", default="x")), default={"a": 9})))


@query(
    "SELECT o_orderkey AS key, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE list_position(['F', 'O', 'P'], o_orderstatus) - 1 END AS INTEGER) AS status, CASE WHEN o_orderkey % 5 = 0 THEN -1.5 ELSE o_totalprice END AS total, "
    "CASE WHEN o_orderkey % 2 = 0 THEN 'none' ELSE o_orderpriority END AS note, CASE WHEN o_orderkey % 7 = 0 THEN '1,2' ELSE '4' END AS items, CASE WHEN o_orderkey % 2 = 0 THEN 9 ELSE 5 END AS in_a, 'x' AS in_b FROM orders"
)
def flatten_defaults(spark, sf_dir):
    o, key = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    absent = lambda n, c: F.when(key % n != 0, c)
    df = o.select(key.alias("key"), absent(3, F.col("o_orderstatus")).alias("status"), absent(5, F.col("o_totalprice")).alias("total"), absent(2, F.col("o_orderpriority")).alias("note"), absent(7, F.array(F.lit(4))).alias("list"), absent(2, F.struct(F.lit(5).alias("a"), F.lit(None).cast("string").alias("b"))).alias("in"))
    out = plain(api.compile(DEFAULTS).flatten(df))
    return out.withColumn("items", F.array_join(F.col("list").cast("array<string>"), ",")).drop("list")


@query("SELECT c_custkey AS key, CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal END AS bal, CASE WHEN c_custkey % 4 = 0 THEN c_nationkey END AS nation FROM customer")
def flatten_nullable_scalar(spark, sf_dir):
    s = Schema(rec("N", fld("key", "long"), fld("bal", "double*"), fld("nation", "int*")))
    c = read(spark, sf_dir, "customer")
    return api.compile(s).flatten(c.select(F.col("c_custkey").alias("key"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal")).alias("bal"), F.when(F.col("c_custkey") % 4 == 0, F.col("c_nationkey")).alias("nation")))


PART = Schema(rec("Part", fld("key", "long"), fld("what", {"type": "record*", "name": "What", "fields": [fld("brand", "string"), fld("size", "int")]})))


def parts(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("key"), F.when(F.col("p_partkey") % 3 != 0, F.struct(F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))).alias("what"))


@query("SELECT p_partkey AS key, p_partkey % 3 = 0 AS missing, CASE WHEN p_partkey % 3 <> 0 THEN p_brand END AS brand, CASE WHEN p_partkey % 3 <> 0 THEN p_size END AS size FROM part")
def flatten_nullable_record(spark, sf_dir):
    out = api.compile(PART).flatten(parts(spark, sf_dir))
    return out.select("key", F.col("what").isNull().alias("missing"), F.col("what.c0").alias("brand"), F.col("what.c1").alias("size"))


@query("SELECT p_partkey AS key, CASE WHEN p_partkey % 3 <> 0 THEN p_brand END AS brand, CASE WHEN p_partkey % 3 <> 0 THEN p_size END AS size FROM part")
def unflatten_nullable_record(spark, sf_dir):
    c = api.compile(PART)
    return c.unflatten(c.flatten(parts(spark, sf_dir))).select("key", "what.brand", "what.size")


# Enums


FLAGS = Schema(rec("L", fld("order", "long"), fld("line", "int"), fld("flag", enum("Flag", "A", "N", "R")), fld("status", enum("LSt", "F", "O"))))


def lines(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order"), F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"))


@query("SELECT l_orderkey AS \"order\", l_linenumber AS line, CAST(list_position(['A', 'N', 'R'], l_returnflag) - 1 AS INTEGER) AS flag, CAST(list_position(['F', 'O'], l_linestatus) - 1 AS INTEGER) AS status FROM lineitem")
def enum_encode(spark, sf_dir):
    return api.compile(FLAGS).flatten(lines(spark, sf_dir))


@query("SELECT l_orderkey AS \"order\", l_linenumber AS line, l_returnflag AS flag, l_linestatus AS status FROM lineitem")
def enum_decode(spark, sf_dir):
    c = api.compile(FLAGS)
    return c.unflatten(c.flatten(lines(spark, sf_dir)))


@query("SELECT o_orderkey AS key, CAST(CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'F' THEN 2 END AS INTEGER) AS status FROM orders")
def enum_version_remap(spark, sf_dir):
    a, b = Schema(rec("E", fld("key", "long"), fld("status", enum("S", "F", "O", "P")))), Schema(rec("E", fld("key", "long"), fld("status", enum("S", "O", "X", "F"))))
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"))
    return api.compile(a, b).flatten(o)


@query(f"SELECT l_orderkey AS \"order\", l_linenumber AS line, l_returnflag IN ('A', 'R') AS ok FROM lineitem")
def enum_unknown_symbols(spark, sf_dir):
    s = Schema(rec("L", fld("order", "long"), fld("line", "int"), fld("flag", enum("Flag", "A", "R"))))
    out = api.compile(s).flatten(lines(spark, sf_dir).drop("status"))
    return out.select("order", "line", F.col("flag").isNotNull().alias("ok"))


@query(
    "SELECT l_orderkey AS \"order\", l_linenumber AS line, l_returnflag <> 'N' AND l_linenumber % 3 <> 0 AS ok, CASE WHEN l_returnflag = 'N' THEN 'flag: Bad value: \"N\" (schema versioning)' WHEN l_linenumber % 3 = 0 THEN 'Key missing: \"status\"' END AS error, "
    "CASE WHEN l_returnflag <> 'N' AND l_linenumber % 3 <> 0 THEN CAST(list_position(['R', 'A'], l_returnflag) - 1 AS INTEGER) END AS flag FROM lineitem"
)
def flatten_checked_rows(spark, sf_dir):
    """Typed rows that carry their error instead of ending the query."""
    b = Schema(rec("L", fld("order", "long"), fld("line", "int"), fld("flag", enum("Flag", "R", "A")), fld("status", enum("LSt", "F", "O"))))
    df = lines(spark, sf_dir).withColumn("status", F.when(F.col("line") % 3 != 0, F.col("status")))
    out = api.compile(FLAGS, b).flatten_checked(df.select("*", F.col("order").alias("o"), F.col("line").alias("l")), ["o", "l"])
    return out.select(F.col("o").alias("order"), F.col("l").alias("line"), "ok", "error", F.col("tuple.flag").alias("flag"))


# Unions: value, count and name of an event, by its type


EVENT = Schema(rec("Event", fld("id", "long"), fld("what", ["null", "long", "double", "string"])))


def events(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    tag = F.when(F.col("event_type") == "view", 0).when(F.col("event_type") == "click", 1).when(F.col("event_type") == "purchase", 2).otherwise(3)
    what = F.struct(tag.alias(TAG), F.when(tag == 1, F.col("user_id")).alias("long"), F.when(tag == 2, F.col("value")).alias("double"), F.when(tag == 3, F.col("event_type")).alias("string"))
    return e.select(F.col("event_id").alias("id"), what.alias("what"))


TAGS = "CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 ELSE 3 END"


@query(f"SELECT event_id AS id, {TAGS} AS what_tag, CASE WHEN event_type = 'purchase' THEN value END AS d, CASE WHEN event_type = 'click' THEN user_id END AS l, CASE WHEN event_type IN ('error', 'signup') THEN event_type END AS s FROM events")
def union_encode(spark, sf_dir):
    out = plain(api.compile(EVENT).flatten(events(spark, sf_dir)))
    return out.select("id", "what_tag", F.col("what.double").alias("d"), F.col("what.long").alias("l"), F.col("what.string").alias("s"))


@query(f"SELECT event_id AS id, {TAGS} AS tag, CASE WHEN event_type = 'click' THEN user_id END AS l, CASE WHEN event_type = 'purchase' THEN value END AS d, CASE WHEN event_type IN ('error', 'signup') THEN event_type END AS s FROM events")
def union_decode(spark, sf_dir):
    c = api.compile(EVENT)
    w = F.col("what")
    return c.unflatten(c.flatten(events(spark, sf_dir))).select("id", w[TAG].alias("tag"), w["long"].alias("l"), w["double"].alias("d"), w["string"].alias("s"))


@query("SELECT event_id AS id, CASE event_type WHEN 'view' THEN 2 WHEN 'click' THEN 1 WHEN 'purchase' THEN 1 ELSE 0 END AS tag, CASE WHEN event_type = 'click' THEN CAST(user_id AS DOUBLE) WHEN event_type = 'purchase' THEN value END AS d, CASE WHEN event_type IN ('error', 'signup') THEN event_type END AS s FROM events")
def union_remap(spark, sf_dir):
    b = Schema(rec("Event", fld("id", "long"), fld("what", ["string", "double", "null"])))
    out = plain(api.compile(EVENT, b).flatten(events(spark, sf_dir)))
    return out.select("id", F.col("what_tag").alias("tag"), F.col("what.double").alias("d"), F.col("what.string").alias("s"))


@query("SELECT event_id AS id, CASE WHEN event_type = 'purchase' THEN value WHEN event_type = 'click' THEN NULL END AS what FROM events")
def union_to_scalar(spark, sf_dir):
    a = Schema(rec("Event", fld("id", "long"), fld("what", ["null", "double", "string"])))
    b = Schema(rec("Event", fld("id", "long"), fld("what", "double")))
    e = events(spark, sf_dir)
    w = F.col("what")
    df = e.select("id", F.struct(F.when(w[TAG] == 2, 1).when(w[TAG] == 0, 0).otherwise(2).alias(TAG), w["double"].alias("double"), w["string"].alias("string")).alias("what"))
    return api.compile(a, b).flatten(df)


@query("SELECT event_id AS id, 1 AS tag, value AS d FROM events")
def scalar_to_union(spark, sf_dir):
    a, b = Schema(rec("Event", fld("id", "long"), fld("what", "double"))), Schema(rec("Event", fld("id", "long"), fld("what", ["string", "double"])))
    out = plain(api.compile(a, b).flatten(read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("value").alias("what"))))
    return out.select("id", F.col("what_tag").alias("tag"), F.col("what.double").alias("d"))


# Arrays, maps, fixed


@query("SELECT vec_id AS id, CAST(k - 1 AS INTEGER) AS place, CAST(embedding[k] AS DOUBLE) AS x FROM embeddings, unnest(range(1, len(embedding) + 1)) t(k)")
def array_of_scalars(spark, sf_dir):
    a, b = Schema(rec("V", fld("id", "long"), fld("v", arr("float")))), Schema(rec("V", fld("id", "long"), fld("v", arr("double"))))
    out = api.compile(a, b).flatten(read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")))
    return out.select("id", F.posexplode("v").alias("place", "x"))


BASKET = Schema(rec("Basket", fld("order", "long"), fld("items", arr(rec("Item", fld("line", "int"), fld("qty", "double"), fld("flag", enum("Flag", "A", "N", "R")))))))


@query("SELECT l_orderkey AS \"order\", l_linenumber AS line, l_quantity AS qty, CAST(list_position(['A', 'N', 'R'], l_returnflag) - 1 AS INTEGER) AS flag FROM lineitem")
def array_of_records(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    df = li.groupBy(F.col("l_orderkey").alias("order")).agg(F.collect_list(F.struct(F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("qty"), F.col("l_returnflag").alias("flag"))).alias("items"))
    out = api.compile(BASKET).flatten(df)
    return out.select("order", F.inline("items")).toDF("order", "line", "qty", "flag")


@query("SELECT event_id AS id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, 1 AS n FROM events")
def map_of_scalars(spark, sf_dir):
    a, b = Schema(rec("P", fld("id", "long"), fld("m", {"type": "map", "values": "int"}))), Schema(rec("P", fld("id", "long"), fld("m", {"type": "map", "values": "long"})))
    df = read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.from_json("props", "map<string,int>").alias("m"))
    return api.compile(a, b).flatten(df).select("id", F.col("m")["k"].alias("k"), F.size("m").alias("n"))


@query("SELECT c_custkey AS key, CASE WHEN length(c_name) % 2 = 0 THEN substr(c_name, 1, 4) END AS code FROM customer")
def fixed_check(spark, sf_dir):
    s = Schema(rec("F", fld("key", "long"), fld("code", {"type": "fixed", "name": "Code", "size": 4})))
    code = F.when(F.length("c_name") % 2 == 0, F.substring("c_name", 1, 4)).otherwise(F.substring("c_name", 1, 5))
    out = api.compile(s).flatten(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), code.cast("binary").alias("code")))
    return out.select("key", F.col("code").cast("string").alias("code"))


# Widening


def widened(spark, sf_dir, table, key, column, source, target, cast=None):
    a, b = (Schema(rec("W", fld("key", "long"), fld("x", t))) for t in (source, target))
    x = F.col(column) if cast is None else F.col(column).cast(cast)
    return api.compile(a, b).flatten(read(spark, sf_dir, table).select(F.col(key).cast("long").alias("key"), x.alias("x")))


@query("SELECT p_partkey AS key, CAST(p_size AS BIGINT) AS x FROM part")
def promote_int_long(spark, sf_dir):
    return widened(spark, sf_dir, "part", "p_partkey", "p_size", "int", "long")


@query("SELECT p_partkey AS key, CAST(CAST(p_size AS FLOAT) AS DOUBLE) AS x FROM part")
def promote_int_float(spark, sf_dir):
    return widened(spark, sf_dir, "part", "p_partkey", "p_size", "int", "float").withColumn("x", F.col("x").cast("double"))


@query("SELECT p_partkey AS key, CAST(p_size AS DOUBLE) AS x FROM part")
def promote_int_double(spark, sf_dir):
    return widened(spark, sf_dir, "part", "p_partkey", "p_size", "int", "double")


@query("SELECT l_orderkey AS key, CAST(CAST(l_partkey AS FLOAT) AS DOUBLE) AS x FROM lineitem")
def promote_long_float(spark, sf_dir):
    return widened(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "long", "float").withColumn("x", F.col("x").cast("double"))


@query("SELECT l_orderkey AS key, CAST(l_partkey AS DOUBLE) AS x FROM lineitem")
def promote_long_double(spark, sf_dir):
    return widened(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "long", "double")


@query("SELECT p_partkey AS key, CAST(CAST(p_size AS FLOAT) AS DOUBLE) AS x FROM part")
def promote_float_double(spark, sf_dir):
    return widened(spark, sf_dir, "part", "p_partkey", "p_size", "float", "double", "float")


@query("SELECT CAST(n_nationkey AS BIGINT) AS key, hex(encode(n_name)) AS x FROM nation")
def promote_string_bytes(spark, sf_dir):
    return widened(spark, sf_dir, "nation", "n_nationkey", "n_name", "string", "bytes").withColumn("x", F.hex("x"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS key, n_name AS x FROM nation")
def promote_bytes_string(spark, sf_dir):
    return widened(spark, sf_dir, "nation", "n_nationkey", "n_name", "bytes", "string", "binary")


# Evolution


def customer_v1() -> Schema:
    return Schema(rec("C", fld("key", "long"), fld("name", "string"), fld("nation", "int"), fld("bal", "double")))


def customers_v1(spark, sf_dir):
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("bal"))


@query("SELECT c_custkey AS key, c_name AS name, c_nationkey AS nation, c_acctbal AS bal, 'new' AS state, 3 AS level FROM customer")
def evolve_add_default(spark, sf_dir):
    b = Schema(rec("C", fld("key", "long"), fld("name", "string"), fld("nation", "int"), fld("bal", "double"), fld("state", "string", default="new"), fld("level", "int", default=3)))
    return api.compile(customer_v1(), b).flatten(customers_v1(spark, sf_dir))


@query("SELECT c_custkey AS key, c_acctbal AS bal FROM customer")
def evolve_drop_field(spark, sf_dir):
    return api.compile(customer_v1(), Schema(rec("C", fld("key", "long"), fld("bal", "double")))).flatten(customers_v1(spark, sf_dir))


@query("SELECT c_acctbal AS bal, c_nationkey AS nation, c_name AS name, c_custkey AS key FROM customer")
def evolve_reorder(spark, sf_dir):
    return api.compile(customer_v1(), Schema(rec("C", fld("bal", "double"), fld("nation", "int"), fld("name", "string"), fld("key", "long")))).flatten(customers_v1(spark, sf_dir))


RENAMED = Schema(rec("Client", fld("id", "long", aliases=["key"]), fld("title", "string", aliases=["name"]), fld("nation", "long"), fld("bal", "double"), aliases=["C"]))


@query("SELECT c_custkey AS id, c_name AS title, CAST(c_nationkey AS BIGINT) AS nation, c_acctbal AS bal FROM customer")
def evolve_rename_alias(spark, sf_dir):
    return api.compile(customer_v1(), RENAMED).flatten(customers_v1(spark, sf_dir))


@query("SELECT c_custkey AS key, c_name AS name, CAST(c_nationkey AS BIGINT) AS nation, c_acctbal AS bal FROM customer")
def evolve_downgrade_alias(spark, sf_dir):
    old = Schema(rec("C", fld("key", "long"), fld("name", "string"), fld("nation", "long"), fld("bal", "double")))
    df = customers_v1(spark, sf_dir).select(F.col("key").alias("id"), F.col("name").alias("title"), F.col("nation").cast("long").alias("nation"), "bal")
    return api.compile(RENAMED, old, downgrade=True).flatten(df)


@query("SELECT p_partkey AS key, p_brand AS brand, p_size AS size FROM part")
def evolve_record_to_nullable(spark, sf_dir):
    a = Schema(rec("Part", fld("key", "long"), fld("what", rec("What", fld("brand", "string"), fld("size", "int")))))
    df = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.struct(F.col("p_brand").alias("brand"), F.col("p_size").alias("size")).alias("what"))
    out = api.compile(a, PART).flatten(df)
    return out.select("key", F.col("what.c0").alias("brand"), F.col("what.c1").alias("size"))


@query("SELECT p_partkey AS key, CAST(p_size AS BIGINT) AS size FROM part")
def evolve_scalar_to_nullable(spark, sf_dir):
    a, b = Schema(rec("P", fld("key", "long"), fld("size", "int"))), Schema(rec("P", fld("key", "long"), fld("size", "long*")))
    return api.compile(a, b).flatten(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_size").alias("size")))


@query("SELECT c_custkey AS key, CAST(c_nationkey AS DOUBLE) AS nation, 1 AS level FROM customer")
def evolve_chain(spark, sf_dir):
    b = Schema(rec("C", fld("key", "long"), fld("nation", "long"), fld("level", "int", default=1)))
    c = Schema(rec("C", fld("key", "long"), fld("nation", "double"), fld("level", "int", default=2)))
    return api.compile(customer_v1(), b, c).flatten(customers_v1(spark, sf_dir))


@query("SELECT s_suppkey AS key, s_acctbal AS bal FROM supplier")
def hidden_fields(spark, sf_dir):
    s = Schema(rec("S", fld("key", "long"), fld("name", "string", hidden=True), fld("bal", "double")))
    c = api.compile(s)
    df = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal"))
    return c.unflatten(c.flatten(df))


@query("SELECT o_orderdate AS bucket, o_orderkey AS key, o_totalprice AS total FROM orders")
def service_fields_flatten(spark, sf_dir):
    c = api.compile(Schema(rec("O", fld("key", "long"), fld("total", "double"))), service_fields=["long"])
    df = read(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("bucket"), F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("total"))
    return c.flatten(df, ["bucket"])


@query("SELECT o_custkey AS bucket, o_orderkey AS key, o_totalprice AS total FROM orders")
def service_fields_unflatten(spark, sf_dir):
    c = api.compile(Schema(rec("O", fld("key", "long"), fld("total", "double"))), service_fields=["long"])
    df = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("bucket"), F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("total"))
    return c.unflatten(c.flatten(df, ["bucket"]), ["bucket"])


# Updates


@query(
    "SELECT c_custkey AS id, 2 AS pos, c_name AS value FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 3, CAST(c_nationkey AS VARCHAR) FROM customer WHERE c_custkey % 3 = 0 "
    f"UNION ALL SELECT c_custkey, 5, CAST(list_position({listed(SEGMENTS)}, c_mktsegment) - 1 AS VARCHAR) FROM customer WHERE c_custkey % 5 = 0"
)
def xflatten_rows(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    df = c.select(key.alias("id"), F.lit(None).cast("long").alias("key"), F.when(key % 2 == 0, F.col("c_name")).alias("name"), F.struct(F.when(key % 3 == 0, F.col("c_nationkey")).alias("nation")).alias("geo"), F.struct(F.lit(None).cast("double").alias("bal"), F.when(key % 5 == 0, F.col("c_mktsegment")).alias("segment")).alias("acct"))
    return api.compile(CUSTOMER).xflatten_rows(df, ["id"]).select("id", "pos", "value")


@query(
    f"SELECT event_id AS id, '=' AS op, 2 AS pos, CAST({TAGS} AS DOUBLE) AS number, NULL AS word FROM events UNION ALL SELECT event_id, '=', 3, CASE event_type WHEN 'click' THEN CAST(user_id AS DOUBLE) WHEN 'purchase' THEN value END, CASE WHEN event_type IN ('error', 'signup') THEN event_type END FROM events"
)
def xflatten_union(spark, sf_dir):
    df = events(spark, sf_dir).select(F.col("id").alias("event"), F.lit(None).cast("long").alias("id"), "what")
    out = api.compile(EVENT).xflatten(df, ["event"]).select(F.col("event").alias("id"), F.inline("updates"))
    is_word = F.schema_of_variant("value") == "STRING"
    return out.select("id", "op", "pos", F.when(~is_word, F.try_variant_get("value", "$", "double")).alias("number"), F.when(is_word, F.try_variant_get("value", "$", "string")).alias("word"))


@query("SELECT event_id AS id, 3 AS pos, CAST(user_id AS VARCHAR) AS value FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, 4, event_type FROM events")
def xflatten_service(spark, sf_dir):
    c = api.compile(Schema(rec("E", fld("user", "long"), fld("kind", "string"))), service_fields=["int", "string"])
    df = read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 2 == 0, F.col("user_id")).alias("user"), F.col("event_type").alias("kind"))
    return c.xflatten_rows(df, ["id"]).select("id", "pos", "value")


@query("SELECT p_partkey AS id, 2 AS pos, p_brand AS brand, p_size AS size FROM part WHERE p_partkey % 3 <> 0")
def xflatten_nullable_record(spark, sf_dir):
    c = api.compile(PART, alpha_nullable_record_xflatten=True)
    df = parts(spark, sf_dir).select(F.col("key").alias("id"), F.lit(None).cast("long").alias("key"), "what")
    out = c.xflatten(df, ["id"]).select("id", F.inline("updates"))
    return out.select("id", "pos", F.try_variant_get("value", "$.c0", "string").alias("brand"), F.try_variant_get("value", "$.c1", "int").alias("size"))


@query("SELECT c_custkey AS id, 1 AS pos, c_acctbal AS number FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 3, CAST(c_custkey AS DOUBLE) FROM customer")
def xflatten_evolution(spark, sf_dir):
    b = Schema(rec("C", fld("bal", "double"), fld("nation", "int"), fld("key", "long")))
    df = customers_v1(spark, sf_dir).select(F.col("key").alias("id"), "key", F.lit(None).cast("string").alias("name"), F.lit(None).cast("int").alias("nation"), F.when(F.col("key") % 2 == 0, F.col("bal")).alias("bal"))
    return api.compile(customer_v1(), b).xflatten(df, ["id"]).select("id", F.inline("updates")).select("id", "pos", F.try_variant_get("value", "$", "double").alias("number"))


# Validation of JSON text


def checked(spark, sf_dir, schema, text) -> DataFrame:
    e = read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), text.alias("doc"))
    return schema.validate_json(e, "doc")


PROPS = Schema(rec("Props", fld("k", "int"), fld("level", "int", default=5)))


@query("SELECT event_id AS id, TRUE AS is_valid, CAST(json_extract(props, '$.k') AS INTEGER) AS k, 5 AS level FROM events")
def validate_ok(spark, sf_dir):
    return checked(spark, sf_dir, PROPS, F.col("props")).select("id", "is_valid", F.col("value.k").alias("k"), F.col("value.level").alias("level"))


@query(
    "SELECT event_id AS id, event_id % 4 = 0 AS is_valid, CASE event_id % 4 WHEN 1 THEN 'k: Not a int: x' WHEN 2 THEN 'k: Not a int: 1.5' WHEN 3 THEN 'Invalid data' END AS error FROM events"
)
def validate_errors(spark, sf_dir):
    i = F.col("event_id") % 4
    return checked(spark, sf_dir, PROPS, F.when(i == 0, F.col("props")).when(i == 1, '{"k": "x"}').when(i == 2, '{"k": 1.5}').otherwise('{"k": ')).select("id", "is_valid", "error")


@query("SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN 'other: Unknown field' END AS error FROM events")
def validate_unknown_key(spark, sf_dir):
    return checked(spark, sf_dir, PROPS, F.when(F.col("event_id") % 2 == 0, '{"k": 1, "other": 2}').otherwise(F.col("props"))).select("id", "error")


@query("SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN 'Field k missing' END AS error FROM events")
def validate_missing(spark, sf_dir):
    return checked(spark, sf_dir, PROPS, F.when(F.col("event_id") % 2 == 0, '{"level": 1}').otherwise(F.col("props"))).select("id", "error")


@query("SELECT event_id AS id, CASE WHEN user_id % 2 = 0 THEN 'k: Not a int: ' || CAST(2147483648 + user_id AS VARCHAR) END AS error FROM events")
def validate_int_range(spark, sf_dir):
    big = F.concat(F.lit('{"k": '), (F.lit(2147483648).cast("long") + F.col("user_id")).cast("string"), F.lit("}"))
    return checked(spark, sf_dir, PROPS, F.when(F.col("user_id") % 2 == 0, big).otherwise(F.col("props"))).select("id", "error")


@query("SELECT event_id AS id, CASE WHEN event_type IN ('error', 'signup') THEN 'kind: Not a Kind: ' || event_type END AS error FROM events")
def validate_enum(spark, sf_dir):
    s = Schema(rec("X", fld("kind", enum("Kind", "click", "purchase", "view"))))
    return checked(spark, sf_dir, s, F.to_json(F.struct(F.col("event_type").alias("kind")))).select("id", "error")


@query(
    "SELECT event_id AS id, CASE event_id % 6 WHEN 1 THEN 'Field u missing' WHEN 2 THEN 'u/what: Unexpected key in union' WHEN 3 THEN 'u/int: Not a int: a' WHEN 4 THEN 'l/2: Unexpected type in union: null' WHEN 5 THEN 'l/1/string: Unexpected key in union' END AS error FROM events"
)
def validate_union(spark, sf_dir):
    s = Schema(rec("X", fld("u", ["int", "string"]), fld("l", arr(["int", "string"]), default=[])))
    i = F.col("event_id") % 6
    t = F.when(i == 0, '{"u": {"int": 1}, "l": [{"string": "x"}]}').when(i == 1, '{"u": null}').when(i == 2, '{"u": {"what": 1}}').when(i == 3, '{"u": {"int": "a"}}').when(i == 4, '{"u": {"int": 1}, "l": [{"int": 2}, null]}').otherwise('{"u": {"int": 1}, "l": [{"int": 2, "string": "x"}]}')
    return checked(spark, sf_dir, s, t).select("id", "error")


#: Numbers as JSON writes them, what a field of type int and one of type long make of them, and the value.
NUMBERS = (("7", True, True, 7), ("7.0", True, True, 7), ("1.00000000001", False, False, None), ("0.9999999999999", False, False, None), ("2147483647.0", True, True, 2147483647), ("2147483648", False, True, 2147483648), ("-2147483648", True, True, -2147483648), ("9223372036854775807", False, True, 9223372036854775807), ("9223372036854775808", False, False, None), ("1e3", True, True, 1000), ("25e-1", False, False, None), ("1e400", False, False, None))


@query(f"SELECT event_id AS id, int_ok, long_ok, n.value AS value FROM events JOIN ({stated([(k, *x[1:]) for k, x in enumerate(NUMBERS)], 'k, int_ok, long_ok, value')}) n ON event_id % {len(NUMBERS)} = k")
def validate_fractions(spark, sf_dir):
    """Whole numbers are told from others by all of their digits."""
    texts = F.array(*[F.lit('{"k": ' + x[0] + "}") for x in NUMBERS])
    e = read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.get(texts, (F.col("event_id") % len(NUMBERS)).cast("int")).alias("doc"))
    one = Schema(rec("N", fld("k", "int"))).validate_json(e, "doc").select("id", "doc", F.col("is_valid").alias("int_ok"))
    return Schema(rec("N", fld("k", "long"))).validate_json(one, "doc").select("id", "int_ok", F.col("is_valid").alias("long_ok"), F.col("value.k").alias("value"))


@query("SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN 'list/2: Not a int: b' WHEN event_id % 3 = 1 THEN 'map/z: Not a string: 1' END AS error FROM events")
def validate_nested_paths(spark, sf_dir):
    s = Schema(rec("X", fld("list", arr("int")), fld("map", {"type": "map", "values": "string"})))
    i = F.col("event_id") % 3
    return checked(spark, sf_dir, s, F.when(i == 0, '{"list": [1, "b"], "map": {}}').when(i == 1, '{"list": [], "map": {"a": "x", "z": 1}}').otherwise('{"list": [1, 2], "map": {"a": "x"}}')).select("id", "error")


# Facts about schemas


SHIPMENT = Schema(rec(
    "Shipment", fld("order", "long"), fld("buyer", rec("Buyer", fld("name", "string"), fld("home", rec("Home", fld("nation", "int"), fld("region", "string*"))))), fld("lines", {"type": "array*", "items": "double*"}),
    fld("paid", ["null", "double", "string*"]), fld("gift", {"type": "record*", "name": "Gift", "fields": [fld("note", "string")]}), fld("taxes", {"type": "map", "values": "float"}), fld("state", enum("State", "OPEN", "DONE")), fld("seal", {"type": "fixed*", "name": "Seal", "size": 4}),
))
CELLS = (("$service_field$", "int"), ("$service_field$", "string*"), ("order", "long"), ("buyer.name", "string"), ("buyer.home.nation", "int"), ("buyer.home.region", "string*"), ("lines", "array*"), ("paid.$type$", "union_type"), ("paid", "union_value"), ("gift", "record*"), ("taxes", "map"), ("state", "enum"), ("seal", "fixed*"))


@query(stated([(k, n) for k, (n, _) in enumerate(CELLS)], "pos, name"))
def schema_names(spark, sf_dir):
    return spark.createDataFrame(list(enumerate(SHIPMENT.names(["int", "string*"]))), "pos int, name string")


@query(stated([(k, t) for k, (_, t) in enumerate(CELLS)], "pos, type"))
def schema_types(spark, sf_dir):
    return spark.createDataFrame(list(enumerate(SHIPMENT.types(["int", "string*"]))), "pos int, type string")


@query(stated([(k, *x) for k, x in enumerate(CELLS)], "pos, name, type"))
def bound_names_and_types(spark, sf_dir):
    """The same of compiled converters, which know their service fields."""
    c = api.compile(SHIPMENT, service_fields=["int", "string*"])
    return spark.createDataFrame([(k, n, t) for k, (n, t) in enumerate(zip(c.names(), c.types(), strict=True))], "pos int, name string, type string")


GRID = {"null": "null", "boolean": "boolean", "int": "int", "long": "long", "float": "float", "double": "double", "bytes": "bytes", "string": "string", "array": arr("int"), "map": {"type": "map", "values": "int"}, "record": rec("foo", fld("A", "int")), "enum": enum("e", "A"), "fixed": {"type": "fixed", "name": "f", "size": 4}}
WIDER = (("int", "long"), ("int", "float"), ("int", "double"), ("long", "float"), ("long", "double"), ("float", "double"), ("bytes", "string"), ("string", "bytes"))


@query(
    f"WITH k AS (SELECT unnest({listed(GRID)}) AS k) SELECT a.k AS source, b.k AS target, a.k = b.k OR (a.k || '>' || b.k) IN ({', '.join(repr(f'{x}>{y}') for x, y in WIDER)}) AS compatible FROM k a, k b"
)
def schema_compat_matrix(spark, sf_dir):
    made = {k: Schema(v) for k, v in GRID.items()}
    return spark.createDataFrame([(a, b, api.are_compatible(x, y)[0]) for a, x in made.items() for b, y in made.items()], "source string, target string, compatible boolean")


PET = Schema(rec("Pet", fld("kind", enum("Kind", "CAT", "DOG")), fld("name", "string")))


@query("""SELECT 'Pet' AS name, sha256('{"name":"Pet","type":"record","fields":[{"name":"kind","type":{"name":"Kind","type":"enum","symbols":["CAT","DOG"]}},{"name":"name","type":"string"}]}') AS digest""")
def schema_fingerprint(spark, sf_dir):
    return spark.createDataFrame([("Pet", PET.fingerprint("sha256", 32).hex())], "name string, digest string")


@query("""SELECT '{"type":"record","name":"Pet","fields":[{"name":"kind","type":{"type":"enum","name":"Kind","symbols":["CAT","DOG"]}},{"name":"name","type":"string"}]}' AS definition""")
def schema_export(spark, sf_dir):
    return spark.createDataFrame([(json.dumps(PET.export(), separators=(",", ":")),)], "definition string")


@query("""SELECT * FROM (VALUES ('bad', FALSE, 'R/A: Unknown Avro type: bad'), ('int', TRUE, CAST(NULL AS VARCHAR)), ('long', TRUE, NULL)) t(kind, ok, error)""")
def schema_checks(spark, sf_dir):
    made = [(k, *api.create(rec("R", fld("A", k)))) for k in ("bad", "int", "long")]
    return spark.createDataFrame([(k, ok, None if ok else m) for k, ok, m in made], "kind string, ok boolean, error string")


# The exact path: MessagePack, recursion, streams


@query("SELECT c_custkey AS id, TRUE AS ok, c_name AS name, c_nationkey AS nation, c_mktsegment AS segment FROM customer")
def msgpack_roundtrip(spark, sf_dir):
    c = api.compile(CUSTOMER)
    df = dealt(customers(spark, sf_dir), "key").select(F.col("key").alias("id"), F.to_json(F.struct("key", "name", "geo", "acct")).alias("doc"))
    packed = c.flatten_msgpack(df, "doc", ["id"], "json").select("id", F.col("value").alias("tuple"))
    back = c.unflatten_msgpack(packed, "tuple", ["id"]).select("id", F.col("value").alias("object"))
    out = exact.apply(back, "object", lambda x: x, "msgpack", "json", ["id"])
    got = F.from_json("value", "name string, geo struct<nation:int>, acct struct<segment:string>")
    return out.select("id", "ok", got.alias("o")).select("id", "ok", "o.name", "o.geo.nation", "o.acct.segment")


@query(f"SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN '[' || c_custkey || ',\"' || c_name || '\",' || c_nationkey || ',' || (list_position({listed(SEGMENTS)}, c_mktsegment) - 1) || ']' END AS value, CASE WHEN c_custkey % 2 <> 0 THEN 'Key missing: \"segment\"' END AS error FROM customer")
def flatten_json_exact(spark, sf_dir):
    s = Schema(rec("C", fld("key", "long"), fld("name", "string"), fld("nation", "int"), fld("segment", enum("Sg", *SEGMENTS))))
    c = dealt(read(spark, sf_dir, "customer"), "c_custkey")
    doc = F.to_json(F.struct(F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("segment"), F.col("c_nationkey").alias("nation"), F.col("c_name").alias("name"), F.col("c_custkey").alias("key")))
    return api.compile(s).flatten_json(c.select(F.col("c_custkey").alias("id"), doc.alias("doc")), "doc", ["id"]).select("id", "value", "error")


THREAD = Schema(rec("node", fld("next", ["null", "node"]), fld("label", "string")))


def thread_docs(spark, sf_dir):
    """(id, doc): all turns of each conversation, in order, as a chain of records; a label is the turn's role and whole text."""
    label = F.concat(F.coalesce("role", F.lit("-")), F.lit(": "), F.coalesce("text", F.lit("")))
    tail = F.concat(F.lit(","), F.substring(F.to_json(F.struct(label.alias("label"))), 2, (1 << 31) - 1))
    turns = read(spark, sf_dir, "conversations").where("conv_id IS NOT NULL").select(F.col("conv_id").alias("id"), F.struct(F.col("turn").alias("turn"), tail.alias("tail")).alias("t"))
    tails = F.reverse(F.transform(F.sort_array("ts"), lambda t: t["tail"]))
    # The heads of all records, and then from the last record on what closes each.
    doc = F.concat(F.repeat(F.lit('{"next":{"node":'), F.size("ts") - 1), F.lit('{"next":null'), F.array_join(tails, "}"))
    return turns.groupBy("id").agg(F.collect_list("t").alias("ts")).select("id", doc.alias("doc"))


@query("SELECT conv_id AS id, TRUE AS ok, TRUE AS same FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)")
def recursive_thread(spark, sf_dir):
    """Each whole conversation as a chain of records, there and back."""
    c = api.compile(THREAD)
    flat = c.flatten_json(thread_docs(spark, sf_dir), "doc", ["id", "doc"]).select("id", "doc", F.col("value").alias("tuple"))
    back = c.unflatten_json(flat, "tuple", ["id", "doc"])
    return back.select("id", "ok", F.col("value").eqNullSafe(F.col("doc")).alias("same"))


@query("SELECT event_id AS id, user_id AS user, CAST(list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1 AS INTEGER) AS kind, value AS detail_value FROM events")
def stream_flatten(spark, sf_dir):
    """flatten over a stream of the events' files, all that is there now, appended to files in the shared folder and read back."""
    import uuid

    from schemaloom.streaming import run_available, work_folder

    s = Schema(rec("E", fld("id", "long"), fld("user", "long"), fld("kind", enum("Ek", *KINDS)), fld("detail", rec("Dt", fld("value", "double")))))
    here = read(spark, sf_dir, "events")
    stream = spark.readStream.schema(here.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    base = f"{work_folder(spark)}/stream-{uuid.uuid4().hex}"
    work = lambda df: plain(api.compile(s).flatten(df.select(F.col("event_id").alias("id"), F.col("user_id").alias("user"), F.col("event_type").alias("kind"), F.struct(F.col("value").alias("value")).alias("detail"))))
    run_available(stream, work, f"{base}/out", f"{base}/state").awaitTermination()
    return spark.read.parquet(f"{base}/out")


# Every rule, by its cases


@query(stated([(k, rule, why) for k, (rule, _, why) in enumerate(cases.REFUSED)], "n, rule, error"))
def definitions_refused(spark, sf_dir):
    made = [(k, rule, *api.create(d)) for k, (rule, d, _) in enumerate(cases.REFUSED)]
    return spark.createDataFrame([(k, rule, None if ok else e) for k, rule, ok, e in made], "n int, rule string, error string")


@query(stated([(k, rule, why is None, why) for k, (rule, *_, why) in enumerate(cases.PAIRS)], "n, rule, ok, error"))
def revisions_compared(spark, sf_dir):
    return spark.createDataFrame([(k, rule, *api.are_compatible(Schema(a), Schema(b), mode)) for k, (rule, a, b, mode, _) in enumerate(cases.PAIRS)], "n int, rule string, ok boolean, error string")


@query(stated([(k, rule, why is None, why if why else json.dumps(x, separators=(",", ":"))) for k, (rule, _, x, why) in enumerate(cases.VALID)], "n, rule, ok, result"))
def values_validated(spark, sf_dir):
    made = [(k, rule, *api.validate(Schema(t), x)) for k, (rule, t, x, _) in enumerate(cases.VALID)]
    return spark.createDataFrame([(k, rule, ok, exact.dumps(out) if ok else out) for k, rule, ok, out in made], "n int, rule string, ok boolean, result string")


def converted(case: dict):
    """One conversion, of its schemas, options and input."""
    c = api.compile(*map(Schema, case["schemas"]), **case["options"])
    work = {"flatten": c.flatten_object, "unflatten": lambda x: c.unflatten_object(x)[0], "xflatten": c.xflatten_object}[case["what"]]
    return work(case["input"])


def result_of(x) -> tuple[bool, str]:
    return (False, x) if isinstance(x, str) else (True, json.dumps(x, separators=(",", ":")))


def conversion_cases(spark) -> DataFrame:
    rows = [(k, rule, json.dumps({"what": what, "schemas": schemas, "options": options, "input": x})) for k, (rule, what, schemas, options, x, _) in enumerate(cases.CONVERTED)]
    return spark.createDataFrame(rows, "n int, rule string, doc string")


@query(stated([(k, rule, *result_of(y)) for k, (rule, *_, y) in enumerate(cases.CONVERTED)], "n, rule, ok, result"))
def conversions_by_rule(spark, sf_dir):
    out = exact.apply(conversion_cases(spark), "doc", converted, "json", "json")
    return out.select("n", "rule", "ok", F.coalesce("value", "error").alias("result"))


@query(stated([(k, rule, *result_of(y)) for k, (rule, what, *_, y) in enumerate(cases.CONVERTED)], "n, rule, ok, result"))
def conversions_to_msgpack(spark, sf_dir):
    """The same conversions written as MessagePack, which is then read as JSON; B4, B5 and B6."""
    packed = exact.apply(conversion_cases(spark), "doc", converted, "json", "msgpack").withColumnRenamed("ok", "made").withColumnRenamed("error", "why")
    out = exact.apply(packed, "value", lambda x: x, "msgpack", "json", ["n", "rule", "made", "why"])
    return out.select("n", "rule", F.col("made").alias("ok"), F.coalesce("why", "value").alias("result"))


@query("SELECT event_id AS id, TRUE AS ok, '[[\"=\",2,' || (event_id % 7) || '],[\"=\",1,\"' || event_type || '\"]]' AS value FROM events")
def xflatten_msgpack(spark, sf_dir):
    """Updates in the order of the input's keys, from MessagePack to MessagePack."""
    c = api.compile(Schema(rec("E", fld("kind", "string"), fld("rest", "long"), fld("more", "string"))))
    doc = F.concat(F.lit('{"rest":'), (F.col("event_id") % 7).cast("string"), F.lit(',"kind":"'), F.col("event_type"), F.lit('"}'))
    packed = exact.apply(dealt(read(spark, sf_dir, "events"), "event_id").select(F.col("event_id").alias("id"), doc.alias("doc")), "doc", lambda x: x, "json", "msgpack", ["id"]).select("id", F.col("value").alias("doc"))
    out = c.xflatten_msgpack(packed, "doc", ["id"]).select("id", F.col("value").alias("updates"))
    return exact.apply(out, "updates", lambda x: x, "msgpack", "json", ["id"]).select("id", "ok", "value")


BROKEN = ('{"b": {"$binary": "zz"}, "k": 1}', "Invalid data"), ('{"b": {"$binary": 5}, "k": 1}', "Invalid data"), ('{"b": null, "k": NaN}', "Invalid data"), ('{"k": 1, "k": 2}', "k: Duplicate Key"), ('{"k": ', "Invalid data"), ('{"b": null, "k": 5}', None)


@query(
    f"SELECT c_custkey AS id, e IS NULL AS ok, e AS error, CASE WHEN e IS NULL THEN '[null,5]' END AS value FROM (SELECT c_custkey, CASE c_custkey % 8 {' '.join(f'WHEN {k} THEN {literal(e)}' for k, (_, e) in enumerate(BROKEN) if e)} WHEN 6 THEN 'Nested too deeply' WHEN 7 THEN 'Nested too deeply' END AS e FROM customer)"
)
def broken_rows(spark, sf_dir):
    """Text that can't be read is an error of its row, however it is broken."""
    deep = [F.lit('{"b": null, "k": ' + "[" * 20_000 + "]" * 20_000 + "}"), F.concat(F.repeat(F.lit('{"k":'), 12_000), F.lit("1"), F.repeat(F.lit("}"), 12_000))]
    texts = F.array(*[F.lit(x) for x, _ in BROKEN], *deep)
    c = dealt(read(spark, sf_dir, "customer").select("c_custkey"), "c_custkey").select(F.col("c_custkey").alias("id"), F.get(texts, (F.col("c_custkey") % 8).cast("int")).alias("doc"))
    return api.compile(Schema(rec("B", fld("b", "bytes*"), fld("k", "long")))).flatten_json(c, "doc", ["id"]).select("id", "ok", "error", "value")


FACTS = (
    ("A6 is", "schema", "True"), ("A6 is", "text", "False"), ("A11 text", "record", "Schema (Shipment)"), ("A11 text", "primitive", "Schema (long)"),
    ("A2 preserved", "export", '{"type":"record","name":"K","unit":"kg","fields":[{"name":"w","type":"long"}]}'), ("A2 preserved", "refused", "fingerprint should contain only fields from AST"),
    ("A2 auto defaults", "values", '{"w":0,"l":[],"u":{"string":""},"n":null}'), ("A2 forward reference", "off", "K/a: Unknown Avro type: Later"), ("A2 forward reference", "on", "True"),
    ("C10 dump", "lines", ". MAP 2|w LONG 3|l ARRAY 2|l/1 STR a|l/2 NIL null"), ("C12 mapping", "lines", "K -> K|  (w aka mass): int -> long|  to: default"),
    ("2.3 cyclic", "refused", "Infinite loop detected in the data"),
)


@query(stated([(k, *x) for k, x in enumerate(FACTS)], "n, rule, what, value"))
def schema_facts(spark, sf_dir):
    """Options, texts and dumps of schemas."""
    from schemaloom.sources import msgpack

    kept, later = rec("K", fld("w", "long"), unit="kg"), rec("K", fld("a", "Later"), fld("b", {"type": "fixed", "name": "Later", "size": 2}))
    auto = Schema(rec("K", fld("w", "long"), fld("l", arr("long")), fld("u", ["string", "long"]), fld("n", "long*")), defaults="auto")
    mapping = api.compile(Schema(rec("K", fld("w", "int"))), Schema(rec("K", fld("mass", "long", aliases=["w"]), fld("to", "string", default="x"))))
    loop = {"type": "array"}
    loop["items"] = loop
    values = [
        str(api.is_schema(SHIPMENT)), str(api.is_schema("Shipment")), repr(SHIPMENT), repr(Schema("long")),
        json.dumps(dict(sorted(Schema(kept, preserve_in_ast=["unit"], preserve_in_fingerprint=["unit"]).export().items(), key=lambda x: ("type", "name", "unit", "fields").index(x[0]))), separators=(",", ":")), api.create(kept, preserve_in_fingerprint=["unit"])[1],
        json.dumps(auto.validate({}), separators=(",", ":")), api.create(later)[1], str(api.create(later, forward_reference=True)[0]),
        "|".join(msgpack.dump(msgpack.encode({"w": 3, "l": ["a", None]}))), "|".join(mapping.describe().split("\n")), api.create(loop)[1].split(": ")[-1],
    ]
    return spark.createDataFrame([(k, rule, what, v) for k, ((rule, what, _), v) in enumerate(zip(FACTS, values, strict=True))], "n int, rule string, what string, value string")
