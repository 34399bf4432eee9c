"""Queries over whole tables, with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formwork import streaming
from formwork.functions import register
from formwork.operators import validation as v
from formwork.operators.expressions import sure
from formwork.schema import order
from formwork.schema.compile import compile_schema
from formwork.sources import shared_dir, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Of the queries of one column: table, column and schema.
COLUMN_QUERIES: dict[str, tuple[str, str, str]] = {}


def column_query(name: str, of: str, keys: str, column: str, schema: str, sql: str) -> None:
    """Registers: keys and whether the column's value belongs to the schema."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, of)
        return df.select(*keys.split(), sure(v.condition(df, column, schema)).alias("valid"))

    QUERIES[name] = query
    ORACLES[name] = f"SELECT {', '.join(keys.split())}, {sql} AS valid FROM {of}"
    COLUMN_QUERIES[name] = of, column, schema


_LINE = "l_orderkey l_linenumber l_partkey l_suppkey l_extendedprice"
for _name, _table, _keys, _column, _schema, _sql in (
    ("v01_int_range", "lineitem", _LINE, "l_linenumber", "(int, 1 <= x <= 5)", "l_linenumber BETWEEN 1 AND 5"),
    ("v02_int_exclusive", "lineitem", _LINE, "l_linenumber", "(int, 0 < x, x < 6)", "l_linenumber BETWEEN 1 AND 5"),
    ("v03_float_open", "lineitem", _LINE, "l_discount", "(float, 0.0 < x < 0.1)", "(l_discount > 0.0 AND l_discount < 0.1::DOUBLE)"),
    ("v04_float_half_open", "orders", "o_orderkey", "o_totalprice", "(float, 1000 <= x < 250000.5)", "(o_totalprice >= 1000 AND o_totalprice < 250000.5::DOUBLE)"),
    ("v05_string_enum", "orders", "o_orderkey", "o_orderpriority", '(string, x in ["1-URGENT", "2-HIGH"])', "o_orderpriority IN ('1-URGENT', '2-HIGH')"),
    ("v06_or_of_equalities", "orders", "o_orderkey", "o_orderpriority", '(string, x == "1-URGENT" || x == "2-HIGH")', "o_orderpriority IN ('1-URGENT', '2-HIGH')"),
    ("v07_literal_string", "customer", "c_custkey", "c_mktsegment", '"BUILDING"', "c_mktsegment = 'BUILDING'"),
    ("v08_int_enum", "part", "p_partkey", "p_size", "(int, x in [1, 5, 9, 14, 50])", "p_size IN (1, 5, 9, 14, 50)"),
    ("v09_string_length", "documents", "doc_id", "text", "(string, len(x) >= 1000)", "length(text) >= 1000"),
    ("v10_list_length", "embeddings", "vec_id", "embedding", "([(float)], len(x) == 64)", "len(embedding) = 64"),
    ("v11_list_elements", "embeddings", "vec_id", "embedding", "[(float, -0.3 <= x <= 0.3)]", "len([e FOR e IN embedding IF e::DOUBLE < -0.3::DOUBLE OR e::DOUBLE > 0.3::DOUBLE]) = 0"),
    ("v13_kind_mismatch", "lineitem", _LINE, "l_tax", "(int)", "false"),
    ("v14_int_as_float", "orders", "o_orderkey", "o_orderkey", "(float)", "o_orderkey <= 18014398509481984"),
    ("v15_never", "events", "event_id", "user_id", "(int, x > 5, x < 3)", "false"),
    ("v16_sum", "lineitem", _LINE, "l_linenumber", "(int, x < 3) | (int, x > 5)", "(l_linenumber < 3 OR l_linenumber > 5)"),
    ("v17_sized_int", "part", "p_partkey", "p_partkey", "(int8)", "p_partkey BETWEEN -128 AND 127"),
    ("v18_null_literal", "customer", "c_custkey", "c_name", "null", "c_name IS NULL"),
    ("f01_not_equal", "lineitem", _LINE, "l_linenumber", "(int, x != 3)", "l_linenumber <> 3"),
    ("f02_not", "lineitem", _LINE, "l_linenumber", "(int, !(x == 2 || x == 4))", "NOT (l_linenumber = 2 OR l_linenumber = 4)"),
    ("f03_general_or", "part", "p_partkey", "p_size", "(int, x < 5 || x > 45)", "(p_size < 5 OR p_size > 45)"),
    ("f04_modulo", "part", "p_partkey", "p_size", "(int, x % 3 == 0)", "p_size % 3 = 0"),
    ("f05_arithmetic", "lineitem", _LINE, "l_linenumber", "(int, x * 2 + 1 < 9)", "l_linenumber * 2 + 1 < 9"),
    ("f06_match", "pages", "page_id", "url", '(string, x ~ "^https://[a-z0-9.]+/")', "regexp_matches(url, '^https://[a-z0-9.]+/')"),
    ("f07_starts_with", "pages", "page_id", "url", '(string, startsWith(x, "https://"))', "starts_with(url, 'https://')"),
    ("f08_ends_with", "pages", "page_id", "url", '(string, endsWith(x, "1"))', "suffix(url, '1')"),
    ("f09_contains", "documents", "doc_id", "text", '(string, contains(x, " of "))', "contains(text, ' of ')"),
    ("f10_url", "pages", "page_id", "url", "(string, url(x))", r"regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^\s/?#]+[^\s]*$')"),
    ("f16_subtract", "lineitem", _LINE, "l_linenumber", "(int, x - 2 > 1)", "l_linenumber - 2 > 1"),
    ("f17_divide", "lineitem", _LINE, "l_linenumber", "(int, x / 2 > 1.5)", "l_linenumber / 2 > 1.5"),
    ("f18_minus", "lineitem", _LINE, "l_linenumber", "(int, -x + 7 < 4)", "7 - l_linenumber < 4"),
    ("f11_length_or_prefix", "documents", "doc_id", "text", '(string, len(x) < 500 || startsWith(x, "The "))', "(length(text) < 500 OR starts_with(text, 'The '))"),
):
    column_query(_name, _table, _keys, _column, _schema, _sql)


def text_query(name: str, schema: str, spark_text: Callable[[], Column], sql_text: str, sql_valid: str) -> None:
    """Registers: events and whether a JSON text made of each belongs to the schema."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, "events").select("event_id", spark_text().alias("doc")).withColumn("valid", sure(v.json_condition(F.col("doc"), schema)))

    QUERIES[name] = query
    ORACLES[name] = f"SELECT event_id, {sql_text} AS doc, {sql_valid} AS valid FROM events"


def _joined(*pieces) -> Callable[[], Column]:
    """Text from pieces: strings as they are, (n, strings) by event_id modulo n, None the id."""

    def one(p) -> Column:
        if p is None:
            return F.col("event_id").cast("string")
        if isinstance(p, str):
            return F.lit(p)
        n, choices = p
        return F.element_at(F.array(*map(F.lit, choices)), (F.col("event_id") % n).cast("int") + 1)

    return lambda: F.concat(*map(one, pieces))


def _sql_joined(*pieces) -> str:
    def one(p) -> str:
        if p is None:
            return "event_id::VARCHAR"
        if isinstance(p, str):
            return f"'{p}'"
        n, choices = p
        return f"CASE event_id % {n} " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(choices)) + " END"

    return " || ".join(map(one, pieces))


for _name, _schema, _pieces, _sql in (
    ("j03_closed_object", '{"id":(int)}', ('{"id":', None, (3, [',"zz":1', "", ""]), "}"), "event_id % 3 <> 0"),
    ("j04_required_key", '{"id":(int),"v":(int)}', ("{", (2, ["", '"id":7,']), '"v":', None, "}"), "event_id % 2 = 1"),
    ("j05_optional_key", '{"id":(int,optional)}', ("{", (3, ["", '"id":null', '"id":5']), "}"), "event_id % 3 <> 1"),
    ("j06_int_syntax", '{"v":(int)}', ('{"v":', (2, ["1", "1.0"]), "}"), "event_id % 2 = 0"),
    ("j06_float_syntax", '{"v":(float)}', ('{"v":', (3, ["1", "1.0", "1e400"]), "}"), "event_id % 3 <> 2"),
    ("j07_list_of_objects", '{"a":[{"q":(int)}]}', ('{"a":[{"q":', None, '},{"q":', (4, ['"x"', "2", "3", "4"]), "}]}"), "event_id % 4 <> 0"),
    ("j08_tuple", "#{(int),(int, x > 0)}", ("[", (3, ["1", "1,2", "1,2,3"]), "]"), "event_id % 3 = 1"),
    ("j09_duplicate_key", '{"k":(int)}', ('{"k":', None, (5, [',"k":2', "", "", "", ""]), (7, ["", "}", "}", "}", "}", "}", "}"])), "event_id % 5 <> 0 AND event_id % 7 <> 0"),
    ("j10_sum", '{"v":(int)|(string)}', ('{"v":', (3, ["1", '"a"', "true"]), "}"), "event_id % 3 <> 2"),
    ("j11_literal_object", '{"kind":"a","n":(int, 0 <= x < 5000)}', ('{"kind":', (2, ['"a"', '"b"']), ',"n":', None, "}"), "event_id % 2 = 0 AND event_id < 5000"),
    ("j12_nested_optional", '{"a":(string),"b":({"a":(string),"b":(int)},optional)}', ('{"a":"x"', (3, ["", ',"b":{"a":"y","b":1}', ',"b":{"a":"y"}']), "}"), "event_id % 3 <> 2"),
    ("j13_one_value", '{"a":(int)}', ('{"a":', None, "}", (7, ["", " x", "}", '{"b":2}', "],[2", ",1", " "])), "event_id % 7 IN (0, 6)"),
):
    text_query(_name, _schema, _joined(*_pieces), _sql_joined(*_pieces), f"({_sql})")


def string_query(name: str, schema: str, pieces: tuple, sql_valid: str) -> None:
    """Registers: events and whether a string made of each belongs to the schema."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, "events").select("event_id", _joined(*pieces)().alias("s"))
        return df.withColumn("valid", sure(v.condition(df, "s", schema)))

    QUERIES[name] = query
    ORACLES[name] = f"SELECT event_id, {_sql_joined(*pieces)} AS s, ({sql_valid}) AS valid FROM events"


string_query("f12_email", "(email)", ("user", None, (4, ["@mail.example.org", "@mail", "mail.org", "@a-b.c"])), "event_id % 4 IN (0, 3)")
string_query("f13_uuid", "(uuid)", ("0000000", (2, ["0", "g"]), "-1234-5678-9abc-def012345678"), "event_id % 2 = 0")
string_query("f14_ipv4", "(ipv4)", ("10.0.", (3, ["0", "256", "01"]), ".7"), "event_id % 3 = 0")
string_query("f15_parsedate", '(string, parsedate(x, "yyyy-MM-dd"))', ("2024-", (3, ["01", "13", "2x"]), "-05"), "event_id % 3 = 0")


def query(name: str, sql: str):
    """Registers a function and its SQL."""

    def put(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return put


@query("j01_variant_kind", "SELECT event_id, json_type(props::JSON, '$.k') IN ('UBIGINT', 'BIGINT') AS valid FROM events")
def j01(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", sure(v.json_condition(F.col("props"), '{"k":(int)}')).alias("valid"))


@query("j02_variant_range", "SELECT event_id, (props::JSON->>'$.k')::BIGINT BETWEEN 10 AND 50 AS valid FROM events")
def j02(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", sure(v.json_condition(F.col("props"), '{"k":(int, 10 <= x <= 50)}')).alias("valid"))


@query("f19_own_function", "SELECT p_partkey, p_size % 2 = 0 AS valid FROM part")
def f19(spark, sf_dir):
    """A function of the user's own, called by a schema."""
    register("even", lambda x: x % 2 == 0)
    df = table(spark, sf_dir, "part")
    return df.select("p_partkey", sure(v.condition(df, "p_size", "(int, even(x))")).alias("valid"))


@query("m01_map", "SELECT event_id, event_id % 4 IN (0, 2) AS valid FROM events")
def m01(spark, sf_dir):
    """A map as an object: required and optional keys, a wrong value, an unknown key."""
    pairs = lambda *kv: F.map_from_arrays(F.array(*(F.lit(k) for k, _ in kv)), F.array(*(x for _, x in kv)))
    one, two, big = F.lit(1).cast("long"), F.lit(2).cast("long"), F.col("event_id") + 100
    held = F.element_at(F.array(pairs(("a", one)), pairs(("b", two)), pairs(("a", two), ("b", one)), pairs(("a", one), ("z", big))), (F.col("event_id") % 4).cast("int") + 1)
    df = table(spark, sf_dir, "events").select("event_id", held.alias("m"))
    return df.select("event_id", sure(v.condition(df, "m", '{"a":(int, x < 50),"b":(int,optional)}')).alias("valid"))


CUSTOMER = '{"c_custkey":(int, x >= 1),"c_name":(string, len(x) > 0),"c_nationkey":(int, 0 <= x <= 24),"c_acctbal":(float, x >= 0),"c_mktsegment":(string, x in ["BUILDING","MACHINERY","FURNITURE"])}'
_CUSTOMER_SQL = {"c_custkey": "c_custkey >= 1", "c_name": "length(c_name) > 0", "c_nationkey": "c_nationkey BETWEEN 0 AND 24", "c_acctbal": "c_acctbal >= 0", "c_mktsegment": "c_mktsegment IN ('BUILDING', 'MACHINERY', 'FURNITURE')"}
LINEITEM = '{"l_orderkey":(int),"l_partkey":(int, x >= 1),"l_suppkey":(int, x >= 1),"l_linenumber":(int, 1 <= x <= 5),"l_quantity":(float, 1 <= x <= 50),"l_extendedprice":(float, x > 0),"l_discount":(float, 0 <= x < 0.1),"l_tax":(float, 0 <= x <= 0.08),"l_returnflag":(string, x in ["A","N"]),"l_linestatus":(string, x in ["F","O"])}'
_LINEITEM_SQL = {"l_orderkey": "true", "l_partkey": "l_partkey >= 1", "l_suppkey": "l_suppkey >= 1", "l_linenumber": "l_linenumber BETWEEN 1 AND 5", "l_quantity": "l_quantity BETWEEN 1 AND 50", "l_extendedprice": "l_extendedprice > 0", "l_discount": "(l_discount >= 0 AND l_discount < 0.1::DOUBLE)", "l_tax": "(l_tax >= 0 AND l_tax <= 0.08::DOUBLE)", "l_returnflag": "l_returnflag IN ('A', 'N')", "l_linestatus": "l_linestatus IN ('F', 'O')"}


def _report_sql(of: str, fields: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{k}' AS path, count(*) FILTER (WHERE {p}) AS valid, count(*) FILTER (WHERE NOT ({p})) AS invalid FROM {of}" for k, p in fields.items())


@query("v12_closed_object", f"SELECT c_custkey, {' AND '.join(_CUSTOMER_SQL.values())} AS valid FROM customer")
def v12(spark, sf_dir):
    return v.validate(table(spark, sf_dir, "customer"), CUSTOMER).select("c_custkey", "valid")


@query("r01_report", _report_sql("customer", _CUSTOMER_SQL))
def r01(spark, sf_dir):
    return v.report(table(spark, sf_dir, "customer"), CUSTOMER)


@query("r01_report_lineitem", _report_sql("lineitem", _LINEITEM_SQL))
def flagship(spark, sf_dir):
    return v.report(table(spark, sf_dir, "lineitem"), LINEITEM, closed=False)


@query("r02_report_by_group", "SELECT event_type, 'value' AS path, count(*) FILTER (WHERE value >= 10 AND value < 60.5::DOUBLE) AS valid, count(*) FILTER (WHERE NOT (value >= 10 AND value < 60.5::DOUBLE)) AS invalid FROM events GROUP BY event_type")
def r02(spark, sf_dir):
    return v.report(table(spark, sf_dir, "events").select("event_type", "value"), '{"value":(float, 10 <= x < 60.5)}', by=["event_type"])


_ORDERS = '{"o_orderstatus":(string, x in ["F","O"]),"o_totalprice":(float, x <= 200000)}'


@query("r03_quarantine", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE NOT (o_orderstatus IN ('F', 'O') AND o_totalprice <= 200000)")
def r03(spark, sf_dir):
    return v.split(table(spark, sf_dir, "orders"), _ORDERS, closed=False)[1].select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("r03_conforming", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_totalprice <= 200000")
def r03b(spark, sf_dir):
    return v.split(table(spark, sf_dir, "orders"), _ORDERS, closed=False)[0].select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("r04_profile", " UNION ALL ".join(f"SELECT '{c}' AS path, count(*) FILTER (WHERE {c} IS NULL) AS n_null, {low} AS low, {high} AS high, {members} AS members FROM lineitem" for c, low, high, members in (("l_linenumber", "min(l_linenumber)::VARCHAR", "max(l_linenumber)::VARCHAR", "NULL::VARCHAR"), ("l_suppkey", "min(l_suppkey)::VARCHAR", "max(l_suppkey)::VARCHAR", "NULL::VARCHAR"), ("l_returnflag", "NULL::VARCHAR", "NULL::VARCHAR", "string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag)"), ("l_linestatus", "NULL::VARCHAR", "NULL::VARCHAR", "string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus)"))))
def r04(spark, sf_dir):
    found = v.profile(table(spark, sf_dir, "lineitem").select("l_linenumber", "l_suppkey", "l_returnflag", "l_linestatus"))
    return found.withColumn("members", F.array_join("members", ","))


@query("r05_violations", "SELECT p_partkey, 'p_size' AS path FROM part WHERE NOT p_size <= 40 UNION ALL SELECT p_partkey, 'p_retailprice' AS path FROM part WHERE NOT p_retailprice < 1200")
def r05(spark, sf_dir):
    return v.violations(table(spark, sf_dir, "part"), '{"p_size":(int, x <= 40),"p_retailprice":(float, x < 1200)}', ["p_partkey"], closed=False)


@query("r06_duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def r06(spark, sf_dir):
    return v.duplicates(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


def _soundness(name: str, of: str, column: str, narrow: str, wide: str, sql_narrow: str, sql_wide: str) -> None:
    """Registers: rows that belong to a subtype but not to its supertype (there are none)."""

    def found(spark: SparkSession, sf_dir: str) -> DataFrame:
        if not order.is_subtype(compile_schema(narrow), compile_schema(wide)):
            raise AssertionError(f"{narrow} isn't within {wide}")
        df = table(spark, sf_dir, of)
        low, high = (sure(v.condition(df, column, s)) for s in (narrow, wide))
        return df.agg(F.count_if(low).alias("narrow"), F.count_if(high).alias("wide"), F.count_if(low & ~high).alias("wrong"))

    QUERIES[name] = found
    ORACLES[name] = f"SELECT count(*) FILTER (WHERE {sql_narrow}) AS narrow, count(*) FILTER (WHERE {sql_wide}) AS wide, count(*) FILTER (WHERE ({sql_narrow}) AND NOT ({sql_wide})) AS wrong FROM {of}"


_soundness("s01_int_subtype", "lineitem", "l_linenumber", "(int, 2 <= x <= 4)", "(int, x > 1)", "l_linenumber BETWEEN 2 AND 4", "l_linenumber > 1")
_soundness("s02_enum_subtype", "orders", "o_orderstatus", '(string, x in ["F"])', '(string, x in ["F","P"])', "o_orderstatus = 'F'", "o_orderstatus IN ('F', 'P')")
_soundness("s03_int_float_subtype", "events", "user_id", "(int, x >= 10)", "(float)", "user_id >= 10", "user_id <= 18014398509481984")
_soundness("s04_list_subtype", "embeddings", "embedding", "[(float, -0.3 <= x <= 0.3)]", "[(float, x <= 0.3)]", "len([e FOR e IN embedding IF e::DOUBLE < -0.3::DOUBLE OR e::DOUBLE > 0.3::DOUBLE]) = 0", "len([e FOR e IN embedding IF e::DOUBLE > 0.3::DOUBLE]) = 0")


def _bound(name: str, how, sql: str) -> None:
    def found(spark: SparkSession, sf_dir: str) -> DataFrame:
        a, b = (compile_schema(s) for s in ("(int, 1 <= x <= 4)", "(int, 3 <= x <= 6)"))
        df = table(spark, sf_dir, "lineitem")
        return df.select(*_LINE.split(), sure(v.condition(df, "l_linenumber", how(a, b))).alias("valid"))

    QUERIES[name], ORACLES[name] = found, f"SELECT {', '.join(_LINE.split())}, {sql} AS valid FROM lineitem"


_bound("s05_lub", order.lub, "l_linenumber BETWEEN 1 AND 6")
_bound("s06_glb", order.glb, "l_linenumber BETWEEN 3 AND 4")


@query("t01_stream", "SELECT event_id, event_type IN ('click', 'view') AND value >= 20 AS valid FROM events")
def t01(spark, sf_dir):
    """The events as a stream, validated batch by batch into a table of the shared folder."""
    out = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    events = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    rows = streaming.validated(stream, '{"event_type":(string, x in ["click","view"]),"value":(float, x >= 20)}', closed=False)
    rows = rows.select("event_id", "valid")
    rows.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{out}/rows")
