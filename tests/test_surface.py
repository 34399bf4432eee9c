"""Documents that name each other, conforming projections, types as SQL, tables that keep their schema."""

import uuid

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formwork import functions
from formwork.operators import conform, sql
from formwork.operators import validation as v
from formwork.operators.expressions import sure
from formwork.plans import catalogue, structures  # noqa: F401
from formwork.schema import order
from formwork.schema.compile import compile_schema as c
from formwork.schema.documents import DocumentError, Documents
from formwork.schema.syntax import SchemaError
from formwork.sources import table, tables

ORDER = '{\n  "id": (string),\n  "user": (user),\n  "price": (number),\n  "products": [ (product) ]\n}'
#: Two documents of a schema collection: types and functions that the host supplies.
FEEDBACK = '{\n  "id": (string, pk=true),\n  "kind": (string, x in ["nps", "complaint"]),\n  "text": (analyzed, optional=true, len(x) > 0),\n  "labels": [(string, x ~ "[a-z0-9:]+")],\n  "posted_at": (datetime, parsedate(x, "rfc3339"))\n}'
FUNCALL = '{\n  "a": (string, fn(x)),\n  "b": (int, fn("a")),\n  "c": (int, x > fn(x)),\n  "d": (something, fn1(x) > fn2(x))\n}'


def test_documents_in_order_of_their_references():
    docs = Documents({"order": ORDER, "user": '{"name":(string),"home":(address,optional)}', "address": '{"city":(string)}', "product": '{"sku":(string,len(x)>2),"maker":(user)}'})
    assert docs.order().index("address") < docs.order().index("user") < docs.order().index("product") < docs.order().index("order")
    assert docs.compile("order").get("products").type == c('[{"sku":(string,len(x)>2),"maker":{"name":(string),"home":({"city":(string)},optional)}}]')
    assert set(docs.all()) == set(docs.texts)


def test_types_of_the_host(spark):
    functions.register("fn", lambda x: F.length(x.cast("string")))
    for name in ("fn1", "fn2"):
        functions.register(name, lambda x: x)
    host = {"analyzed": "(string)", "something": c("(int)")}.get
    docs = Documents({"feedback": FEEDBACK, "funcall": FUNCALL}, host)
    kind = docs.compile("feedback")
    assert kind.get("text").optional and kind.get("text").type == c("(string,len(x)>=1)")
    df = spark.createDataFrame([('{"id":"a","kind":"nps","labels":["x:1"],"posted_at":"2024-01-05T10:00:00Z"}',), ('{"id":"a","kind":"nps","text":"","labels":[],"posted_at":"2024-01-05T10:00:00Z"}',), ('{"id":"a","kind":"nps","labels":[],"posted_at":"5.1.24"}',)], "doc string")
    assert [r.ok for r in df.select(sure(v.json_condition(F.col("doc"), kind)).alias("ok")).collect()] == [True, False, False]
    assert set(f.name for f in docs.compile("funcall").fields) == set("abcd")


@pytest.mark.parametrize(
    "texts, document, line, message",
    [
        ({"a": '{"b":(b)}', "b": '[(c)]', "c": '{\n"x":(a,optional)}'}, "a", None, "a -> b -> c -> a"),
        ({"a": '{"b":\n (nobody)}'}, "a", 2, "unresolved type 'nobody'"),
        ({"a": "(b)", "b": '{"q":\n\n(int,x>=1.5)}'}, "b", 3, "64 bits"),
        ({"a": "{"}, "a", 1, "expected"),
        ({"self": '{"next":(self,optional)}'}, "self", None, "self -> self"),
    ],
)
def test_errors_name_document_and_line(texts, document, line, message):
    with pytest.raises(DocumentError) as e:
        Documents(texts).compile(sorted(texts)[0])
    assert (e.value.document, e.value.line) == (document, line) and message in str(e.value) and str(e.value).startswith(document)


# ------------------------------------------------------------------ conforming projections


def test_conform_json_of_all_kinds(spark):
    rows = ['{"m":"Ann@X.ORG","n":1,"s":1,"l":[{"u":"0000000A-1234-5678-9ABC-DEF012345678"}],"t":[1,"x"],"a":{"q":[1]}}', '{"m":null,"n":2.5,"s":"x","l":[],"t":[2,"y"],"a":3,"o":null}', '{"m":"ann","n":1,"s":1,"l":[],"t":[1,"x"],"a":1}', None]
    df = spark.createDataFrame([(x,) for x in rows], "doc string").select(F.try_parse_json("doc").alias("value"))
    schema = '{"m":(email)|null,"n":(float),"s":(int)|(string),"l":[{"u":(uuid)}],"t":#{(int),(string)},"a":(any),"o":(null,optional)}'
    found = conform.conform_value(df, "value", schema, "row")
    assert found.schema["row"].dataType.simpleString() == "struct<a:variant,l:array<struct<u:string>>,m:string,n:double,o:void,s:variant,t:struct<_1:bigint,_2:string>>"
    got = [r.row and (r.row.m, r.row.n, r.row.s.toPython(), [e.u for e in r.row.l], tuple(r.row.t), r.row.a.toPython()) for r in found.collect()]
    assert got == [("ann@x.org", 1.0, 1, ["0000000a-1234-5678-9abc-def012345678"], (1, "x"), {"q": [1]}), (None, 2.5, "x", [], (2, "y"), 3), None, None]


def test_conform_tables(spark):
    df = spark.createDataFrame([(1, {"k": 2}, [("A@B.de", 1)], "x"), (-1, {"k": 2}, [], "x"), (3, {}, [], "x")], "i int, m map<string,int>, l array<struct<mail:string,n:int>>, extra string")
    schema = '{"i":(int,x>0),"m":{"k":(int,optional)},"l":[{"mail":(email),"n":(int)}],"none":(string,optional)}'
    got = conform.conform(df, schema, closed=False)
    assert got.schema.simpleString() == "struct<i:bigint,l:array<struct<mail:string,n:bigint>>,m:struct<k:bigint>,none:string>"
    assert [(r.i, [tuple(e) for e in r.l], r.m.k, r.none) for r in got.collect()] == [(1, [("a@b.de", 1)], 2, None), (3, [], None, None)]
    assert conform.conform(df, schema).count() == 0  # closed: an unknown column is wrong
    assert "GreaterThanOrEqual(l_linenumber,2)" in conform.conform(table(spark, "/root/testdata/sf0.001", "lineitem"), '{"l_linenumber":(int,x>1)}', closed=False)._jdf.queryExecution().toString()


# ---------------------------------------------------------------------------- types as SQL


@pytest.mark.parametrize("name", sorted(catalogue.COLUMN_QUERIES))
def test_sql_says_what_columns_say(spark, data, name):
    of, column, schema = catalogue.COLUMN_QUERIES[name]
    df = table(spark, data, of)
    sql.create_function(spark, "conforms", schema, df.schema[column].dataType)
    same = df.select(sure(v.condition(df, column, schema)).alias("a"), F.expr(f"coalesce({sql.sql_condition(df, column, schema)}, false)").alias("b"), F.expr(f"conforms({sql.name_of(column)})").alias("c"))
    assert same.filter("a <> b OR a <> c").count() == 0


NESTED = [
    ("array<struct<q:int,s:string>>", '[{"q":(int,x>0),"s":(string)|null}]', "array(named_struct('q',1,'s',null)) array(named_struct('q',0,'s','a')) array()"),
    ("map<string,int>", '{"k":(int),"z z":(int,optional)}', "map('k',1) map('k',1,'z_z',2) map()"),
    ("struct<a:array<int>,b:double>", '{"a":#{(int),(int,x!=3)},"b":(float,optional)}', "named_struct('a',array(1,3),'b',1.0D) named_struct('a',array(1,2),'b',null) named_struct('a',array(1),'b',1.0D)"),
    ("string", '(string,x in ["it\'s","a\\\\b","\\n"])|(string,len(x)>3)', "'it\\'s' 'a\\\\b' '\\n' 'abcd' 'abc'"),
    ("decimal(20,0)", "(uint64,x!=7)", "9223372036854775808BD 18446744073709551615BD 7 3 -1"),
    ("bigint", "(int,x==-9223372036854775808||x>9223372036854775806)", "9223372036854775807L (-9223372036854775807L-1L) 0L"),
]


@pytest.mark.parametrize("kind, schema, values", NESTED, ids=[k for k, *_ in NESTED])
def test_sql_of_nested_values(spark, kind, schema, values):
    rows = [f"CAST({x} AS {kind})" for x in values.split(" ")] + [f"CAST(NULL AS {kind})"]
    df = spark.sql(" UNION ALL ".join(f"SELECT {x} AS `the value`" for x in rows))
    sql.create_function(spark, "fits", schema, T.DataType.fromDDL(kind))
    got = df.select(sure(v.condition(df, "the value", schema)).alias("a"), F.expr("fits(`the value`)").alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got] and any(r.a for r in got) and not all(r.a for r in got)


def test_own_functions_in_sql(spark):
    functions.register("odd", lambda x: x % 2 == 1)
    with pytest.raises(SchemaError, match="has no SQL"):
        sql.create_function(spark, "is_odd", "(int,odd(x))", "int")
    sql.register("odd", "{0} % 2 = 1")
    sql.create_function(spark, "is_odd", "(int,odd(x))", "int")
    assert [r.ok for r in spark.sql("SELECT is_odd(x) AS ok FROM VALUES (1), (2), (NULL) AS t(x)").collect()] == [True, False, False]


def test_sql_functions_reach_the_scan(spark, data):
    sql.create_function(spark, "small", "(int,x<3)", "int")
    df = table(spark, data, "part")
    plan = df.filter(F.expr(sql.sql_condition(df, "p_size", "(int,x<5||x>45)")))._jdf.queryExecution().toString()
    assert "Or(LessThanOrEqual(p_size,4),GreaterThanOrEqual(p_size,46))" in plan


# ------------------------------------------------------------------ tables with a schema


def test_tables_keep_their_schema(spark):
    name = f"kept_{uuid.uuid4().hex[:8]}"
    frame = lambda rows, kinds="a int, b string": spark.createDataFrame(rows, kinds)
    first = '{"a":(int,0<=x<10),"b":(string,x in ["it\'s","y"])}'
    try:
        bad = tables.create(frame([(1, "it's"), (20, "y")]), name, first)
        assert [r.a for r in bad.collect()] == [20] and tables.kept_schema(spark, name) == c(first)
        assert [r.a for r in tables.append(frame([(2, "y"), (11, "y")]), name).collect()] == [11]
        tables.append(frame([(3, "y")]), name, '{"a":(int,x==3),"b":"y"}')  # narrower
        wider = '{"a":(int,0<=x<100),"b":(string),"c":(int,optional)}'
        assert order.compare(c(first), c(wider)) == "widening"
        for schema in (wider, '{"a":(int),"b":(int)}', '{"a":(int,5<=x<50),"b":(string)}'):
            with pytest.raises(tables.BreakingChange):
                tables.append(frame([(50, "z")]), name, schema)
        assert tables.append(frame([(50, "z", 7)], "a int, b string, c bigint"), name, wider, evolve=True).count() == 0
        assert tables.kept_schema(spark, name) == c(wider)
        assert sorted((r.a, r.b, r.c) for r in spark.table(name).collect()) == [(1, "it's", None), (2, "y", None), (3, "y", None), (50, "z", 7)]
        with pytest.raises(SchemaError, match="keeps no schema"):
            spark.range(3).write.saveAsTable(name + "_plain")
            tables.append(spark.range(1), name + "_plain")
        long = "{" + ",".join(f'"field_{i}":(string,x in ["{"v" * 40}","{i}"],optional)' for i in range(200)) + "}"
        tables.keep_schema(spark, name, long)
        assert tables.kept_schema(spark, name) == c(long)
    finally:
        for t in (name, name + "_plain"):
            spark.sql(f"DROP TABLE IF EXISTS {t}")
