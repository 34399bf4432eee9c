"""The schema language: same types, subtypes, accepted values, printed text, errors."""

import json
import random

import pytest
from pyspark.sql import functions as F

from formwork import sources, streaming
from formwork.operators import validation as v
from formwork.operators import variant
from formwork.operators.expressions import sure
from formwork.schema import dsl, order
from formwork.schema.compile import compile_schema as c
from formwork.schema.syntax import SchemaError, parse, show

SAME = [
    ["1337", "+1337"],
    ["1.01", "1.01e0"],
    ['{"a":(int),"b":(string)}', '{"b":(string,pk),"a":(int)}'],
    ["(int)", "(int)|(int)", "(int)|(never)", "1337|(int)", "(int)|1337"],
    ["(any)", "(int)|(any)", "(any)|(int)|(any)|(string)"],
    ["(bool)", "true|false", "true|false|true"],
    ["(int,x>=0,x<=100)", "(int,x>=0&&x<=100)", "(int,0<=x<=100)", "(int,-1<x<=100)", "(int,-1<x<101)"],
    ['(string,x in ["a","b","c"])', '(string,x in ["c","a","b"])', '(string,x=="a"||x=="b"||x=="c")'],
    ["([(string)],len(x)>=1,len(x)<=100)", "([(string)],len(x)>0,len(x)<101)"],
    ['({"a":(int)},len(x)>=1,len(x)<=100)', '({"a":(int)},len(x)>0,len(x)<101)'],
    ["(int,x in [1,2,3])", "(int,1<=x<=3)"],
    ["(int)|(string)", "(int)|(never)|(string)", "(string)|(int)|(string)"],
    ["(bool)|(float)", "(bool)|(int)|(float)|(bool)"],
    ["(float,x>=0.0,x<=100.0)", "(float,x>=0&&x<=100)", "(float,0<=x<=100)"],
    ['([{"a":(int)}],len(x)>=1,len(x)<=100)', '([{"a":(int)}],len(x)>0,len(x)<=100)', '([{"a":(int)}],len(x)>0,len(x)<101)'],
    ["(never)", "(int,x==1,x==2)", "(int,x>5,x<3)", "(string,len(x)<0)"],
]


@pytest.mark.parametrize("group", SAME, ids=lambda g: g[0])
def test_same_type(group):
    assert len({c(s) for s in group}) == 1
    assert c(str(c(group[0]))) == c(group[0])
    assert len({c(s).fingerprint for s in group}) == 1


@pytest.mark.parametrize(
    "a, b, within",
    [
        ("(never)", "(any)", True),
        ("(int)", "(never)", False),
        ("(any)", "(never)", False),
        ("(int,x>0)", "(int)", True),
        ("(int)", "(int,x>0)", False),
        ("(int,x>10)", "(int,x>=10)", True),
        ("(int,-1<x<9)", "(int,-1<x<10)", True),
        ('{"a":(int,x>0)}', '{"a":(int)}', True),
        ('{"a":(int)}', '{"a":(int),"b":(int,optional)}', True),
        ('{"a":(string)}', '{"a":(string,optional)}', True),
        ('{"a":(string,optional)}', '{"a":(string)}', False),
        ("[(int,x>0)]", "[(int)]", True),
        ("[1,2]", "[(int)]", True),
        ("(int)|(string)", "(int)|(string)|(bool)", True),
        ("(int)", "(float)", True),
        ("(never)", "(int)", True),
        ("(int)", "(int)", True),
        ("(int,x>9)", "(int,x>=10)", True),
        ("(int,-1<x<11)", "(int,0<=x<=10)", True),
        ("(int,0<=x<10)", "(int,-1<x<10)", True),
        ("(int,0<x<10)", "(int,0<x<10)", True),
    ],
)
def test_subtype(a, b, within):
    a, b = c(a), c(b)
    assert order.is_subtype(a, b) is within
    if a != b and within:
        assert not order.is_subtype(b, a)


def test_bounds_of_types():
    assert order.lub(c("10"), c("20")) == c("(int,x in [10,20])")
    assert order.lub(c("(int,x<0)"), c("(int,x>=0)")) == c("(int)")
    assert order.lub(c("(int,x>0)"), c("(int,x<0)")) == c("(int,x>0)|(int,x<0)")
    assert order.glb(c("(int,x>=0)"), c("(int,x<=100)")) == c("(int,0<=x<=100)")
    assert order.glb(c("(int,x>0)"), c("(int,x<0)")) == c("(never)")
    assert [order.compare(c(a), c(b)) for a, b in (("(int)", "(int)"), ("(int,x>0)", "(int)"), ("(int)", "(int,x>0)"), ("(int)", "(string)"))] == ["equal", "widening", "narrowing", "breaking"]


ACCEPTS = [
    ('"expected"', ['"expected"'], ['"other"', "1"]),
    ("1337", ["1337"], ["1338", "1337.0"]),
    ("null", ["null"], ["true"]),
    ('["a"]', ['["a"]'], ['["b"]', "[]"]),
    ("(int)", ["67"], ["69.0", '"7"']),
    ("(float)", ["18014398509481984", "1.5", "1e3"], ["18014398509481985", "1e400"]),
    ("(int,0<=x<=100)", ["0", "100"], ["1337"]),
    ('{"a":(string)}', ['{"a":"x"}'], ["{}", '{"a":"x","b":"y"}', '{"a":"x","a":"x"}', "x"]),
    ('{"a":(string),"b":(int,optional)}', ['{"a":"x"}', '{"a":"x","b":1}'], ['{"a":"x","b":null}']),
    ("[(int,x>0)]", ["[]", "[1,2]"], ["[1,-1]"]),
    ("([(int)],len(x)>2)", ["[1,2,3]"], ["[1,2]"]),
    ("(int)|(string)", ["1", '"a"'], ["true", "1.0"]),
    ("[(int)|(string)]", ['[1,"a"]'], ["[true]"]),
    ("(string,len(x)==2)", ['"é😀"'], ['"abc"']),
    ("true", ["true"], ["false"]),
    ("(string)", ['"x"'], ["10"]),
    ("(int,0<=x<=100)", ["67"], ["-1"]),
    ("(int,x in [0,1,2])", ["1"], ["3"]),
    ('{"a":(string),"b":({"a":(string),"b":(int)},optional)}', ['{"a":"Triple X"}', '{"a":"xXx","b":{"a":"Xxx","b":1337}}'], ['{"a":"xXx","b":{"a":"Xxx"}}']),
    ("[(string)]", ["[]", '["kat","schema"]'], ["[67,69]", '["valid",67]']),
    ("([(int,x<0)],len(x)>2)", ["[-1,-2,-3]"], ["[-1,-2,1]", "[-1]"]),
    ("[(int,x in [0,1,2])]", ["[1]"], ["[3]"]),
    ("(any)", ["1", "null", " [1] "], ["", "nul", "1 2", "1,2", "1],[2", '1} x', "[1]]", '{"a":1} x', '{"a":1}}', '{"a":1}{"b":2}']),
    ("null", [" null "], ["null null"]),
]


@pytest.mark.parametrize("schema, good, bad", ACCEPTS, ids=lambda x: x if isinstance(x, str) else "")
def test_json_values(spark, schema, good, bad):
    rows = spark.createDataFrame([(x, True) for x in good] + [(x, False) for x in bad] + [(None, False)], "doc string, want boolean")
    found = rows.select("doc", "want", sure(v.json_condition(F.col("doc"), schema)).alias("valid")).collect()
    assert [(r.doc, r.valid) for r in found] == [(r.doc, r.want) for r in found]


def test_typed_nulls(spark):
    df = spark.createDataFrame([(1, "x"), (None, "x"), (1, None)], "a int, b string")
    got = lambda s, **k: [r.valid for r in v.validate(df, s, **k).collect()]
    assert got('{"a":(int),"b":(string,optional)}') == [True, False, True]
    assert got('{"a":(int)|null,"b":(string)}') == [True, True, False]
    assert got('{"a":(int)}') == [False] * 3 and got('{"a":(int)}', closed=False) == [True, False, True]
    good, bad = v.split(df, '{"a":(int),"b":(string)}')
    assert good.count() == 1 and bad.count() == 2
    empty = df.filter("false")
    assert [(r.valid, r.invalid) for r in v.report(empty, '{"a":(int),"b":(string)}').collect()] == [(0, 0), (0, 0)]


def test_condition_reaches_the_scan(spark, data):
    good, _ = v.split(spark.read.parquet(f"{data}/lineitem.parquet"), '{"l_linenumber":(int,1<=x<=5)}', closed=False)
    plan = good.select("l_linenumber")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(l_linenumber,1)" in plan


def test_infer(spark, data):
    df = spark.read.parquet(f"{data}/lineitem.parquet").select("l_linenumber", "l_returnflag")
    kind = v.infer(df)
    assert v.validate(df, kind).filter("not valid").count() == 0
    assert kind == c('{"l_linenumber":(int,1<=x<=7),"l_returnflag":(string,x in ["A","N","R"])}')


def test_printed_text():
    s = dsl.object_(dsl.field("id", dsl.type_("uuid")), dsl.field("age", dsl.optional(dsl.where(dsl.int_, dsl.binary(">=", dsl.x, 18)))))
    assert show(s) == '{"id":(uuid),"age":(int,x>=18,optional)}' and parse(show(s)) == s
    for text in ('(string,x in ["admin","user"])', '(string,x~"[a-z]+")', "(int,x!=67)", '({"a":"b"})|(string)', "(int,x<(x+1)*2)", "#{1,(int)}"):
        assert show(parse(text)) == text
    assert parse('[1, 2,] // end') == parse("/* a */ [1,2]")
    assert json.loads(show(parse('{"a":[null,true,-3.5,"q\\n"]}'))) == {"a": [None, True, -3.5, "q\n"]}


@pytest.mark.parametrize("bad", ["(nosuch)", "(int,x>=1.5)", "(string,x>1)", "(int,optional)", "[(int),(string)]", '{"a":1,"a":2}', "9223372036854775808", "(int,len(x)>1)", "(int,1<2)", '(int,x in ["a"])', "(int", '{"a":(int,optional=1)}', '{"t":(.t)}', "(bool,x>true)"])
def test_errors(bad):
    with pytest.raises(SchemaError):
        c(bad)


def test_names_and_paths():
    assert c('{"t":(int,x>0),"u":(.t)}').get("u").type == c("(int,x>0)")
    assert c("(age)", {"age": "(int,0<=x<150)"}) == c("(int,0<=x<=149)")


def test_names_of_formats():
    assert c("(date)") == c('(string,parsedate(x,"yyyy-MM-dd"))') and c("(ipv4)") == c("(string,ipv4(x))")
    assert order.is_subtype(c("(datetime)"), c("(string)"))


@pytest.mark.parametrize(
    "text, at",
    [("(int,x>=1.5)", 5), ('{"a":(int),"b":(nosuch)}', 15), ('{"a":1,"a":2}', 0), ('{"a":[(int),(string)]}', 5), ('{"a":9223372036854775808}', 5), ("(int, x > 0, len(x) > 1)", 13)],
)
def test_errors_have_places(text, at):
    with pytest.raises(SchemaError) as e:
        c(text)
    assert e.value.at == at and f"(at {at})" in str(e.value)


PRINTED = [
    *("null", "true", "false", "-1337", "1337", "-13.37", "13.37", '"when in doubt, use brute force"', '["test-1","test-2"]', "{}", "(uuid)", "[(string)]", "[null,false]", "(true,optional)"),
    '{"str":"test","int":1337,"null":null,"float":-3.141519,"list":["str",1337],"type":(uuid),"obj":{"str":"test","int":1337}}',
    *("(int,x+1<100)", "(int,(x+1)<100)", "(int,x<(x+1)*2)", "(int,x!=67)", '(string,x~"[a-z]+")', '({"str":"test"})|(string)', "(int)|(float)|(string)", "(int,-x<3)", "(int,even(x))", "(int,!(x==1))"),
]


@pytest.mark.parametrize("text", PRINTED)
def test_printed_as_read(text):
    assert show(parse(text)) == text


def test_built_as_read():
    d = dsl
    rating = d.field("rating", d.optional(d.where(d.int_, d.binary("<=", d.binary("<=", 0, d.x), 10))))
    assert show(d.object_(d.field("kind", d.where(d.string, d.binary("in", d.x, ["a", "b"]))), rating)) == '{"kind":(string,x in ["a","b"]),"rating":(int,0<=x<=10,optional)}'
    assert parse(show(d.sum_(d.int_, d.with_(d.list_(d.string))))) == d.sum_(d.int_, d.with_(d.list_(d.string)))


def test_sums_of_many_literals_and_ranges():
    assert c("|".join(f"{i}" for i in range(0, 4000, 2))) == c(f"(int,x in [{','.join(map(str, range(0, 4000, 2)))}])")
    assert c("|".join(f"(int,{i}<=x<={i + 9})" for i in range(0, 5000, 10))) == c("(int,0<=x<=4999)")
    assert c("(float,0<=x<1)|(float,1<=x<2)") == c("(float,0<=x<2)") and str(c("(float,0<=x<1)|(float,1<x<2)")).count("|") == 1


def test_infer_json(spark):
    rows = ['{"a":null,"b":1,"OBJECT<k":"x"}', '{"a":2,"b":1.5,"c":{"d":[1,null]}}', '{"a":3,"b":true,"c":{"d":[]}}', '{"a":4,"c":{"e":null}}']
    df = spark.createDataFrame([(x,) for x in rows], "doc string").select(F.parse_json("doc").alias("v"))
    kind = v.infer_json(df, "v")
    assert df.select(sure(v.condition(df, "v", kind)).alias("ok")).filter("not ok").count() == 0
    assert str(kind) == str(c('{"OBJECT<k":(string,optional),"a":((int)|null,optional),"b":(any,optional),"c":({"d":([(int)|null],optional),"e":(null,optional)},optional)}'))
    assert v.infer_json(df.filter("false"), "v") == c("(never)")


def test_maps_as_objects(spark):
    df = spark.createDataFrame([({"a": 1},), ({"b": 2},), ({"a": None},), ({"a": 1, "z": 1},), (None,), ({},)], "m map<string,bigint>")
    got = lambda s: [r.ok for r in df.select(sure(v.condition(df, "m", s)).alias("ok")).collect()]
    assert got('{"a":(int),"b":(int,optional)}') == [True, False, False, False, False, False]
    assert got('{"a":(int)|null}') == [True, False, True, False, False, False]
    assert got('({"a":(any,optional),"z":(any,optional)},len(x)<=1)') == [True, False, True, False, False, True]


def test_quarantine_of_tables_and_streams(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (-1, "y"), (None, "z")], "a int, b string")
    schema, at = '{"a":(int,x>0),"b":(string)}', lambda name: str(tmp_path / name)
    sources.quarantine(df, schema, at("good"), at("bad"))
    df.write.parquet(at("in"))
    stream = spark.readStream.schema(df.schema).parquet(at("in"))
    for _ in range(2):  # the second query has nothing new
        streaming.quarantine(stream, schema, at("stream_good"), at("stream_bad"), at("state")).awaitTermination()
    for good, bad in (("good", "bad"), ("stream_good", "stream_bad")):
        assert [r.b for r in spark.read.parquet(at(good)).collect()] == ["x"]
        assert sorted(r.b for r in spark.read.parquet(at(bad)).collect()) == ["y", "z"]
    assert [r.value is None for r in sources.json_lines(spark, _lines(tmp_path, ["1", "1 2", "{"])).collect()] == [False, True, True]


def _lines(folder, lines):
    (folder / "lines.txt").write_text("\n".join(lines))
    return str(folder / "lines.txt")


def _random_schema(rng, depth=2):
    pick = rng.random()
    if depth == 0 or pick < 0.5:
        return rng.choice(["(any)", "(never)", "null", "(bool)", "true", "(int)", "(float)", "(string)", "3", '"ab"', f"(int,x>={rng.randrange(-2, 5)})", f"(int,{rng.randrange(-2, 3)}<=x<{rng.randrange(2, 6)})", f"(float,x<{rng.randrange(-1, 4)}.5)", "(int,x in [1,3])", '(string,x in ["ab","c"])', f"(string,len(x)>{rng.randrange(3)})"])
    inner = lambda: _random_schema(rng, depth - 1)
    if pick < 0.65:
        return f"([({inner()})],len(x)<={rng.randrange(1, 4)})"
    if pick < 0.8:
        return "{" + f'"a":({inner()}' + rng.choice([")", ",optional)"]) + rng.choice(["", f',"b":({inner()},optional)']) + "}"
    if pick < 0.88:
        return "#{" + f"{inner()},{inner()}" + "}"
    return f"({inner()})|({inner()})"


def _random_value(rng, depth=2):
    if depth == 0 or rng.random() < 0.6:
        return rng.choice([None, True, False, 0, 1, 3, -2, 7, 0.5, 2.0, "", "ab", "c", "abc"])
    inner = lambda: _random_value(rng, depth - 1)
    return [inner() for _ in range(rng.randrange(4))] if rng.random() < 0.5 else {k: inner() for k in ("a", "b", "z") if rng.random() < 0.5}


def test_subtypes_accept_no_more(spark):
    """Whatever belongs to a type belongs to its supertypes, to its lub with any and to both sides of a glb."""
    rng = random.Random(11)
    kinds = sorted({c(_random_schema(rng)) for _ in range(70)}, key=str)
    values = sorted({json.dumps(_random_value(rng)) for _ in range(500)})
    df = spark.createDataFrame([(x,) for x in values], "doc string")
    pairs = [(a, b) for a in kinds for b in kinds if a != b and order.is_subtype(a, b)]
    bounds = [(a, b, order.lub(a, b), order.glb(a, b)) for a, b in zip(kinds, reversed(kinds))]
    wanted = list(dict.fromkeys([*kinds, *(k for x in bounds for k in x[2:])]))
    flags = df.select("doc", variant.parsed(F.col("doc")).alias("v")).select("doc", *(sure(variant.predicate(k, F.col("v"))).alias(str(i)) for i, k in enumerate(wanted))).collect()
    accepts = {k: {r.doc for r in flags if r[str(i)]} for i, k in enumerate(wanted)}
    assert len(pairs) > 150 and sum(map(bool, accepts.values())) > 30
    assert [(str(a), str(b)) for a, b in pairs if not accepts[a] <= accepts[b]] == []
    assert [(str(a), str(b)) for a, b, up, down in bounds if not (accepts[a] | accepts[b] <= accepts[up] and accepts[down] <= accepts[a] & accepts[b])] == []
