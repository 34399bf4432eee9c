"""Nested violations, inference by group, keys, unions of ranges and decided subtypes against plain code."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from formwork.operators import inference, keys, paths
from formwork.operators import validation as v
from formwork.operators.expressions import sure
from formwork.schema import domains, order
from formwork.schema import types as t
from formwork.schema.compile import compile_schema as c
from formwork.schema.syntax import SchemaError

# ------------------------------------------------------------------ ranges and subtypes


@pytest.mark.parametrize(
    "a, b",
    [
        ("(int,x<5||x>45)", "(int,x<5)|(int,x>45)"),
        ("(int,x!=3)", "(int,x<3)|(int,x>3)"),
        ("(int,!(x==2||x==4))", "(int,x!=2,x!=4)"),
        ("(int,!(0<x<10))", "(int,x<=0||x>=10)"),
        ("(int,!(x in [1,2,9]))", "(int,x!=1&&x!=2&&x!=9)"),
        ("(float,x!=3)", "(float,x<3.0)|(float,x>3.0)"),
        ("(int,(x>0&&x<5)||x==7||x>=9)", "(int,1<=x<=4)|7|(int,x>8)"),
        ("(int,x<3||x>=3)", "(int)"),
        ('(string,len(x)<2||x=="abc")', '(string,len(x)<=1)|"abc"'),
        ('(int,x!=3)|(string)', '(string)|(int,x>=4)|(int,x<=2)'),
    ],
)
def test_spellings_of_one_union(a, b):
    assert c(a) == c(b) and order.compare(c(a), c(b)) == "equal"
    assert c(str(c(a))) == c(a)


@pytest.mark.parametrize(
    "a, b, within",
    [
        ("(int,x%4==0)", "(int,x%2==0)", True),
        ("(int,x%2==0)", "(int,x%4==0)", False),
        ("(int,x<3)", "(int,x!=3)", True),
        ("(int,x in [2,4])", "(int,x!=3)", True),
        ("(int,x in [2,4])", "(int,x%2==0)", True),
        ("(int,x in [2,5])", "(int,x%2==0)", False),
        ("(int,x%6==1,x>0)", "(int,x%3==1)", True),
        ("(int,x%6==1)", "(int,x%3==1)", True),
        ("(int,x%6==-1)", "(int,x%3==-1,x<0)", True),
        ("(int)", "(int,x%3==0)|(int,x%3==1)|(int,x%3==2)", False),
        ("(int,x>=0)", "(int,x%3==0)|(int,x%3==1)|(int,x%3==2)", True),
        ("(int,0<=x<100,x*2<10)", "(int,x<=4)", True),
        ("(int,x*2<10)", "(int,x<=4)", False),  # beyond 2**62 the product has no value: undecided
        ("(int,1<=x<=6)", "(int,x<=3)|(int,x%2==0)|5", True),
        ('(string,x in ["ab","ac"])', '(string,startsWith(x,"a"),len(x)==2)', True),
        ('(string,x in ["ab","bc"])', '(string,startsWith(x,"a"))', False),
        ("(int,x%1000003==1)", "(int,x%2==1)", False),
    ],
)
def test_decided_subtypes(a, b, within):
    assert order.is_subtype(c(a), c(b)) is within


def _random_condition(rng, depth=2):
    n = lambda: rng.randrange(-6, 7)
    pick = rng.random()
    if depth and pick < 0.25:
        return f"({_random_condition(rng, depth - 1)}{rng.choice(['&&', '||'])}{_random_condition(rng, depth - 1)})"
    if depth and pick < 0.35:
        return f"!({_random_condition(rng, depth - 1)})"
    if pick < 0.6:
        return f"x{rng.choice(['<', '<=', '>', '>=', '==', '!='])}{n()}"
    if pick < 0.85:
        return f"x%{rng.randrange(1, 7)}{rng.choice(['==', '!=', '<'])}{n()}"
    return f"x in [{n()},{n()}]"


def test_subtypes_against_enumeration(spark):
    """No value of a decided subtype is outside; what enumeration shows to be outside isn't decided
    to be within; and most of what is within is found."""
    rng = random.Random(23)
    kinds = sorted({c(f"(int,{_random_condition(rng)},-40<=x)" if rng.random() < 0.5 else f"(int,{_random_condition(rng)})") for _ in range(90)}, key=str)
    values = list(range(-130, 131))
    df = spark.createDataFrame([(x,) for x in values], "x int")
    flags = df.select("x", *(sure(v.condition(df, "x", k)).alias(str(i)) for i, k in enumerate(kinds))).collect()
    accepts = {k: {r.x for r in flags if r[str(i)]} for i, k in enumerate(kinds)}
    for k in kinds:  # the evaluator that decides is the columns'
        members = k.members if isinstance(k, t.SumType) else (k,)
        assert {x for x in values if any(m != t.NEVER and domains.accepts(t.parts(m)[1], x) for m in members)} == accepts[k], str(k)
    inside = [(a, b) for a in kinds for b in kinds if accepts[a] <= accepts[b]]
    said = {(a, b) for a in kinds for b in kinds if order.is_subtype(a, b)}
    assert [(str(a), str(b)) for a, b in said if not accepts[a] <= accepts[b]] == []
    assert len(said) > 0.95 * len(inside) and len(inside) > 500


def test_unions_reach_the_scan(spark, data):
    df = spark.read.parquet(f"{data}/part.parquet")
    good, _ = v.split(df, '{"p_size":(int,x<5||x>45)}', closed=False)
    plan = good.select("p_size")._jdf.queryExecution().toString()
    assert "Or(LessThanOrEqual(p_size,4),GreaterThanOrEqual(p_size,46))" in plan.split("PushedFilters")[1]


def test_nan_is_no_value(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (5.0,), (None,)], "x double")
    got = lambda s: [r.ok for r in df.select(sure(v.condition(df, "x", s)).alias("ok")).collect()]
    assert got("(float)") == got("(float,x<3)|(float,x>=3)") == [True, False, True, False]
    assert got("(float,x!=1)") == [False, False, True, False] and got("(float,x<3)") == [True, False, False, False]


@pytest.mark.parametrize(
    "text, at",
    [("(string, startsWith())", 9), ('(string, startsWith("a","b","c"))', 9), ('(string, parsedate(x, "rfc33"))', 9), ("(string, parsedate(x, x))", 9), ('(string, parsedate(x, "yyyy-MM-dd\'T"))', 9), ("(string, email(x, x))", 9), ('{"a":(string, match())}', 14)],
)
def test_calls_are_checked_with_their_place(text, at):
    with pytest.raises(SchemaError) as e:
        c(text)
    assert e.value.at == at


def test_dates_and_predicates(spark):
    df = spark.createDataFrame([("2024-02-29T10:00:00.25+01:00",), ("2024-02-29 10:00:00",), ("2023-02-29T10:00:00Z",), ("x",), (None,)], "s string")
    got = lambda s: [r.ok for r in df.select(sure(v.condition(df, "s", s)).alias("ok")).collect()]
    assert got('(string,parsedate("rfc3339"))') == [True, False, False, False, False]
    assert got("(datetime)") == [True, True, False, False, False] == got('(datetime,match("^2024"))')
    assert c('(string,startsWith("a"))') == c('(string,startsWith(x,"a"))') and c("(string,uuid())") == c("(uuid)")
    with pytest.raises(SchemaError, match="len is of x only"):
        v.condition(df, "s", "(string,len(len(x))<3)")


# -------------------------------------------------------------------- nested violations

SCHEMA = '{"id":(int),"a":([{"q":(int,x>0),"s":(string)|null}],len(x)<=3),"t":(#{(int),(string,len(x)<3)},optional),"u v":({"k":(float,x<1)},optional),"m":(int)|(string)}'


def _kind(value):
    return {type(None): "null", bool: "bool", int: "int", float: "float", str: "string", list: "list", dict: "object"}[type(value)]


def _walk(doc):
    """(path, problem) of a document under SCHEMA, by hand."""
    if _kind(doc) != "object":
        return [("", "kind")]
    out = [(k if k.isidentifier() else f'["{k}"]', "unknown") for k in doc if k not in ("id", "a", "t", "u v", "m")]
    out += [(k, "missing") for k in ("id", "a", "m") if k not in doc]
    if "id" in doc and _kind(doc["id"]) != "int":
        out.append(("id", "kind"))
    if "m" in doc and _kind(doc["m"]) not in ("int", "string"):
        out.append(("m", "kind"))
    if "a" in doc:
        inner = []
        if _kind(doc["a"]) != "list":
            out.append(("a", "kind"))
        else:
            for i, e in enumerate(doc["a"]):
                if _kind(e) != "object":
                    inner.append((f"a[{i}]", "kind"))
                    continue
                inner += [(f"a[{i}].{k}", "missing") for k in ("q", "s") if k not in e] + [(f"a[{i}].{k}", "unknown") for k in e if k not in ("q", "s")]
                if "q" in e and (_kind(e["q"]) != "int" or e["q"] <= 0):
                    inner.append((f"a[{i}].q", "value" if _kind(e["q"]) == "int" else "kind"))
                if "s" in e and _kind(e["s"]) not in ("null", "string"):
                    inner.append((f"a[{i}].s", "kind"))
            out += inner or ([("a", "value")] if len(doc["a"]) > 3 else [])
    if "t" in doc:
        x = doc["t"]
        if _kind(x) != "list":
            out.append(("t", "kind"))
        elif len(x) != 2:
            out.append(("t", "value"))
        else:
            out += [("t[0]", "kind")] if _kind(x[0]) != "int" else []
            out += [("t[1]", "kind" if _kind(x[1]) != "string" else "value")] if _kind(x[1]) != "string" or len(x[1]) > 2 else []
    if "u v" in doc:
        x = doc["u v"]
        if _kind(x) != "object":
            out.append(('["u v"]', "kind"))
        else:
            out += [('["u v"].k', "missing")] if "k" not in x else []
            out += [('["u v"].' + k, "unknown") for k in x if k != "k"]
            if "k" in x and (_kind(x["k"]) not in ("int", "float") or x["k"] >= 1):
                out.append(('["u v"].k', "value" if _kind(x["k"]) in ("int", "float") else "kind"))
    return out


def _random_doc(rng):
    leaf = lambda: rng.choice([None, True, 0, 1, 7, -2, 0.5, 2.5, "", "ab", "abc"])
    some = lambda n: [rng.choice([leaf(), {k: leaf() for k in ("q", "s", "z") if rng.random() < 0.7}]) for _ in range(rng.randrange(n))]
    if rng.random() < 0.05:
        return leaf()
    doc = {"id": rng.choice([1, 1, 1, leaf()]), "a": rng.choice([some(5), some(5), leaf()]), "t": rng.choice([[leaf(), leaf()], [1, "ab"], some(4), leaf()]), "u v": rng.choice([{k: leaf() for k in ("k", "x")}, {"k": 0}, leaf()]), "m": leaf(), "w": leaf(), 'q"r': 1}
    return {k: x for k, x in doc.items() if rng.random() < (0.2 if k in ("w", 'q"r') else 0.8)}


def _quoted(path):
    return path.replace('["q"r"]', '["q\\"r"]')


def test_nested_violations_of_json_against_plain_code(spark):
    rng = random.Random(5)
    docs = {i: _random_doc(rng) for i in range(400)}
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in docs.items()], "n int, doc string").select("n", F.parse_json("doc").alias("value"))
    found = paths.value_violations(df, "value", SCHEMA, ["n"]).collect()
    assert Counter((r.n, r.path, r.problem) for r in found) == Counter((i, _quoted(p), what) for i, d in docs.items() for p, what in _walk(d))
    assert all(r.place == "".join("[]" if p and p[0].isdigit() else p for p in _parts(r.path)) for r in found)
    bad = {r.n for r in df.filter(~sure(v.condition(df, "value", SCHEMA))).collect()}
    assert bad == {r.n for r in found} and len(bad) > 100


def _parts(path):
    import re

    return [p[1:-1] if re.fullmatch(r"\[\d+\]", p) else p for p in re.split(r"(\[\d+\])", path)]


def test_nested_violations_of_tables(spark):
    rows = [(1, [(1, "a"), (-2, None)], {"k": 0.5}, ("x", 1)), (2, None, {}, None), (None, [(5, "b")] * 4, {"k": 2.0, "z z": 0.1}, ("x", None)), (4, [], {"k": 0.0}, ("x", 3))]
    df = spark.createDataFrame(rows, "id int, a array<struct<q:int,s:string>>, m map<string,double>, s struct<b:string,c:int>").withColumn("found", F.lit(0))
    schema = '{"id":(int),"a":([{"q":(int,x>0),"s":(string)}],len(x)<4),"m":{"k":(float,x<1)},"s":({"b":(string),"c":(int,optional)},optional),"gone":(int)}'
    got = {(r.found, r.id, r.path, r.place, r.problem) for r in paths.nested_violations(df, schema, ["found", "id"]).collect()}
    assert got == {
        *((0, i, "gone", "gone", "missing") for i in (1, 2, None, 4)),
        *((0, 1, p, q, w) for p, q, w in (("a[1].q", "a[].q", "value"), ("a[1].s", "a[].s", "missing"))),
        *((0, 2, p, p, "missing") for p in ("a", "m.k")),
        *((0, None, p, p, w) for p, w in (("id", "missing"), ("a", "value"), ("m.k", "value"), ('m["z z"]', "unknown"))),
    }
    whole = paths.nested_violations(df, schema.replace(',"gone":(int)', ""), ["id"]).collect()
    assert {(r.id, r.path) for r in whole} >= {(4, "found"), (1, "found")} and all(r.problem == "unknown" for r in whole if r.path == "found")
    assert paths.nested_violations(df.filter("false"), schema, ["id"]).collect() == []


def test_samples_are_least_and_limited_before_the_shuffle(spark):
    rows = [(i % 97, f"p[{i}]", "p[]", "value" if i % 3 else "kind") for i in range(1000)]
    found = spark.createDataFrame(rows, "id int, path string, place string, problem string").repartition(5)
    got = paths.samples(found, 4)
    want = [r for what in ("value", "kind") for r in sorted(x for x in rows if x[3] == what)[:4]]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    plan = got._jdf.queryExecution().toString()
    assert "row_number(), 4, Partial" in plan and plan.index("Final") < plan.index("Partial")


# --------------------------------------------------------------------------- inference


def test_inferred_types_accept_all_and_merge_in_any_order(spark):
    rng = random.Random(9)
    docs = [(rng.choice("abc"), i % 7, json.dumps(_random_doc(rng))) for i in range(300)]
    df = spark.createDataFrame(docs, "g string, part int, doc string").select("g", "part", F.parse_json("doc").alias("value"))
    whole = {r.g: r.schema for r in inference.infer_by(df, "value", ["g"]).collect()}
    assert set(whole) == set("abc")
    for g, text in whole.items():
        some = df.filter(F.col("g") == g)
        assert some.filter(~sure(v.condition(some, "value", text))).count() == 0, text
        assert str(c(text)) == text
    states = inference.observed(df, "value", ["g", "part"])
    kept = states.collect()
    rng.shuffle(kept)
    halves = [spark.createDataFrame(x, states.schema) for x in (kept[: len(kept) // 3], kept[len(kept) // 3 :])]
    twice = inference.merged(inference.merged(halves[1], ["g", "part"]).unionByName(halves[0]), ["g"])
    once = inference.merged(states, ["g"])
    for merged in (twice, once):
        assert {r.g: r.schema for r in inference.schemas(merged, ["g"]).collect()} == whole
    total = inference.schema(inference.merged(states))
    assert df.filter(~sure(v.condition(df, "value", total))).count() == 0


def test_inferred_types_of_tables(spark):
    rows = [(None, 1, [1.5, 2.5], {"k": "x"}, float("nan")), (None, None, [], {}, 1.0), ("g", 5, [0.0, None], {"k": "y", "j": None}, 2.0)]
    df = spark.createDataFrame(rows, "g string, n int, f array<double>, m map<string,string>, z double").select("g", F.struct("n", "f", "m", "z").alias("row"))
    got = {r.g: r.schema for r in inference.infer_by(df, "row", ["g"]).collect()}
    assert got["g"] == str(c('{"f":([(float,x==0.0)|null],len(x)==2),"m":{"j":null,"k":"y"},"n":5,"z":(float,x==2.0)}'))
    assert got[None] == str(c('{"f":([(float,1.5<=x<=2.5)],len(x)<=2),"m":{"k":("x",optional)},"n":(1,optional),"z":(any)}'))
    many = spark.range(100).select(F.lit(1).alias("g"), F.col("id").cast("string").alias("s"))
    assert [r.schema for r in inference.infer_by(many, "s", ["g"]).collect()] == ["(string,len(x)>=1,len(x)<=2)"]
    assert inference.infer_by(many.filter("false"), "s", ["g"]).collect() == [] and inference.schema(inference.observed(many.filter("false"), "s")) == t.NEVER


# --------------------------------------------------------------------- keys and references


def test_keys_are_read_from_schemas():
    found = keys.keys_of('{"a":(int,pk),"b":(string,pk=true,unique=false),"c":(int,unique,ref="t.id",optional),"d":"x"}')
    assert found == keys.Keys(("a", "b"), ("c",), {"c": ("t", "id")})
    for bad in ('{"a":(int,ref="t")}', '{"a":(int,ref=1)}', '{"a":(int,pk=1)}', "[(int)]"):
        with pytest.raises(SchemaError):
            keys.keys_of(bad)


def test_keys_and_planted_orphans(spark):
    child = spark.createDataFrame([(1, 10, "a"), (1, 10, "b"), (None, 11, None), (3, None, None), (4, 99, "a"), (5, 99, "c")], "id int, parent int, code string")
    parent = spark.createDataFrame([(10,), (11,), (12,), (None,)], "key int")
    schemas = {"child": '{"id":(int,pk),"parent":(int,optional,ref="parent.key"),"code":(string,unique)}', "parent": '{"key":(int)}'}
    got = {tuple(r) for r in keys.key_violations({"child": child, "parent": parent}, schemas).collect()}
    assert got == {("child", "pk", "id", '{"id":1}', 2), ("child", "pk", "id", '{"id":null}', 1), ("child", "unique", "code", '{"code":"a"}', 2), ("child", "ref", "parent", '{"parent":99}', 2)}
    with pytest.raises(SchemaError, match="isn't given"):
        keys.key_violations({"child": child}, schemas)
    assert keys.orphans(child.filter("false"), ("parent",), parent, ("key",)).collect() == []
    none = {(r.parent, r.n) for r in keys.orphans(child, ("parent",), parent.filter("false"), ("key",)).collect()}
    assert none == {(10, 2), (11, 1), (99, 2)}


# ------------------------------------------------------------------------------ unsigned 64 bits


def test_unsigned_64_bits(spark):
    top = 2**64 - 1
    docs = spark.createDataFrame([("0",), ("-1",), (str(2**63 - 1),), (str(2**63),), (str(top),), (str(top + 1),), ("1.5",), ("1.0",)], "doc string")
    ok = lambda s: [r.ok for r in docs.select(sure(v.json_condition(F.col("doc"), s)).alias("ok")).collect()]
    assert ok("(uint64)") == [True, False, True, True, True, False, False, False]
    assert ok("(uint64,x>5)") == [False, False, True, True, True, False, False, False]
    assert ok("(uint64,x<=5||x==9223372036854775807)") == [True, False, True, False, False, False, False, False]
    assert ok("(int)") == [True, True, True, False, False, False, False, False]
    df = docs.limit(6).select(F.col("doc").cast("decimal(20,0)").alias("n"))
    typed = lambda s: [r.ok for r in df.select(sure(v.condition(df, "n", s)).alias("ok")).collect()]
    assert typed("(uint64)") == [True, False, True, True, True, False] and typed("(int,x!=0)") == [False, True, True, False, False, False]
    assert order.is_subtype(c("(uint32)"), c("(uint64)")) and order.compare(c("(int,x>=0)"), c("(uint64)")) == "widening"
    assert c("(uint64,x!=3)") == c("(uint64,x<3||x>3)") and c(str(c("(uint64)"))) == c("(uint64)")
    assert v.to_spark(c("(uint64)")).simpleString() == "decimal(20,0)"
