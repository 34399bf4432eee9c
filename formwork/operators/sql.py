"""Types as SQL: conditions as text, and temporary functions that ``spark.sql`` can call."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from formwork.functions import EMAIL, IPV4, URL, UUID, layouts
from formwork.operators import columns
from formwork.schema import types as t
from formwork.schema.compile import compile_schema
from formwork.schema.syntax import Binary, Call, ListNode, Lit, SchemaError, Unary, X

_TRY = {"+": "try_add", "-": "try_subtract", "*": "try_multiply", "/": "try_divide", "%": "try_mod"}
#: How functions that schemas call read in SQL: arguments by number.
FUNCTIONS = {
    "match": "rlike({0}, {1})",
    "startsWith": "startswith({0}, {1})",
    "endsWith": "endswith({0}, {1})",
    "contains": "contains({0}, {1})",
}


def register(name: str, text: str) -> None:
    """How a user's own function reads in SQL, such as ``{0} % 2 = 0``."""
    FUNCTIONS[name] = text


def literal(v) -> str:
    """A Python value as a SQL literal of the type that a literal column has."""
    match v:
        case None:
            return "NULL"
        case bool():
            return str(v).upper()
        case int():
            return f"{v}" if -(1 << 31) <= v < 1 << 31 else f"{v}L" if v >= -(1 << 63) + 1 else "(-9223372036854775807L - 1L)"
        case float():
            return f"{v!r}D" if v == v and abs(v) != float("inf") else f"DOUBLE('{v}')"
        case str():
            return "'" + re.sub(r"[\x00-\x1f]", lambda m: f"\\u{ord(m[0]):04x}", v.replace("\\", "\\\\").replace("'", "\\'")) + "'"
    raise SchemaError(f"no literal: {v!r}")


def name_of(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def _expression(e, x: str, length: str | None) -> str:
    inner = lambda a: _expression(a, x, length)
    match e:
        case Lit(_, v):
            return literal(v)
        case ListNode(items):
            return f"array({', '.join(map(inner, items))})"
        case Call("len", (arg,)) if arg == X:
            if length is None:
                raise SchemaError("this type has no length")
            return length
        case Call("email" | "uuid" | "url" | "ipv4" as name, (arg,)):
            return f"rlike({inner(arg)}, {literal({'email': EMAIL, 'uuid': UUID, 'url': URL, 'ipv4': IPV4}[name])})"
        case Call("parsedate", (arg, Lit(_, layout))):
            return "(" + " OR ".join(f"try_to_timestamp({inner(arg)}, {literal(p)}) IS NOT NULL" for p in layouts(layout)) + ")"
        case Call(name, args):
            if name not in FUNCTIONS:
                raise SchemaError(f"{name!r} has no SQL; see register")
            return f"({FUNCTIONS[name].format(*map(inner, args))})"
        case Unary("!", arg):
            return f"(NOT {inner(arg)})"
        case Unary(op, arg):
            return f"try_subtract(0, {inner(arg)})" if op == "-" else inner(arg)
        case Binary("||" | "&&" as op, left, right):
            return f"({inner(left)} {'OR' if op == '||' else 'AND'} {inner(right)})"
        case Binary("~", left, right):
            return f"rlike({inner(left)}, {inner(right)})"
        case Binary("in", left, right):
            return f"array_contains({inner(right)}, {inner(left)})"
        case Binary(op, left, right) if op in _TRY:
            return f"{_TRY[op]}({inner(left)}, {inner(right)})"
        case Binary(op, left, right):
            return f"({inner(left)} {'=' if op == '==' else op} {inner(right)})"
    if e == X:
        return x
    raise SchemaError(f"not a value here: {e!r}")


def _length(x: str, dt: T.DataType) -> str | None:
    if isinstance(dt, T.StringType):
        return f"char_length({x})"
    if isinstance(dt, (T.ArrayType, T.MapType)):
        return f"size({x})"
    if isinstance(dt, T.StructType):
        return " + ".join(["0", *(f"int({x}.{name_of(f.name)} IS NOT NULL)" for f in dt.fields)])
    return None


def _within(b: t.Bounds, x: str) -> list[str]:
    low = [f"{x} {'>' if b.low_open else '>='} {literal(b.low)}"] if b.low is not None else []
    return low + ([f"{x} {'<' if b.high_open else '<='} {literal(b.high)}"] if b.high is not None else [])


def _held(base: t.Type, c: t.Constraint, x: str, dt: T.DataType) -> str:
    kind, length = columns.kind_of(dt), _length(x, dt)
    if (not c.length.free and length is None) or (not c.bounds.free and kind not in ("int", "float")):
        return "FALSE"
    found = _within(c.bounds, x) + (_within(c.length, f"({length})") if not c.length.free else [])
    if c.enum is not None:
        fits = [v for v in sorted(c.enum, key=t.key) if v.kind in (kind, "null") or ({v.kind, kind} == {"int", "float"} and base == t.FLOAT)]
        plain = [literal(v.value) for v in fits if v.kind != "null"]
        ways = [f"{x} IN ({', '.join(plain)})"] * bool(plain) + [f"{x} IS NULL"] * (len(plain) < len(fits))
        found.append(f"({' OR '.join(ways)})" if ways else "FALSE")
    found += [_expression(e, f"CAST({x} AS BIGINT)" if kind == "int" and base != t.HUGE else x, length) for e in sorted(c.rest, key=str)]
    return " AND ".join(found) or "TRUE"


def _sure(p: str) -> str:
    return p if p in ("TRUE", "FALSE") else f"coalesce({p}, FALSE)"


def predicate(k: t.Type, x: str, dt: T.DataType, depth: int = 0) -> str:
    """A SQL condition: whether ``x``, an expression of type ``dt``, belongs to ``k``.  It says what ``columns.predicate`` says."""
    kind = columns.kind_of(dt)
    match k:
        case t.Basic("any"):
            return "TRUE"
        case t.Basic("null"):
            return f"{x} IS NULL"
        case t.Basic("float") if kind == "int":
            return f"{x} <= {t.FLOAT_LIMIT}L"
        case t.Basic("huge"):
            return f"{x} BETWEEN {t.INT_MAX + 1}BD AND {t.HUGE_MAX}BD" if kind == "int" and isinstance(dt, T.DecimalType) else "FALSE"
        case t.Basic("int") if isinstance(dt, T.DecimalType) and kind == "int":
            return f"{x} BETWEEN {t.INT_MIN}BD AND {t.INT_MAX}BD"
        case t.Basic("float") if isinstance(dt, (T.FloatType, T.DoubleType)):
            return f"({x} IS NOT NULL AND NOT isnan({x}))"
        case t.Basic(name):
            return f"{x} IS NOT NULL" if name == kind else "FALSE"
        case t.Literal(v):
            return f"{x} IS NULL" if v.kind == "null" else f"{x} = {literal(v.value)}" if v.kind == kind else "FALSE"
        case t.ListType(item):
            if not isinstance(dt, T.ArrayType):
                return "FALSE"
            return f"forall({x}, e{depth} -> {_sure(field(item, False, f'e{depth}', dt.elementType, depth + 1))})"
        case t.TupleType(items):
            if isinstance(dt, T.ArrayType):
                each = [_sure(field(i, False, f"get({x}, {n})", dt.elementType, depth)) for n, i in enumerate(items)]
                return f"({' AND '.join([f'size({x}) = {len(items)}', *each])})"
            if isinstance(dt, T.StructType) and len(dt.fields) == len(items):
                return f"({' AND '.join([f'{x} IS NOT NULL', *(field(i, False, f'{x}.{name_of(f.name)}', f.dataType, depth) for i, f in zip(items, dt.fields))])})"
            return "FALSE"
        case t.ObjectType(fields):
            return _object(fields, x, dt, depth)
        case t.SumType(members):
            base = columns.common_base(members)
            if base is not None:
                return f"({predicate(base, x, dt, depth)} AND ({' OR '.join(f'({_held(base, t.parts(m)[1], x, dt)})' for m in members)}))"
            return f"({' OR '.join(_sure(predicate(m, x, dt, depth)) for m in members)})"
        case t.Refined(base, c):
            return f"({predicate(base, x, dt, depth)} AND {_held(base, c, x, dt)})"
    raise TypeError(k)


def field(k: t.Type, optional: bool, x: str, dt: T.DataType, depth: int = 0) -> str:
    """``predicate`` of a field, which may be absent if it is optional."""
    p = predicate(k, x, dt, depth)
    return f"({x} IS NULL OR {p})" if optional or (columns.accepts_null(k) and k not in (t.ANY, t.NULL)) else p


def _object(fields: tuple, x: str, dt: T.DataType, depth: int) -> str:
    names = {f.name for f in fields}
    if isinstance(dt, T.StructType):
        kinds = {f.name: f.dataType for f in dt.fields}
        each = [field(f.type, f.optional, f"{x}.{name_of(f.name)}", kinds[f.name], depth) if f.name in kinds else literal(f.optional) for f in fields]
        return f"({' AND '.join([f'{x} IS NOT NULL', *each, *('FALSE' for name in kinds if name not in names)])})"
    if isinstance(dt, T.MapType) and isinstance(dt.keyType, T.StringType):
        known = f"array({', '.join(literal(f.name) for f in fields)})"
        out = [f"size(array_except(map_keys({x}), CAST({known} AS ARRAY<STRING>))) = 0"]
        for f in fields:
            there, p = f"map_contains_key({x}, {literal(f.name)})", _sure(field(f.type, False, f"element_at({x}, {literal(f.name)})", dt.valueType, depth))
            out.append(f"(NOT {there} OR {p})" if f.optional else f"{there} AND {p}")
        return f"({' AND '.join(out)})"
    return "FALSE"


def sql_condition(df: DataFrame, column: str, schema, names: dict | None = None) -> str:
    """Whether the values of a typed column belong to a schema, as SQL for ``expr`` or ``WHERE``."""
    return field(compile_schema(schema, names), False, name_of(column), df.schema[column].dataType)


def create_function(spark: SparkSession, name: str, schema, dt: T.DataType | str, names: dict | None = None) -> None:
    """Make ``name(x)`` a function of the session: whether a value of a Spark type belongs to a schema (false where that is unknown).

    Spark inlines its body, so that a filter by the function is planned as the condition itself."""
    kind = T.DataType.fromDDL(dt) if isinstance(dt, str) else dt
    body = _sure(field(compile_schema(schema, names), False, "x", kind))
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x {kind.simpleString()}) RETURNS BOOLEAN RETURN {body}")
