"""Types as conditions on VARIANT columns, which keep JSON's kinds: 1 is no 1.0, absent is not null."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from formwork.operators.columns import common_base
from formwork.operators.expressions import constraint, sure
from formwork.schema import types as t

_SPARK = {"bool": ("BOOLEAN", "boolean"), "int": ("BIGINT", "bigint"), "string": ("STRING", "string")}


def parsed(text: Column) -> Column:
    """The VARIANT of a text that holds exactly one JSON value, else NULL.

    Spark's parser stops behind the first value of a text.  In an array with the text's own hash
    behind it, anything that follows the value shows: the array has two elements only if the text is one value."""
    mark = F.xxhash64(text)
    pair = F.try_parse_json(F.concat(F.lit("["), text, F.lit(","), mark.cast("string"), F.lit("]")))
    one = (F.try_variant_get(pair, "$[1]", "bigint") == mark) & F.try_variant_get(pair, "$[2]", "variant").isNull()
    return F.when(one, F.try_variant_get(pair, "$[0]", "variant"))


def _get(v: Column, kind: str) -> Column:
    return F.try_variant_get(v, "$", kind)


def _is(v: Column, kind: str) -> Column:
    return F.schema_of_variant(v) == kind


def _float(v: Column) -> Column:
    """Floats as JSON writes them, and integers up to the limit; no infinities.

    The scale-0 decimals are integers beyond 64 bits, which belong to no type."""
    kind, x = F.schema_of_variant(v), _get(v, "double")
    real = ((kind == "DOUBLE") | (kind == "FLOAT") | (kind.startswith("DECIMAL") & ~((kind.endswith(",0)")) & (F.abs(x) >= float(1 << 63))))) & (F.abs(x) != float("inf"))
    return real | ((kind == "BIGINT") & (_get(v, "bigint") <= t.FLOAT_LIMIT))


def predicate(k: t.Type, v: Column) -> Column:
    """Whether the JSON value ``v`` belongs to ``k``; an absent value (SQL NULL) belongs to none."""
    match k:
        case t.Basic("any"):
            return v.isNotNull()
        case t.Basic("never"):
            return F.lit(False)
        case t.Basic("null"):
            return F.is_variant_null(v)
        case t.Basic("float"):
            return _float(v)
        case t.Basic("huge"):
            kind, x = F.schema_of_variant(v), _get(v, "decimal(38,0)")
            return kind.startswith("DECIMAL") & kind.endswith(",0)") & (x > F.lit(t.INT_MAX)) & (x <= F.lit(str(t.HUGE_MAX)).cast("decimal(20,0)"))
        case t.Basic(name):
            return _is(v, _SPARK[name][0])
        case t.Literal(lit):
            return _equals(v, lit)
        case t.ListType(item):
            return F.forall(_get(v, "array<variant>"), lambda e: sure(predicate(item, e)))
        case t.TupleType(items):
            a = _get(v, "array<variant>")
            return reduce(and_, (sure(predicate(i, F.get(a, F.lit(n)))) for n, i in enumerate(items)), F.size(a) == len(items))
        case t.ObjectType(fields):
            m = _get(v, "map<string,variant>")
            known = F.array(*(F.lit(f.name) for f in fields)).cast("array<string>")
            out = m.isNotNull() & (F.size(F.array_except(F.map_keys(m), known)) == 0)
            for f in fields:
                there, p = F.map_contains_key(m, f.name), sure(predicate(f.type, F.element_at(m, f.name)))
                out = out & ((~there | p) if f.optional else (there & p))
            return out
        case t.SumType(members) if (base := common_base(members)) is not None:
            return sure(predicate(base, v)) & reduce(or_, (sure(_constraint(base, t.parts(m)[1], v)) for m in members))
        case t.SumType(members):
            return reduce(or_, (sure(predicate(m, v)) for m in members))
        case t.Refined(base, c):
            return sure(predicate(base, v)) & _constraint(base, c, v)
    raise TypeError(k)


def _equals(v: Column, lit) -> Column:
    if lit.kind == "null":
        return F.is_variant_null(v)
    if lit.kind == "float":
        kind = F.schema_of_variant(v)
        return ((kind == "DOUBLE") | kind.startswith("DECIMAL")) & (_get(v, "double") == lit.value)
    name, spark = _SPARK[lit.kind]
    return _is(v, name) & (_get(v, spark) == lit.value)


def _constraint(base: t.Type, c: t.Constraint, v: Column) -> Column:
    match base:
        case t.Basic("int"):
            return constraint(c, _get(v, "bigint"), None)
        case t.Basic("float"):
            return constraint(c, _get(v, "double"), None)
        case t.Basic("string"):
            x = _get(v, "string")
            return constraint(c, x, F.char_length(x))
        case t.Basic("bool"):
            return constraint(c, _get(v, "boolean"), None)
        case t.ListType() | t.TupleType():
            a = _get(v, "array<variant>")
            return constraint(c, a, F.size(a))
        case t.ObjectType():
            m = _get(v, "map<string,variant>")
            return constraint(c, m, F.size(m))
    enum = F.lit(True) if c.enum is None else reduce(or_, (sure(_equals(v, lit)) for lit in sorted(c.enum, key=t.key)), F.lit(False))
    return enum & constraint(t.Constraint(c.bounds, c.length, None, c.rest), v, None)
