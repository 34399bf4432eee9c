"""Schema expressions as columns."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from formwork.functions import REGISTRY
from formwork.schema import types as t
from formwork.schema.syntax import Binary, Call, ListNode, Lit, SchemaError, Unary, X

_TRY = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply, "/": F.try_divide, "%": F.try_mod}


def sure(p: Column) -> Column:
    """A condition that is false where it is unknown."""
    return F.coalesce(p, F.lit(False))


def column_of(e, x: Column, length: Column | None) -> Column:
    """The expression for the value ``x`` and its length.  Arithmetic errors give null."""
    match e:
        case Lit(_, v):
            return F.lit(v)
        case ListNode(items):
            return F.array(*(column_of(i, x, length) for i in items))
        case Call("len", (arg,)) if arg == X:
            if length is None:
                raise SchemaError("this type has no length")
            return length
        case Call(name, args):
            if name == "len":
                raise SchemaError("len is of x only")
            if name not in REGISTRY:
                raise SchemaError(f"unknown function {name!r}")
            if name == "parsedate":  # its layout is a name, known when the schema is compiled
                return REGISTRY[name](column_of(args[0], x, length), args[1].value)
            return REGISTRY[name](*(column_of(a, x, length) for a in args))
        case Unary("!", arg):
            return ~column_of(arg, x, length)
        case Unary(op, arg):
            inner = column_of(arg, x, length)
            return F.try_subtract(F.lit(0), inner) if op == "-" else inner
        case Binary(op, left, right):
            a, b = column_of(left, x, length), column_of(right, x, length)
            match op:
                case "||":
                    return a | b
                case "&&":
                    return a & b
                case "==":
                    return a == b
                case "!=":
                    return a != b
                case "<":
                    return a < b
                case "<=":
                    return a <= b
                case ">":
                    return a > b
                case ">=":
                    return a >= b
                case "~":
                    return F.rlike(a, b)
                case "in":
                    return F.array_contains(b, a)
            return _TRY[op](a, b)
    if e == X:
        return x
    raise SchemaError(f"not a value here: {e!r}")


def in_bounds(b: t.Bounds, x: Column) -> list[Column]:
    out = []
    if b.low is not None:
        out.append(x > b.low if b.low_open else x >= b.low)
    if b.high is not None:
        out.append(x < b.high if b.high_open else x <= b.high)
    return out


def constraint(c: t.Constraint, x: Column, length: Column | None, fits=lambda v: True, wide: Column | None = None) -> Column:
    """``c`` for the value ``x``; ``fits``: which literals x can equal at all; ``wide``: x in the type
    in which expressions are computed, if that isn't its own."""
    found = in_bounds(c.bounds, x)
    if not c.length.free:
        found += in_bounds(c.length, length)
    if c.enum is not None:
        values = [v for v in sorted(c.enum, key=t.key) if fits(v)]
        plain = [v.value for v in values if v.kind != "null"]
        held = x.isin(plain) if plain else F.lit(False)
        found.append(held | x.isNull() if len(plain) < len(values) else held)
    found += [column_of(e, x if wide is None else wide, length) for e in sorted(c.rest, key=str)]
    return reduce(and_, found) if found else F.lit(True)
