"""Types as conditions on typed columns.

The conditions are bare (null where the value is null) as far as they can be, so that a filter on
them reaches the scan.  SQL's NULL stands for an absent value and for null: it conforms where the
field is optional or the type accepts null.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formwork.operators.expressions import constraint, sure
from formwork.schema import types as t

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_REAL = (T.FloatType, T.DoubleType, T.DecimalType)


def _is_wide(dt: T.DataType) -> bool:
    """Decimals without a fraction are integers, some beyond 64 bits."""
    return isinstance(dt, T.DecimalType) and dt.scale == 0


def kind_of(dt: T.DataType) -> str:
    """The kind of a Spark type's values."""
    if _is_wide(dt):
        return "int"
    for kind, classes in (("bool", T.BooleanType), ("int", _WHOLE), ("float", _REAL), ("string", T.StringType), ("null", T.NullType)):
        if isinstance(dt, classes):
            return kind
    return "other"


def accepts_null(k: t.Type) -> bool:
    match k:
        case t.SumType(members):
            return any(map(accepts_null, members))
        case t.Refined(base, c):
            return accepts_null(base) and (c.enum is None or any(v.kind == "null" for v in c.enum))
        case t.Literal(v):
            return v.kind == "null"
    return k in (t.ANY, t.NULL)


def length_of(c: Column, dt: T.DataType) -> Column | None:
    """Code points of a string, elements of an array or map, fields present in a struct."""
    if isinstance(dt, T.StringType):
        return F.char_length(c)
    if isinstance(dt, (T.ArrayType, T.MapType)):
        return F.size(c)
    if isinstance(dt, T.StructType):
        return reduce(lambda a, b: a + b, (c.getField(f.name).isNotNull().cast("int") for f in dt.fields), F.lit(0))
    return None


def predicate(k: t.Type, c: Column, dt: T.DataType) -> Column:
    """Whether the value of ``c``, a column of type ``dt``, belongs to ``k``."""
    kind = kind_of(dt)
    match k:
        case t.Basic("any"):
            return F.lit(True)
        case t.Basic("null"):
            return c.isNull()
        case t.Basic("float") if kind == "int":
            return c <= t.FLOAT_LIMIT
        case t.Basic("huge"):
            return c.between(F.lit(str(t.INT_MAX + 1)).cast("decimal(20,0)"), F.lit(str(t.HUGE_MAX)).cast("decimal(20,0)")) if _is_wide(dt) else F.lit(False)
        case t.Basic("int") if _is_wide(dt):
            return c.between(t.INT_MIN, t.INT_MAX)
        case t.Basic("float") if isinstance(dt, (T.FloatType, T.DoubleType)):
            return c.isNotNull() & ~F.isnan(c)  # NaN isn't a value of the language
        case t.Basic(name):
            return c.isNotNull() if name == kind else F.lit(False)
        case t.Literal(v):
            if v.kind == "null":
                return c.isNull()
            return c == F.lit(v.value) if v.kind == kind else F.lit(False)
        case t.ListType(item):
            if not isinstance(dt, T.ArrayType):
                return F.lit(False)
            return F.forall(c, lambda e: sure(field(item, False, e, dt.elementType)))
        case t.TupleType(items):
            return _tuple(items, c, dt)
        case t.ObjectType(fields):
            return _object(fields, c, dt)
        case t.SumType(members):
            base = common_base(members)
            if base is not None:
                return predicate(base, c, dt) & reduce(or_, (_held(base, t.parts(m)[1], c, dt) for m in members))
            return reduce(or_, (sure(predicate(m, c, dt)) for m in members))
        case t.Refined(base, held):
            return predicate(base, c, dt) & _held(base, held, c, dt)
    raise TypeError(k)


def common_base(members: tuple) -> t.Type | None:
    """The number or string type that all members of a sum refine, if there is one: their conditions
    can stay bare, and reach the scan as an alternative."""
    bases = {t.parts(m)[0] for m in members}
    base = bases.pop()
    return base if not bases and base in (t.INT, t.FLOAT, t.STRING) else None


def _held(base: t.Type, held: t.Constraint, c: Column, dt: T.DataType) -> Column:
    """The constraint on a value that is known to belong to ``base``."""
    kind = kind_of(dt)
    if not held.length.free and length_of(c, dt) is None:
        return F.lit(False)
    fits = lambda v: v.kind == kind or v.kind == "null" or {v.kind, kind} == {"int", "float"} and base == t.FLOAT
    if not held.bounds.free and kind not in ("int", "float"):
        return F.lit(False)
    return constraint(held, c, length_of(c, dt), fits, c.cast("long") if kind == "int" and base != t.HUGE else None)


def field(k: t.Type, optional: bool, c: Column, dt: T.DataType) -> Column:
    """``predicate`` of a field, which may be absent if it is optional."""
    p = predicate(k, c, dt)
    return c.isNull() | p if optional or (accepts_null(k) and k not in (t.ANY, t.NULL)) else p


def _tuple(items: tuple, c: Column, dt: T.DataType) -> Column:
    if isinstance(dt, T.ArrayType):
        each = [sure(field(k, False, F.get(c, F.lit(i)), dt.elementType)) for i, k in enumerate(items)]
        return reduce(and_, each, F.size(c) == len(items))
    if isinstance(dt, T.StructType) and len(dt.fields) == len(items):
        each = [field(k, False, c.getField(f.name), f.dataType) for k, f in zip(items, dt.fields)]
        return reduce(and_, each, c.isNotNull())
    return F.lit(False)


def _object(fields: tuple, c: Column, dt: T.DataType) -> Column:
    if isinstance(dt, T.StructType):
        found = struct_fields(fields, dt, lambda name: c.getField(name))
        return reduce(and_, found.values(), c.isNotNull())
    if isinstance(dt, T.MapType) and isinstance(dt.keyType, T.StringType):
        known = F.array(*(F.lit(f.name) for f in fields)).cast("array<string>")
        out = F.size(F.array_except(F.map_keys(c), known)) == 0
        for f in fields:
            there, p = F.map_contains_key(c, f.name), sure(field(f.type, False, F.element_at(c, f.name), dt.valueType))
            out = out & ((~there | p) if f.optional else (there & p))
        return out
    return F.lit(False)


def struct_fields(fields: tuple, dt: T.StructType, column) -> dict[str, Column]:
    """A condition for each field of an object type, and for each field that it doesn't know."""
    types = {f.name: f.dataType for f in dt.fields}
    out = {}
    for f in fields:
        out[f.name] = field(f.type, f.optional, column(f.name), types[f.name]) if f.name in types else F.lit(f.optional)
    return out | {name: F.lit(False) for name in types if name not in out}
