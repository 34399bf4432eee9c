"""Values rewritten to their schema: in the Spark types that hold them, and in normal form.

JSON becomes typed columns, objects become structs with the schema's fields, and what a format
function accepts (``email``, ``uuid`` ...) becomes its normal form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formwork.functions import NORMAL
from formwork.operators import columns, variant
from formwork.operators.expressions import sure
from formwork.operators.validation import condition, split, to_spark
from formwork.schema import types as t
from formwork.schema.compile import compile_schema
from formwork.schema.syntax import Call, SchemaError, X


def normal(c: t.Constraint, value: Column) -> Column:
    """The normal form that the constraint's format functions give a string, one after another by name."""
    for name in sorted(e.name for e in c.rest if isinstance(e, Call) and e.args == (X,) and e.name in NORMAL):
        value = NORMAL[name](value)
    return value


def rewritten(k: t.Type, x: Column, dt: T.DataType) -> Column:
    """A value that belongs to ``k``, in the type ``to_spark(k)``; ``dt`` is the type it has.  NULL stays NULL."""
    to, json = to_spark(k), isinstance(dt, T.VariantType)
    if isinstance(to, T.NullType):
        return F.lit(None)
    if isinstance(to, T.VariantType):
        return x if json else _variant(x, dt)
    match k:
        case t.SumType() if isinstance(to, T.DecimalType):
            return F.try_variant_get(x, "$", to.simpleString()) if json else x.cast(to)
        case t.Refined(base, c):
            inner = rewritten(base, x, dt)
            return normal(c, inner) if base == t.STRING else inner
        case t.SumType(members):
            inner = [m for m in members if m != t.NULL]
            fits = [(sure(variant.predicate(m, x) if json else columns.field(m, False, x, dt)), rewritten(m, x, dt)) for m in inner]
            first, *rest = fits
            return reduce(lambda done, one: done.when(*one), rest, F.when(*first))
        case t.ListType(item):
            inner, of = (F.try_variant_get(x, "$", "array<variant>"), T.VariantType()) if json else (x, dt.elementType)
            return F.transform(inner, lambda e: rewritten(item, e, of))
        case t.TupleType(items):
            if json:
                held = F.try_variant_get(x, "$", "array<variant>")
                values = [(F.get(held, F.lit(i)), T.VariantType()) for i in range(len(items))]
            elif isinstance(dt, T.StructType):
                held, values = x, [(x.getField(f.name), f.dataType) for f in dt.fields]
            else:
                held, values = x, [(F.get(x, F.lit(i)), dt.elementType) for i in range(len(items))]
            return _when(held, F.struct(*(rewritten(i, v, of).alias(f"_{n + 1}") for n, (i, (v, of)) in enumerate(zip(items, values)))))
        case t.ObjectType(fields):
            held = F.try_variant_get(x, "$", "map<string,variant>") if json else x
            return _when(held, F.struct(*(_field(f, held, T.MapType(T.StringType(), T.VariantType()) if json else dt).alias(f.name) for f in fields)))
    return F.try_variant_get(x, "$", to.simpleString()) if json else x.cast(to)


def _when(held: Column, value: Column) -> Column:
    return F.when(held.isNotNull(), value)


def _field(f: t.Field, held: Column, dt: T.DataType) -> Column:
    if isinstance(dt, T.MapType):
        return rewritten(f.type, F.element_at(held, f.name), dt.valueType)
    kinds = {g.name: g.dataType for g in dt.fields}
    return rewritten(f.type, held.getField(f.name), kinds[f.name]) if f.name in kinds else F.lit(None).cast(to_spark(f.type))


def _variant(x: Column, dt: T.DataType) -> Column:
    return F.to_variant_object(x) if isinstance(dt, (T.StructType, T.ArrayType, T.MapType)) else x.cast("variant")


def conform(df: DataFrame, schema, closed: bool = True, names: dict | None = None) -> DataFrame:
    """The rows that belong to the object schema, with its fields as columns, in order of their names.

    A field that no column holds is NULL, as it must be optional.  A narrow operation: the bare condition still reaches the scan."""
    kind = compile_schema(schema, names)
    if not isinstance(kind, t.ObjectType):
        raise SchemaError("rows need an object schema")
    dt = {f.name: f.dataType for f in df.schema.fields}
    good = split(df, kind, closed)[0]
    return good.select(*((rewritten(f.type, F.col(f"`{f.name}`"), dt[f.name]) if f.name in dt else F.lit(None).cast(to_spark(f.type))).alias(f.name) for f in kind.fields))


def conform_value(df: DataFrame, column: str, schema, name: str | None = None, names: dict | None = None) -> DataFrame:
    """``df`` with the column (typed or VARIANT) rewritten to the schema, as ``name``; NULL where it doesn't belong to it."""
    kind = compile_schema(schema, names)
    value = rewritten(kind, F.col(column), df.schema[column].dataType)
    return df.withColumn(name or column, F.when(sure(condition(df, column, kind)), value))
