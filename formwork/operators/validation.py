"""What a user does with a schema and a DataFrame."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formwork.operators import columns, variant
from formwork.operators.expressions import sure
from formwork.schema import types as t
from formwork.schema.compile import compile_schema
from formwork.schema.syntax import SchemaError


def condition(df: DataFrame, column: str, schema, names: dict | None = None) -> Column:
    """Whether the values of one column (typed or VARIANT) belong to a schema.

    The condition is NULL where the value is, and where arithmetic has no result (``10 / x > 1`` at 0): a filter on it
    keeps what belongs; for a filter on its opposite wrap it in ``sure``."""
    kind, dt = compile_schema(schema, names), df.schema[column].dataType
    if isinstance(dt, T.VariantType):
        return variant.predicate(kind, F.col(column))
    return columns.field(kind, False, F.col(column), dt)


def free_name(name: str, taken: list[str]) -> str:
    """``name``, lengthened until no column has it."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def json_condition(text: Column, schema, names: dict | None = None) -> Column:
    """Whether a column of JSON text belongs to a schema; text that isn't exactly one JSON value
    belongs to none.  NULL counts as no, as in ``condition``: wrap it in ``sure`` to negate it."""
    return variant.predicate(compile_schema(schema, names), variant.parsed(text))


def field_conditions(df: DataFrame, schema, closed: bool = True, names: dict | None = None) -> dict[str, Column]:
    """A condition for each field of an object schema over the columns of ``df``.

    ``closed``: columns that the schema doesn't know are wrong, as in any object; else they are left alone."""
    kind = compile_schema(schema, names)
    if not isinstance(kind, t.ObjectType):
        raise SchemaError("rows need an object schema")
    known = {f.name for f in kind.fields}
    fields = [f for f in df.schema.fields if closed or f.name in known]
    out = columns.struct_fields(kind.fields, T.StructType(fields), F.col)
    for f in df.schema.fields:
        own = kind.get(f.name)
        if own and isinstance(f.dataType, T.VariantType):
            p = variant.predicate(own.type, F.col(f.name))
            out[f.name] = F.col(f.name).isNull() | p if own.optional else p
    return out


def row_condition(df: DataFrame, schema, closed: bool = True, names: dict | None = None) -> Column:
    return reduce(and_, field_conditions(df, schema, closed, names).values(), F.lit(True))


def validate(df: DataFrame, schema, name: str = "valid", closed: bool = True, names: dict | None = None) -> DataFrame:
    """``df`` with a boolean column: whether the row belongs to the object schema."""
    return df.withColumn(name, sure(row_condition(df, schema, closed, names)))


def split(df: DataFrame, schema, closed: bool = True, names: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows that belong to the schema and those that don't.

    The first is filtered by the bare condition, which reaches the scan."""
    p = row_condition(df, schema, closed, names)
    return df.filter(p), df.filter(~sure(p))


def violations(df: DataFrame, schema, keys: list[str], closed: bool = True, names: dict | None = None) -> DataFrame:
    """``keys`` and ``path``: one row for each field of each row that doesn't conform."""
    wrong = [F.when(~sure(p), F.lit(name)) for name, p in field_conditions(df, schema, closed, names).items()]
    return df.select(*keys, F.explode(F.array_compact(F.array(*wrong))).alias("path"))


def report(df: DataFrame, schema, by: list[str] | None = None, closed: bool = True, names: dict | None = None) -> DataFrame:
    """``path, valid, invalid``: counts for each field, in one pass; ``by``: for each group."""
    by = by or []
    conditions = field_conditions(df.drop(*by) if closed else df, schema, closed, names)
    held = [free_name(f"counts{i}", by) for i in range(len(conditions))]
    counts = [F.struct(F.count_if(sure(p)).alias("valid"), F.count_if(~sure(p)).alias("invalid")).alias(c) for c, p in zip(held, conditions.values())]
    rows = df.groupBy(*by).agg(*counts)
    paths = F.array(*(F.struct(F.lit(name).alias("path"), F.col(f"{c}.valid").alias("valid"), F.col(f"{c}.invalid").alias("invalid")) for c, name in zip(held, conditions)))
    one = free_name("r", by)
    return rows.select(*by, F.explode(paths).alias(one)).select(*by, f"{one}.*")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with ``n``: what a primary key forbids."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def to_spark(kind: t.Type) -> T.DataType:
    """The Spark type that holds all values of a type; VARIANT where none does."""
    match kind:
        case t.Basic(name):
            simple = {"bool": T.BooleanType(), "int": T.LongType(), "float": T.DoubleType(), "string": T.StringType(), "null": T.NullType(), "huge": T.DecimalType(20, 0)}
            return simple.get(name, T.VariantType())
        case t.Literal(v):
            return to_spark(t.Basic(v.kind))
        case t.Refined(base, _):
            return to_spark(base)
        case t.ListType(item):
            return T.ArrayType(to_spark(item))
        case t.TupleType(items):
            return T.StructType([T.StructField(f"_{i + 1}", to_spark(k)) for i, k in enumerate(items)])
        case t.ObjectType(fields):
            return T.StructType([T.StructField(f.name, to_spark(f.type), f.optional) for f in fields])
        case t.SumType(members):
            found = {to_spark(m) for m in members if m != t.NULL}
            if found == {T.LongType(), T.DecimalType(20, 0)}:
                return T.DecimalType(20, 0)
            return found.pop() if len(found) == 1 else T.VariantType()
    raise TypeError(kind)


def from_spark(dt: T.DataType) -> t.Type:
    """The least type that a Spark type's values belong to."""
    kind = columns.kind_of(dt)
    if isinstance(dt, T.DecimalType) and dt.scale == 0 and dt.precision > 18:
        return t.ANY  # may go beyond what the language's integers hold
    if kind != "other":
        return t.Basic(kind)
    if isinstance(dt, T.ArrayType):
        return t.ListType(from_spark(dt.elementType))
    if isinstance(dt, T.StructType):
        return t.ObjectType(tuple(sorted((t.Field(f.name, from_spark(f.dataType), f.nullable) for f in dt.fields), key=lambda f: f.name)))
    return t.ANY


def profile(df: DataFrame, most: int = 20) -> DataFrame:
    """``path, n_null, low, high, members``: what the values of each column are, in one pass.

    Bounds of numbers, and up to ``most`` distinct values of strings, as text (null if there are more)."""
    counts, rows = [], []
    for i, f in enumerate(df.schema.fields):
        kind, c = columns.kind_of(f.dataType), F.col(f.name)
        number = kind in ("int", "float")
        sample = F.collect_set(c) if kind == "string" else F.lit(None).cast("array<string>")
        few = F.approx_count_distinct(c) if kind == "string" else F.lit(0)
        counts += [F.count_if(c.isNull()).alias(f"n{i}"), F.min(c if number else F.lit(None)).cast("string").alias(f"l{i}"), F.max(c if number else F.lit(None)).cast("string").alias(f"h{i}"), few.alias(f"d{i}")]
        rows.append((i, f.name, kind, sample))
    first = df.agg(*counts).first()
    small = [F.sort_array(sample).alias(f"s{i}") for i, _, kind, sample in rows if kind == "string" and first[f"d{i}"] <= 2 * most]
    sets = df.agg(*small).first().asDict() if small else {}
    members = lambda i: sets.get(f"s{i}") if sets.get(f"s{i}") and len(sets[f"s{i}"]) <= most else None
    out = [(name, first[f"n{i}"], first[f"l{i}"], first[f"h{i}"], members(i)) for i, name, _, _ in rows]
    return df.sparkSession.createDataFrame(out, "path string, n_null long, low string, high string, members array<string>")


def infer(df: DataFrame, most: int = 20) -> t.ObjectType:
    """The schema of a table's rows: kinds, bounds of numbers, enums of strings with few values,
    optional where there are nulls."""
    fields = []
    types = {f.name: f.dataType for f in df.schema.fields}
    for r in profile(df, most).collect():
        kind = from_spark(types[r.path])
        if r.members and kind == t.STRING:
            kind = t.refined(kind, t.Constraint(enum=frozenset(t.Lit("string", v) for v in r.members)))
        elif kind in (t.INT, t.FLOAT) and r.low is not None and r.high != "NaN":
            of = int if kind == t.INT else float
            kind = t.refined(kind, t.Constraint(t.Bounds(of(r.low), of(r.high))))
        fields.append(t.Field(r.path, kind, r.n_null > 0))
    return t.ObjectType(tuple(sorted(fields, key=lambda f: f.name)))


def infer_json(values: DataFrame, column: str) -> t.Type:
    """The schema of a VARIANT column: what ``schema_of_variant_agg`` finds, as a type, with null
    where values are null.

    That description drops the nulls of a field that has other values, so a second pass looks for
    nulls at each path of objects; elements of lists may always be null.  Every value belongs to the
    result, but for floats that are infinite and integers beyond 64 bits."""
    dt = described(values.agg(F.schema_of_variant_agg(F.col(column)).alias("s")).first().s)
    paths = list(_paths(dt, F.col(column)))
    nulls = values.agg(*(F.max(sure(F.is_variant_null(v))).alias(f"n{i}") for i, (_, v) in enumerate(paths))).first()
    if isinstance(dt, T.NullType) and not nulls.n0:
        return t.NEVER
    return _with_nulls(dt, (), {path for (path, _), has in zip(paths, nulls) if has})


def described(text: str) -> T.DataType:
    """Spark's description of a VARIANT as a Spark type; quoted keys are left as they are."""
    return T.DataType.fromDDL(re.sub(r"`(?:[^`]|``)*`|OBJECT<", lambda m: m[0] if m[0][0] == "`" else "STRUCT<", text))


def _paths(dt: T.DataType, v: Column, path: tuple = ()):
    yield path, v
    if isinstance(dt, T.StructType):
        held = F.try_variant_get(v, "$", "map<string,variant>")
        for f in dt.fields:
            yield from _paths(f.dataType, F.element_at(held, f.name), (*path, f.name))


def _with_nulls(dt: T.DataType, path: tuple | None, nulls: set) -> t.Type:
    """``path`` is None within lists, where all may be null."""
    if isinstance(dt, T.StructType):
        fields = [t.Field(f.name, _with_nulls(f.dataType, None if path is None else (*path, f.name), nulls), True) for f in dt.fields]
        kind = t.ObjectType(tuple(sorted(fields, key=lambda f: f.name)))
    elif isinstance(dt, T.ArrayType):
        kind = t.ListType(_with_nulls(dt.elementType, None, nulls))
    else:
        kind = from_spark(dt)
    return t.sum_of([kind, t.NULL]) if path is None or path in nulls else kind
