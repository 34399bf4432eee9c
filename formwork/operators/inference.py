"""Schemas of what is there, by group: a lattice of observations that can be kept and merged.

Each value says something at each of its paths: its kind, a number's or a length's bounds, a
string itself.  A state has one row for each group, path and kind, made by aggregates that combine
before the shuffle; states of parts of a table merge to the state of the whole, in any order.  A
state is assembled to the least type above all values, as far as bounds, enums and lengths tell.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formwork.operators import columns
from formwork.operators.expressions import sure
from formwork.operators.validation import described
from formwork.schema import types as t
from formwork.schema.syntax import Lit

_SEEN = "struct<path:array<string>,kind:string,i:bigint,f:double,l:int,s:string>"
_BOUNDS = ("i", "f", "l")


def _seen(path: Column, kind: str | Column, i=None, f=None, length=None, s=None) -> Column:
    """One observation.  What isn't given is null."""
    values = [(i, "bigint"), (f, "double"), (length, "int"), (s, "string")]
    return F.struct(path, F.lit(kind) if isinstance(kind, str) else kind, *((F.lit(None) if v is None else v).cast(k) for v, k in values)).cast(_SEEN)


def _step(path: Column, name: str | Column) -> Column:
    """A field's path; the steps of fields begin with a dot, and ``[]`` is that of elements."""
    return F.concat(path, F.array(F.lit(f".{name}") if isinstance(name, str) else F.concat(F.lit("."), name)))


def _element(path: Column) -> Column:
    return F.concat(path, F.array(F.lit("[]")))


def _typed(x: Column, dt: T.DataType, path: Column) -> Column:
    """The observations that a value of a typed column makes."""
    kind = columns.kind_of(dt)
    none = F.array(_seen(path, "null"))
    if isinstance(dt, T.VariantType):
        return F.array(_seen(path, F.when(x.isNull() | sure(F.is_variant_null(x)), "null").otherwise("other")))
    if isinstance(dt, T.StructType):
        inner = [F.when(x.getField(f.name).isNotNull(), _typed(x.getField(f.name), f.dataType, _step(path, f.name))).otherwise(F.array().cast(f"array<{_SEEN}>")) for f in dt.fields]
        found = F.concat(F.array(_seen(path, "object")), *inner)
    elif isinstance(dt, T.ArrayType):
        found = F.concat(F.array(_seen(path, "list", length=F.size(x))), F.flatten(F.transform(x, lambda e: _typed(e, dt.elementType, _element(path)))))
    elif isinstance(dt, T.MapType) and isinstance(dt.keyType, T.StringType):
        found = F.concat(F.array(_seen(path, "object")), F.flatten(F.transform(F.map_entries(x), lambda e: _typed(e["value"], dt.valueType, _step(path, e["key"])))))
    elif kind == "float":
        value = x.cast("double")
        found = F.array(_seen(path, F.when(F.isnan(value) | (F.abs(value) == float("inf")), "other").otherwise(kind), f=value))
    elif kind in ("bool", "int", "string"):
        found = F.array(_seen(path, kind, i=x if kind == "int" else None, length=F.char_length(x) if kind == "string" else None, s=x if kind == "string" else None))
    else:
        found = F.array(_seen(path, "other"))
    return F.when(x.isNull(), none).otherwise(found)


def _json(v: Column, dt: T.DataType, path: Column) -> Column:
    """The observations that a VARIANT makes; ``dt``: what containers hold in all rows together."""
    kind, get = F.schema_of_variant(v), lambda k: F.try_variant_get(v, "$", k)
    real = kind.isin("DOUBLE", "FLOAT") | (kind.startswith("DECIMAL") & ~(kind.endswith(",0)") & (F.abs(get("double")) >= float(1 << 63))))
    found = F.when(sure(F.is_variant_null(v)), F.array(_seen(path, "null")))
    found = found.when(kind == "BOOLEAN", F.array(_seen(path, "bool"))).when(kind == "BIGINT", F.array(_seen(path, "int", i=get("bigint"))))
    found = found.when(kind == "STRING", F.array(_seen(path, "string", length=F.char_length(get("string")), s=get("string"))))
    found = found.when(real & (F.abs(get("double")) != float("inf")), F.array(_seen(path, "float", f=get("double"))))
    if isinstance(dt, T.StructType):
        held = get("map<string,variant>")
        inner = [F.when(sure(F.map_contains_key(held, f.name)), _json(F.element_at(held, f.name), f.dataType, _step(path, f.name))).otherwise(F.array().cast(f"array<{_SEEN}>")) for f in dt.fields]
        found = found.when(held.isNotNull(), F.concat(F.array(_seen(path, "object")), *inner))
    if isinstance(dt, T.ArrayType):
        held = get("array<variant>")
        found = found.when(held.isNotNull(), F.concat(F.array(_seen(path, "list", length=F.size(held))), F.flatten(F.transform(held, lambda e: _json(e, dt.elementType, _element(path))))))
    return F.when(v.isNull(), F.array().cast(f"array<{_SEEN}>")).otherwise(found.otherwise(F.array(_seen(path, "other"))))


def _observations(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    x, dt, root = F.col(column), df.schema[column].dataType, F.array().cast("array<string>")
    if isinstance(dt, T.VariantType):
        seen = _json(x, described(df.agg(F.schema_of_variant_agg(x).alias("s")).first().s), root)
    else:
        seen = _typed(x, dt, root)
    return df.select(*by, F.explode(seen).alias("_seen")).select(*by, "_seen.*")


def _same(a: DataFrame, b: DataFrame, names: list[str], how: str) -> DataFrame:
    right = b.withColumnsRenamed({c: f"_of_{c}" for c in names})
    on = reduce(lambda x, y: x & y, (a[c].eqNullSafe(right[f"_of_{c}"]) for c in names))
    return a.join(right, on, how).drop(*(f"_of_{c}" for c in names))


def observed(df: DataFrame, column: str, by: list[str] | None = None, most: int = 20) -> DataFrame:
    """The state of a column (typed or VARIANT) in each group: ``by``, ``path``, ``kind``, ``n``, lowest
    and highest ints, floats and lengths, and ``members``: all values of strings of up to ``most`` distinct ones, else null.

    Strings are counted by a sketch first, and collected only where it finds few, so that no task
    holds more than a bounded set for a group and path.  SQL's NULL in a VARIANT column says nothing; in typed columns it is null, and an absent field in structs.
    """
    by = by or []
    rows, names = _observations(df, column, by), [*by, "path", "kind"]
    bounds = [g(c).alias(f"{side}_{c}") for c in _BOUNDS for g, side in ((F.min, "low"), (F.max, "high"))]
    counts = rows.groupBy(*names).agg(F.count("*").alias("n"), *bounds, F.approx_count_distinct("s").alias("_few"))
    few = counts.filter((F.col("kind") == "string") & (F.col("_few") <= 2 * most)).select(*names)
    sets = _same(rows.filter(F.col("kind") == "string").select(*names, "s"), few, names, "left_semi").groupBy(*names).agg(F.collect_set("s").alias("members"))
    out = _same(counts.drop("_few"), sets, names, "left")
    return out.withColumn("members", F.when(F.size("members") <= most, F.sort_array("members")))


def merged(states: DataFrame, by: list[str] | None = None, most: int = 20) -> DataFrame:
    """The state of all that the given rows of states are of; enums of more than ``most`` are given up."""
    sides = [g(f"{side}_{c}").alias(f"{side}_{c}") for c in _BOUNDS for g, side in ((F.min, "low"), (F.max, "high"))]
    known = F.sort_array(F.array_distinct(F.flatten(F.collect_list("members"))))
    out = states.groupBy(*(by or []), "path", "kind").agg(F.sum("n").alias("n"), *sides, F.when(F.count_if(F.col("members").isNull()) == 0, known).alias("members"))
    return out.withColumn("members", F.when(F.size("members") <= most, F.col("members")))


def schemas(states: DataFrame, by: list[str]) -> DataFrame:
    """``by`` and ``schema``: the text of each group's type.  A group has a row for each path and kind."""

    def assemble(rows: pa.Table) -> pa.Table:
        return rows.select(by).slice(0, 1).append_column("schema", pa.array([str(assembled(rows.drop_columns(by).to_pylist()))]))

    kept = T.StructType([states.schema[c] for c in by] + [T.StructField("schema", T.StringType())])
    return states.groupBy(*by).applyInArrow(assemble, kept)


def schema(states: DataFrame) -> t.Type:
    """The type of a state without groups."""
    return assembled([r.asDict() for r in states.collect()])


def infer_by(df: DataFrame, column: str, by: list[str], most: int = 20) -> DataFrame:
    """``by`` and ``schema`` of the column's values in each group."""
    return schemas(observed(df, column, by, most), by)


def assembled(rows: list[dict]) -> t.Type:
    """The type of one group's state; every value that was observed belongs to it."""
    kinds: dict[tuple, dict[str, dict]] = {}
    below: dict[tuple, set[tuple]] = {}
    for r in rows:
        path = tuple(r["path"])
        kinds.setdefault(path, {})[r["kind"]] = r
        if path:
            below.setdefault(path[:-1], set()).add(path)

    def bounds(r: dict, of: str) -> t.Bounds:
        return t.Bounds(r[f"low_{of}"], r[f"high_{of}"])

    def at(path: tuple) -> t.Type:
        return t.sum_of([one(path, kind, r) for kind, r in kinds.get(path, {}).items()])

    def one(path: tuple, kind: str, r: dict) -> t.Type:
        match kind:
            case "null":
                return t.NULL
            case "bool":
                return t.BOOL
            case "int":
                return t.refined(t.INT, t.Constraint(bounds(r, "i")))
            case "float":
                return t.refined(t.FLOAT, t.Constraint(bounds(r, "f")))
            case "string":
                some = r["members"]
                return t.refined(t.STRING, t.Constraint(length=bounds(r, "l")) if some is None else t.Constraint(enum=frozenset(Lit("string", s) for s in some)))
            case "list":
                return t.refined(t.ListType(at((*path, "[]"))), t.Constraint(length=bounds(r, "l")))
            case "object":
                fields = []
                for inner in sorted(p for p in below.get(path, ()) if p[-1][0] == "."):
                    there = sum(k["n"] for k in kinds[inner].values())
                    fields.append(t.Field(inner[-1][1:], at(inner), there < r["n"]))
                return t.ObjectType(tuple(fields))
        return t.ANY

    return at(())
