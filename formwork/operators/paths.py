"""Where inside a value a schema is violated: a walk over structs, arrays, maps and VARIANT that is
directed by the schema and carries the path.

A problem has the ``path`` of the value (``items[1].q``), the ``place`` that such paths share
(``items[].q``), and what is wrong: ``missing``, ``unknown`` (a field that the schema doesn't know),
``kind`` (of another kind) or ``value`` (of the kind, but outside its constraint).
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formwork.operators import columns, variant
from formwork.operators.expressions import constraint, sure
from formwork.operators.validation import free_name, row_condition
from formwork.schema import types as t
from formwork.schema.compile import compile_schema
from formwork.schema.syntax import SchemaError

_PROBLEMS = "array<struct<path:string,place:string,problem:string>>"


@dataclass(frozen=True)
class At:
    """A path as a column, and its place."""

    path: Column
    place: Column

    def field(self, name: str, root: bool = False) -> At:
        step = name if root and _plain(name) else f".{name}" if _plain(name) else f"[{json.dumps(name, ensure_ascii=False)}]"
        return At(F.concat(self.path, F.lit(step)), F.concat(self.place, F.lit(step)))

    def key(self, name: Column) -> At:
        """A field whose name is known only from the value."""
        quoted = F.concat(F.lit('["'), F.regexp_replace(name, r'(["\\])', r"\\$1"), F.lit('"]'))
        step = F.when(name.rlike("^[A-Za-z_][A-Za-z0-9_]*$"), F.concat(F.when(self.path == "", "").otherwise("."), name)).otherwise(quoted)
        return At(F.concat(self.path, step), F.concat(self.place, step))

    def element(self, i: Column) -> At:
        return At(F.concat(self.path, F.lit("["), i.cast("string"), F.lit("]")), F.concat(self.place, F.lit("[]")))

    def problem(self, wrong: Column, what: Column | str) -> Column:
        one = F.struct(self.path.alias("path"), self.place.alias("place"), (what if isinstance(what, Column) else F.lit(what)).alias("problem"))
        return F.when(sure(wrong), F.array(one)).otherwise(_none())


def _plain(name: str) -> bool:
    return re.fullmatch("[A-Za-z_][A-Za-z0-9_]*", name) is not None


def _none() -> Column:
    return F.array().cast(_PROBLEMS)


def _all(*found: Column) -> Column:
    return F.concat(*found) if found else _none()


# ------------------------------------------------------------------------ kinds of values


class _Typed:
    """A value in a typed column."""

    def __init__(self, c: Column, dt: T.DataType):
        self.c, self.dt = c, dt

    def fits(self, k: t.Type) -> Column:
        return sure(columns.field(k, False, self.c, self.dt))

    def null(self) -> Column:
        return self.c.isNull()

    def absent(self) -> Column:
        return self.c.isNull()

    def length(self) -> Column | None:
        return columns.length_of(self.c, self.dt)

    def each(self, walk) -> Column | None:
        """The problems of all elements, each by ``walk(element, place)``; None if it's no list."""
        if not isinstance(self.dt, T.ArrayType):
            return None
        return F.flatten(F.transform(self.c, lambda e, i: walk(_Typed(e, self.dt.elementType), i)))

    def item(self, i: int) -> _Typed:
        if isinstance(self.dt, T.StructType):
            return _Typed(self.c.getField(self.dt.fields[i].name), self.dt.fields[i].dataType)
        return _Typed(F.get(self.c, F.lit(i)), self.dt.elementType)

    def items(self) -> Column | None:
        """How many elements it has, as a tuple."""
        return F.lit(len(self.dt.fields)) if isinstance(self.dt, T.StructType) else F.size(self.c) if isinstance(self.dt, T.ArrayType) else None

    def object(self) -> Column | None:
        """Whether it is an object; None if it can't be one."""
        return self.c.isNotNull() if isinstance(self.dt, (T.StructType, T.MapType)) else None

    def field(self, name: str):
        """The field's value (None: there is none), and whether it is there."""
        if isinstance(self.dt, T.StructType):
            dt = {f.name: f.dataType for f in self.dt.fields}.get(name)
            inner = None if dt is None else _typed(self.c.getField(name), dt)
            return inner, F.lit(False) if inner is None else ~inner.absent()
        return _typed(F.element_at(self.c, name), self.dt.valueType), F.map_contains_key(self.c, name)

    def unknown(self, known: list[str], at: At) -> Column:
        if isinstance(self.dt, T.StructType):
            return _all(*(at.field(f.name).problem(F.lit(True), "unknown") for f in self.dt.fields if f.name not in known))
        keys = F.array_except(F.map_keys(self.c), F.array(*map(F.lit, known)).cast("array<string>"))
        return F.flatten(F.transform(keys, lambda k: at.key(k).problem(F.lit(True), "unknown")))


class _Json(_Typed):
    """A value in a VARIANT column."""

    def __init__(self, v: Column):
        super().__init__(v, T.VariantType())

    def fits(self, k: t.Type) -> Column:
        return sure(variant.predicate(k, self.c))

    def null(self) -> Column:
        return sure(F.is_variant_null(self.c))

    def _list(self) -> Column:
        return F.try_variant_get(self.c, "$", "array<variant>")

    def _map(self) -> Column:
        return F.try_variant_get(self.c, "$", "map<string,variant>")

    def length(self) -> Column | None:
        return F.coalesce(F.size(self._list()), F.size(self._map()))

    def each(self, walk) -> Column | None:
        return F.when(self._list().isNull(), F.lit(None)).otherwise(F.flatten(F.transform(self._list(), lambda e, i: walk(_Json(e), i))))

    def item(self, i: int) -> _Typed:
        return _Json(F.get(self._list(), F.lit(i)))

    def items(self) -> Column | None:
        return F.size(self._list())

    def object(self) -> Column | None:
        return self._map().isNotNull()

    def field(self, name: str):
        return _Json(F.element_at(self._map(), name)), sure(F.map_contains_key(self._map(), name))

    def unknown(self, known: list[str], at: At) -> Column:
        return _Typed(self._map(), T.MapType(T.StringType(), T.VariantType())).unknown(known, at)


def _typed(c: Column, dt: T.DataType) -> _Typed:
    return _Json(c) if isinstance(dt, T.VariantType) else _Typed(c, dt)


# ------------------------------------------------------------------------------- the walk


def problems(k: t.Type, x: _Typed, at: At, root: bool = False) -> Column:
    """An array of the problems of ``x`` under the type; empty where it conforms."""
    match k:
        case t.SumType(members):
            inner = [m for m in members if m != t.NULL]
            if len(inner) == 1:  # a value or null
                return F.when(x.null(), _none()).otherwise(problems(inner[0], x, at, root))
            roots = [t.parts(m)[0] for m in members]
            loose = reduce(or_, (x.fits(r) for r in set(roots)))
            return at.problem(~x.fits(k), F.when(loose, "value").otherwise("kind"))
        case t.Refined(base, c) if isinstance(base, (t.ListType, t.TupleType, t.ObjectType)):
            inner = problems(base, x, at, root)
            length = x.length()
            own = at.problem(~sure(constraint(c, x.c, length)), "value") if length is not None else _none()
            return F.when(F.size(inner) > 0, inner).otherwise(own)
        case t.Refined(base, _):
            return at.problem(~x.fits(k), F.when(x.fits(base), "value").otherwise("kind"))
        case t.Literal(v) if v.kind != "null":
            return at.problem(~x.fits(k), F.when(x.fits(t.Basic(v.kind)), "value").otherwise("kind"))
        case t.ListType(item):
            found = x.each(lambda e, i: problems(item, e, at.element(i)))
            return at.problem(F.lit(True), "kind") if found is None else F.coalesce(found, at.problem(F.lit(True), "kind"))
        case t.TupleType(items):
            n = x.items()
            if n is None or (isinstance(x.dt, T.StructType) and len(x.dt.fields) != len(items)):
                return at.problem(F.lit(True), "kind")
            found = _all(*(problems(one, x.item(i), at.element(F.lit(i))) for i, one in enumerate(items)))
            return F.when(sure(n == len(items)) & ~x.absent(), found).otherwise(at.problem(F.lit(True), F.when(n.isNull() | x.absent(), "kind").otherwise("value")))
        case t.ObjectType(fields):
            there = x.object()
            if there is None:
                return at.problem(F.lit(True), "kind")
            found = [_of_field(f, x, at.field(f.name, root)) for f in fields]
            return F.when(there, _all(*found, x.unknown([f.name for f in fields], at))).otherwise(at.problem(F.lit(True), "kind"))
    return at.problem(~x.fits(k), "kind")


def _of_field(f: t.Field, x: _Typed, at: At) -> Column:
    inner, there = x.field(f.name)
    missing = _none() if f.optional else at.problem(F.lit(True), "missing")
    if inner is None:
        return missing
    if isinstance(x.dt, T.StructType) and columns.accepts_null(f.type):
        missing = _none()  # SQL's NULL is null or absent
    return F.when(there, problems(f.type, inner, at)).otherwise(missing)


def _row_problems(df: DataFrame, kind: t.Type, closed: bool) -> Column:
    if not isinstance(kind, t.ObjectType):
        raise SchemaError("rows need an object schema")
    types = {f.name: f.dataType for f in df.schema.fields}
    at, found = At(F.lit(""), F.lit("")), []
    for f in kind.fields:
        here = at.field(f.name, True)
        if f.name not in types:
            found += [] if f.optional else [here.problem(F.lit(True), "missing")]
            continue
        x = _typed(F.col(f"`{f.name.replace('`', '``')}`"), types[f.name])
        missing = _none() if f.optional or (columns.accepts_null(f.type) and not isinstance(x, _Json)) else here.problem(F.lit(True), "missing")
        found.append(F.when(x.absent(), missing).otherwise(problems(f.type, x, here)))
    known = {f.name for f in kind.fields}
    found += [at.field(name, True).problem(F.lit(True), "unknown") for name in types if closed and name not in known]
    return _all(*found)


def nested_violations(df: DataFrame, schema, keys: list[str], closed: bool = True, names: dict | None = None) -> DataFrame:
    """``keys``, ``path``, ``place`` and ``problem``: a row for each innermost value that violates
    the object schema, in nested columns of any kind.

    Rows that conform are filtered by the plain condition first and aren't walked.  A container of
    wrong length is named itself, if its elements conform.  Of a sum of several kinds the value itself is named.
    ``closed`` as in ``validate``; key columns aren't part of the schema unless it names them."""
    kind = compile_schema(schema, names)
    known = {f.name for f in kind.fields} if isinstance(kind, t.ObjectType) else set()
    rows = df.drop(*(k for k in keys if k not in known)) if closed else df
    found = free_name("found", df.columns)
    bad = df.filter(~sure(row_condition(rows, kind, closed))).select(*keys, F.explode(_row_problems(rows, kind, closed)).alias(found))
    return bad.select(*keys, f"{found}.path", f"{found}.place", f"{found}.problem")


def value_violations(df: DataFrame, column: str, schema, keys: list[str], names: dict | None = None) -> DataFrame:
    """``nested_violations`` of the values of one column, typed or VARIANT, under any schema; paths
    begin at the value, whose own path is empty.  SQL's NULL is ``missing``, unless the column is typed and the schema accepts null."""
    kind, x = compile_schema(schema, names), _typed(F.col(column), df.schema[column].dataType)
    at = At(F.lit(""), F.lit(""))
    missing = _none() if not isinstance(x, _Json) and columns.accepts_null(kind) else at.problem(F.lit(True), "missing")
    found = free_name("found", df.columns)
    bad = df.filter(~x.fits(kind)).select(*keys, F.explode(F.when(x.absent(), missing).otherwise(problems(kind, x, at, True))).alias(found))
    return bad.select(*keys, f"{found}.path", f"{found}.place", f"{found}.problem")


def by_place(found: DataFrame, by: list[str] | None = None) -> DataFrame:
    """How often each problem occurs at each place, ``n``; ``by``: in each group of key columns."""
    return found.groupBy(*(by or []), "place", "problem").agg(F.count("*").alias("n"))


def samples(found: DataFrame, k: int, by: list[str] | None = None) -> DataFrame:
    """Up to ``k`` violations of each place and problem (and group ``by``): those of least keys, in
    order of the columns; rerunning gives the same.

    A ranking with a limit: each task keeps its own least ``k`` of a place before the shuffle, so
    that a place that is violated everywhere sends ``k`` rows a task and no table is sorted."""
    group = [*(by or []), "place", "problem"]
    order = [c for c in found.columns if c not in group]
    rank = free_name("rank", found.columns)
    ranked = found.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.filter(F.col(rank) <= k).drop(rank)
