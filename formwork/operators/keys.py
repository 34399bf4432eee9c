"""Keys and references between tables, as schemas declare them: ``pk``, ``unique`` and
``ref="table.column"`` on the fields of an object schema."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formwork.schema.syntax import Attr, Flag, Lit, ObjectNode, SchemaError, SchemaNode, parse


@dataclass(frozen=True)
class Keys:
    """primary: the fields that together are the primary key; unique: fields whose values don't
    repeat; references: field to (table, column)."""

    primary: tuple[str, ...] = ()
    unique: tuple[str, ...] = ()
    references: dict[str, tuple[str, str]] = field(default_factory=dict)


def keys_of(schema) -> Keys:
    """The keys that an object schema (text or node) declares."""
    node = parse(schema) if isinstance(schema, str) else schema
    while isinstance(node, SchemaNode):
        node = node.type
    if not isinstance(node, ObjectNode):
        raise SchemaError("keys are declared on the fields of an object")
    primary, unique, references = [], [], {}
    for name, value in node.fields:
        for c in value.clauses if isinstance(value, SchemaNode) else ():
            if not isinstance(c, (Flag, Attr)) or c.name not in ("pk", "unique", "ref"):
                continue
            said = c.value if isinstance(c, Attr) else Lit("bool", True)
            if c.name == "ref":
                to = said.value.split(".") if isinstance(said, Lit) and said.kind == "string" else []
                if len(to) != 2 or not all(to):
                    raise SchemaError(f'{name}: ref is "table.column"')
                references[name] = (to[0], to[1])
            elif not isinstance(said, Lit) or said.kind != "bool":
                raise SchemaError(f"{name}: {c.name} is true or false")
            elif said.value:
                (primary if c.name == "pk" else unique).append(name)
    return Keys(tuple(primary), tuple(unique), references)


def repeated(df: DataFrame, key: tuple[str, ...], nulls: bool) -> DataFrame:
    """``key`` and ``n``: values of a key that occur more than once; with ``nulls`` (a primary key) also each
    that has a null part, else keys with nulls don't count.

    Equal keys are counted in each task first, so that a key of many rows sends one row a task."""
    null = reduce(or_, (F.col(c).isNull() for c in key))
    rows = df.select(*key) if nulls else df.select(*key).filter(~null)
    return rows.groupBy(*key).agg(F.count("*").alias("n")).filter((F.col("n") > 1) | null if nulls else F.col("n") > 1)


def orphans(df: DataFrame, columns: tuple[str, ...], parent: DataFrame, parent_columns: tuple[str, ...]) -> DataFrame:
    """``columns`` and ``n``: references to keys that ``parent`` doesn't have, and how many rows have
    them.  A reference with a null part refers to nothing and passes.

    Equal references are counted before the join, which so has one row for each and no hot key; which side
    is broadcast is left to Spark, which checks sizes."""
    there = reduce(and_, (F.col(c).isNotNull() for c in columns))
    refs = df.select(*columns).filter(there).groupBy(*columns).agg(F.count("*").alias("n"))
    held = parent.select(*(F.col(p).alias(f"_to_{i}") for i, p in enumerate(parent_columns)))
    return refs.join(held, reduce(and_, (F.col(c) == F.col(f"_to_{i}") for i, c in enumerate(columns))), "left_anti")


def key_violations(tables: dict[str, DataFrame], schemas: dict) -> DataFrame:
    """``of`` (table), ``rule`` (``pk``, ``unique`` or ``ref``), ``fields``, ``key`` (its value as JSON) and ``n`` (rows
    that have it): all violations of the keys that the schemas of some tables declare."""
    found: list[DataFrame] = []

    def add(of: str, rule: str, fields: tuple[str, ...], rows: DataFrame) -> None:
        key = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
        found.append(rows.select(F.lit(of).alias("of"), F.lit(rule).alias("rule"), F.lit(",".join(fields)).alias("fields"), key.alias("key"), "n"))

    for of, schema in schemas.items():
        keys = keys_of(schema)
        if keys.primary:
            add(of, "pk", keys.primary, repeated(tables[of], keys.primary, True))
        for name in keys.unique:
            add(of, "unique", (name,), repeated(tables[of], (name,), False))
        for name, (to, column) in keys.references.items():
            if to not in tables:
                raise SchemaError(f"{of}.{name} refers to {to!r}, which isn't given")
            add(of, "ref", (name,), orphans(tables[of], (name,), tables[to], (column,)))
    if not found:
        raise SchemaError("no schema declares a key")
    return reduce(DataFrame.unionByName, found)
