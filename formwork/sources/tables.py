"""Tables that keep their schema: as properties in the catalogue, checked on every append."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from formwork.operators.validation import split
from formwork.schema import order
from formwork.schema import types as t
from formwork.schema.compile import compile_schema
from formwork.schema.syntax import SchemaError

_KEY, _PIECE = "formwork.schema", 3000  # metastores bound the length of one property


class BreakingChange(SchemaError):
    """A write whose schema the table's doesn't allow."""


def keep_schema(spark: SparkSession, table: str, schema, names: dict | None = None) -> None:
    """Set the table's schema, as text in its properties."""
    text = str(compile_schema(schema, names))
    pieces = [text[i : i + _PIECE] for i in range(0, len(text), _PIECE)]
    quote = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    held = {f"{_KEY}.{i}": p for i, p in enumerate(pieces)} | {f"{_KEY}.pieces": str(len(pieces))}
    spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ({', '.join(f'{quote(k)} = {quote(v)}' for k, v in held.items())})")


def kept_schema(spark: SparkSession, table: str) -> t.Type | None:
    """The schema that the table keeps; None if it keeps none."""
    held = {r.key: r.value for r in spark.sql(f"SHOW TBLPROPERTIES {table}").collect()}
    n = int(held.get(f"{_KEY}.pieces", 0))
    return compile_schema("".join(held[f"{_KEY}.{i}"] for i in range(n))) if n else None


def create(df: DataFrame, table: str, schema, closed: bool = True) -> DataFrame:
    """Make a table of the rows that belong to the schema, which it keeps; returns the rows that don't."""
    good, bad = split(df, schema, closed)
    good.write.saveAsTable(table)
    keep_schema(df.sparkSession, table, schema)
    return bad


def append(df: DataFrame, table: str, schema=None, evolve: bool = False, closed: bool = True) -> DataFrame:
    """Append the rows that belong to ``schema`` (without it, to the table's); returns the rows that don't.

    What the schema is to the table's (``compare``) decides: equal and narrowing writes are taken; a widening
    one only with ``evolve``, which makes it the table's schema and adds its new columns; a breaking one is refused, before anything is written."""
    spark = df.sparkSession
    old = kept_schema(spark, table)
    if old is None:
        raise SchemaError(f"{table} keeps no schema")
    new = old if schema is None else compile_schema(schema)
    change = order.compare(old, new)
    if change == "breaking" or (change == "widening" and not evolve):
        raise BreakingChange(f"{change} change of {table}: {new} is not within {old}")
    good, bad = split(df, new, closed)
    have = spark.table(table).columns
    if change == "widening":
        added = [f for f in good.schema.fields if f.name not in have]
        if added:
            spark.sql(f"ALTER TABLE {table} ADD COLUMNS ({', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in added)})")
        keep_schema(spark, table, new)
    good.unionByName(spark.table(table).limit(0), allowMissingColumns=True).select(spark.table(table).columns).write.mode("append").saveAsTable(table)
    return bad
