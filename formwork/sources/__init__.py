"""Reading JSON for validation, and writing what passes and what doesn't."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formwork.operators.validation import split
from formwork.operators.variant import parsed
from formwork.schema.compile import compile_schema


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Only a local session (tests) without such a setting gets a folder of its own."""
    named = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """``text`` and ``value`` (VARIANT; null where it isn't one JSON value) for each line of a text file or folder."""
    return spark.read.text(path).select(F.col("value").alias("text"), parsed(F.col("value")).alias("value"))


def quarantine(df: DataFrame, schema, good_path: str, bad_path: str, closed: bool = True) -> None:
    """Write conforming rows to one Parquet folder and the others to another."""
    good, bad = split(df, schema, closed)
    good.write.parquet(good_path)
    bad.write.parquet(bad_path)


def with_schema_metadata(df: DataFrame, schema) -> DataFrame:
    """``df`` with each field's type as text in its column's metadata, key ``schema``."""
    kind = compile_schema(schema)
    for f in kind.fields:
        if f.name in df.columns:
            df = df.withMetadata(f.name, df.schema[f.name].metadata | {"schema": str(f.type), "optional": f.optional})
    return df
