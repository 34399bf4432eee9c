"""Validation of streams: the same conditions, without state or watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame

from formwork.operators.validation import free_name, validate


def validated(stream: DataFrame, schema, name: str = "valid", closed: bool = True) -> DataFrame:
    """A stream with a boolean column: whether the row belongs to the object schema."""
    return validate(stream, schema, name, closed)


def quarantine(stream: DataFrame, schema, good_path: str, bad_path: str, checkpoint: str, closed: bool = True, **trigger):
    """Start a query that appends each micro-batch's rows to one of two Parquet folders, by batch
    number, so that a repeated batch replaces its own files."""

    def put(batch: DataFrame, number: int) -> None:
        mark = free_name("valid", batch.columns)
        held = validate(batch, schema, mark, closed).persist()
        try:
            for wanted, path in ((True, good_path), (False, bad_path)):
                held.filter(held[mark] == wanted).drop(mark).write.mode("overwrite").parquet(f"{path}/batch={number}")
        finally:
            held.unpersist()

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
