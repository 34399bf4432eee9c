"""What several operators share: written stages, batches of texts, hashes over byte arrays."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formwork.sources import shared_dir, table  # noqa: F401

#: Java pattern of a word: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Java pattern of what separates words.
SPACE = r"[\x20\x09-\x0D]+"


_made: list[list[DataFrame]] = []


def written(df: DataFrame) -> DataFrame:
    """``df``, written as a table in the shared folder and read again: a cut in the lineage that
    outlives executors."""
    path = f"{shared_dir(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    if _made:
        _made[-1].append(found)
    return found


def dropped(df: DataFrame) -> None:
    """Delete the table that ``written`` made; only once all that was read from it is written, too.

    Spark deletes shuffle files once the driver has collected the plans that made them, so this asks
    for a collection: what led to the table goes with it."""
    spark = df.sparkSession
    for f in df.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f).getParent()
        if folder.getName().startswith("stage-"):
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    spark._jvm.System.gc()


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes tables ``written`` inside: ``kept(table)`` all but this one, which thus must not read
    from the others any more, and leaving the block those written since."""
    made: list[DataFrame] = []
    _made.append(made)

    def kept(table: DataFrame) -> DataFrame:
        for other in made:
            if other is not table:
                dropped(other)
        made[:] = [table]
        return table

    try:
        yield kept
    finally:
        _made.remove(made)


def beside(rows: DataFrame, small: DataFrame, *on: str, how: str = "inner", most: int = 50_000, most_bytes: int = 16 << 20) -> DataFrame:
    """``rows`` joined with ``small`` on columns ``on`` (nulls are equal).

    ``small`` is broadcast only if it is counted to have up to ``most`` rows and ``most_bytes`` of
    text; else both sides are shuffled, and adaptive execution splits hot keys."""
    texts = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in small.schema if f.dataType.typeName() == "string"]
    n, held = small.agg(F.count("*"), F.sum(sum(texts, F.lit(0)))).first()
    right = small.withColumnsRenamed({c: f"_of_{c}" for c in on})
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in on))
    right = F.broadcast(right) if n <= most and (held or 0) <= most_bytes else right.hint("merge")
    return rows.join(right, same, how).drop(*(f"_of_{c}" for c in on))


#: Names of the columns that tell rows apart (``row_keys``).
KEYS = ["key_a", "key_b"]


def row_keys(id_column: str, text_column: str) -> tuple[Column, Column]:
    """Two 64-bit hashes of a row's id, whether it has one, and text: rows that share an id, or
    have none, stay apart by 128 bits; equal rows are equal."""
    given, text = F.col(id_column).cast("string"), F.coalesce(F.col(text_column), F.lit(""))
    return F.xxhash64(text, given, given.isNull()).alias("key_a"), F.xxhash64(F.lit("b"), given.isNull(), given, text).alias("key_b")


def keyed(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, key_a, key_b, text``: a null text is empty, ids keep their type."""
    return docs.select(F.col(id_column).alias("doc_id"), *row_keys(id_column, text_column), F.coalesce(F.col(text_column), F.lit("")).alias("text"))


def type_of(df: DataFrame, column: str) -> str:
    """A column's type as a schema string has it."""
    return df.schema[column].dataType.simpleString()


# --------------------------------------------------------------------------- arrays in tasks

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[int, np.ndarray] = {}

#: True at the six ASCII white space bytes.
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0..n modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        size = max(1 << 16, 1 << (n + 1).bit_length())
        have = np.full(size, np.uint64(base), np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 1 << 23:
            _powers[base] = have
    return have


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * _GOLD
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Rolling:
    """Hashes of any slices of one byte array; equal slices have equal hashes."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * _power(_BASE, len(data))[: len(data)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        back = _power(_INVERSE, len(self.sums))
        return mixed((self.sums[ends] - self.sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours; ``len(x) - width + 1`` values."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return x if have == width else np.minimum(x[: len(x) - (width - have)], x[width - have :])


class Texts:
    """Some whole texts as one byte array, each followed by a line feed, with their words."""

    def __init__(self, texts: list[bytes]):
        self.n = len(texts)
        raw = b"\n".join(texts) + b"\n"
        self.data = np.frombuffer(raw, np.uint8)
        lengths = np.fromiter(map(len, texts), np.int64, self.n)
        self.begins = np.zeros(self.n, np.int64)
        np.cumsum(lengths[:-1] + 1, out=self.begins[1:])
        self.lengths = lengths

    def words(self) -> None:
        """Find ``starts`` and ``ends`` of all words, and ``first`` (n + 1): where each text's begin."""
        blank = BLANK[self.data]
        edge = np.flatnonzero(np.diff(blank, prepend=True, append=True))
        self.blank, self.starts, self.ends = blank, edge[0::2], edge[1::2]
        self.first = np.append(np.searchsorted(self.starts, self.begins), len(self.starts))

    def spaced(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        """All words joined by one space, with each word's start and end there."""
        keep = ~self.blank
        keep[self.ends] = True
        flat = self.data[keep]
        lengths = self.ends - self.starts
        ends = np.cumsum(lengths + 1) - 1
        flat[ends] = 32
        return flat.tobytes(), ends - lengths, ends


def text_chunks(batches, budget: int = 2 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of Arrow batches whose texts (column ``text``) have about ``budget`` bytes, and the
    texts as UTF-8.  A text is never divided."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index("text")).cast(pa.binary()).to_pylist()
        at, held = 0, 0
        for i, t in enumerate(texts):
            if held and held + len(t) > budget:
                yield batch.slice(at, i - at), texts[at:i]
                at, held = i, 0
            held += len(t) + 1
        if at < len(texts):
            yield batch.slice(at), texts[at:]


def arrow_column(batch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


#: Cells of a frequency sketch at its smallest.
CELLS = 1 << 16
