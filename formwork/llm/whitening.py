"""Whitening of embeddings: an exact scatter from residues, then an eigendecomposition.

Entries become whole numbers.  Each partition multiplies its rows with themselves modulo several
primes (float matrix products, exact while sums stay below 2**53); sums of residues are put together
by Chinese remaindering to the exact scatter matrix, whatever the order and size of partitions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formwork.llm.common import type_of, written

#: Primes are below this, so that ROWS products of two residues stay below 2**53.
_TOP, _ROWS = 1 << 20, 1 << 13
#: Rows of a scatter matrix that travel together.
_BLOCK = 64


def primes(n: int) -> list[int]:
    """The ``n`` greatest primes below 2**20."""
    found, p = [], _TOP - 1
    small = [q for q in range(2, 1024) if all(q % r for r in range(2, int(q**0.5) + 1))]
    while len(found) < n:
        if all(p % q for q in small):
            found.append(p)
        p -= 2
    return found


def primes_for(bound: int) -> list[int]:
    """As many primes as tell whole numbers up to ``bound`` and down to its negative apart."""
    n, product = 1, primes(1)[0]
    while product <= 2 * bound:
        n += 1
        product *= primes(n)[-1]
    return primes(n)


def residue_products(x: np.ndarray, ps: list[int]) -> list[np.ndarray]:
    """``x.T @ x`` modulo each prime."""
    out = []
    for p in ps:
        total = np.zeros((x.shape[1],) * 2, np.int64)
        for i in range(0, len(x), _ROWS):
            r = np.mod(x[i : i + _ROWS], p).astype(np.float64)
            total = (total + (r.T @ r).astype(np.int64) % p) % p
        out.append(total)
    return out


def from_residues(parts: list[np.ndarray], ps: list[int]) -> np.ndarray:
    """Whole numbers (Python's) of least absolute value with the given residues, by mixed radices."""
    value, product = parts[0].astype(object), ps[0]
    for r, p in zip(parts[1:], ps[1:]):
        value = value + product * (((r.astype(object) - value) * pow(product, -1, p)) % p)
        product *= p
    return np.where(value > product // 2, value - product, value)


@dataclass(frozen=True)
class Whitening:
    """What is fitted of vectors of one length: n of them, sums by dimension, the first unit
    eigenvectors (columns) of their covariance with eigenvalues, its trace, the rank, and how far
    the whitened covariance is from the identity (None until measured, or without rank)."""

    n: int
    sums: tuple[int, ...]
    axes: np.ndarray
    values: np.ndarray
    trace: float
    rank: int
    error: float | None = None

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exactly: int64 where that has room, else Python's numbers."""
        most = int(max(x.max(initial=0), -1 - x.min(initial=0))) + 1
        small = self.n * most + max(map(abs, self.sums), default=0) < 1 << 62
        return (x if small else x.astype(object)) * self.n - np.array(self.sums, np.int64 if small else object)

    def projected(self, centred: np.ndarray) -> np.ndarray:
        """Whitened coordinates of rows of ``centred``; NaN beyond the rank."""
        z = (centred / self.n).astype(np.float64) @ self.axes
        out = np.full(z.shape, np.nan)
        out[:, : self.rank] = z[:, : self.rank] / np.sqrt(self.values[: self.rank])
        return out


def usable(vector: Column) -> Column:
    """True for vectors that aren't null and hold finite entries only."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad


def whole(vectors: pa.Array, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length that occurs: which rows have it, and floor(scale * entry) of these rows.

    What exceeds a long becomes the nearest long."""
    lengths = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    begins = np.cumsum(lengths) - lengths
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        with np.errstate(over="ignore"):
            y = np.floor(flat[begins[at][:, None] + np.arange(d)] * scale)
        inside = (y >= -(2.0**63)) & (y < 2.0**63)
        yield at, np.where(inside, np.where(inside, y, 0).astype(np.int64), np.where(y > 0, np.iinfo(np.int64).max, np.iinfo(np.int64).min))


_KINDS = (np.dtype("<i1"), np.dtype("<i2"), np.dtype("<i4"), np.dtype("<i8"))


def _packed(vectors: DataFrame, scale: int) -> DataFrame:
    """``dim, most, packed``: whole entries in the least bytes that a row needs; equal vectors are
    equal there.  ``most``: entries are from ``-1 - most`` to ``most``."""

    def pack(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x in whole(batch.column(0), scale):
                most = np.maximum(x.max(axis=1), -1 - x.min(axis=1))
                kind = np.searchsorted([np.iinfo(k).max for k in _KINDS], most)
                rows = [row.astype(_KINDS[k]).tobytes() for row, k in zip(x, kind.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), x.shape[1], np.int32)), pa.array(most), pa.array(rows, pa.binary())], ["dim", "most", "packed"])

    return vectors.mapInArrow(pack, "dim int, most long, packed binary")


def _unpacked(batches) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of ``_packed`` as matrices, up to ``_ROWS`` of one length at a time."""
    for batch in batches:
        for i in range(0, batch.num_rows, _ROWS):
            dims, packs = batch.column("dim").slice(i, _ROWS).to_numpy(), batch.column("packed").slice(i, _ROWS).to_pylist()
            widths = np.fromiter(map(len, packs), np.int64, len(packs)) // dims
            for d, w in sorted(set(zip(dims.tolist(), widths.tolist()))):
                some = np.flatnonzero((dims == d) & (widths == w)).tolist()
                yield d, np.frombuffer(b"".join(packs[j] for j in some), f"<i{w}").reshape(-1, d).astype(np.int64)


def scatter(distinct: DataFrame, ps: dict[int, list[int]], salts: int = 16) -> dict[int, np.ndarray]:
    """The exact ``[x, 1].T @ [x, 1]`` of the rows of each length, as Python's numbers.

    Each task has one matrix of residues for a length and prime; these are added by blocks of rows,
    first within salts, then all, and the driver gets one matrix for each length and prime."""

    def multiply(batches) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[np.ndarray]] = {}
        for d, x in _unpacked(batches):
            new = residue_products(np.column_stack([x, np.ones(len(x), np.int64)]), ps[d])
            sums[d] = [(s + t) % p for s, t, p in zip(sums[d], new, ps[d])] if d in sums else new
        for d, parts in sums.items():
            for p, m in zip(ps[d], parts):
                for k in range(0, d + 1, _BLOCK):
                    yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([p], pa.int32()), pa.array([k], pa.int32()), pa.array([m[k : k + _BLOCK].tobytes()], pa.binary())], ["dim", "prime", "block", "part"])

    def add(rows: pa.Table) -> pa.Table:
        p, total = rows.column("prime")[0].as_py(), 0
        for raw in rows.column("part"):
            total = (total + np.frombuffer(raw.as_buffer(), np.int64)) % p
        return rows.slice(0, 1).select(["dim", "prime", "block"]).append_column("part", pa.array([total.tobytes()], pa.binary()))

    kind = "dim int, prime int, block int, part binary"
    parts = distinct.select("dim", "packed").mapInArrow(multiply, kind).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    parts = parts.groupBy("dim", "prime", "block", "salt").applyInArrow(add, kind).groupBy("dim", "prime", "block").applyInArrow(add, kind)
    blocks: dict[tuple[int, int], list[tuple[int, bytes]]] = {}
    for r in parts.collect():
        blocks.setdefault((r.dim, r.prime), []).append((r.block, r.part))
    whole_of = lambda d, p: np.frombuffer(b"".join(x for _, x in sorted(blocks[d, p])), np.int64).reshape(d + 1, d + 1)
    return {d: from_residues([whole_of(d, p) for p in ps[d]], ps[d]) for d in ps}


def decomposed(moments: np.ndarray, components: int) -> Whitening:
    """The fit for exact moments ``[x, 1].T @ [x, 1]``.

    The covariance is the exact fraction, rounded once; each axis' largest entry is positive."""
    n, sums = int(moments[-1, -1]), moments[-1, :-1]
    cov = ((n * moments[:-1, :-1] - np.outer(sums, sums)) / (n * n)).astype(np.float64)
    values, axes = np.linalg.eigh(cov)
    values, axes = np.maximum(values[::-1][:components], 0), axes[:, ::-1][:, :components]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])
    rank = int((values > values[:1] * len(cov) * np.finfo(float).eps).sum())
    return Whitening(n, tuple(int(s) for s in sums), np.ascontiguousarray(axes), values, float(np.trace(cov)), rank)


def _measured(distinct: DataFrame, fits: dict[int, Whitening]) -> dict[int, Whitening]:
    """The fits with their ``error``: the fitted vectors are whitened, and their covariance compared
    with the identity."""

    def add(batches) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for d, x in _unpacked(batches):
            f = fits[d]
            z = np.column_stack([np.ones(len(x)), f.projected(f.centred(x))[:, : f.rank]])
            sums[d] = sums.get(d, 0) + z.T @ z
        for d, m in sums.items():
            i, j = np.indices(m.shape)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m.size, d, np.int32)), *(pa.array(x.ravel().astype(np.int32)) for x in (i, j)), pa.array(m.ravel())], ["dim", "i", "j", "s"])

    rows = distinct.select("dim", "packed").mapInArrow(add, "dim int, i int, j int, s double").groupBy("dim", "i", "j").agg(F.sum("s").alias("s")).collect()
    out = {}
    for d, f in fits.items():
        m = np.zeros((f.rank + 1,) * 2)
        for r in rows:
            if r.dim == d:
                m[r.i, r.j] = r.s
        cov = m[1:, 1:] / f.n - np.outer(m[0, 1:], m[0, 1:]) / f.n**2
        error = float(np.abs(cov - np.eye(f.rank)).max()) if f.rank else None
        out[d] = Whitening(f.n, f.sums, f.axes, f.values, f.trace, f.rank, error)
    return out


def fit(vectors: DataFrame, components: int = 4, scale: int = 256, vector_column: str = "embedding") -> dict[int, Whitening]:
    """The whitening of each vector length, fitted on all distinct vectors of whole entries.

    Equal vectors are folded in each task and then by a shuffle, in two bytes an entry for most
    embeddings.  The driver holds matrices of a length by itself only."""
    rows = vectors.select(F.col(vector_column).alias("vector")).filter(usable(F.col("vector")))
    distinct = written(_packed(rows, scale).distinct())
    ps = {}
    for r in distinct.groupBy("dim").agg(F.count("*").alias("n"), F.max("most").alias("most")).collect():
        ps[r.dim] = primes_for(r.n * (r.most + 1) ** 2)
    fits = {d: decomposed(m, components) for d, m in scatter(distinct, ps).items()}
    return _measured(distinct, fits)


def whitened(vectors: DataFrame, components: int = 4, scale: int = 256, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """A row for each usable vector and component: ``vec_id, component, n, deviation, whitened,
    explained, identity_error``.

    Entries count as x = floor(scale * entry); the fit has each distinct x once: n vectors with sums
    S.  ``deviation`` is the sum of (n * x - S)**2 over dimensions, exactly (decimal; null beyond 38
    digits).  Components are unit eigenvectors of the covariance by falling eigenvalue e, each with its largest entry
    positive; ``whitened`` is x - S / n along the component over sqrt(e), ``explained`` e over the
    trace, and ``identity_error`` how far the fitted vectors' whitened covariance is from the
    identity.

    Vectors that are null, empty or hold null or non-finite entries have no rows.  Vectors of each
    length are fitted by themselves, and have as many components as entries if those are fewer.
    Components beyond the rank (eigenvalue 0 in double precision) have null ``whitened``, and with
    rank 0 ``explained`` and ``identity_error`` are null.  Null and repeated ids are rows of their
    own; other columns are ignored; an empty table gives no rows.
    """
    fits = fit(vectors, components, scale, vector_column)
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def rows(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in whole(batch.column(1), scale):
                f = fits[x.shape[1]]
                k, y = len(f.values), f.centred(x)
                if y.dtype == object or int(np.abs(y).max()) ** 2 * x.shape[1] >= 1 << 63:
                    sums = (y.astype(object) ** 2).sum(axis=1).tolist()
                    deviation = pa.array([int(s) if s < 10**38 else None for s in sums], pa.decimal128(38))
                else:
                    deviation = pa.array((y * y).sum(axis=1)).cast(pa.decimal128(38))
                z = f.projected(y).ravel()
                explained = f.values / f.trace if f.rank else np.full(k, np.nan)
                row = np.repeat(np.arange(len(x)), k)
                one = lambda v, t: pa.array([v] * len(row), t)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at[row])), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), one(f.n, pa.int64()), deviation.take(pa.array(row)), pa.array(z, mask=np.isnan(z)), pa.array(np.tile(explained, len(x)), mask=np.isnan(np.tile(explained, len(x)))), one(f.error, pa.float64())],
                    names,
                )

    held = vectors.select(F.col(id_column).alias("vec_id"), F.col(vector_column).alias("vector")).filter(usable(F.col("vector")))
    return held.mapInArrow(rows, f"vec_id {type_of(held, 'vec_id')}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
