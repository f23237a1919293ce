"""Whitening of embeddings by a two-pass covariance.

An entry c becomes the whole number x = floor(1024 * c) + 100000, so the first pass adds up whole numbers and the mean is
exact. The second pass centres and multiplies blocks of rows by themselves (NumPy's GEMM); the sums of partitions are merged
by treeAggregate. LAPACK's symmetric solver gives the components on the driver from one d x d matrix, and mean and
components, d x 8 numbers, are broadcast for the projection. A third pass measures the covariance of what is projected.

Edge cases: vectors that are null or hold null or non-finite entries are dropped; vectors of each length are a fit of their
own (an empty vector has no component and gives no rows); ids are of any type, may be null or repeat, and each row counts;
x is held within 2^62; a component whose variance is no more than rounding (all vectors equal, fewer vectors than entries)
has whitened null, as there is nothing to scale, and is left out of identity_error; deviation is null where it would pass 64
bits, deviation_exact has it up to 38 digits; extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import decimal
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import DecimalType, DoubleType, IntegerType, LongType, StructField, StructType

from .common import frugal

SCALE, SHIFT, COMPONENTS, ROWS = 1024, 100_000, 8, 8192
LIMIT = 1 << 62


@dataclass(frozen=True)
class Fit:
    """Of the vectors of one length: their number, exact sums, components by falling eigenvalue, and what these explain."""

    n: int
    sums: list[int]
    components: np.ndarray | None = None
    values: np.ndarray | None = None
    explained: np.ndarray | None = None
    error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n in double precision: the whole part of the mean is taken off before the fraction."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n / self.n for s in self.sums])
        return (x - whole).astype(np.float64) - rest

    def projected(self, x: np.ndarray) -> np.ndarray:
        """Whitened values; NaN where a component has no variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.values > 0, self.centred(x) @ self.components / np.sqrt(np.maximum(self.values, 0)), np.nan)

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n * x - S)^2, exact."""
        sums = np.array(self.sums, object)
        bound = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0)
        if bound < LIMIT:
            off = self.n * x - sums.astype(np.int64)
            if x.shape[1] * int(np.abs(off).max(initial=0)) ** 2 < LIMIT:
                return (off * off).sum(axis=1).tolist()
            x = off.astype(object)
        else:
            x = self.n * x.astype(object) - sums
        return (x * x).sum(axis=1).tolist()


def integers(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, x) of a list column's usable vectors, by length."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(column), -1))
    for size in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == size)
        for k in range(0, len(rows), ROWS):
            part = rows[k : k + ROWS]
            flat = column.take(pa.array(part)).flatten().cast(pa.float64())
            values = np.asarray(pc.fill_null(flat, float("nan"))).reshape(-1, size)
            fine = np.isfinite(values).all(axis=1)
            if fine.any():
                with np.errstate(over="ignore"):
                    whole = np.clip(np.floor(SCALE * values[fine]), -float(LIMIT), float(LIMIT) - 2.0**10)
                yield part[fine], whole.astype(np.int64) + SHIFT


def first_sums(vectors: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """Number of vectors and exact sums for each length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            for rows, x in integers(batch.column(0)):
                n, s = sums.get(x.shape[1], (0, np.zeros(x.shape[1], object)))
                # halves of 32 bits cannot overflow; Python's whole numbers carry on
                sums[x.shape[1]] = n + len(rows), s + (x >> 32).sum(axis=0).astype(object) * (1 << 32) + (x & 0xFFFFFFFF).sum(axis=0).astype(object)
        for size, (n, s) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([size], pa.int32()), pa.array([n]), pa.array([[str(v) for v in s]])], ["size", "n", "sums"])

    def merged(a: dict, b: dict) -> dict:
        for size, (n, s) in b.items():
            m, t = a.get(size, (0, [0] * size))
            a[size] = m + n, [x + y for x, y in zip(t, s)]
        return a

    parts = vectors.mapInArrow(frugal(run), "size int, n long, sums array<string>").rdd
    return parts.treeAggregate({}, lambda a, r: merged(a, {r["size"]: (r["n"], [int(v) for v in r["sums"]])}), merged)


def second_moments(vectors: DataFrame, fits: dict[int, Fit], projected: bool = False) -> dict[int, np.ndarray]:
    """Sums of outer products of centred (or whitened) vectors for each length."""
    sent = vectors.sparkSession.sparkContext.broadcast(fits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in integers(batch.column(0)):
                fit = sent.value[x.shape[1]]
                y = np.nan_to_num(fit.projected(x)) if projected else fit.centred(x)
                sums[x.shape[1]] = sums[x.shape[1]] + y.T @ y if x.shape[1] in sums else y.T @ y
        for size, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([size], pa.int32()), pa.array([s.tobytes()], pa.binary())], ["size", "sums"])

    def merged(a: dict, b: dict) -> dict:
        for size, s in b.items():
            a[size] = a[size] + s if size in a else s
        return a

    parts = vectors.mapInArrow(frugal(run), "size int, sums binary").rdd
    return parts.treeAggregate({}, lambda a, r: merged(a, {r["size"]: np.frombuffer(bytes(r["sums"]))}), merged)


def fit(vectors: DataFrame, components: int = COMPONENTS) -> dict[int, Fit]:
    """A fit for each length of vector; vectors has the vector as its only column."""
    fits = {size: Fit(n, s) for size, (n, s) in first_sums(vectors).items()}
    if not fits:
        return {}
    products = second_moments(vectors, fits)
    for size, f in fits.items():
        covariance = products[size].reshape(size, size) / f.n
        values, axes = np.linalg.eigh((covariance + covariance.T) / 2)
        values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
        axes = axes * np.where(np.take_along_axis(axes, np.abs(axes).argmax(axis=0)[None], 0) < 0, -1.0, 1.0)
        trace = float(np.trace(covariance))
        values = np.where(values > size * np.finfo(float).eps * max(trace, 0.0), values, 0.0)
        fits[size] = Fit(f.n, f.sums, axes, values, values / trace if trace > 0 else np.zeros(len(values)))
    for size, s in second_moments(vectors, fits, projected=True).items():
        f, used = fits[size], fits[size].values > 0
        own = s.reshape(len(used), len(used)) / f.n
        error = float(np.abs(own - np.eye(len(used)))[np.ix_(used, used)].max(initial=0.0))
        fits[size] = Fit(f.n, f.sums, f.components, f.values, f.explained, error)
    return fits


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """key, component, n, deviation, whitened, explained, identity_error and deviation_exact of each vector and component."""
    fits = fit(df.select(vector), components)
    sent = df.sparkSession.sparkContext.broadcast(fits)
    wide = pa.decimal128(38, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in integers(batch.column(1)):
                f = sent.value[x.shape[1]]
                k = len(f.values)
                values, away = f.projected(x).ravel(), f.deviations(x)
                each = lambda v: pa.array(v).take(pa.array(np.repeat(np.arange(len(rows)), k)))
                exact = pa.array([decimal.Decimal(v) if v < 10**38 else None for v in away], wide)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(np.repeat(rows, k))),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))),
                        pa.array(np.full(k * len(rows), f.n)),
                        each([v if v < 1 << 63 else None for v in away]).cast(pa.int64()),
                        pa.array(values, from_pandas=True),
                        pa.array(np.tile(f.explained, len(rows))),
                        pa.array(np.full(k * len(rows), f.error)),
                        each(exact),
                    ],
                    ["key", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_exact"],
                )

    doubles = (StructField(x, DoubleType()) for x in ("whitened", "explained", "identity_error"))
    schema = StructType([StructField("key", df.schema[key].dataType), StructField("component", IntegerType()), StructField("n", LongType()), StructField("deviation", LongType()), *doubles, StructField("deviation_exact", DecimalType(38, 0))])
    return df.select(key, vector).mapInArrow(frugal(run), schema).withColumnRenamed("key", key)
