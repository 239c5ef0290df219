"""Whitening of embeddings by covariances from column aggregates.

One Spark SQL aggregation sums the centred products of every dimension pair of the upper triangle; the covariance is assembled from
these sums, LAPACK decomposes it, and every row is projected on the leading components.

Entries become whole numbers (fixed-point, UNITS to one), so all sums are exact and no order of rows or tasks changes a digit. Columns
are centred by their rounded mean before they are multiplied; what rounding leaves of the mean, a fraction of one unit, is taken out of the
sums in exact arithmetic. Centred entries whose products could exceed a long in the sum are multiplied as doubles.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotemill.llm.common import written

UNITS, ORIGIN = 64, 1_000_000
COMPONENTS = 16
#: Products in one aggregation; wider vectors take several over the same table.
PAIRS_PER_AGGREGATE = 8192
#: Entries from this size on, in units, are no vector's: they would leave the whole numbers of a double.
LARGEST = 2.0**53


def fixed_point(vector: Column) -> Column:
    """The vector's entries as whole numbers, null if the vector or an entry is null, not finite or too large, or there is none."""
    entries = F.transform(vector, lambda c: F.lit(float(UNITS)) * c.cast("double"))
    sound = (F.size(vector) > 0) & F.forall(entries, lambda c: F.coalesce(F.abs(c) < LARGEST, F.lit(False)))  # NaN is above all
    return F.when(sound, F.transform(entries, lambda c: F.floor(c).cast("long") + ORIGIN))


@dataclass(frozen=True)
class Moments:
    """Exact sums of n vectors, and their covariance with divisor n."""

    n: int
    sums: list[int]
    covariance: np.ndarray

    @property
    def centre(self) -> list[int]:
        return [(2 * s + self.n) // (2 * self.n) for s in self.sums]


def _one(df: DataFrame, expressions: list[str]) -> list:
    """The values of one row of aggregates, taken some thousand at a time."""
    found: list = []
    for k in range(0, len(expressions), PAIRS_PER_AGGREGATE):
        found += df.selectExpr(f"array({', '.join(expressions[k : k + PAIRS_PER_AGGREGATE])}) as a").first().a
    return found


def upper_triangle(width: int) -> list[str]:
    """Sums of the products of every pair of the columns x0, x1 and on, row by row of the upper triangle."""
    return [f"sum(x{i} * x{j})" for i in range(width) for j in range(i, width)]


def symmetric(upper: list, width: int) -> np.ndarray:
    """The full matrix of the upper triangle's values."""
    full = np.zeros((width, width))
    full[np.triu_indices(width)] = upper
    return full + np.triu(full, 1).T


def moments(vectors: DataFrame, width: int) -> Moments | None:
    """Sums and covariance of column x, vectors of so many whole numbers; None of an empty table."""
    entries = [f"cast(x[{i}] as decimal(38, 0))" for i in range(width)]
    n, *bounds = _one(vectors, ["cast(count(1) as decimal(38, 0))", *(f"{f}({e})" for f in ("sum", "min", "max") for e in entries)])
    n, (sums, least, most) = int(n), ([int(b or 0) for b in bounds[k : k + width]] for k in (0, width, 2 * width))
    if not n:
        return None
    centre = [(2 * s + n) // (2 * n) for s in sums]
    reach = max(max(m - c, c - l) for l, m, c in zip(least, most, centre, strict=True))
    kind = "long" if n * reach * reach < 1 << 62 else "double"
    centred = vectors.selectExpr(*(f"coalesce(cast(x[{i}] - {c} as {kind}), cast(0 as {kind})) as x{i}" for i, c in enumerate(centre)))  # never null, which makes the sums cheaper
    products = _one(centred, upper_triangle(width))
    rest = [s - n * c for s, c in zip(sums, centre, strict=True)]
    pairs = ((i, j) for i in range(width) for j in range(i, width))
    if kind == "long":  # quotients of whole numbers are rounded once
        upper = [(n * p - rest[i] * rest[j]) / (n * n) for (i, j), p in zip(pairs, products, strict=True)]
    else:
        upper = [p / n - (rest[i] / n) * (rest[j] / n) for (i, j), p in zip(pairs, products, strict=True)]
    return Moments(n, sums, symmetric(upper, width))


def decomposed(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Leading eigenvalues, falling, and unit eigenvectors as columns, the largest entry of each positive. Values that are zero but for rounding are left out."""
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    kept = int((values[:most] > max(values[0], 0) * len(values) * np.finfo(float).eps).sum())
    values, vectors = values[:kept], vectors[:, :kept]
    if kept:
        vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(kept)])
    return values, vectors


@dataclass(frozen=True)
class Projection:
    """What a task needs to whiten rows: bounded by the square of the vectors' width."""

    n: int
    centre: np.ndarray
    rest: np.ndarray
    matrix: np.ndarray

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Rows of x less their mean, on every component, over the root of its eigenvalue."""
        return ((x - self.centre) - self.rest / self.n) @ self.matrix

    def deviations(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sum of (n x - S)^2 for each row, and whether a long holds it."""
        y = x - self.centre
        fits = ((self.n * y.astype(float) - self.rest) ** 2).sum(axis=1) < 2.0**63 * (1 - 1e-9)
        return ((self.n * np.where(fits[:, None], y, 0) - self.rest) ** 2).sum(axis=1), fits


def _rows(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _fixed_width(embeddings: DataFrame, vector: str) -> tuple[DataFrame, int]:
    """Rows (vec_id, x) of the commonest width, the least of equals, and that width, 0 if there are none."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), fixed_point(F.col(vector)).alias("x")).filter(F.col("x").isNotNull())
    found = rows.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), "width").first()
    width = found.width if found else 0
    return rows.filter(F.size("x") == width), width


def whitened(embeddings: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error for every sound row and component.

    Needs vec_id and the vector's column; other columns are ignored. The fit list is each distinct vector of whole numbers once, so copies
    weigh nothing. Rows whose vector is null or empty, or holds an entry that is null, not finite or of 2^53 units or more, are left out, as
    are rows whose vector is not of the commonest width (of equally common ones the least). Repeated rows and null ids stay. Components whose
    eigenvalue is zero but for rounding (fewer vectors than dimensions, constant dimensions) are left out; equal eigenvalues share a space, of
    which LAPACK picks the axes. deviation is null where a long does not hold it. An empty table gives no rows.
    """
    rows, width = _fixed_width(embeddings, vector)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    spark = embeddings.sparkSession
    fit = written(rows.select("x").distinct(), "fit-list") if width else None
    found = moments(fit, width) if width else None
    values, vectors = decomposed(found.covariance, components) if found else (np.zeros(0), np.zeros((0, 0)))
    if not len(values):
        return spark.createDataFrame([], schema)
    centre, kept = found.centre, len(values)
    rest = np.array([s - found.n * c for s, c in zip(found.sums, centre, strict=True)], np.int64)
    onto = Projection(found.n, np.array(centre, np.int64), rest, vectors / np.sqrt(values))
    error = identity_error(fit, onto, width, kept)
    explained = values / np.trace(found.covariance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _rows(batch["x"], width)
                deviation, fits = onto.deviations(x)
                each = np.repeat(np.arange(len(x)), kept)
                yield pa.record_batch({
                    "vec_id": batch["vec_id"].take(pa.array(each)),
                    "component": pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), len(x))),
                    "n": pa.array(np.full(len(each), onto.n, np.int64)),
                    "deviation": pa.array(deviation[each], mask=~fits[each]),
                    "whitened": pa.array(onto.whitened(x).ravel()),
                    "explained": pa.array(np.tile(explained, len(x))),
                    "identity_error": pa.array(np.full(len(each), error)),
                })

    return rows.mapInArrow(run, schema)


def identity_error(fit: DataFrame, onto: Projection, width: int, kept: int) -> float:
    """Largest absolute entry of the whitened fit list's covariance less the identity, by the same column aggregates over the whitened rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                w = onto.whitened(_rows(batch["x"], width))
                yield pa.record_batch({f"x{k}": pa.array(np.ascontiguousarray(w[:, k])) for k in range(kept)})

    space = fit.mapInArrow(run, ", ".join(f"x{k} double" for k in range(kept)))
    means = [s / onto.n for s in _one(space, [f"sum(x{k})" for k in range(kept)])]
    products = _one(space.selectExpr(*(f"x{k} - {m!r}D as x{k}" for k, m in enumerate(means))), upper_triangle(kept))
    return float(np.abs(symmetric([p / onto.n for p in products], kept) - np.eye(kept)).max())
