"""Whitening of embeddings: a covariance in two passes, its eigenvectors, and a projection of every row.

Entries are put on an integer grid first, so that sums, means and deviations are exact whatever the order of rows. The
first pass sums the distinct grid vectors as integers; the second sums centred outer products, one matrix product per
batch and one matrix per partition, merged by ``treeAggregate``. Only sums and d x d matrices leave the executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meadowlark.llm.common import durable

#: Eigenvalues below this share of their sum are rounding, not a direction of the data; they give no component.
LEAST_SHARE = 1e-12
_INT64 = (1 << 63) - 1
#: Entries that one matrix product takes at most.
BLOCK = 1 << 22


def grid(vector: Column, steps: int = 256) -> Column:
    """Entries as long: floor of ``steps`` times each; null for a vector that is null or has null or non-finite entries."""
    entries = vector.cast("array<double>")
    odd = F.exists(entries, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.when(entries.isNotNull() & ~odd, F.transform(entries, lambda c: F.floor(c * steps).cast("long")))


def _blocks(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[np.ndarray]:
    """The rows of a list column as matrices of BLOCK entries at most (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch.column(column)
        flat = rows.flatten().to_numpy(zero_copy_only=False)
        x = flat.reshape(batch.num_rows, -1)
        step = max(1, BLOCK // max(1, x.shape[1]))
        for k in range(0, len(x), step):
            yield x[k : k + step]


def _total(x: np.ndarray) -> np.ndarray:
    """Column sums of integers; Python integers where 64 bits might not hold them."""
    most = max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0
    return x.sum(axis=0) if most * len(x) <= _INT64 else x.astype(object).sum(axis=0)


def _numerators(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: 64-bit integers where they hold it, else Python integers."""
    most = max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0
    if n * most + max(map(abs, sums), default=0) <= _INT64:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _deviations(numerators: np.ndarray) -> list[int | None]:
    """Exact sums of squares per row; null where a long can't hold one."""
    most = max(abs(int(numerators.max())), abs(int(numerators.min()))) if numerators.size else 0
    if most * most * max(1, numerators.shape[1]) <= _INT64:
        squares = numerators.astype(np.int64)
        return (squares * squares).sum(axis=1).tolist()
    return [s if s <= _INT64 else None for s in (sum(int(v) * int(v) for v in row) for row in numerators)]


class Whitening(NamedTuple):
    """``n`` distinct vectors with integer ``sums``; ``directions`` (d x k) are unit eigenvectors of the covariance by
    falling ``eigenvalues`` (k), whose sum over all d is ``trace``; ``identity_error`` is measured over the fit list."""

    n: int
    sums: list[int]
    directions: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float


def exact_sums(vectors: DataFrame, d: int) -> tuple[int, list[int]]:
    """The row count and the exact integer sums per entry of a table of one list column with ``d`` entries a row."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * d
        for x in _blocks(batches):
            n += len(x)
            sums = [a + int(b) for a, b in zip(sums, _total(x))]
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([[str(s) for s in sums]], pa.list_(pa.string()))], ["n", "sums"])

    def add(state: tuple[int, list[int]], row) -> tuple[int, list[int]]:
        return state[0] + row[0], [a + int(b) for a, b in zip(state[1], row[1])]

    return vectors.mapInArrow(partial, "n long, sums array<string>").rdd.treeAggregate((0, [0] * d), add, add)


def centred_products(vectors: DataFrame, d: int, centre, width: int | None = None) -> np.ndarray:
    """The sum of outer products of ``centre(rows)`` over a table of one list column, ``width`` x ``width`` (``d`` if none).

    One matrix product per block, one matrix per partition, merged in a tree on the executors.
    """
    width = width or d

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for x in _blocks(batches):
            y = centre(x)
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

    def add(state: np.ndarray | None, row) -> np.ndarray:
        m = row if isinstance(row, np.ndarray) or row is None else np.frombuffer(row[0]).reshape(width, width)
        return m if state is None else state if m is None else state + m

    merged = vectors.mapInArrow(partial, "m binary").rdd.treeAggregate(None, add, add)
    return np.zeros((width, width)) if merged is None else merged


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S/n as double, rounded once."""
    return _numerators(x, n, sums).astype(np.float64) / n


def fit(vectors: DataFrame, d: int, components: int = 4) -> Whitening:
    """The whitening of a durable table of distinct grid vectors, one list column of ``d`` entries.

    Directions have their largest entry positive. Those whose eigenvalue is below LEAST_SHARE of the sum are left out, so
    there may be fewer than ``components``, and none where all vectors are equal.
    """
    n, sums = exact_sums(vectors, d)
    if not n:
        return Whitening(0, sums, np.zeros((d, 0)), np.zeros(0), 0.0, 0.0)
    covariance = centred_products(vectors, d, lambda x: _centred(x, n, sums)) / n
    values, directions = np.linalg.eigh(covariance)
    trace = float(np.trace(covariance))
    kept = [k for k in reversed(range(d)) if values[k] > LEAST_SHARE * trace][:components]
    values, directions = values[kept], directions[:, kept]
    directions = directions * np.where(directions[np.abs(directions).argmax(axis=0), range(len(kept))] < 0, -1.0, 1.0) if kept else directions
    scaled = directions / np.sqrt(values)
    if not kept:
        return Whitening(n, sums, directions, values, trace, 0.0)
    # the grid's own mean is exact, so the whitened rows' mean is that of rounding alone; it is taken off all the same
    mean = _means(vectors, d, lambda x: _centred(x, n, sums) @ scaled, len(kept), n)
    again = centred_products(vectors, d, lambda x: _centred(x, n, sums) @ scaled - mean, len(kept)) / n
    return Whitening(n, sums, directions, values, trace, float(np.abs(again - np.eye(len(kept))).max()))


def _means(vectors: DataFrame, d: int, project, width: int, n: int) -> np.ndarray:
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for x in _blocks(batches):
            total += project(x).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["s"])

    def add(state: list[float], row) -> list[float]:
        return [a + b for a, b in zip(state, row[0] if hasattr(row, "asDict") else row)]

    return np.array(vectors.mapInArrow(partial, "s array<double>").rdd.treeAggregate([0.0] * width, add, add)) / n


def whitened(rows: DataFrame, components: int = 4, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """Each usable row's first whitened components: (vec_id, component, n, deviation, whitened, explained, identity_error).

    Rows whose vector is null or holds null or non-finite entries are dropped. The space's dimension is the most frequent
    length of the others (of equally frequent ones the greatest): vectors of another length, empty ones among them, aren't
    in the space and give one row each with null figures and component 0. The fit list is every distinct grid vector of
    that dimension once, so copies, a third of all rows among them, weigh nothing; they still get their rows, null and
    repeated keys included. ``deviation`` is null where a long can't hold it. An empty table gives no rows, and so does a
    table whose usable vectors are all equal, as no direction has a variance. Only ``key`` and ``vector`` are taken, so
    further columns and their names don't matter.
    """
    on_grid = rows.select(F.col(key).cast("long").alias("vec_id"), grid(F.col(vector)).alias("x")).where(F.col("x").isNotNull())
    lengths = on_grid.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("c")).where("d > 0")
    usual = lengths.orderBy(F.desc("c"), F.desc("d")).first()
    d = usual["d"] if usual else 0
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    distinct = durable(on_grid.where(F.size("x") == d).select("x").distinct())
    w = fit(distinct, d, components)
    n, sums = w.n, w.sums
    scaled, explained = w.directions / np.sqrt(w.eigenvalues), w.eigenvalues / (w.trace or 1.0)
    width, error = len(w.eigenvalues), w.identity_error

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for x in _blocks([batch], 1):
                ids = batch.column(0).slice(at, len(x)).to_pylist()
                at += len(x)
                numerators = _numerators(x, n, sums)
                deviation = [v for v in _deviations(numerators) for _ in range(width)]
                y = (numerators.astype(np.float64) / n) @ scaled
                total = len(x) * width
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([v for v in ids for _ in range(width)], pa.int64()), pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), len(x))),
                        pa.array(np.full(total, n)), pa.array(deviation, pa.int64()), pa.array(y.ravel()), pa.array(np.tile(explained, len(x))),
                        pa.array(np.full(total, error)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    inside = on_grid.where((F.size("x") == d) & (F.size("x") > 0)).mapInArrow(project, schema) if width else rows.sparkSession.createDataFrame([], schema)
    none = lambda kind: F.lit(None).cast(kind)
    outside = on_grid.where((F.size("x") != d) | (F.size("x") == 0)).select(
        "vec_id", F.lit(0).alias("component"), F.lit(n).cast("long").alias("n"), none("long").alias("deviation"), none("double").alias("whitened"),
        none("double").alias("explained"), none("double").alias("identity_error"),
    )
    return inside.unionByName(outside)
