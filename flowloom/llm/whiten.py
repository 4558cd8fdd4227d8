"""Whitening of vectors by a tiled covariance.

Entries become integers, floor(scale * entry) + offset, and all sums over rows are exact. Dimensions are cut into column
blocks. Tasks cut their rows into row blocks and send the column blocks of each, centred, to one place; there every pair of
column blocks is multiplied, and the products are added to the tile that the pair of dimensions belongs to. Tiles of all
tasks are summed by their keys, the covariance is put together and decomposed on the driver (dimensions squared, whatever
the number of rows).

Centring takes the whole part of each mean off the entries before they are multiplied; the rest of the means, below one, is
taken off the exact sums. So the covariance is the exact one, rounded once, however the table is partitioned.

Rows with a null vector or with null or non-finite entries are dropped, and so are vectors whose length is not the commonest
(of equally common lengths the greatest). A null id is kept as such, repeated rows are rows each, and all count in the fit.
Components without variance (eigenvalues below rounding) have null as whitened value; `explained` is null if no entry varies.
Entries whose integer is 2^52 or more are an error. Columns other than the two named are ignored, whatever their names. An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.negatives import commonest_length, smallest_kind
from flowloom.llm.support import ship

TILE = 16
#: Cells of a row block.
BLOCK_CELLS = 1 << 18
EXACT = 1 << 53
WIDE = pa.decimal128(38, 0)
RESULT = "vec_id long, deviation decimal(38,0), whitened array<double>"


def usable(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """vec_id, embedding of the vectors without null and non-finite entries, of all lengths."""
    v = F.col("embedding")
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("embedding"))
    return rows.where(v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


@dataclass(frozen=True)
class Whitening:
    """What a fit found: sums S of n rows, and unit eigenvectors (columns of axes) by falling eigenvalue."""

    scale: int
    offset: int
    n: int
    sums: list[int]
    covariance: np.ndarray
    values: np.ndarray
    axes: np.ndarray

    @property
    def whole(self) -> np.ndarray:
        """Whole parts of the means."""
        return np.array([s // self.n for s in self.sums], dtype=np.int64)

    @property
    def rest(self) -> list[int]:
        """n times what is left of the means."""
        return [s % self.n for s in self.sums]

    @property
    def explained(self) -> np.ndarray:
        total = np.trace(self.covariance)
        return self.values / total if total > 0 else np.full(len(self.values), np.nan)

    @property
    def live(self) -> np.ndarray:
        """Which components have variance beyond rounding."""
        return self.values > len(self.sums) * np.finfo(float).eps * max(self.values.max(initial=0.0), 0.0)

    def whitened(self, y: np.ndarray) -> np.ndarray:
        """Rows of y = x - whole, on the components; NaN where a component has no variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            out = ((y - np.array([r / self.n for r in self.rest])) @ self.axes) / np.sqrt(self.values)
        out[:, ~self.live] = np.nan
        return out

    def deviations(self, y: np.ndarray) -> list[Decimal]:
        """Sum of (n * x - S)^2 over the dimensions of each row, exact: n * x - S is n * y - rest."""
        n, top = self.n, int(np.abs(y).max()) if y.size else 0
        exact = len(self.sums) * top * max(n, top) < 1 << 62
        r = np.array(self.rest, dtype=np.int64 if exact else object)
        y = y if exact else y.astype(object)
        mixed, square, rest = (y * r).sum(1).tolist(), (y * y).sum(1).tolist(), sum(x * x for x in self.rest)
        return [Decimal(n * n * s - 2 * n * m + rest) for s, m in zip(square, mixed, strict=True)]


def _integers(values: pa.Array, dims: int, scale: int, offset: int) -> np.ndarray:
    x = np.floor(float(scale) * np.asarray(values.flatten(), dtype=np.float64).reshape(len(values), dims))
    if x.size and np.abs(x).max() >= 2.0**52:
        raise ValueError("an entry is too large for an exact integer")
    return x.astype(np.int64) + offset


def _row_blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[pa.RecordBatch]:
    step = max(1, BLOCK_CELLS // max(1, dims))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def _sums(rows: DataFrame, dims: int, scale: int, offset: int) -> tuple[int, list[int]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros(dims, dtype=object)
        for batch in _row_blocks(batches, dims):
            x = _integers(batch.column(1), dims, scale, offset)
            exact = not x.size or len(x) * int(np.abs(x).max()) < 1 << 63
            sums = sums + (x.sum(0) if exact else x.astype(object).sum(0)).astype(object)
            n += len(x)
        cells = [Decimal(int(s)) for s in sums] + [Decimal(n)]
        yield pa.RecordBatch.from_arrays([pa.array(range(dims + 1), pa.int32()), pa.array(cells, WIDE)], names=["dim", "own"])

    # a row for each dimension of each task; the last one is the count
    total = rows.mapInArrow(run, "dim int, own decimal(38,0)").groupBy("dim").agg(F.sum("own").alias("own"))
    found = {r["dim"]: int(r["own"]) for r in total.collect()}
    return found.get(dims, 0), [found.get(i, 0) for i in range(dims)]


def column_blocks(rows: DataFrame, dims: int, scale: int, offset: int, whole: np.ndarray) -> DataFrame:
    """(row_block, col, rows, kind, cells): centred integers of TILE dimensions of some rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, number = TaskContext.get().partitionId() << 32, 0
        for batch in _row_blocks(batches, dims):
            y = _integers(batch.column(1), dims, scale, offset) - whole
            parts = [y[:, c : c + TILE] for c in range(0, dims, TILE)]
            kinds = [smallest_kind(p) for p in parts]
            size = len(parts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([first + number] * size, pa.int64()), pa.array(range(size), pa.int32()), pa.array([len(y)] * size, pa.int32()), pa.array(kinds), pa.array([p.astype(k).tobytes() for p, k in zip(parts, kinds, strict=True)], pa.binary())],
                names=["row_block", "col", "rows", "kind", "cells"],
            )
            number += 1

    return rows.mapInArrow(run, "row_block long, col int, rows int, kind string, cells binary")


class Tiles:
    """Exact sums of products, by pair of column blocks."""

    def __init__(self) -> None:
        self.sums: dict[tuple[int, int], np.ndarray] = {}
        self.bounds: dict[tuple[int, int], int] = {}

    def add(self, tile: tuple[int, int], cells: np.ndarray, bound: int) -> None:
        """bound: what no cell exceeds. Sums are 64-bit integers as long as their bounds are, then Python's."""
        total = self.bounds.get(tile, 0) + bound
        own = self.sums.get(tile)
        if own is None:
            own = np.zeros(cells.shape, dtype=np.int64)
        if total >= 1 << 63 or cells.dtype == object:
            own, cells = own.astype(object), cells.astype(object)
        self.sums[tile], self.bounds[tile] = own + cells, total

    def multiply(self, blocks: dict[int, np.ndarray]) -> None:
        """All pairs of the column blocks of one row block."""
        tops = {c: int(np.abs(b).max()) if b.size else 0 for c, b in blocks.items()}
        floats = {c: b.astype(np.float64) for c, b in blocks.items()}
        for p in blocks:
            for q in blocks:
                if p <= q:
                    bound = len(blocks[p]) * tops[p] * tops[q]
                    cells = (floats[p].T @ floats[q]).astype(np.int64) if bound < EXACT else blocks[p].astype(object).T @ blocks[q].astype(object)
                    self.add((p, q), cells, bound)

    def batches(self) -> Iterator[pa.RecordBatch]:
        for (p, q), cells in self.sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([q], pa.int32()), pa.array([[Decimal(int(x)) for x in cells.ravel()]], pa.list_(WIDE))], names=["p", "q", "cells"])


_TILES = "p int, q int, cells array<decimal(38,0)>"


def products(blocks: DataFrame, dims: int) -> np.ndarray:
    """Sums of products of all pairs of dimensions, as Python integers."""
    width = lambda c: min(TILE, dims - c * TILE)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles, of, own = Tiles(), None, {}
        for batch in batches:
            for row_block, col, rows, kind, cells in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row_block != of and own:
                    tiles.multiply(own)
                    own = {}
                of, own[col] = row_block, np.frombuffer(cells, kind).reshape(rows, width(col)).astype(np.int64)
        if own:
            tiles.multiply(own)
        yield from tiles.batches()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles = Tiles()
        for batch in batches:
            for p, q, cells in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                whole = np.array([int(x) for x in cells], dtype=object)
                bound = max(map(abs, whole), default=0)
                tiles.add((p, q), whole.astype(np.int64) if bound < 1 << 63 else whole, bound)
        yield from tiles.batches()

    # a row block meets in one place; a task multiplies one row block after the other and keeps the tiles alone
    partial = blocks.repartition("row_block").sortWithinPartitions("row_block", "col").mapInArrow(multiply, _TILES)
    total = partial.repartition("p", "q").mapInArrow(add, _TILES)
    out = np.zeros((dims, dims), dtype=object)
    for r in total.collect():  # dimensions squared
        p, q = r["p"], r["q"]
        cells = np.array([int(x) for x in r["cells"]], dtype=object).reshape(width(p), width(q))
        out[p * TILE : p * TILE + width(p), q * TILE : q * TILE + width(q)] = cells
        out[q * TILE : q * TILE + width(q), p * TILE : p * TILE + width(p)] = cells.T
    return out


def fit(rows: DataFrame, dims: int, components: int = 32, scale: int = 64, offset: int = 1_000_000) -> Whitening | None:
    """Of usable rows that all have `dims` entries; None if there are none."""
    n, sums = _sums(rows, dims, scale, offset)
    if not n:
        return None
    whole, rest = np.array([s // n for s in sums], dtype=np.int64), [s % n for s in sums]
    together = products(column_blocks(rows, dims, scale, offset, whole), dims)
    covariance = np.array([[(n * together[i, j] - rest[i] * rest[j]) / (n * n) for j in range(dims)] for i in range(dims)], dtype=np.float64).reshape(dims, dims)
    values, axes = np.linalg.eigh(covariance) if dims else (np.zeros(0), np.zeros((0, 0)))
    order = np.argsort(-values, kind="stable")[:components]
    return Whitening(scale, offset, n, sums, covariance, values[order], axes[:, order])


def transform(rows: DataFrame, model: Whitening) -> DataFrame:
    """vec_id, deviation (exact), whitened: a row for each row, null for components without variance."""
    dims = len(model.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _row_blocks(batches, dims):
            y = _integers(batch.column(1), dims, model.scale, model.offset) - model.whole
            values = model.whitened(y)
            flat = pa.array(values.ravel(), from_pandas=True)
            steps = pa.array(np.arange(len(y) + 1) * values.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.deviations(y), WIDE), pa.ListArray.from_arrays(steps, flat)], names=["vec_id", "deviation", "whitened"])

    return rows.mapInArrow(run, RESULT)


def identity_error(rows: DataFrame, model: Whitening) -> float | None:
    """Greatest entry of the covariance of the whitened rows themselves, less the identity; over components with variance."""
    dims, live = len(model.sums), np.flatnonzero(model.live)
    if not len(live):
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(live) + 1, len(live)))
        for batch in _row_blocks(batches, dims):
            w = model.whitened(_integers(batch.column(1), dims, model.scale, model.offset) - model.whole)[:, live]
            sums[:-1] += w.T @ w
            sums[-1] += w.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(sums.size), pa.int32()), pa.array(sums.ravel())], names=["cell", "own"])

    total = np.zeros((len(live) + 1) * len(live))
    for r in rows.mapInArrow(run, "cell int, own double").groupBy("cell").agg(F.sum("own").alias("own")).collect():
        total[r["cell"]] = r["own"] / model.n
    total = total.reshape(len(live) + 1, len(live))
    return float(np.abs(total[:-1] - np.outer(total[-1], total[-1]) - np.eye(len(live))).max())


def whiten(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", components: int = 32, scale: int = 64, offset: int = 1_000_000) -> tuple[DataFrame, Whitening | None, float | None]:
    """(rows with vec_id, deviation, whitened; the fit; its identity error). Of an empty table: no rows, None and None."""
    spark = vectors.sparkSession
    ship(spark)
    rows = usable(vectors, key, column)
    dims = commonest_length(rows)
    model = None
    if dims is not None:
        rows = rows.where(F.size("embedding") == dims)
        model = fit(rows, dims, components, scale, offset)
    if model is None:
        return spark.createDataFrame([], RESULT), None, None
    return transform(rows, model), model, identity_error(rows, model)
