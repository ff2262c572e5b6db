"""Neighbourhoods of voxels, frame by frame.

A frame is small however many there are: its voxels go to one task, are laid out on the grid as a
volume, and neighbours are shifted copies of it. No voxel is sent to its neighbours.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelkit.model import key_columns, key_schema

#: Called with the cells (three index arrays), their values (one array for each column) and the volume's shape.
Kernel = Callable[[tuple[np.ndarray, ...], list[np.ndarray], tuple[int, ...]], list[np.ndarray]]


def by_frame(signal: DataFrame, grid: DataFrame, columns: Sequence[str], kernel: Kernel, out: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """(keys, timepoint, voxel, ``out``) of a kernel over every frame's voxels that lie on the grid.

    The grid is (voxel, x, y, z) with whole numbers; a frame must hold a voxel once.
    """
    placed = signal.join(grid.select("voxel", *[F.col(c).cast("int").alias(c) for c in "xyz"]), "voxel")
    given = placed.select(*keys, "timepoint", "voxel", "x", "y", "z", *[F.col(c).cast("double").alias(c) for c in columns])

    def run(key: tuple, table: pa.Table) -> pa.Table:
        cells = [table.column(c).to_numpy() for c in "xyz"]
        cells = tuple(c - c.min() for c in cells)
        values = [table.column(c).to_numpy(zero_copy_only=False) for c in columns]
        found = kernel(cells, values, tuple(int(c.max()) + 1 for c in cells))
        return pa.table(key_columns(key, table.schema, table.num_rows) | {"voxel": table.column("voxel")} | {n: pa.array(v, pa.float64(), mask=np.isnan(v)) for n, v in zip(out, found, strict=True)})

    schema = f"{key_schema(given, [*keys, 'timepoint', 'voxel'])}, {', '.join(f'{n} double' for n in out)}"
    return given.groupBy(*keys, "timepoint").applyInArrow(run, schema)


def shifted_sums(cells: tuple[np.ndarray, ...], values: np.ndarray, shape: tuple[int, ...], offsets: Sequence[tuple[int, int, int]]) -> np.ndarray:
    """For each cell the sum of the values at these offsets from it; NaN where one of them is missing."""
    reach = max(abs(d) for o in offsets for d in o)
    volume = np.full([n + 2 * reach for n in shape], np.nan)
    volume[tuple(c + reach for c in cells)] = values
    total = np.zeros(len(values))
    for o in offsets:
        total += volume[tuple(c + reach + d for c, d in zip(cells, o, strict=True))]
    return total


def blurred(cells: tuple[np.ndarray, ...], values: np.ndarray, shape: tuple[int, ...], weights: np.ndarray) -> np.ndarray:
    """For each cell the weighted sum around it, one axis after the other; cells without a value count as 0."""
    volume, reach = np.zeros(shape), len(weights) // 2
    volume[cells] = values
    for axis in range(3):
        padded = np.pad(volume, [(reach, reach) if k == axis else (0, 0) for k in range(3)])
        volume = sum(w * np.take(padded, np.arange(shape[axis]) + k, axis=axis) for k, w in enumerate(weights))
    return volume[cells]
