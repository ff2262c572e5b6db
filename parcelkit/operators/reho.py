"""Regional homogeneity: Kendall's coefficient of concordance around each voxel."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .volumes import by_frame, shifted_sums

KEYS = ("element",)


def neighbours(n: int) -> list[tuple[int, int, int]]:
    """Offsets of a cluster: 7 is faces, 19 faces and edges, 27 the cube, 125 the cube of width five."""
    if n not in (7, 19, 27, 125):
        raise ValueError("clusters have 7, 19, 27 or 125 voxels")
    reach = 2 if n == 125 else 1
    most = {7: 1, 19: 2}.get(n, 3 * reach)
    return [o for o in product(range(-reach, reach + 1), repeat=3) if sum(map(abs, o)) <= most]


def reho(signal: DataFrame, grid: DataFrame, n: int = 27, mask: DataFrame | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """Concordance of each voxel's cluster over time; voxels whose cluster leaves the grid, or that the
    mask leaves out, are 1, as is a cluster without any variation.

    Ranks and ties come from one pass over each voxel's series; each frame's ranks are then summed
    around its voxels.
    """
    near = neighbours(n)
    series = Window.partitionBy(*keys, "voxel")
    same = F.count(F.lit(1)).over(Window.partitionBy(*keys, "voxel", "value")).cast("double")
    # A tie of t frames has t rows, and t * t - 1 on each of them makes t ^ 3 - t.
    ranked = signal.select(*keys, "timepoint", "voxel", (F.rank().over(series.orderBy("value")) + (same - 1) / 2).alias("r"), (same * same - 1).alias("tie"))
    sums = by_frame(ranked, grid, ["r", "tie"], lambda cells, values, shape: [shifted_sums(cells, v, shape, near) for v in values], ["s", "tie"], keys)
    whole = sums.groupBy(*keys, "voxel").agg(F.sum(F.col("s") * F.col("s")).alias("s2"), F.count("s").alias("whole"), F.count("*").cast("double").alias("t"), F.sum("tie").alias("tie"))
    m, t = F.lit(float(n)), F.col("t")
    den = m * m * t * (t * t - 1) - m * F.col("tie")
    inside = F.col("whole") == F.col("t")
    if mask is not None:
        whole = whole.join(mask.select("voxel").distinct().withColumn("in_mask", F.lit(True)), "voxel", "left")
        inside = inside & F.col("in_mask")
    w = F.when(inside & (den != 0), F.try_divide(12 * F.col("s2") - 3 * m * m * t * (t + 1) * (t + 1), den)).otherwise(1.0)
    return whole.select(*keys, "voxel", F.lit(0).alias("timepoint"), w.alias("value"))
