"""Aggregation of voxels over parcels, spheres and maps.

A signal has the element's keys, timepoint, voxel and value. All results have the keys, timepoint,
col and value; with a time aggregate, or for signals without time, the timepoint is gone or is kept.
Dimension tables are joined as they are: Spark broadcasts them where their measured size allows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import product

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelkit.functions import stats

KEYS = ("element",)


def over_time(frames: DataFrame, method: str | None, params: dict | None, keys: Sequence[str]) -> DataFrame:
    if method is None:
        return frames
    return frames.groupBy(*keys, "col").agg(stats.by_name(method, params)(F.col("value")).alias("value"))


def parcel_aggregation(
    signal: DataFrame, parcels: DataFrame, method: str = "mean", method_params: dict | None = None, time_method: str | None = None,
    time_method_params: dict | None = None, mask: DataFrame | None = None, labels: Sequence[str] | None = None, keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Aggregates the voxels of each parcel in each frame, then, if asked, the frames.

    Labels without a voxel keep a row with null in every frame. The mask is applied to the
    dimension table, before the signal is read.
    """
    voxels = parcels.select("voxel", F.col("label").alias("col"))
    if mask is not None:
        voxels = voxels.join(mask.select("voxel").distinct(), "voxel", "left_semi")
    joined = signal.join(voxels, "voxel")
    frames = joined.groupBy(*keys, "timepoint", "col").agg(stats.by_name(method, method_params)(F.col("value")).alias("value"))
    if labels is not None:
        there = {r["col"] for r in voxels.select("col").distinct().collect()}  # labels of one parcellation
        if empty := [x for x in labels if x not in there]:
            bare = signal.select(*keys, "timepoint").distinct().select(*keys, "timepoint", F.explode(F.array(*map(F.lit, empty))).alias("col"), F.lit(None).cast("double").alias("value"))
            frames = frames.unionByName(bare)
    return over_time(frames, time_method, time_method_params, keys)


def _within(grid: DataFrame, seeds: DataFrame, radius: float) -> DataFrame:
    """(voxel, label, d) of the voxels within the radius of each seed: both are put into cells of the
    radius' size, and a seed meets the voxels of the 27 cells around it."""
    cell = lambda c, k=0: (F.floor(F.col(c) / radius) + k).cast("long")
    voxels = grid.select("voxel", *"xyz", *[cell(c).alias(f"c{c}") for c in "xyz"])
    around = F.array(*[F.struct(*[F.lit(k).alias(f"k{c}") for k, c in zip(o, "xyz", strict=True)]) for o in product((-1, 0, 1), repeat=3)])
    moved = seeds.select(F.col("seed").alias("label"), *[F.col(c).alias(f"s{c}") for c in "xyz"], F.explode(around).alias("k"))
    moved = moved.select("label", "sx", "sy", "sz", *[(cell(f"s{c}") + F.col(f"k.k{c}")).alias(f"c{c}") for c in "xyz"])
    square = sum(((F.col(c) - F.col(f"s{c}")) * (F.col(c) - F.col(f"s{c}")) for c in "xyz"), F.lit(0.0))
    return voxels.join(moved, ["cx", "cy", "cz"]).select("voxel", "label", square.alias("d")).where(F.col("d") <= float(radius) ** 2)


def sphere_voxels(grid: DataFrame, seeds: DataFrame, radius: float | None, allow_overlap: bool = False) -> DataFrame:
    """(voxel, label) of the voxels within the radius of each seed; without a radius, the nearest one.

    A join of two dimension tables on cells of space, done before any signal is read. The nearest voxel
    is looked for in growing spheres, until every seed has one.
    """
    if radius:
        found = _within(grid, seeds, radius).select("voxel", "label")
    else:
        ends = grid.agg(F.count("*").alias("n"), *[f(c).alias(f"{n}{c}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))]).first()
        far = seeds.agg(*[F.max(F.greatest(F.abs(F.col(c) - F.lit(ends[f"lo{c}"])), F.abs(F.col(c) - F.lit(ends[f"hi{c}"])))).alias(c) for c in "xyz"]).first() if ends["n"] else None
        most = sum((far[c] or 0.0) ** 2 for c in "xyz") ** 0.5 if far else 0.0
        reach = max(1e-9, max((float(ends[f"hi{c}"] - ends[f"lo{c}"]) for c in "xyz"), default=1.0) / max(1.0, ends["n"] ** (1 / 3))) if ends["n"] else 1.0
        rest, parts = seeds, []
        while ends["n"]:
            near = _within(grid, rest, reach).groupBy("label").agg(F.min_by("voxel", F.struct("d", "voxel")).alias("voxel")).select("voxel", "label")
            parts.append(near)
            rest = rest.join(near.select(F.col("label").alias("seed")), "seed", "left_anti")
            if reach > most or not rest.limit(1).count():
                break
            reach *= 2
        found = reduce(DataFrame.unionByName, parts) if parts else grid.select("voxel", F.lit("").alias("label")).where("false")
    if not allow_overlap and found.groupBy("voxel").count().where("count > 1").limit(1).count():
        raise ValueError("spheres overlap")
    return found


def sphere_aggregation(signal: DataFrame, grid: DataFrame, seeds: DataFrame, radius: float | None, allow_overlap: bool = False, **how) -> DataFrame:
    """parcel_aggregation() over spheres."""
    return parcel_aggregation(signal, sphere_voxels(grid, seeds, radius, allow_overlap), **how)


def maps_aggregation(
    signal: DataFrame, maps: DataFrame, time_method: str | None = None, time_method_params: dict | None = None, mask: DataFrame | None = None, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Least-squares weights of the maps (voxel, region, weight) in each frame.

    The maps' Gram matrix is small: its inverse turns the maps into one set of voxel weights, so that
    a frame's answer is a single weighted sum.
    """
    used = maps if mask is None else maps.join(mask.select("voxel").distinct(), "voxel", "left_semi")
    a, b = used.alias("a"), used.alias("b")
    gram = a.join(b, F.col("a.voxel") == F.col("b.voxel")).groupBy(F.col("a.region").alias("i"), F.col("b.region").alias("j")).agg(F.sum(F.col("a.weight") * F.col("b.weight")).alias("g")).collect()
    names = sorted({r["i"] for r in gram})
    at = {n: k for k, n in enumerate(names)}
    matrix = np.zeros((len(names), len(names)))
    for r in gram:
        matrix[at[r["i"]], at[r["j"]]] = r["g"]
    inverse = np.linalg.pinv(matrix)
    rows = [(names[i], names[j], float(inverse[i, j])) for i in range(len(names)) for j in range(len(names)) if abs(inverse[i, j]) > 1e-15]
    table = signal.sparkSession.createDataFrame(rows, "col string, region string, w double")
    weights = used.join(table, "region").groupBy("voxel", "col").agg(F.sum(F.col("weight") * F.col("w")).alias("w"))
    frames = signal.join(weights, "voxel").groupBy(*keys, "timepoint", "col").agg(F.sum(F.col("value") * F.col("w")).alias("value"))
    return over_time(frames, time_method, time_method_params, keys)


def temporal_snr(signal: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean over deviation of every voxel's series, as a signal of one frame; constant voxels are null."""
    deviation = F.stddev_pop("value")
    return signal.groupBy(*keys, "voxel").agg(F.try_divide(F.avg("value"), deviation).alias("value")).withColumn("timepoint", F.lit(0))


def with_index(frames: DataFrame, labels: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """Adds idx, the label's place."""
    return frames.withColumn("idx", F.array_position(F.array(*map(F.lit, labels)), F.col("col")).cast("int") - 1)
