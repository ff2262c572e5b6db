"""Preprocessing: time slices, detrending, filtering, confounds, smoothing."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelkit.model import key_columns, key_schema

from .volumes import blurred, by_frame

KEYS = ("element",)


def slice_bounds(n_frames: int, start: float, stop: float | None, duration: float | None, t_r: float) -> tuple[int, int]:
    """First frame and the one after the last, of seconds.

    An end that isn't given, or a negative one, is counted in frames before it is divided by t_r like
    seconds are: with t_r 2 and start 2, a table of 168 frames ends at frame 84.
    """
    if start == 0 and stop in (None, -1, n_frames):
        raise ValueError("the slice is everything: leave the step out")
    if duration is not None and stop is not None:
        raise ValueError("give stop or duration")
    if stop is None:
        stop = start + duration if duration is not None else n_frames
    elif stop < 0:
        stop = n_frames + 1 + stop
    first, last = int(start // t_r), int(stop // t_r)
    if last > n_frames:
        raise IndexError(f"the slice ends at {last} of {n_frames} frames")
    return first, last


def slice_time(frames: DataFrame, first: int, last: int) -> DataFrame:
    """Frames first .. last - 1, counted from 0 again; the same call slices confounds."""
    return frames.where((F.col("timepoint") >= first) & (F.col("timepoint") < last)).withColumn("timepoint", F.col("timepoint") - first)


def detrend(signal: DataFrame, by: str = "voxel", keys: Sequence[str] = KEYS) -> DataFrame:
    """Residuals of each series' linear trend."""
    w = Window.partitionBy(*keys, by)
    t, v = F.col("timepoint").cast("double"), F.col("value")
    slope = F.coalesce(F.try_divide(F.covar_pop(v, t).over(w), F.var_pop(t).over(w)), F.lit(0.0))
    return signal.withColumn("value", v - F.avg(v).over(w) - slope * (t - F.avg(t).over(w)))


def standardise(signal: DataFrame, by: str = "voxel", keys: Sequence[str] = KEYS) -> DataFrame:
    """Each series over its mean and sample deviation; a constant series becomes 0."""
    w = Window.partitionBy(*keys, by)
    v = F.col("value")
    return signal.withColumn("value", F.coalesce(F.try_divide(v - F.avg(v).over(w), F.stddev_samp(v).over(w)), F.lit(0.0)))


def _per_group(df: DataFrame, group: Sequence[str], kernel) -> DataFrame:
    """Replaces value by kernel(sorted values) in each group; other columns stay."""

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("timepoint").to_numpy(), kind="stable")
        out = np.empty(len(order))
        out[order] = kernel(table.column("value").to_numpy()[order])
        return table.set_column(table.schema.get_field_index("value"), "value", pa.array(out))

    return df.groupBy(*group).applyInArrow(run, df.schema)


def band_pass(signal: DataFrame, low_pass: float | None, high_pass: float | None, t_r: float, by: str = "voxel", keys: Sequence[str] = KEYS, order: int = 5) -> DataFrame:
    """Zero-phase filter: the spectrum times the squared gain of Butterworth filters of ``order``."""

    def kernel(x: np.ndarray) -> np.ndarray:
        f = np.fft.rfftfreq(len(x), t_r)
        gain = np.ones(len(f))
        if low_pass is not None:
            gain /= 1 + (f / low_pass) ** (2 * order)
        if high_pass is not None:
            gain *= np.where(f > 0, 1 / (1 + (high_pass / np.maximum(f, 1e-12)) ** (2 * order)), 0)
        return np.fft.irfft(np.fft.rfft(x) * gain, len(x))

    return _per_group(signal, [*keys, by], kernel)


def temporal_filter(signal: DataFrame, detrended: bool = True, standardised: bool = True, low_pass: float | None = None, high_pass: float | None = None, t_r: float = 1.0, by: str = "voxel", keys: Sequence[str] = KEYS, mask: DataFrame | None = None) -> DataFrame:
    """Detrends, filters and standardises, in this order; the mask limits voxels."""
    if mask is not None:
        signal = signal.join(mask.select("voxel").distinct(), "voxel", "left_semi")
    if detrended:
        signal = detrend(signal, by, keys)
    if low_pass is not None or high_pass is not None:
        signal = band_pass(signal, low_pass, high_pass, t_r, by, keys)
    return standardise(signal, by, keys) if standardised else signal


#: The confounds behind each part of a strategy.
CONFOUNDS = {
    "motion": ["trans_x", "trans_y", "trans_z", "rot_x", "rot_y", "rot_z"],
    "wm_csf": ["csf", "white_matter"],
    "global_signal": ["global_signal"],
}


def confound_plan(strategy: dict[str, str], available: Sequence[str]) -> dict[str, list[str]]:
    """Columns to take, and squares and derivatives to make, for a strategy such as {'motion': 'full'}.

    Parts are motion, wm_csf and global_signal; terms are basic, power2, derivatives and full.
    """
    there, plan = set(available), {"select": [], "derivatives": [], "squares": []}
    for part, terms in strategy.items():
        if part not in CONFOUNDS or terms not in ("basic", "power2", "derivatives", "full"):
            raise ValueError(f"no such strategy: {part} {terms}")
        for c in CONFOUNDS[part]:
            if c not in there:
                raise ValueError(f"{c} is missing")
            wanted = [c]
            if terms in ("derivatives", "full"):
                wanted.append(f"{c}_derivative1")
            if terms in ("power2", "full"):
                wanted += [f"{w}_power2" for w in list(wanted)]
            plan["select"] += wanted
            for w in wanted:
                if w not in there:
                    plan["squares" if w.endswith("_power2") else "derivatives"].append(w)
                    source = w.removesuffix("_power2")
                    if w.endswith("_power2") and source.endswith("_derivative1") and source not in there and source not in plan["derivatives"]:
                        plan["derivatives"].append(source)
    return plan


def rename_confounds(confounds: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Columns of another format under their usual names."""
    return confounds.withColumnsRenamed(mapping)


def pick_confounds(confounds: DataFrame, plan: dict[str, list[str]], spike: float | None = None, fd: str = "framewise_displacement", keys: Sequence[str] = KEYS) -> DataFrame:
    """The planned confounds: derivatives first, then squares, then a column that marks spikes.

    A first frame without a value takes that of the second.
    """
    order = Window.partitionBy(*keys).orderBy("timepoint")
    out = confounds
    for d in plan["derivatives"]:
        c = F.col(d.removesuffix("_derivative1"))
        out = out.withColumn(d, c - F.lag(c).over(order))
    for s in plan["squares"]:
        c = F.col(s.removesuffix("_power2"))
        out = out.withColumn(s, c * c)
    columns = list(plan["select"])
    if spike is not None:
        out = out.withColumn("spike", F.when(F.nanvl(F.col(fd), F.lit(0.0)) > spike, 1.0).otherwise(0.0))
        columns.append("spike")
    filled = [F.when((F.col("timepoint") == 0) & (F.col(c).isNull() | F.isnan(c)), F.lead(c).over(order)).otherwise(F.col(c)).alias(c) for c in columns]
    return out.select(*keys, "timepoint", *filled)


def scrub(confounds: DataFrame, fd_threshold: float = 0.5, dvars_threshold: float = 1.5, segment: int = 0, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, timepoint) of the frames to keep: calm ones, in runs of at least ``segment`` frames.

    A missing measure (null or NaN, as in a first frame) is calm.
    """
    above = lambda c, most: F.coalesce(F.nanvl(F.col(c), F.lit(None).cast("double")) > most, F.lit(False))
    noisy = above("framewise_displacement", fd_threshold) | above("std_dvars", dvars_threshold)
    calm = confounds.where(~noisy).select(*keys, "timepoint")
    if segment <= 0:
        return calm
    run = F.col("timepoint") - F.row_number().over(Window.partitionBy(*keys).orderBy("timepoint"))
    sized = calm.withColumn("run", run).withColumn("n", F.count("*").over(Window.partitionBy(*keys, "run")))
    return sized.where(F.col("n") >= segment).select(*keys, "timepoint")


def regress_one(signal: DataFrame, confound: DataFrame, by: str = "voxel", keys: Sequence[str] = KEYS) -> DataFrame:
    """Residuals of each series on a single confound (keys, timepoint, x) and a constant."""
    joined = signal.join(confound.select(*keys, "timepoint", "x"), [*keys, "timepoint"]).where("x IS NOT NULL")
    w = Window.partitionBy(*keys, by)
    slope = F.coalesce(F.try_divide(F.covar_pop("value", "x").over(w), F.var_pop("x").over(w)), F.lit(0.0))
    rest = F.col("value") - F.avg("value").over(w) - slope * (F.col("x") - F.avg("x").over(w))
    return joined.select(*keys, by, "timepoint", rest.alias("value"))


def _projections(confounds: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """(keys, timepoint, q): an orthonormal basis of each element's confounds and a constant, frame by frame.

    ``q`` has len(columns) + 1 numbers; those beyond the rank are 0.
    """
    given = confounds.select(*keys, "timepoint", F.array(*[F.col(c).cast("double") for c in columns]).alias("x"))
    given = given.where(~F.exists("x", lambda v: v.isNull() | F.isnan(v)))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        x = np.array(table.column("x").to_pylist(), float).reshape(table.num_rows, -1)
        x = x - x.mean(axis=0)
        scale = np.linalg.norm(x, axis=0)
        u, size, _ = np.linalg.svd(x / np.where(scale > 0, scale, 1), full_matrices=False)
        q = np.zeros((len(x), len(columns) + 1))
        rank = int((size > 1e-10 * max(1.0, size.max(initial=0))).sum())
        q[:, :rank], q[:, -1] = u[:, :rank], 1 / np.sqrt(len(x))
        return pa.table(key_columns(key, table.schema, len(x)) | {"timepoint": table.column("timepoint"), "q": pa.array(q.tolist(), pa.list_(pa.float64()))})

    return given.groupBy(*keys).applyInArrow(run, f"{key_schema(given, [*keys, 'timepoint'])}, q array<double>")


def remove_confounds(signal: DataFrame, confounds: DataFrame, by: str = "voxel", keys: Sequence[str] = KEYS) -> DataFrame:
    """Residuals of each series on all confounds (keys, timepoint, columns) and a constant.

    An element's confounds are made orthonormal once; then a series' coefficients are plain sums of
    products, and only they travel. Frames without a whole set of confounds are left out, and confounds
    of frames that the signal doesn't have. A series must have all frames of its element.
    """
    columns = [c for c in confounds.columns if c not in (*keys, "timepoint")]
    frames = signal.select(*keys, "timepoint").distinct()
    basis = _projections(confounds.join(frames, [*keys, "timepoint"], "left_semi"), columns, keys)
    joined = signal.select(*keys, by, "timepoint", "value").join(basis, [*keys, "timepoint"])
    parts = range(len(columns) + 1)
    fitted = joined.groupBy(*keys, by).agg(*[F.sum(F.col("value") * F.col("q")[k]).alias(f"_c{k}") for k in parts])
    rest = F.col("value") - sum((F.col("q")[k] * F.col(f"_c{k}") for k in parts), F.lit(0.0))
    return joined.join(fitted, [*keys, by]).select(*keys, by, "timepoint", rest.alias("value"))


def check_confounds(signal: DataFrame, confounds: DataFrame, columns: Sequence[str], keys: Sequence[str] = KEYS) -> None:
    """Raises unless every column is there and signal and confounds have the same number of frames in each element."""
    if missing := [c for c in columns if c not in confounds.columns]:
        raise ValueError(f"confounds lack {missing}")
    n = lambda df, name: df.select(*keys, "timepoint").distinct().groupBy(*keys).agg(F.count("*").alias(name))
    counted = n(signal, "frames").join(n(confounds, "rows"), list(keys), "left")
    if wrong := counted.where("rows IS NULL OR frames <> rows").limit(1).collect():
        raise ValueError(f"{wrong[0]['frames']} frames but {wrong[0]['rows']} rows of confounds: {wrong[0].asDict()}")


def confound_remover(
    signal: DataFrame, confounds: DataFrame, strategy: dict[str, str] | None = None, spike: float | None = None, scrub_segment: int | None = None, fd_threshold: float = 0.5,
    std_dvars_threshold: float = 1.5, detrended: bool = True, standardised: bool = True, low_pass: float | None = None, high_pass: float | None = None, t_r: float = 1.0,
    mask: DataFrame | None = None, by: str = "voxel", keys: Sequence[str] = KEYS, validate: bool = True,
) -> DataFrame:
    """Removes confounds from every series.

    In this order: checks, choice and derivation of the confounds by ``strategy`` (all parts in full by
    default), a spike column, scrubbing of signal and confounds alike (``scrub_segment`` frames in a row
    at least), detrending of both, filtering of both, residuals, standardisation. The mask limits voxels.
    """
    strategy = {part: "full" for part in CONFOUNDS} if strategy is None else strategy
    plan = confound_plan(strategy, confounds.columns)
    needed = [c for part in strategy for c in CONFOUNDS[part]] + (["framewise_displacement"] if spike is not None or scrub_segment is not None else []) + (["std_dvars"] if scrub_segment is not None else [])
    if validate:
        check_confounds(signal, confounds, needed, keys)
    if mask is not None:
        signal = signal.join(mask.select("voxel").distinct(), "voxel", "left_semi")
    picked = pick_confounds(confounds, plan, spike, keys=keys)
    signal = signal.select(*keys, by, "timepoint", "value")
    if scrub_segment is not None:
        kept = scrub(confounds, fd_threshold, std_dvars_threshold, scrub_segment, keys)
        signal, picked = (df.join(kept, [*keys, "timepoint"], "left_semi") for df in (signal, picked))
    if detrended or low_pass is not None or high_pass is not None:
        columns = [c for c in picked.columns if c not in (*keys, "timepoint")]
        long = picked.unpivot([*keys, "timepoint"], columns, "col", "value").where("value IS NOT NULL AND NOT isnan(value)")
        long = temporal_filter(long, detrended, False, low_pass, high_pass, t_r, "col", keys)
        picked = long.groupBy(*keys, "timepoint").pivot("col", columns).agg(F.first("value"))
        signal = temporal_filter(signal, detrended, False, low_pass, high_pass, t_r, by, keys)
    rest = remove_confounds(signal, picked, by, keys)
    return standardise(rest, by, keys) if standardised else rest


def smooth(signal: DataFrame, grid: DataFrame, fwhm: float, voxel_size: float = 1.0, truncate: float = 4.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """Gaussian smoothing; weights outside the grid, or beyond ``truncate`` deviations, are left out and the rest sum to 1.

    Each frame is smoothed as a volume, one axis after the other.
    """
    sigma = fwhm / math.sqrt(8 * math.log(2)) / voxel_size
    reach = int(truncate * sigma + 0.5)
    weights = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma * sigma))

    def kernel(cells: tuple, values: list, shape: tuple) -> list:
        there = ~np.isnan(values[0])
        return [blurred(cells, np.where(there, values[0], 0), shape, weights) / blurred(cells, there.astype(float), shape, weights)]

    return by_frame(signal, grid, ["value"], kernel, ["value"], keys)
