"""Reference data as dimension tables: parcellations, coordinates, maps, masks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcelkit.model import key_columns, key_schema
from parcelkit.sources import readers

KINDS = ("parcellation", "coordinates", "maps", "mask", "grid")
_COLUMNS = {"parcellation": ("voxel", "parcel_id", "label"), "coordinates": ("seed", "x", "y", "z"), "maps": ("voxel", "region", "weight"), "mask": ("voxel",), "grid": ("voxel", "x", "y", "z")}
_data: dict[str, dict[str, Callable[[SparkSession], DataFrame]]] = {k: {} for k in KINDS}
_built_in: set[tuple[str, str]] = set()


def _known(kind: str) -> None:
    if kind not in KINDS:
        raise ValueError(f"no such kind: {kind}; there are {list(KINDS)}")


def register_data(kind: str, name: str, provider: Callable[[SparkSession], DataFrame] | str, overwrite: bool = False, built_in: bool = False, labels: str | Sequence[str] | None = None) -> None:
    """Names a dimension table, or a file that holds one; what is built in can't be replaced.

    ``labels`` name the regions of an image: a list, or a file of one label a line.
    """
    _known(kind)
    if (kind, name) in _built_in:
        raise ValueError(f"{name} is built in")
    if name in _data[kind] and not overwrite:
        raise ValueError(f"{name} is registered already")
    _data[kind][name] = (lambda spark: read_data(spark, kind, provider, labels)) if isinstance(provider, str) else provider
    if built_in:
        _built_in.add((kind, name))


def deregister_data(kind: str, name: str) -> None:
    _known(kind)
    if (kind, name) in _built_in:
        raise ValueError(f"{name} is built in")
    if name not in _data[kind]:
        raise ValueError(f"no {kind} called {name}")
    del _data[kind][name]


def list_data(kind: str) -> list[str]:
    _known(kind)
    return sorted(_data[kind])


def load_data(kind: str, name: str, spark: SparkSession) -> DataFrame:
    """The table of that name, or in that file, with the columns of its kind."""
    _known(kind)
    if name in _data[kind]:
        return _data[kind][name](spark).select(*_COLUMNS[kind])
    if readers.extension(name):
        return read_data(spark, kind, name)
    raise ValueError(f"no {kind} called {name}; there are {list_data(kind)}")


def read_data(spark: SparkSession, kind: str, path: str, labels: str | Sequence[str] | None = None) -> DataFrame:
    """A dimension table from a file: a table with the kind's columns, or an image.

    An image's values are the ids of a parcellation (0 is none), a mask where they are above 0, and
    the weights of maps, one map a frame; as a grid its voxels have their places. Regions without
    ``labels`` are called by their ids. The number of labels must be that of the regions.
    """
    if not readers.is_image(path):
        return readers.read(spark, path).select(*_COLUMNS[kind])
    image = readers.nifti(spark, path)
    if kind == "mask":
        return image.where("value > 0").select("voxel").distinct()
    if kind == "grid":
        return image.where("timepoint = 0").select("voxel", "x", "y", "z")
    if kind == "coordinates":
        raise ValueError("coordinates come from a table")
    if isinstance(labels, str):
        labels = [r["value"].strip() for r in spark.read.text(labels, wholetext=False).collect()]  # one line for each region
    if kind == "maps":
        named = image.where("value <> 0").select("voxel", F.col("timepoint").alias("place"), F.col("value").alias("weight"))
        if labels is None:
            return named.select("voxel", F.concat(F.lit("map_"), F.col("place").cast("string")).alias("region"), "weight")
        names = spark.createDataFrame(list(enumerate(labels)), "place int, region string")
        return named.join(names, "place").select("voxel", "region", "weight")
    parcels = image.where("value <> 0").select("voxel", F.col("value").cast("int").alias("parcel_id"))
    if labels is None:
        return parcels.select("voxel", "parcel_id", F.col("parcel_id").cast("string").alias("label"))
    check_parcellation(parcels, labels)
    return label_parcels(parcels, spark.createDataFrame(list(enumerate(labels)), "place int, label string"))


def _mean_above(signal: DataFrame, lower: float = 0.2) -> DataFrame:
    return quantile_mask(signal, lower)


#: Masks that are computed from a signal, by name; each takes the signal and its parameters.
MASK_FUNCTIONS: dict[str, Callable[..., DataFrame]] = {"quantile_mask": _mean_above}


def mask_of(spec: object, spark: SparkSession, signal: DataFrame | None = None, inherit: DataFrame | None = None, grid: DataFrame | None = None) -> DataFrame:
    """A mask (voxel) as specified: a table, a name, {name: parameters}, or a list of these.

    A name is a registered mask, a file, a function of MASK_FUNCTIONS that computes the mask from the
    signal, or 'inherit', the mask that belongs to the data. Several masks are intersected; a list may
    hold {'threshold': share} and {'connected': true} for that, which are an error beside one mask.
    """
    masks, how = [], {}
    for item in spec if isinstance(spec, list | tuple) else [spec]:
        if isinstance(item, DataFrame):
            masks.append(item.select("voxel").distinct())
            continue
        if isinstance(item, dict) and len(item) != 1:
            raise ValueError(f"one mask to an entry, not {sorted(item)}")
        name, params = next(iter(item.items())) if isinstance(item, dict) else (item, None)
        if name in ("threshold", "connected"):
            how[name] = params
        elif name == "inherit":
            if inherit is None or params:
                raise ValueError("there is no mask to inherit" if inherit is None else "an inherited mask takes no parameters")
            masks.append(inherit.select("voxel").distinct())
        elif name in MASK_FUNCTIONS:
            if signal is None:
                raise ValueError(f"{name} needs a signal")
            masks.append(MASK_FUNCTIONS[name](signal, **(params or {})))
        else:
            if params:
                raise ValueError(f"{name} takes no parameters")
            masks.append(load_data("mask", name, spark))
    if not masks:
        raise ValueError("no mask is given")
    if len(masks) == 1:
        if how:
            raise ValueError(f"{sorted(how)} need several masks")
        return masks[0]
    return intersect_masks(masks, **how, grid=grid)


def check_parcellation(parcels: DataFrame, labels: Sequence[str]) -> None:
    n = parcels.where("parcel_id <> 0").agg(F.count_distinct("parcel_id")).first()[0]
    if n != len(labels):
        raise ValueError(f"{n} parcels but {len(labels)} labels")


def label_parcels(parcels: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels (place from 0, label) by the order of the ids, which may have gaps."""
    ids = parcels.where("parcel_id <> 0").select("parcel_id").distinct()
    ranked = ids.withColumn("place", F.row_number().over(Window.orderBy("parcel_id")) - 1)  # one row for each parcel
    return parcels.join(ranked.join(labels, "place").select("parcel_id", "label"), "parcel_id").select("voxel", "parcel_id", "label")


def merge_parcellations(named: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """One parcellation of several; a voxel belongs to the first that has it.

    Labels that occur in more than one get their parcellation's name before them; ids move past those
    of the parcellations before.
    """
    parts = [p.select("voxel", "parcel_id", "label", F.lit(k).alias("rank"), F.lit(name).alias("source")) for k, (name, p) in enumerate(named)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    twice = every.select("label", "rank").distinct().groupBy("label").agg(F.count("*").alias("n")).where("n > 1").select("label", F.lit(True).alias("twice"))
    highest = every.agg(F.max("parcel_id").alias("highest"))
    first = F.row_number().over(Window.partitionBy("voxel").orderBy("rank"))
    kept = every.withColumn("first", first).where("first = 1").join(twice, "label", "left")
    return kept.join(F.broadcast(highest)).select(
        "voxel", (F.col("parcel_id") + F.col("rank") * F.col("highest")).cast("int").alias("parcel_id"),
        F.when(F.col("twice"), F.concat_ws("_", "source", "label")).otherwise(F.col("label")).alias("label"),
    )


def closest_resolution(wanted: Column, available: Sequence[float]) -> Column:
    """The largest available that isn't above the wanted one, else the smallest."""
    values = F.array(*[F.lit(float(v)) for v in sorted(available)])
    return F.coalesce(F.array_max(F.filter(values, lambda v: v <= wanted)), F.array_min(values))


def intersect_masks(masks: Sequence[DataFrame], threshold: float = 0.5, connected: bool = False, grid: DataFrame | None = None) -> DataFrame:
    """Voxels in at least the given share of masks: 1 is the intersection, 0 the union."""
    if not 0 <= threshold <= 1:
        raise ValueError("the threshold lies between 0 and 1")
    every = masks[0].select("voxel").distinct()
    for m in masks[1:]:
        every = every.unionByName(m.select("voxel").distinct())
    found = every.groupBy("voxel").agg((F.count("*") / F.lit(float(len(masks)))).alias("share")).where(F.col("share") >= threshold).select("voxel")
    return largest_component(found, grid) if connected else found


def largest_component(mask: DataFrame, grid: DataFrame) -> DataFrame:
    """The largest face-connected part of a mask (the one with the smallest voxel on a tie).

    Labels spread to neighbours and each round also jumps to its label's label, so rounds grow with
    the logarithm of the part's extent; every few rounds the lineage is cut.
    """
    cells = mask.join(grid, "voxel")
    step = F.explode(F.array(*[F.struct(*[F.lit(d).alias(c) for c, d in zip("abc", v, strict=True)]) for v in ((1, 0, 0), (0, 1, 0), (0, 0, 1))]))
    moved = cells.select(F.col("voxel").alias("u"), "x", "y", "z", step.alias("s")).select("u", (F.col("x") + F.col("s.a")).alias("x"), (F.col("y") + F.col("s.b")).alias("y"), (F.col("z") + F.col("s.c")).alias("z"))
    one = moved.join(cells.withColumnRenamed("voxel", "v"), ["x", "y", "z"]).select("u", "v")
    both = _cut(one.unionByName(one.select(F.col("v").alias("u"), F.col("u").alias("v"))))
    label = _cut(cells.select("voxel", F.col("voxel").alias("label")))
    while True:
        near = both.join(label, both["v"] == label["voxel"]).groupBy("u").agg(F.min("label").alias("m"))
        new = label.join(near, label["voxel"] == near["u"], "left").select("voxel", F.least("label", F.coalesce("m", "label")).alias("label"), F.col("label").alias("old"))
        jump = new.select(F.col("voxel").alias("label"), F.col("label").alias("further"))
        new = _cut(new.join(jump, "label").select("voxel", "old", F.least("label", "further").alias("label")))
        done = new.where("label <> old").limit(1).count() == 0
        label = new.select("voxel", "label")
        if done:
            break
    largest = label.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(1)
    return label.join(largest, "label", "left_semi").select("voxel")


def _cut(df: DataFrame) -> DataFrame:
    from parcelkit.plans.lineage import cut

    return cut(df)


def brain_mask(template: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Voxels whose probability in the template (voxel, probability) reaches the threshold."""
    return template.where(F.col("probability") >= threshold).select("voxel")


def quantile_mask(image: DataFrame, lower: float = 0.2) -> DataFrame:
    """Voxels whose mean value lies above a quantile of all voxels' means."""
    mean = image.groupBy("voxel").agg(F.avg("value").alias("m"))
    cut = mean.agg(F.percentile("m", lower).alias("cut"))
    return mean.join(F.broadcast(cut)).where("m > cut").select("voxel")


def transform_coordinates(points: DataFrame, affine: Sequence[Sequence[float]]) -> DataFrame:
    """Points (x, y, z) under an affine map of three rows and four columns."""
    moved = {c: sum((F.lit(float(row[k])) * F.col(n) for k, n in enumerate("xyz")), F.lit(float(row[3]))) for c, row in zip("xyz", affine, strict=True)}
    return points.select(*[moved[c].alias(c) if c in moved else F.col(c) for c in points.columns])


def warp(values: DataFrame, lookup: DataFrame) -> DataFrame:
    """Values (voxel, ...) in another space, by a table (voxel, target) of nearest voxels."""
    return values.join(lookup, "voxel").drop("voxel").withColumnRenamed("target", "voxel")


#: Voxels of a grid that values are resampled to, at most; it goes to every worker, 28 bytes a voxel.
MOST_VOXELS = 4_000_000


def resample(values: DataFrame, grid: DataFrame, target: DataFrame, affine: Sequence[Sequence[float]], method: str | None = None, keys: Sequence[str] = ("element",)) -> DataFrame:
    """Values (keys, timepoint, voxel, value) on another grid, where ``affine`` takes the target's places to the source's.

    ``method`` is nearest or continuous (linear between the eight cells around); by default it is found
    by interpolation(), one job. Both grids have whole-numbered places. Places outside the source, or
    beside a missing value, are left out. One frame goes to one task.
    """
    method = method or interpolation(values)
    if method not in ("nearest", "continuous"):
        raise ValueError(f"no such interpolation: {method}")
    if target.count() > MOST_VOXELS:
        raise ValueError(f"a grid to resample to has at most {MOST_VOXELS} voxels")
    wanted = transform_coordinates(target.select("voxel", *"xyz"), affine).toArrow()  # sent with the kernel, its size is checked
    ids, places = wanted.column("voxel").to_numpy(), np.stack([wanted.column(c).to_numpy() for c in "xyz"])
    placed = values.join(grid.select("voxel", *[F.col(c).cast("int").alias(c) for c in "xyz"]), "voxel")
    given = placed.select(*keys, "timepoint", "x", "y", "z", F.col("value").cast("double").alias("value"))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        cells = [table.column(c).to_numpy() for c in "xyz"]
        low = np.array([c.min() for c in cells])
        volume = np.full([int(c.max() - m) + 3 for c, m in zip(cells, low, strict=True)], np.nan)  # a margin of missing cells
        volume[tuple(c - m + 1 for c, m in zip(cells, low, strict=True))] = table.column("value").to_numpy(zero_copy_only=False)
        at = places - low[:, None] + 1
        top = np.array(volume.shape)[:, None] - 1
        if method == "nearest":
            out = volume[tuple(np.clip(np.floor(at + 0.5).astype(int), 0, top))]
        else:
            base = np.clip(np.floor(at).astype(int), 0, top)
            part, out = np.clip(at - base, 0, 1), np.zeros(at.shape[1])
            for corner in np.ndindex(2, 2, 2):
                step = np.array(corner)[:, None]
                weight = np.prod(np.where(step, part, 1 - part), axis=0)
                near = volume[tuple(np.minimum(base + step, top))]
                out += np.where(weight > 0, weight * near, 0)
            out[((at < 0) | (at > top)).any(axis=0)] = np.nan
        there = ~np.isnan(out)
        return pa.table(key_columns(key, table.schema, int(there.sum())) | {"voxel": pa.array(ids[there]), "value": pa.array(out[there])})

    return given.groupBy(*keys, "timepoint").applyInArrow(run, f"{key_schema(given, [*keys, 'timepoint'])}, voxel int, value double")


def warper_for(specs: Sequence[dict], source: str, target: str) -> dict:
    """The one transform from source to target."""
    found = [s for s in specs if s["src"] == source and s["dst"] == target]
    if len(found) != 1:
        raise ValueError(f"{len(found)} transforms from {source} to {target}")
    return found[0]


def interpolation(values: DataFrame) -> str:
    """'nearest' for values of just 0 and 1, else 'continuous'."""
    other = values.where(~F.col("value").isin(0.0, 1.0)).limit(1).count()
    both = values.select("value").distinct().limit(3).count() if not other else 0
    return "nearest" if not other and both == 2 else "continuous"
