"""Markers: named computations from a signal to features of declared kinds.

A marker's regions are given as tables, or by name: of a registered parcellation, list of coordinates,
set of maps, or of a file that holds one. Names are looked up when the marker runs, so a marker can be
written in a configuration file.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelkit.operators import aggregate, complexity, connectivity, dims, reho, shapes, spectral

from .registry import register

Keys = Sequence[str]


@dataclass
class Marker:
    """``compute(signal, keys)`` gives {feature: DataFrame}; ``kinds`` says what each feature is."""

    name: str
    kinds: dict[str, str]
    compute: Callable[[DataFrame, Keys], dict[str, DataFrame]]
    on: Sequence[str] = ("BOLD",)
    params: dict = field(default_factory=dict)
    dependencies: Sequence[str] = ()
    programs: Sequence[str] = ()

    def features(self, signal: DataFrame, keys: Keys = ("element",)) -> dict[str, tuple[str, DataFrame]]:
        out = self.compute(signal, keys)
        if set(out) != set(self.kinds):
            raise ValueError(f"{self.name} declares {sorted(self.kinds)} but gives {sorted(out)}")
        return {f: (self.kinds[f], df) for f, df in out.items()}


def _table(kind: str, given: DataFrame | str | Sequence[str], signal: DataFrame) -> DataFrame:
    """A dimension table as it is, or by its name; several parcellations are merged."""
    if isinstance(given, DataFrame):
        return given
    names = [given] if isinstance(given, str) else list(given)
    tables = [dims.load_data(kind, n, signal.sparkSession) for n in names]
    if len(tables) > 1 and kind != "parcellation":
        raise ValueError(f"only one {kind} can be given")
    return tables[0] if len(tables) == 1 else dims.merge_parcellations(list(zip(names, tables, strict=True)))


class Regions:
    """Parcels, spheres or maps that a signal is aggregated over."""

    def __init__(self, kind: str, data: dict, labels: Sequence[str] | None = None, masks: object = None, **how):
        if kind not in ("parcels", "spheres", "maps"):
            raise ValueError(f"no such regions: {kind}")
        self.kind, self.data, self._labels, self.masks, self.how = kind, data, labels, masks, how

    def grid(self, signal: DataFrame) -> DataFrame:
        return _table("grid", self.data["grid"], signal)

    def frames(self, signal: DataFrame, keys: Keys) -> DataFrame:
        how = dict(self.how)
        if self.masks is not None:
            how["mask"] = dims.mask_of(self.masks, signal.sparkSession, signal=signal)
        if self.kind == "parcels":
            return aggregate.parcel_aggregation(signal, _table("parcellation", self.data["parcels"], signal), keys=keys, **how)
        if self.kind == "spheres":
            return aggregate.sphere_aggregation(signal, self.grid(signal), _table("coordinates", self.data["seeds"], signal), keys=keys, **how)
        return aggregate.maps_aggregation(signal, _table("maps", self.data["maps"], signal), keys=keys, **how)

    def labels(self, signal: DataFrame) -> list[str]:
        """The regions' names in their order: by id, or as the names sort."""
        if self._labels is not None:
            return list(self._labels)
        if self.kind == "parcels":
            table = _table("parcellation", self.data["parcels"], signal).select("parcel_id", "label").distinct().orderBy("parcel_id", "label")
            return [r["label"] for r in table.collect()]  # one row for each region
        column, kind = ("seed", "coordinates") if self.kind == "spheres" else ("region", "maps")
        return [r[0] for r in _table(kind, self.data["seeds" if self.kind == "spheres" else "maps"], signal).select(column).distinct().orderBy(column).collect()]

    def series(self, signal: DataFrame, keys: Keys) -> DataFrame:
        return aggregate.with_index(self.frames(signal, keys), self.labels(signal), keys)


def _described(**params) -> dict:
    """Parameters for the catalog: tables are named by their columns only."""
    return {k: f"table({', '.join(v.columns)})" if isinstance(v, DataFrame) else _described(**v) if isinstance(v, dict) else v for k, v in params.items() if v is not None}


@register("marker")
def aggregation(name: str, regions: str, dims: dict, on: Sequence[str] = ("BOLD",), **how) -> Marker:
    """Parcel, sphere or map aggregation."""
    of = Regions(regions, dims, **how)
    kind = "vector" if how.get("time_method") else "timeseries"
    return Marker(name, {"aggregation": kind}, lambda s, keys: {"aggregation": of.frames(s, keys)}, on, _described(regions=regions, **dims, **how))


@register("marker")
def functional_connectivity(name: str, regions: str, dims: dict, labels: Sequence[str] | None = None, conn_method: str = "correlation", shrink: bool = False, edges: bool = False, on: Sequence[str] = ("BOLD",), **how) -> Marker:
    """Connectivity between regions, or between their edge series; the tangent space is that of all elements."""
    of = Regions(regions, dims, labels, **how)

    def compute(s: DataFrame, keys: Keys) -> dict[str, DataFrame]:
        series = of.series(s, keys)
        if conn_method == "tangent":
            found = connectivity.tangent(connectivity.edge_series(series, keys) if edges else series, keys)
        elif edges:
            found = connectivity.edge_connectivity(series, conn_method, keys)
        else:
            found = connectivity.matrix(series, conn_method, shrink, keys)
        return {"functional_connectivity": found}

    return Marker(name, {"functional_connectivity": "matrix"}, compute, on, _described(regions=regions, conn_method=conn_method, shrink=shrink, edges=edges, **dims, **how))


@register("marker")
def cross_parcellation(name: str, one: DataFrame | str, two: DataFrame | str, labels_one: Sequence[str] | None = None, labels_two: Sequence[str] | None = None, corr_method: str = "pearson", on: Sequence[str] = ("BOLD",), **how) -> Marker:
    if isinstance(one, str) and one == two or labels_one is not None and labels_two is not None and list(labels_one) == list(labels_two):
        raise ValueError("the parcellations are the same")
    sides = Regions("parcels", {"parcels": one}, labels_one, **how), Regions("parcels", {"parcels": two}, labels_two, **how)

    def compute(s: DataFrame, keys: Keys) -> dict[str, DataFrame]:
        return {"functional_connectivity": connectivity.cross(*(side.series(s, keys) for side in sides), corr_method, keys)}

    return Marker(name, {"functional_connectivity": "matrix"}, compute, on, _described(one=one, two=two, corr_method=corr_method, **how))


@register("marker")
def edge_rss(name: str, parcels: DataFrame | str, labels: Sequence[str] | None = None, on: Sequence[str] = ("BOLD",), **how) -> Marker:
    of = Regions("parcels", {"parcels": parcels}, labels, **how)
    return Marker(name, {"rss_ets": "timeseries"}, lambda s, keys: {"rss_ets": connectivity.edge_rss(of.series(s, keys), keys)}, on, _described(parcels=parcels, **how))


@register("marker")
def edge_time_series(name: str, regions: str, dims: dict, labels: Sequence[str] | None = None, on: Sequence[str] = ("BOLD",), **how) -> Marker:
    of = Regions(regions, dims, labels, **how)
    return Marker(name, {"ets": "timeseries"}, lambda s, keys: {"ets": connectivity.edge_series(of.series(s, keys), keys)}, on, _described(regions=regions, **dims, **how))


@register("marker")
def temporal_snr(name: str, regions: str, dims: dict, on: Sequence[str] = ("BOLD",), **how) -> Marker:
    of = Regions(regions, dims, **how)
    return Marker(name, {"tsnr": "vector"}, lambda s, keys: {"tsnr": of.frames(aggregate.temporal_snr(s, keys), keys).drop("timepoint")}, on, _described(regions=regions, **dims, **how))


@register("marker")
def alff(name: str, regions: str, dims: dict, highpass: float = 0.01, lowpass: float = 0.1, tr: float = 1.0, on: Sequence[str] = ("BOLD",), **how) -> Marker:
    of = Regions(regions, dims, **how)

    def compute(s: DataFrame, keys: Keys) -> dict[str, DataFrame]:
        voxels = spectral.alff(s, highpass, lowpass, tr, keys=keys)
        one = lambda c: voxels.select(*keys, "voxel", F.lit(0).alias("timepoint"), F.col(c).alias("value"))
        return {c: of.frames(one(c), keys).drop("timepoint") for c in ("alff", "falff")}

    return Marker(name, {"alff": "vector", "falff": "vector"}, compute, on, _described(regions=regions, highpass=highpass, lowpass=lowpass, tr=tr, **dims, **how))


@register("marker")
def regional_homogeneity(name: str, regions: str, dims: dict, nneigh: int = 27, on: Sequence[str] = ("BOLD",), **how) -> Marker:
    of = Regions(regions, dims, **how)
    compute = lambda s, keys: {"reho": of.frames(reho.reho(s, of.grid(s), nneigh, keys=keys), keys).drop("timepoint")}
    return Marker(name, {"reho": "vector"}, compute, on, _described(regions=regions, nneigh=nneigh, **dims, **how))


@register("marker")
def complexity_of(name: str, parcels: DataFrame | str, kind: str, on: Sequence[str] = ("BOLD",), **params) -> Marker:
    of = Regions("parcels", {"parcels": parcels})
    return Marker(name, {"complexity": "vector"}, lambda s, keys: {"complexity": complexity.complexity(of.frames(s, keys), kind, keys, **params)}, on, _described(parcels=parcels, kind=kind, **params))


@register("marker")
def shape_spectrum(name: str, vertices: DataFrame | str, n: int = 50, on: Sequence[str] = ("FreeSurfer",)) -> Marker:
    """Eigenvalues of surfaces: the signal has the triangles (a, b, c) of each element, ``vertices`` their places (a table or its path)."""

    def compute(s: DataFrame, keys: Keys) -> dict[str, DataFrame]:
        points = vertices if isinstance(vertices, DataFrame) else s.sparkSession.read.parquet(vertices)
        found = shapes.shape_spectrum(points, s, n, keys)
        sizes = found.select(*keys, "area", "volume").distinct()
        values = found.select(*keys, F.concat(F.lit("ev"), F.col("ev").cast("string")).alias("row"), F.lit("surface").alias("col"), "value")
        each = lambda c: sizes.select(*keys, F.lit(c).alias("col"), F.lit(0).alias("col_idx"), F.col(c).alias("value"))
        return {"eigenvalues": values, "areas": each("area"), "volumes": each("volume")}

    return Marker(name, {"eigenvalues": "scalar_table", "areas": "vector", "volumes": "vector"}, compute, on, _described(vertices=vertices, n=n))
