"""Transforms of stored features: graph measures, NaN policies, spectra of shapes.

A matrix feature is long: element keys, row, col, value, with both halves and the diagonal.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("element",)
POLICIES = ("bypass", "drop_element", "drop_rows", "drop_columns", "drop_symmetric")


def full_matrix(lower: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Both halves of a matrix of which one is stored."""
    other = lower.where("row <> col").select(*keys, F.col("col").alias("row"), F.col("row").alias("col"), "value")
    return lower.select(*keys, "row", "col", "value").unionByName(other)


def nan_policy(matrix: DataFrame, policy: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Leaves out elements, rows, columns, or nodes (as row and column) that have a missing value."""
    if policy not in POLICIES:
        raise ValueError(f"no such policy: {policy}")
    bad = matrix.where(F.col("value").isNull() | F.isnan("value"))
    if policy == "bypass":
        return matrix
    if policy == "drop_element":
        return matrix.join(bad.select(*keys).distinct(), list(keys), "left_anti")
    if policy in ("drop_rows", "drop_columns"):
        on = [*keys, "row" if policy == "drop_rows" else "col"]
        return matrix.join(bad.select(*on).distinct(), on, "left_anti")
    # An element's bad nodes, of which there are no more than regions, go along with its cells.
    missing, whole = F.col("value").isNull() | F.isnan("value"), Window.partitionBy(*keys)
    nodes = F.array_union(*[F.collect_set(F.when(missing, F.col(c))).over(whole) for c in ("row", "col")])
    return matrix.withColumn("_bad", nodes).where(~F.array_contains("_bad", F.col("row")) & ~F.array_contains("_bad", F.col("col"))).drop("_bad")


def degrees_und(matrix: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Number of edges of each node; the diagonal doesn't count."""
    edge = F.sum(((F.col("value") != 0) & (F.col("row") != F.col("col"))).cast("long"))
    return matrix.groupBy(*keys, F.col("row").alias("node")).agg(edge.cast("double").alias("value"))


def strengths_und(matrix: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Sum of each node's weights."""
    return matrix.groupBy(*keys, F.col("row").alias("node")).agg(F.sum("value").alias("value"))


def clustering_coef_wu(matrix: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Onnela's weighted clustering: summed cube roots of the triangles' weights over k (k - 1); 0 for k < 2."""
    root = F.signum("value") * F.pow(F.abs("value"), F.lit(1 / 3))
    e = matrix.where("row <> col AND value <> 0").select(*keys, "row", "col", root.alias("w"))
    a = e.select(*keys, F.col("row").alias("i"), F.col("col").alias("j"), F.col("w").alias("wa"))
    b = e.select(*keys, F.col("row").alias("j"), F.col("col").alias("h"), F.col("w").alias("wb"))
    c = e.select(*keys, F.col("row").alias("h"), F.col("col").alias("i"), F.col("w").alias("wc"))
    triangles = a.join(b, [*keys, "j"]).join(c, [*keys, "h", "i"]).groupBy(*keys, F.col("i").alias("node")).agg(F.sum(F.col("wa") * F.col("wb") * F.col("wc")).alias("t"))
    k = degrees_und(matrix, keys).withColumnRenamed("value", "k")
    t = F.coalesce("t", F.lit(0.0))
    return k.join(triangles, [*keys, "node"], "left").select(*keys, "node", F.when(F.col("k") < 2, 0.0).otherwise(F.try_divide(t, F.col("k") * (F.col("k") - 1))).alias("value"))


def eigenvector_centrality_und(matrix: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Absolute values of the leading eigenvector; one element's matrix goes to one task."""
    given = matrix.select(*keys, "row", "col", "value")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in given.schema[: len(keys)]) + ", node string, value double"

    def run(key: tuple, table: pa.Table) -> pa.Table:
        names, i = np.unique(np.array(table.column("row").to_pylist(), object).astype(str), return_inverse=True)
        j = np.searchsorted(names, np.array(table.column("col").to_pylist(), object).astype(str))
        m = np.zeros((len(names), len(names)))
        m[i, j] = table.column("value").to_numpy()
        values, vectors = np.linalg.eigh((m + m.T) / 2)
        columns = {table.schema[k].name: pa.array([v.as_py()] * len(names), table.schema[k].type) for k, v in enumerate(key)}
        return pa.table(columns | {"node": pa.array(names.tolist(), pa.string()), "value": np.abs(vectors[:, np.argmax(values)])})

    return given.groupBy(*keys).applyInArrow(run, schema)


TRANSFORMS: dict[str, Callable[..., DataFrame]] = {f.__name__: f for f in (degrees_und, strengths_und, clustering_coef_wu, eigenvector_centrality_und)}


def register_graph_transform(name: str, fn: Callable[..., DataFrame]) -> None:
    TRANSFORMS[name] = fn


def read_transform(matrix: DataFrame, transform: str, policy: str = "bypass", keys: Sequence[str] = KEYS, **params) -> DataFrame:
    """A graph measure of each element of a stored matrix feature, after a NaN policy."""
    if transform not in TRANSFORMS:
        raise ValueError(f"no such transform: {transform}; there are {sorted(TRANSFORMS)}")
    return TRANSFORMS[transform](nan_policy(matrix, policy, keys), keys=keys, **params)


def normalize(spectrum: DataFrame, sizes: DataFrame, kind: str, on: Sequence[str]) -> DataFrame:
    """Eigenvalues (value) times the surface's area, or times the volume to the power 2/3."""
    if kind not in ("surface", "volume"):
        raise ValueError(f"no such kind: {kind}")
    size = F.col("area") if kind == "surface" else F.pow("volume", F.lit(2 / 3))
    return spectrum.join(sizes, list(on)).withColumn("value", F.col("value") * size).select(*spectrum.columns)


def reweight(spectrum: DataFrame, order: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Each eigenvalue over its place from 1."""
    return spectrum.withColumn("value", F.col("value") / F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
