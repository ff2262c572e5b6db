"""Spectra of surfaces: eigenvalues of the Laplace-Beltrami operator of triangle meshes.

A mesh is two tables: vertices (keys, vertex, x, y, z) and triangles (keys, a, b, c). The operator is that
of linear finite elements: cotangent weights, and a third of the triangles' areas at each vertex. One
mesh goes to one task; its matrix is never laid out, only applied to vectors.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelkit.model import key_columns, key_schema

KEYS = ("element",)
#: Vertices up to which the matrix is laid out and solved whole.
DENSE = 600


class Laplacian:
    """Symmetric operator M^-1/2 K M^-1/2 of a mesh, with its area and volume."""

    def __init__(self, points: np.ndarray, triangles: np.ndarray):
        corners = points[triangles]
        normal = np.cross(corners[:, 1] - corners[:, 0], corners[:, 2] - corners[:, 0])
        double = np.linalg.norm(normal, axis=1)
        self.area, self.volume = double.sum() / 2, abs(np.einsum("td,td->t", corners[:, 0], normal).sum()) / 6
        i, j, w = [], [], []
        for k in range(3):  # the edge opposite to each corner
            p, q = corners[:, (k + 1) % 3] - corners[:, k], corners[:, (k + 2) % 3] - corners[:, k]
            cot = np.einsum("td,td->t", p, q) / np.maximum(double, 1e-300) / 2
            i += [triangles[:, (k + 1) % 3], triangles[:, (k + 2) % 3]]
            j += [triangles[:, (k + 2) % 3], triangles[:, (k + 1) % 3]]
            w += [cot, cot]
        mass = np.bincount(triangles.ravel(), np.repeat(double / 6, 3), len(points))
        root = 1 / np.sqrt(np.where(mass > 0, mass, 1))
        self.i, self.j = np.concatenate(i), np.concatenate(j)
        w = np.concatenate(w)
        self.n, self.diagonal = len(points), np.bincount(self.i, w, len(points)) * root * root
        self.w = -w * root[self.i] * root[self.j]
        order = np.argsort(self.i, kind="stable")
        self.i, self.j, self.w = self.i[order], self.j[order], self.w[order]
        self.first = np.flatnonzero(np.r_[True, self.i[1:] != self.i[:-1]]) if len(self.i) else np.zeros(0, int)

    def __matmul__(self, x: np.ndarray) -> np.ndarray:
        out = self.diagonal[:, None] * x
        if len(self.first):
            out[self.i[self.first]] += np.add.reduceat(self.w[:, None] * x[self.j], self.first, axis=0)
        return out

    def smallest(self, k: int, tolerance: float = 1e-7, rounds: int = 400, degree: int = 30) -> np.ndarray:
        """The ``k`` smallest eigenvalues: of the whole matrix for small meshes, else by subspace iteration with a Chebyshev filter."""
        k = min(k, self.n)
        if self.n <= DENSE:
            return np.linalg.eigvalsh(self @ np.eye(self.n))[:k]
        size = min(self.n, 2 * k + 10)
        bound = (np.abs(self.diagonal) + np.bincount(self.i, np.abs(self.w), self.n)).max()  # Gershgorin
        x = np.linalg.qr(np.random.default_rng(0).normal(size=(self.n, size)))[0]
        cut, found = bound / 10, np.full(k, np.inf)
        for _ in range(rounds):
            middle, half = (bound + cut) / 2, (bound - cut) / 2
            before, now = x, ((self @ x) - middle * x) / half
            for _ in range(degree - 1):
                before, now = now, 2 * ((self @ now) - middle * now) / half - before
            x = np.linalg.qr(now)[0]
            values, vectors = np.linalg.eigh(x.T @ (self @ x))
            x = x @ vectors
            if np.abs(values[:k] - found).max() <= tolerance * max(values[k - 1], 1e-300):
                return values[:k]
            found, cut = values[:k], max(values[-1], values[k - 1] * 1.01)
        return found


def shape_spectrum(vertices: DataFrame, triangles: DataFrame, n: int = 50, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, ev, value, area, volume): the ``n`` smallest eigenvalues of each mesh, from ev 1, with its size.

    Vertices are numbered as they like; triangles name them. A mesh without triangles gives no rows.
    """
    points = vertices.select(*keys, F.col("vertex").cast("long").alias("a"), F.lit(None).cast("long").alias("b"), F.lit(None).cast("long").alias("c"), *[F.col(c).cast("double").alias(c) for c in "xyz"])
    faces = triangles.select(*keys, *[F.col(c).cast("long").alias(c) for c in "abc"], *[F.lit(None).cast("double").alias(c) for c in "xyz"])
    given = points.unionByName(faces)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        is_face = np.array(table.column("b").is_valid().to_pylist(), bool)
        face, point = table.filter(pa.array(is_face)), table.filter(pa.array(~is_face))
        names = np.sort(point.column("a").to_numpy())
        if not face.num_rows:
            return pa.table(key_columns(key, table.schema, 0) | {"ev": pa.array([], pa.int32())} | {c: pa.array([], pa.float64()) for c in ("value", "area", "volume")})
        order = np.argsort(point.column("a").to_numpy())
        mesh = Laplacian(np.stack([point.column(c).to_numpy()[order] for c in "xyz"], axis=1), np.searchsorted(names, np.stack([face.column(c).to_numpy() for c in "abc"], axis=1)))
        values = mesh.smallest(n)
        size = {c: pa.array([float(v)] * len(values)) for c, v in (("area", mesh.area), ("volume", mesh.volume))}
        return pa.table(key_columns(key, table.schema, len(values)) | {"ev": pa.array(range(1, len(values) + 1), pa.int32()), "value": pa.array(values)} | size)

    return given.groupBy(*keys).applyInArrow(run, f"{key_schema(given, keys)}, ev int, value double, area double, volume double")
