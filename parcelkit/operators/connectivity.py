"""Connectivity: matrices of pairwise measures of series, and edge time series.

A series table has the element's keys, timepoint, idx (the series' place), col (its name) and value.
An element's series go to one task as a matrix of frames by series, so the shuffle is the series
themselves and the pairs are matrix products; nothing is joined with itself. Missing values (null or
NaN) leave out a frame for the pairs they are in; measures of the whole matrix leave it out for all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelkit.model import key_columns, key_schema

KEYS = ("element",)
_CELLS = "row string, row_idx int, col string, col_idx int, value double"
#: Rows of a matrix that leave a kernel at a time.
BLOCK = 1024


def ranks(x: np.ndarray, method: str = "mean") -> np.ndarray:
    """Ranks from 1 down each column; ties share their mean rank, or their least."""
    out = np.empty(x.shape)
    for k in range(x.shape[1]):
        values, at, n = np.unique(x[:, k], return_inverse=True, return_counts=True)
        last = np.cumsum(n)
        out[:, k] = ((2 * last - n + 1) / 2 if method == "mean" else last - n + 1)[at]
    return out


def pairwise(x: np.ndarray, y: np.ndarray, correlation: bool = True) -> np.ndarray:
    """Correlation or covariance of every column of ``x`` with every column of ``y``, over the frames that both have;
    NaN without any, and for a correlation with a constant series."""
    x, y = (v - np.nan_to_num(np.nanmean(np.where(np.isnan(v).all(axis=0), 0, v), axis=0)) for v in (x, y))
    a, b = ~np.isnan(x), ~np.isnan(y)
    x, y, a, b = np.where(a, x, 0), np.where(b, y, 0), a.astype(float), b.astype(float)
    with np.errstate(divide="ignore", invalid="ignore"):
        n = a.T @ b
        mx, my = (x.T @ b) / n, (a.T @ y) / n
        cov = (x.T @ y) / n - mx * my
        if not correlation:
            return cov
        vx, vy = ((x * x).T @ b) / n - mx * mx, (a.T @ (y * y)) / n - my * my
        scale = 1e-14 * np.maximum(1e-300, np.maximum((x * x).max(axis=0, initial=0)[:, None], 0))  # rounding of a constant series
        ok = (vx > scale) & (vy > 1e-14 * np.maximum(1e-300, (y * y).max(axis=0, initial=0)[None]))
        return np.where(ok, np.clip(cov / np.sqrt(np.where(ok, vx * vy, 1)), -1, 1), np.nan)


def rank_pairwise(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Rank correlations over the frames that both columns have; ranks are taken over these frames alone."""
    whole = [~np.isnan(v).any(axis=0) for v in (x, y)]
    out = np.full((x.shape[1], y.shape[1]), np.nan)
    if whole[0].any() and whole[1].any():
        out[np.ix_(*whole)] = pairwise(ranks(x[:, whole[0]]), ranks(y[:, whole[1]]))
    for i, j in np.argwhere(~(whole[0][:, None] & whole[1][None])):
        both = ~np.isnan(x[:, i]) & ~np.isnan(y[:, j])
        if both.sum() > 1:
            out[i, j] = pairwise(ranks(x[both, i : i + 1]), ranks(y[both, j : j + 1]))[0, 0]
    return out


def xi_pairwise(x: np.ndarray) -> np.ndarray:
    """Chatterjee's coefficient of every ordered pair: the steps of the column's ranks in the order of the row's values."""
    n, r = len(x), ranks(x, "least")
    out = np.full((x.shape[1], x.shape[1]), np.nan)
    for i in range(x.shape[1] if n > 1 else 0):
        out[i] = 1 - 3 * np.abs(np.diff(r[np.argsort(x[:, i], kind="stable")], axis=0)).sum(axis=0) / (n * n - 1)
    return out


def framed(table: pa.Table) -> tuple[list[int], list[str], np.ndarray]:
    """Places, names and the matrix (frames in order by places in order) of a table of series; missing values are NaN."""
    idx, t = (table.column(c).to_numpy() for c in ("idx", "timepoint"))
    v = table.column("value").cast(pa.float64()).to_numpy(zero_copy_only=False)
    frames, at = np.unique(t, return_inverse=True)
    places, first, k = np.unique(idx, return_index=True, return_inverse=True)
    x = np.full((len(frames), len(places)), np.nan)
    x[at, k] = v
    return places.tolist(), table.column("col").take(pa.array(first)).to_pylist(), x


def _cells(key: tuple, table: pa.Table, rows: tuple[list, list], cols: tuple[list, list], i: np.ndarray, j: np.ndarray, value: np.ndarray) -> dict:
    names = [np.array(side[1], object) for side in (rows, cols)]
    places = [np.array(side[0], np.int32) for side in (rows, cols)]
    value = pa.array(value, pa.float64(), mask=np.isnan(value))
    return key_columns(key, table.schema, len(i)) | {
        "row": pa.array(names[0][i], pa.string()), "row_idx": pa.array(places[0][i]), "col": pa.array(names[1][j], pa.string()), "col_idx": pa.array(places[1][j]), "value": value,
    }


def _given(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    return series.select(*keys, "timepoint", F.col("idx").cast("int").alias("idx"), "col", F.col("value").cast("double").alias("value"))


def shrunk(x: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Ledoit and Wolf (2004): a covariance drawn towards a multiple of the identity; ``x`` are the centred frames."""
    n, k = x.shape
    mu = np.trace(s) / k
    delta = ((s - mu * np.eye(k)) ** 2).sum() / k
    squares = x * x
    beta = min(delta, ((squares.T @ squares) / n - s * s).sum() / (k * n))
    return (1 - beta / delta) * s + beta / delta * mu * np.eye(k) if delta > 0 else s


def _whole_matrix(x: np.ndarray, kind: str, shrink: bool) -> np.ndarray:
    """Measures that need all series at once, over the frames that all have."""
    x = x[~np.isnan(x).any(axis=1)]
    if not len(x):
        return np.full((x.shape[1], x.shape[1]), np.nan)
    c = x - x.mean(axis=0)
    s = c.T @ c / len(x)
    s = shrunk(c, s) if shrink else s
    if kind == "covariance":
        return s
    if kind == "correlation":
        d = np.sqrt(np.diag(s))
        return s / np.outer(d, d)
    out = np.linalg.pinv(s)
    if kind == "partial correlation":
        d = np.sqrt(np.diag(out))
        out = -out / np.outer(d, d)
        np.fill_diagonal(out, 1.0)
    return out


_PLAIN: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "correlation": lambda x: pairwise(x, x),
    "covariance": lambda x: pairwise(x, x, False),
    "spearman": lambda x: rank_pairwise(x, x),
    "xi correlation": lambda x: xi_pairwise(x[~np.isnan(x).any(axis=1)]),
}
MATRIX_KINDS = ("correlation", "covariance", "precision", "partial correlation", "xi correlation", "spearman")


def matrix(series: DataFrame, kind: str = "correlation", shrink: bool = False, keys: Sequence[str] = KEYS) -> DataFrame:
    """Lower triangle of correlation, covariance, precision, partial or rank correlation, or xi (both halves).

    ``shrink`` takes the Ledoit-Wolf covariance. One element's series go to one task.
    """
    if kind not in MATRIX_KINDS or shrink and kind in ("xi correlation", "spearman"):
        raise ValueError(f"no such kind: {kind}{' shrunk' if shrink else ''}")
    given = _given(series, keys)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        places, names, x = framed(table)
        with np.errstate(divide="ignore", invalid="ignore"):
            out = _PLAIN[kind](x) if kind in _PLAIN and not shrink else _whole_matrix(x, kind, shrink)
        i, j = np.indices(out.shape).reshape(2, -1) if kind == "xi correlation" else np.tril_indices(len(places))
        return pa.table(_cells(key, table, (places, names), (places, names), i, j, out[i, j]))

    return given.groupBy(*keys).applyInArrow(run, f"{key_schema(given, keys)}, {_CELLS}")


def spearman(series: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Lower triangle of rank correlations."""
    return matrix(series, "spearman", keys=keys)


def cross(one: DataFrame, two: DataFrame, method: str = "pearson", keys: Sequence[str] = KEYS) -> DataFrame:
    """Correlation of every series of ``two`` (rows) with every series of ``one`` (columns), over the frames that both have."""
    if method not in ("pearson", "spearman"):
        raise ValueError(f"no such method: {method}")
    given = _given(one, keys).withColumn("side", F.lit(0)).unionByName(_given(two, keys).withColumn("side", F.lit(1)))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        parts = [table.filter(pa.array(side == k)) for k in (0, 1)]
        if not all(p.num_rows for p in parts):
            return pa.table(_cells(key, table, ([], []), ([], []), np.zeros(0, int), np.zeros(0, int), np.zeros(0)))
        frames = [np.unique(p.column("timepoint").to_numpy()) for p in parts]
        both = np.intersect1d(*frames)
        (ca, na, a), (cb, nb, b) = (framed(p) for p in parts)
        a, b = a[np.isin(frames[0], both)], b[np.isin(frames[1], both)]
        out = pairwise(b, a) if method == "pearson" else rank_pairwise(b, a)
        i, j = np.indices(out.shape).reshape(2, -1)
        return pa.table(_cells(key, table, (cb, nb), (ca, na), i, j, out[i, j]))

    return given.groupBy(*keys).applyInArrow(run, f"{key_schema(given, keys)}, {_CELLS}")


def tangent(series: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Covariances of the elements in the tangent space at their mean (the mean's whitening, then the logarithm)."""
    cov = matrix(series, "covariance", keys=keys)
    k = series.agg(F.max("idx")).first()[0] + 1
    mean = np.zeros((k, k))
    for r in cov.groupBy("row_idx", "col_idx").agg(F.avg("value").alias("v")).collect():  # k * k cells
        mean[r["row_idx"], r["col_idx"]] = mean[r["col_idx"], r["row_idx"]] = r["v"]
    w, u = np.linalg.eigh(mean)
    white = u @ np.diag(1 / np.sqrt(np.maximum(w, 1e-12))) @ u.T
    schema = cov.schema

    def run(table: pa.Table) -> pa.Table:
        i, j = (table.column(c).to_numpy() for c in ("row_idx", "col_idx"))
        s = np.zeros((k, k))
        s[i, j] = s[j, i] = table.column("value").to_numpy()
        w, u = np.linalg.eigh(white @ s @ white.T)
        out = u @ np.diag(np.log(np.maximum(w, 1e-12))) @ u.T
        return table.set_column(table.schema.get_field_index("value"), "value", pa.array(out[i, j]))

    return cov.groupBy(*keys).applyInArrow(run, schema)


def standardised(series: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Series with mean 0 and deviation 1 over time; a constant series is null."""
    w = Window.partitionBy(*keys, "idx")
    return series.withColumn("value", F.try_divide(F.col("value") - F.avg("value").over(w), F.stddev_pop("value").over(w)))


def _edges(x: np.ndarray) -> np.ndarray:
    """Products of the standardised columns of every pair u > v, row-major; a constant column's are NaN."""
    c = x - np.nanmean(np.where(np.isnan(x).all(axis=0), 0, x), axis=0)
    d = np.sqrt(np.nanmean(np.where(np.isnan(x).all(axis=0), 0, c * c), axis=0))
    with np.errstate(divide="ignore", invalid="ignore"):
        z = np.where(d > 1e-14 * np.maximum(1e-300, np.nanmax(np.abs(np.nan_to_num(x)), axis=0, initial=0)), c / d, np.nan)
    u, v = np.tril_indices(x.shape[1], -1)
    return z[:, u] * z[:, v]


def _edge_names(names: Sequence[str]) -> list[str]:
    u, v = np.tril_indices(len(names), -1)
    return [f"{names[i]}~{names[j]}" for i, j in zip(u, v, strict=True)]


def edge_series(series: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Products of the standardised series of every pair u > v in each frame; col is u~v, idx row-major."""
    z = standardised(series, keys)
    packed = z.groupBy(*keys, "timepoint").agg(F.array_sort(F.collect_list(F.struct("idx", "col", "value"))).alias("z"))
    outer = packed.select(*keys, "timepoint", "z", F.explode("z").alias("a"))
    pairs = outer.select(*keys, "timepoint", "a", F.explode(F.filter("z", lambda b: b["idx"] < F.col("a.idx"))).alias("b"))
    at = F.col("a.idx") * (F.col("a.idx") - 1) / 2 + F.col("b.idx")
    return pairs.select(*keys, "timepoint", at.cast("int").alias("idx"), F.concat_ws("~", "a.col", "b.col").alias("col"), (F.col("a.value") * F.col("b.value")).alias("value"))


def edge_rss(series: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Root sum of squares over all edges of each frame, from the standardised series alone:
    the sum over pairs of squared products is ((sum of squares) ^ 2 - sum of fourth powers) / 2."""
    z2 = F.col("value") * F.col("value")
    total = F.sum(z2)
    rss = F.sqrt(F.greatest(F.lit(0.0), (total * total - F.sum(z2 * z2)) / 2))
    return standardised(series, keys).groupBy(*keys, "timepoint").agg(rss.alias("value")).withColumn("col", F.lit("root_sum_of_squares_ets"))


def edge_connectivity(series: DataFrame, kind: str = "correlation", keys: Sequence[str] = KEYS) -> DataFrame:
    """Connectivity of the edge series; the number of cells grows with the fourth power of the series.

    Correlation and covariance leave the task in blocks of the matrix's rows, so it is never held whole;
    other kinds need it whole.
    """
    if kind not in ("correlation", "covariance"):
        return matrix(edge_series(series, keys), kind, keys=keys)
    given = _given(series, keys)

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        _, names, x = framed(table)
        edges, labels = _edges(x), _edge_names(names)
        sides = (list(range(len(labels))), labels)
        for lo in range(0, len(labels), BLOCK):
            part = pairwise(edges[:, lo : lo + BLOCK], edges[:, : lo + BLOCK], kind == "correlation")
            i, j = np.nonzero(np.arange(part.shape[1])[None] <= np.arange(lo, lo + part.shape[0])[:, None])
            yield pa.RecordBatch.from_pydict(_cells(key, table, sides, sides, i + lo, j, part[i, j]))

    return given.groupBy(*keys).applyInArrow(run, f"{key_schema(given, keys)}, {_CELLS}")
