"""Aggregates by name, as Column builders for groupBy().agg()."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _sorted(value: Column) -> Column:
    return F.array_sort(F.collect_list(value))


def _mean_of(values: Column) -> Column:
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values).cast("double"))


def winsorized_mean(value: Column, limits: Sequence[float]) -> Column:
    """Mean after the lowest and the highest share take the nearest value that stays; int(share * n) values each, in floating point."""
    if len(limits) != 2 or not all(0 <= x <= 1 for x in limits):
        raise ValueError("limits are two numbers between 0 and 1")
    s = _sorted(value)
    n = F.size(s)
    low, high = (F.floor(F.lit(float(x)) * n).cast("int") for x in limits)
    return _mean_of(F.transform(s, lambda x, i: F.greatest(F.get(s, low), F.least(F.get(s, n - high - 1), x))))


def trim_mean(value: Column, share: float) -> Column:
    """Mean without the lowest and the highest share; int(share * n) values each, in floating point."""
    if not 0 <= share < 0.5:
        raise ValueError("the share to cut lies between 0 and 0.5")
    s = _sorted(value)
    cut = F.floor(F.lit(float(share)) * F.size(s)).cast("int")
    return _mean_of(F.slice(s, cut + 1, F.greatest(F.size(s) - 2 * cut, F.lit(0))))


AGGREGATES: dict[str, Callable[..., Callable[[Column], Column]]] = {
    "mean": lambda: F.avg,
    "std": lambda: F.stddev_pop,
    "sum": lambda: F.sum,
    "min": lambda: F.min,
    "max": lambda: F.max,
    "mode": lambda: lambda v: F.mode(v, True),
    "count": lambda: lambda _: F.count(F.lit(1)).cast("double"),
    "winsorized_mean": lambda limits: lambda v: winsorized_mean(v, limits),
    "trim_mean": lambda proportiontocut: lambda v: trim_mean(v, proportiontocut),
}


def by_name(name: str, params: dict | None = None) -> Callable[[Column], Column]:
    """The aggregate called ``name`` with its parameters."""
    if name not in AGGREGATES:
        raise ValueError(f"no such aggregate: {name}; there are {sorted(AGGREGATES)}")
    return AGGREGATES[name](**(params or {}))


def register(name: str, build: Callable[..., Callable[[Column], Column]]) -> None:
    AGGREGATES[name] = build


def select(df: DataFrame, by: Sequence[str], order: str, pick: Sequence[int] | None = None, drop: Sequence[int] | None = None) -> DataFrame:
    """Rows at (or not at) the given places, from 0, of each group."""
    if (pick is None) == (drop is None):
        raise ValueError("one of pick and drop is needed")
    place = F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1
    inside = F.col("_place").isin(list(pick if pick is not None else drop))
    return df.withColumn("_place", place).where(inside if pick is not None else ~inside).drop("_place")


def correlation(x: Column, y: Column) -> Column:
    """Pearson's correlation; null where one side is constant."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.stddev_pop(F.when(both, x)), F.stddev_pop(F.when(both, y))
    return F.when((a > 0) & (b > 0), F.try_divide(F.covar_pop(x, y), a * b))


def mean_rank(by: Sequence[str], value: str) -> Column:
    """Rank from 1 within ``by``; ties share their mean rank."""
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, value))
    return (F.rank().over(Window.partitionBy(*by).orderBy(value)) + (ties - 1) / F.lit(2.0)).cast("double")


def without_nan(value: Column) -> Column:
    return F.when(~F.isnan(value), value)
