"""Element tables: selectors, intersections, products."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _selectors(elements: DataFrame, selectors: Sequence[str | Sequence[str]]) -> DataFrame:
    """A table (place, wanted) of the selectors' texts."""
    rows = [(k, sorted({str(v) for v in ([s] if isinstance(s, str | int) else s)})) for k, s in enumerate(selectors)]
    return elements.sparkSession.createDataFrame(rows, "place int, wanted array<string>")


def _matches(elements: DataFrame, selectors: Sequence[str | Sequence[str]]) -> DataFrame:
    """(keys, place) of every element and selector that fit.

    A selector meets the elements that have its first text among their keys, by an equality join.
    """
    keyed = elements.select("*", F.array(*[F.col(c).cast("string") for c in elements.columns]).alias("_keys"))
    each = keyed.withColumn("_first", F.explode(F.array_distinct("_keys")))
    wanted = _selectors(elements, selectors).select("place", "wanted", F.get("wanted", F.lit(0)).alias("_first"))
    return each.join(wanted, "_first").where(F.size(F.array_except("wanted", "_keys")) == 0)


def select(elements: DataFrame, selectors: Sequence[str | Sequence[str]]) -> DataFrame:
    """Elements that fit any selector: a text that equals some key, or a set of texts that are all among the keys."""
    if not selectors:
        return elements.where("false")
    return _matches(elements, selectors).select(*elements.columns).distinct()


def unmatched(elements: DataFrame, selectors: Sequence[str | Sequence[str]]) -> list:
    """Selectors that fit no element; one job for all of them."""
    if not selectors:
        return []
    hit = _matches(elements, selectors).select("place").distinct()
    missing = _selectors(elements, selectors).join(hit, "place", "left_anti").select("place").collect()
    return [selectors[r["place"]] for r in sorted(missing, key=lambda r: r["place"])]


def intersect(tables: Sequence[DataFrame]) -> DataFrame:
    """Elements of all sources, which must have the same keys."""
    keys = tables[0].columns
    if any(set(t.columns) != set(keys) for t in tables):
        raise ValueError("the sources' keys differ")
    return reduce(DataFrame.intersect, [t.select(*keys) for t in tables])


def combine(tables: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Data of several sources side by side; no column but the keys may be in two."""
    seen: set[str] = set()
    for t in tables:
        own = set(t.columns) - set(keys)
        if own & seen:
            raise ValueError(f"in two sources: {sorted(own & seen)}")
        seen |= own
    return reduce(lambda a, b: a.join(b, list(keys)), tables)


def as_lines(elements: DataFrame) -> DataFrame:
    """One line for each element, its keys joined by commas."""
    return elements.select(F.concat_ws(",", *[F.col(c).cast("string") for c in elements.columns]).alias("line"))


def product(spark: SparkSession, **values: Sequence[str]) -> DataFrame:
    """Every combination of a few listed values (each key a list written out by hand)."""
    df = spark.range(1)
    for key, options in values.items():
        df = df.withColumn(key, F.explode(F.array(*map(F.lit, options))))
    return df.drop("id")


def without(elements: DataFrame, excluded: DataFrame) -> DataFrame:
    return elements.join(excluded, excluded.columns, "left_anti")


def task_elements(spark: SparkSession, subjects: Sequence[str], tasks: Sequence[str], encodings: Sequence[str]) -> DataFrame:
    """Subjects by tasks by phase encodings; resting tasks and others have different prefixes."""
    df = product(spark, subject=subjects, task=tasks, phase_encoding=encodings)
    prefix = F.when(F.col("task").startswith("REST"), "rfMRI_").otherwise("tfMRI_")
    return df.withColumn("name", F.concat(prefix, "task", F.lit("_"), "phase_encoding"))


def session_elements(spark: SparkSession, subjects: Sequence[str], sessions: Sequence[str], tasks: Sequence[str], encodings: Sequence[str], excluded: DataFrame | None = None) -> DataFrame:
    """Subjects by sessions, tasks and encodings with their run numbers, without listed exceptions."""
    df = product(spark, subject=subjects, session=sessions, task=tasks, phase_encoding=encodings)
    df = df.withColumn("run", F.when(F.col("phase_encoding") == "AP", "1").otherwise("2"))
    return df if excluded is None else without(df, excluded)
