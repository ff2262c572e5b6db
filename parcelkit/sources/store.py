"""The feature store: Parquet tables by kind, partitioned by feature, with a catalog.

A feature's md5 is a partition column, so reading one feature opens its own files only. An element
that a feature has already is skipped, replaced or refused, as the caller says. Appending writes new
files and never rewrites old ones; updating and replacing write a new version of the feature beside
the old one, and a row in the table of versions makes it the one that is read, so a job that dies on
the way changes nothing.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcelkit.model import KINDS, feature_identity


def upsert(existing: DataFrame, new: DataFrame, keys: Sequence[str], mode: str = "update") -> DataFrame:
    """Rows of both tables; where keys are in both, 'update' takes the new rows, 'ignore' the old."""
    if mode not in ("update", "ignore"):
        raise ValueError(f"no such mode: {mode}")
    first, second = (new, existing) if mode == "update" else (existing, new)
    return first.unionByName(second.join(first.select(*keys).distinct(), list(keys), "left_anti"))


def not_stored(new: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of elements that aren't stored yet."""
    return new.join(existing.select(*keys).distinct(), list(keys), "left_anti")


def matrix_to_vector(matrix: DataFrame, kind: str = "full", diagonal: bool = True, keys: Sequence[str] = ("element",)) -> DataFrame:
    """Cells of a triangle, or all, as columns named row~col in row-major order."""
    if kind not in ("triu", "tril", "full"):
        raise ValueError(f"no such kind: {kind}")
    if kind == "full" and not diagonal:
        raise ValueError("the diagonal can be left out of a triangle only")
    cell = {"triu": "row_idx {} col_idx", "tril": "row_idx {} col_idx", "full": "true"}[kind].format({"triu": "<", "tril": ">", "full": ""}[kind] + ("=" if diagonal and kind != "full" else ""))
    order = Window.partitionBy(*keys).orderBy("row_idx", "col_idx")
    return matrix.where(cell).select(*keys, F.concat_ws("~", "row", "col").alias("col"), (F.row_number().over(order) - 1).alias("col_idx"), "value")


def timeseries_2d_to_timeseries(frames: DataFrame, keys: Sequence[str] = ("element",)) -> DataFrame:
    """Matrices by frame as columns named row~col."""
    return frames.select(*keys, "timepoint", F.concat_ws("~", "row", "col").alias("col"), "value")


def wide(feature: DataFrame, index: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """One row for each index value, one column for each col. Giving the columns saves a pass over the data."""
    grouped = feature.groupBy(*index)
    return (grouped.pivot("col", list(columns)) if columns else grouped.pivot("col")).agg(F.first("value"))


def long(table: DataFrame, index: Sequence[str]) -> DataFrame:
    """The reverse of wide()."""
    rest = [c for c in table.columns if c not in index]
    return table.unpivot(list(index), rest, "col", "value")


def check_matrix(n_rows: int, n_cols: int, rows: Sequence[str], cols: Sequence[str], kind: str, diagonal: bool = True) -> None:
    if not diagonal and kind not in ("triu", "tril"):
        raise ValueError("the diagonal can be left out of a triangle only")
    if kind in ("triu", "tril") and n_rows != n_cols:
        raise ValueError("a triangle needs a square matrix")
    if len(rows) != n_rows or len(cols) != n_cols:
        raise ValueError("headers don't fit the matrix")


def check_cells(matrix: DataFrame, kind: str, diagonal: bool = True) -> None:
    """Raises unless the cells (row, row_idx, col, col_idx) are those of a ``kind`` of matrix with one name to a place."""
    names = {side: dict(matrix.select(f"{side}_idx", side).distinct().orderBy(f"{side}_idx").collect()) for side in ("row", "col")}  # one row for each region
    every = sorted(set(names["row"]) | set(names["col"])) if kind in ("triu", "tril") else None
    size = {side: len(every) if every is not None else 1 + max(names[side], default=-1) for side in names}
    check_matrix(size["row"], size["col"], *([(names["row"] | names["col"])[k] for k in every] if every is not None else list(names[side].values()) for side in names), kind, diagonal)
    wrong = {"triu": "row_idx > col_idx", "tril": "row_idx < col_idx", "full": "false"}[kind] + ("" if diagonal else " OR row_idx = col_idx")
    if matrix.where(wrong).limit(1).count():
        raise ValueError(f"cells outside {kind}{'' if diagonal else ' without the diagonal'}")


_VERSIONS = "meta_md5 string, version int"


class FeatureStore:
    """A folder of features. ``single_output`` False gives every element files of its own, under its prefix;
    ``compression`` is a codec of Parquet."""

    def __init__(self, spark: SparkSession, uri: str, keys: Sequence[str], force_float32: bool = True, kinds: Sequence[str] = tuple(KINDS), single_output: bool = True, compression: str = "zstd"):
        self.spark, self.uri, self.keys, self.float32, self.kinds = spark, uri.rstrip("/"), list(keys), force_float32, tuple(kinds)
        self.single, self.compression = single_output, compression

    @classmethod
    def open(cls, spark: SparkSession, uri: str, **how) -> FeatureStore:
        """A store that is there, with the keys that its catalog names."""
        found = cls(spark, uri, [], **how)
        first = found.catalog().select("element_keys").limit(1).collect()
        found.keys = list(first[0]["element_keys"]) if first else []
        return found

    def _there(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def _version(self, md5: str) -> int:
        path = f"{self.uri}/versions"
        if not self._there(path):
            return 0
        return self.spark.read.schema(_VERSIONS).parquet(path).where(F.col("meta_md5") == md5).agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]

    def _folder(self, kind: str, md5: str, version: int | None = None) -> str:
        return f"{self.uri}/{kind}/meta_md5={md5}/version={self._version(md5) if version is None else version}"

    def _write(self, rows: DataFrame, folder: str) -> None:
        writer = rows.write.mode("append").option("compression", self.compression)
        if not self.single:
            prefix = F.concat(F.lit("element_"), F.concat_ws("_", *[F.col(k).cast("string") for k in self.keys]), F.lit("_"))
            writer = rows.withColumn("_element", prefix).write.mode("append").option("compression", self.compression).partitionBy("_element")
        writer.parquet(folder)

    def _rows(self, folder: str) -> DataFrame:
        return self.spark.read.parquet(folder).drop("_element")

    def catalog(self) -> DataFrame:
        """meta_md5, name, kind, element_keys, meta_json of every feature."""
        schema = "meta_md5 string, name string, kind string, element_keys array<string>, meta_json string"
        path = f"{self.uri}/catalog"
        return self.spark.read.schema(schema).parquet(path) if self._there(path) else self.spark.createDataFrame([], schema)

    def store_metadata(self, meta: dict, kind: str) -> str:
        """Lists a feature, once; returns its md5."""
        md5, name, clean = feature_identity(meta)
        if not self.catalog().where(F.col("meta_md5") == md5).limit(1).count():
            row = [(md5, name, kind, clean["_element_keys"], json.dumps(clean, sort_keys=True, default=str))]
            self.spark.createDataFrame(row, "meta_md5 string, name string, kind string, element_keys array<string>, meta_json string").coalesce(1).write.mode("append").parquet(f"{self.uri}/catalog")
        return md5

    def store(self, kind: str, feature: DataFrame, meta: dict, if_stored: str = "skip", matrix_kind: str | None = None, diagonal: bool = True) -> str:
        """Adds a feature's rows; returns its md5.

        Elements that are stored are skipped, updated ('update') or an error ('fail'); 'replace' drops
        what is stored of the feature, 'append' doesn't look. The cells of a matrix are checked where
        ``matrix_kind`` (triu, tril or full) says what they should be.
        """
        if kind not in self.kinds:
            raise ValueError(f"{kind} is not stored here")
        if if_stored not in ("skip", "update", "fail", "append", "replace"):
            raise ValueError(f"no such choice: {if_stored}")
        if matrix_kind is not None:
            check_cells(feature, matrix_kind, diagonal)
        rows = feature.select(*self.keys, *(n for n, _ in KINDS[kind] if n in feature.columns))
        if self.float32:
            rows = rows.withColumn("value", F.col("value").cast("float"))
        md5 = self.store_metadata(meta, kind)
        version = self._version(md5)
        folder = self._folder(kind, md5, version)
        if self._there(folder) and if_stored != "append":
            old = self._rows(folder)
            if if_stored == "fail" and not rows.join(old.select(*self.keys).distinct(), self.keys, "left_semi").isEmpty():
                raise ValueError("an element is stored already")
            if if_stored in ("update", "replace"):
                if if_stored == "update":
                    # All rows of an element that comes again are replaced.
                    rows = rows.unionByName(old.join(rows.select(*self.keys).distinct(), self.keys, "left_anti"))
                fresh = self._folder(kind, md5, version + 1)
                self._delete(fresh)  # of a job that died
                self._write(rows, fresh)
                self.spark.createDataFrame([(md5, version + 1)], _VERSIONS).coalesce(1).write.mode("append").parquet(f"{self.uri}/versions")
                self._delete(folder)
                return md5
            rows = not_stored(rows, old, self.keys)
        self._write(rows, folder)
        return md5

    def _delete(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def find(self, name: str | None = None, md5: str | None = None) -> tuple[str, str]:
        """(md5, kind) of the one feature of that name or md5."""
        if (name is None) == (md5 is None):
            raise ValueError("give a name or an md5")
        found = self.catalog().where(F.col("name") == name if name else F.col("meta_md5") == md5).select("meta_md5", "kind").distinct().limit(2).collect()
        if len(found) != 1:
            raise ValueError(f"{'no' if not found else 'more than one'} feature: {name or md5}")
        return found[0]["meta_md5"], found[0]["kind"]

    def read(self, name: str | None = None, md5: str | None = None) -> DataFrame:
        """A feature's rows, long."""
        found, kind = self.find(name, md5)
        return self._rows(self._folder(kind, found))

    def read_wide(self, name: str | None = None, md5: str | None = None) -> DataFrame:
        """One row for each element (and frame or row); matrices are flattened to row~col."""
        found, kind = self.find(name, md5)
        rows = self.read(md5=found)
        if kind == "matrix":
            rows = rows.withColumn("col", F.concat_ws("~", "row", "col"))
        if kind == "timeseries_2d":
            rows = timeseries_2d_to_timeseries(rows, self.keys)
        extra = {"timeseries": ["timepoint"], "timeseries_2d": ["timepoint"], "scalar_table": ["row"]}.get(kind, [])
        return wide(rows, [*self.keys, *extra])

    def collect(self, others: Sequence[FeatureStore], files: int | None = None) -> None:
        """Adds the features of other stores; ``files`` compacts each feature to so many files."""
        for other in others:
            for r in other.catalog().select("meta_md5", "kind", "meta_json").distinct().collect():  # a row for each feature
                rows, folder = other.read(md5=r["meta_md5"]), self._folder(r["kind"], r["meta_md5"])
                if self._there(folder):
                    rows = not_stored(rows, self._rows(folder), self.keys)
                self._write(rows.coalesce(files) if files else rows, folder)
            new = other.catalog().join(self.catalog().select("meta_md5"), "meta_md5", "left_anti")
            rows = self.spark.createDataFrame(new.collect(), new.schema)
            rows.coalesce(1).write.mode("append").parquet(f"{self.uri}/catalog")

    def reset(self) -> None:
        """Deletes the store's own folders and nothing beside them."""
        for part in ("catalog", "versions", *self.kinds):
            self._delete(f"{self.uri}/{part}")
