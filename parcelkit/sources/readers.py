"""Readers by file extension, images among them, and element files."""

from __future__ import annotations

import gzip
import re
import struct
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    ".csv": lambda spark, path: spark.read.csv(path, header=True, inferSchema=True),
    ".tsv": lambda spark, path: spark.read.csv(path, header=True, inferSchema=True, sep="\t", nullValue="n/a"),
    ".parquet": lambda spark, path: spark.read.parquet(path),
    ".json": lambda spark, path: spark.read.json(path),
    ".orc": lambda spark, path: spark.read.orc(path),
    ".nii": lambda spark, path: nifti(spark, path),
    ".nii.gz": lambda spark, path: nifti(spark, path),
}
#: Types that are passed on by path.
SKIPPED = ("Warp", "FreeSurfer")


def register_reader(extension: str, reader: Callable[[SparkSession, str], DataFrame]) -> None:
    READERS[extension] = reader


def extension(path: str) -> str | None:
    """The longest extension with a reader that the path ends with."""
    return max((e for e in READERS if path.lower().endswith(e)), key=len, default=None)


def is_image(path: str) -> bool:
    return extension(path) in (".nii", ".nii.gz")


#: The number types of the NIfTI-1 format by their codes.
NIFTI_TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}


def decode_nifti(content: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(image with four axes, affine with three rows) of a NIfTI-1 file, gzipped or not.

    The affine takes voxel places to space: the stored matrix if there is one, else the voxel sizes.
    """
    if content[:2] == b"\x1f\x8b":
        content = gzip.decompress(content)
    order = next((o for o in "<>" if len(content) >= 348 and struct.unpack_from(o + "i", content, 0)[0] == 348), None)
    if order is None or content[344:347] != b"n+1":
        raise ValueError("not a single-file NIfTI-1 image")
    dim = struct.unpack_from(order + "8h", content, 40)
    code, sizes = struct.unpack_from(order + "h", content, 70)[0], struct.unpack_from(order + "8f", content, 76)
    offset, slope, shift = struct.unpack_from(order + "3f", content, 108)
    if code not in NIFTI_TYPES or not 1 <= dim[0] <= 7 or any(n < 1 for n in dim[1 : dim[0] + 1]) or any(n > 1 for n in dim[5 : dim[0] + 1]):
        raise ValueError(f"no image of at most four axes of plain numbers: type {code}, axes {dim}")
    shape = tuple(dim[1 + k] if k < dim[0] else 1 for k in range(4))
    image = np.frombuffer(content, order + NIFTI_TYPES[code], int(np.prod(shape)), int(offset)).reshape(shape, order="F").astype(float)
    if slope not in (0.0, 1.0) or slope and shift:
        image = image * slope + shift
    matrix = struct.unpack_from(order + "h", content, 254)[0] > 0
    affine = np.array(struct.unpack_from(order + "12f", content, 280)).reshape(3, 4) if matrix else np.c_[np.diag(sizes[1:4]), np.zeros(3)]
    return image, affine


def voxels_of(files: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, timepoint, voxel, i, j, k, x, y, z, value) of images (keys, content), frame by frame.

    A voxel's number is its place in the file, i + n_i * (j + n_j * k); x, y, z is its place in space.
    """
    given = files.select(*keys, "content")
    keyed = ", ".join(f"`{c}` {given.schema[c].dataType.simpleString()}" for c in keys)
    names = [*keys, "timepoint", "voxel", *"ijk", *"xyz", "value"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                image, affine = decode_nifti(batch.column("content")[row].as_py())
                shape = image.shape[:3]
                cells = np.indices(shape).reshape(3, -1, order="F").astype(np.int32)
                space = affine[:, :3] @ cells + affine[:, 3:]
                n = cells.shape[1]
                for t in range(image.shape[3]):
                    key = [pa.array([batch.column(c)[row].as_py()] * n, batch.schema.field(c).type) for c in keys]
                    value = image[..., t].ravel(order="F")
                    columns = [pa.array(np.full(n, t, np.int32)), pa.array(np.arange(n, dtype=np.int32)), *map(pa.array, cells), *map(pa.array, space), pa.array(value, mask=np.isnan(value))]
                    yield pa.RecordBatch.from_arrays(key + columns, names)

    return given.mapInArrow(run, f"{keyed + ', ' if keyed else ''}timepoint int, voxel int, i int, j int, k int, x double, y double, z double, value double")


def nifti(spark: SparkSession, path: str) -> DataFrame:
    """The voxels of one image, as voxels_of() has them."""
    return voxels_of(spark.read.format("binaryFile").load(path))


def read_files(spark: SparkSession, folder: str, files: DataFrame, keys: Sequence[str], ends: str) -> DataFrame:
    """The contents of files (keys, path relative to the folder) of one extension, with the keys as columns.

    Images are decoded; of tables all columns are read, and one without timepoint has a frame to a row.
    All files come from one listing of the folder.
    """
    kind = extension(ends)
    if kind is None:
        raise ValueError(f"no reader for {ends}")
    options = {"recursiveFileLookup": "true", "pathGlobFilter": f"*{kind}"}
    wanted = files.select(*keys, F.col("path").alias("_path"))
    base = "^.*?" + "/".join(map(re.escape, folder.split("://")[-1].strip("/").split("/"))) + "/"
    relative = lambda c: F.regexp_replace(c, base, "")
    if kind in (".nii", ".nii.gz"):
        found = spark.read.format("binaryFile").options(**options).load(folder).select(relative(F.col("path")).alias("_path"), "content")
        return voxels_of(found.join(wanted, "_path"), keys)
    reader = spark.read.options(**options)
    if kind in (".csv", ".tsv"):
        reader = reader.options(header="true", inferSchema="true", **({"sep": "\t", "nullValue": "n/a"} if kind == ".tsv" else {}))
    found = reader.format({".tsv": "csv"}.get(kind, kind[1:])).load(folder)
    columns = [relative(F.col("_metadata.file_path")).alias("_path")]
    if "timepoint" not in found.columns:  # rows in the order of the file, also where it is read in several blocks
        place = Window.partitionBy("_path").orderBy("_block", "_row")
        found = found.select("*", *columns, F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row"))
        found = found.withColumn("timepoint", F.row_number().over(place) - 1).drop("_block", "_row")
    else:
        found = found.select("*", *columns)
    return found.join(wanted, "_path").drop("_path")


def read(spark: SparkSession, path: str, data_type: str | None = None) -> DataFrame | None:
    """The file as a DataFrame; None for an unknown extension or a type that is passed on by path."""
    if data_type in SKIPPED:
        return None
    found = extension(path)
    return READERS[found](spark, path) if found else None


def element_file(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Elements from a file without a header: all texts, trimmed."""
    df = spark.read.csv(path, header=False, inferSchema=False, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    if len(df.columns) != len(keys):
        raise ValueError(f"{len(df.columns)} columns for the keys {keys}")
    return df.select(*[F.trim(c).alias(k) for c, k in zip(df.columns, keys, strict=True)])


def pack(signal: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each frame, its voxels' values in order."""
    pairs = F.array_sort(F.collect_list(F.struct("voxel", "value")))
    return signal.groupBy(*keys, "timepoint").agg(F.transform(pairs, lambda p: p["value"]).alias("values"))


def unpack(frames: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each voxel of each frame."""
    return frames.select(*keys, "timepoint", F.posexplode("values").alias("voxel", "value"))
