"""Tables in the engine's shapes, derived from the general-purpose test tables.

Each has the same definition in Spark and in SQL (see the texts at the end), so results can be compared.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcelkit.plans import lineage

N_VOXELS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def store_folder(spark: SparkSession) -> Iterator[str]:
    """A folder for a store that a query needs for a while, beside the checkpoints; it is deleted afterwards."""
    folder = f"{lineage.checkpoint_folder(spark)}/store-{uuid.uuid4().hex}"
    try:
        yield folder
    finally:
        lineage.delete(spark, folder)


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors by label as a signal of 64 voxels: element, timepoint, voxel, value."""
    frame = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    frames = table(spark, sf_dir, "embeddings").select(F.col("label").alias("element"), frame.alias("timepoint"), "embedding")
    return frames.select("element", "timepoint", F.posexplode("embedding").alias("voxel", "v")).select("element", "timepoint", "voxel", F.col("v").cast("double").alias("value"))


def grid(spark: SparkSession) -> DataFrame:
    v = F.col("id").cast("int")
    return spark.range(N_VOXELS).select(v.alias("voxel"), (v % 4).alias("x"), (F.floor(v / 4) % 4).cast("int").alias("y"), F.floor(v / 16).cast("int").alias("z"))


def parcels(spark: SparkSession, size: int) -> DataFrame:
    """Blocks of ``size`` voxels: voxel, parcel_id, label."""
    v = F.col("id").cast("int")
    n = (F.floor(v / size) + 1).cast("int")
    return spark.range(N_VOXELS).select(v.alias("voxel"), n.alias("parcel_id"), F.concat(F.lit("P"), n.cast("string")).alias("label"))


def labels(size: int) -> list[str]:
    return [f"P{k + 1}" for k in range(N_VOXELS // size)]


def overlapping(spark: SparkSession) -> DataFrame:
    v = F.col("id").cast("int")
    n = (F.floor((v - 8) / 8) + 1).cast("int")
    return spark.range(8, 40).select(v.alias("voxel"), n.alias("parcel_id"), F.concat(F.lit("P"), n.cast("string")).alias("label"))


def mask(spark: SparkSession, which: str) -> DataFrame:
    return spark.range(N_VOXELS).select(F.col("id").cast("int").alias("voxel")).where("voxel % 3 <> 0" if which == "a" else "voxel >= 16")


def seeds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("s1", 1.0, 1.0, 1.0), ("s2", 2.0, 3.0, 3.0)], "seed string, x double, y double, z double")


def maps(spark: SparkSession) -> DataFrame:
    v = F.col("id").cast("int")
    return spark.range(N_VOXELS).select(v.alias("voxel"), F.when(v < 32, "m1").otherwise("m2").alias("region"), (1.0 + v % 4).alias("weight"))


def blended_maps(spark: SparkSession) -> DataFrame:
    """Two maps that overlap."""
    v = F.col("id").cast("int")
    both = spark.range(N_VOXELS).select(v.alias("voxel"), F.explode(F.array(F.lit("m1"), F.lit("m2"))).alias("region"))
    return both.select("voxel", "region", F.when(F.col("region") == "m1", 1.0 + F.col("voxel") % 4).otherwise(1.0 + F.col("voxel") % 3).alias("weight"))


def ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean value of each kind of event by user and day: element, timepoint, col, value."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("user_id").alias("element"), (F.dayofmonth("ts") - 1).alias("timepoint"), F.col("event_type").alias("col")).agg(F.avg("value").alias("value"))


def confounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = ev(spark, sf_dir).groupBy("element", "timepoint").pivot("col", ["click", "error", "view", "purchase"]).agg(F.first("value"))
    return wide.select("element", "timepoint", F.col("click").alias("csf"), F.col("error").alias("white_matter"), F.col("view").alias("global_signal"),
                       (F.col("purchase") / 100).alias("framewise_displacement"), (F.col("view") / 50).alias("std_dvars"))


#: The same tables as SQL common table expressions.
SQL = {
    "signal": """signal AS (SELECT label AS element, t AS timepoint, CAST(i AS INTEGER) AS voxel, CAST(embedding[i + 1] AS DOUBLE) AS value
  FROM (SELECT label, embedding, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INTEGER) AS t, unnest(range(64)) AS i FROM embeddings))""",
    "grid": "grid AS (SELECT CAST(v AS INTEGER) AS voxel, v % 4 AS x, (v // 4) % 4 AS y, v // 16 AS z FROM range(64) AS r(v))",
    "parc16": "parc16 AS (SELECT CAST(v AS INTEGER) AS voxel, v // 4 + 1 AS parcel_id, 'P' || CAST(v // 4 + 1 AS VARCHAR) AS label FROM range(64) AS r(v))",
    "parc8": "parc8 AS (SELECT CAST(v AS INTEGER) AS voxel, v // 8 + 1 AS parcel_id, 'P' || CAST(v // 8 + 1 AS VARCHAR) AS label FROM range(64) AS r(v))",
    "mask_a": "mask_a AS (SELECT CAST(v AS INTEGER) AS voxel FROM range(64) AS r(v) WHERE v % 3 <> 0)",
    "mask_b": "mask_b AS (SELECT CAST(v AS INTEGER) AS voxel FROM range(64) AS r(v) WHERE v >= 16)",
    "seeds": "seeds AS (SELECT * FROM (VALUES ('s1', 1.0::DOUBLE, 1.0::DOUBLE, 1.0::DOUBLE), ('s2', 2.0, 3.0, 3.0)) AS t(seed, x, y, z))",
    "series16": "series16 AS (SELECT element, timepoint, parcel_id - 1 AS idx, label AS col, avg(value) AS value FROM signal JOIN parc16 USING (voxel) GROUP BY ALL)",
    "series8": "series8 AS (SELECT element, timepoint, parcel_id - 1 AS idx, label AS col, avg(value) AS value FROM signal JOIN parc8 USING (voxel) GROUP BY ALL)",
    "z8": """z8 AS (SELECT element, timepoint, idx, col, (value - avg(value) OVER w) / nullif(stddev_pop(value) OVER w, 0) AS value FROM series8 WINDOW w AS (PARTITION BY element, idx))""",
    "ets8": """ets8 AS (SELECT a.element, a.timepoint, CAST(a.idx * (a.idx - 1) // 2 + b.idx AS INTEGER) AS idx, a.col || '~' || b.col AS col, a.value * b.value AS value
  FROM z8 a JOIN z8 b ON a.element = b.element AND a.timepoint = b.timepoint AND a.idx > b.idx)""",
    "ev": "ev AS (SELECT user_id AS element, CAST(day(ts) - 1 AS INTEGER) AS timepoint, event_type AS col, avg(value) AS value FROM events GROUP BY ALL)",
    "confounds": """confounds AS (SELECT element, timepoint, max(value) FILTER (col = 'click') AS csf, max(value) FILTER (col = 'error') AS white_matter,
  max(value) FILTER (col = 'view') AS global_signal, max(value) FILTER (col = 'purchase') / 100 AS framewise_displacement, max(value) FILTER (col = 'view') / 50 AS std_dvars FROM ev GROUP BY ALL)""",
    "fc8": """fc8 AS (SELECT a.element, a.col AS "row", CAST(a.idx AS INTEGER) AS row_idx, b.col AS col, CAST(b.idx AS INTEGER) AS col_idx,
  CASE WHEN stddev_pop(a.value) > 0 AND stddev_pop(b.value) > 0 THEN covar_pop(a.value, b.value) / (stddev_pop(a.value) * stddev_pop(b.value)) END AS value
  FROM series8 a JOIN series8 b ON a.element = b.element AND a.timepoint = b.timepoint AND a.idx >= b.idx GROUP BY ALL)""",
    "full8": """full8 AS (SELECT element, "row", col, value FROM fc8 UNION ALL SELECT element, col, "row", value FROM fc8 WHERE "row" <> col)""",
    "thin8": """thin8 AS (SELECT element, "row", col, CASE WHEN "row" <> col AND abs(value) >= 0.1 THEN value ELSE 0 END AS value FROM full8)""",
    "nan8": """nan8 AS (SELECT element, "row", col, CASE WHEN element = 3 AND "row" = 'P2' AND col IN ('P2', 'P3') THEN NULL ELSE value END AS value FROM full8)""",
}
_ORDER = list(SQL)


def with_tables(*names: str) -> str:
    """A WITH clause of the named tables, in an order that lets each refer to those before."""
    return "WITH " + ", ".join(SQL[n] for n in _ORDER if n in names) + " "
