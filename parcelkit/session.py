"""Session defaults of the engine."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Frames are integers and results must not depend on the host's zone; AQE sizes shuffles and splits skew.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
}


def session(app: str = "parcelkit", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the defaults, overridden by ``conf`` (dots as double underscores)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
