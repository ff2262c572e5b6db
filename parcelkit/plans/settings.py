"""Settings of the engine: from the session, then the environment, then a default."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

PREFIX = "spark.parcelkit."


def typed(text: str) -> bool | int | float | str:
    """A text as the plainest type it spells."""
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            continue
    return text


def get(name: str, default: object = None, spark: SparkSession | None = None) -> object:
    """The setting ``a.b``: spark.parcelkit.a.b of the session, or PARCELKIT_A_B of the environment."""
    spark = spark or SparkSession.getActiveSession()
    found = spark.conf.get(PREFIX + name, None) if spark is not None else None
    found = found if found is not None else os.environ.get("PARCELKIT_" + name.replace(".", "_").upper())
    return typed(found) if found is not None else default


def put(name: str, value: object, spark: SparkSession) -> None:
    spark.conf.set(PREFIX + name, str(value).lower() if isinstance(value, bool) else str(value))
