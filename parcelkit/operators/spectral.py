"""Amplitudes of low-frequency fluctuations."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelkit.model import key_columns, key_schema

KEYS = ("element",)


def alff(signal: DataFrame, highpass: float = 0.01, lowpass: float = 0.1, tr: float = 1.0, by: str = "voxel", keys: Sequence[str] = KEYS) -> DataFrame:
    """alff and falff of every series: summed amplitudes of the frequencies strictly inside the band,
    over the root of the length, and over the summed amplitudes of all positive frequencies.

    Frequencies count with both signs, as a full transform has them. One series goes to one task.
    """
    if not 0 <= highpass < lowpass or tr <= 0:
        raise ValueError("the band needs 0 <= highpass < lowpass, and tr is above 0")
    given = signal.select(*keys, by, "timepoint", F.col("value").cast("double").alias("value"))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        x = table.column("value").to_numpy()[np.argsort(table.column("timepoint").to_numpy())]
        f, size = np.abs(np.fft.fftfreq(len(x), tr)), np.abs(np.fft.fft(x))
        den, num = size[f > 0].sum(), size[(f > highpass) & (f < lowpass)].sum()
        return pa.table(key_columns(key, table.schema, 1) | {"alff": [float(num / np.sqrt(len(x)))], "falff": [float(num / den) if den > 1e-6 else 0.0]})

    return given.groupBy(*keys, by).applyInArrow(run, f"{key_schema(given, [*keys, by])}, alff double, falff double")
