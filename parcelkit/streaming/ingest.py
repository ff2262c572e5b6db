"""Features of elements as their files arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from parcelkit.sources.store import FeatureStore


def ingest(spark: SparkSession, folder: str, schema: StructType, marker: Callable[[DataFrame], DataFrame], store: FeatureStore, kind: str, meta: dict, checkpoint: str, files_per_batch: int = 1000) -> StreamingQuery:
    """Runs ``marker`` on the signal files that appear in ``folder`` and stores its rows.

    A batch that is run again after a failure adds nothing twice: elements that are stored are skipped.
    A file must hold whole elements.
    """
    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)

    def batch(df: DataFrame, _: int) -> None:
        store.store(kind, marker(df), meta)

    return arriving.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
