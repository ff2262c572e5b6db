"""Cutting the lineage of iterative plans."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Where none is named, a session in local mode (tests, a notebook) gets a temporary one; on a cluster
    that is an error, since a machine's own folder is no place for what other machines must read.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of ``df``, in the folder of checkpoint_folder()."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def delete(spark: SparkSession, folder: str) -> None:
    """Deletes a folder, of any file system that the session knows."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
