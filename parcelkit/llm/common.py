"""What the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelkit.plans.lineage import cut

#: The ASCII letters, the only ones that normalisation folds.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The white space that separates words (blank, tab to carriage return).
BLANKS = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(name: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def fold(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n)).cast("int")


#: Cuts the lineage with a reliable checkpoint, in the folder the cluster names in spark.checkpoint.dir.
durable = cut


#: A key is large if it has more than LARGE_ROWS rows and more than one in LARGE_KEYS of all rows.
LARGE_ROWS, LARGE_KEYS = 512, 10_000


def join_sized(rows: DataFrame, groups: DataFrame, on: list[str], size: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``groups``, which has one row for each key, with its number of rows in ``size``.

    The rows of a large key stay where they are and meet the key's group by broadcast; of ``total`` rows
    fewer than LARGE_KEYS keys can be large. All other keys are shuffled, so no task gets more than a few
    of them.
    """
    most = max(LARGE_ROWS, total // LARGE_KEYS)
    large, small = groups.where(F.col(size) > most), groups.where(F.col(size) <= most)
    hot = rows.join(F.broadcast(large), on)
    return hot.unionByName(rows.join(F.broadcast(large.select(*on)), on, "left_anti").join(small, on))


def arrow_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bounds the rows that one Arrow batch takes to a Python worker, where the session asks for more."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))
