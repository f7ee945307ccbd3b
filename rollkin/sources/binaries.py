"""Photos and documents, stored so that reading some of them moves none of them.

A table of binaries is bucketed and sorted by its key. A reader joins it with the keys it
wants: these few columns are sent to the buckets (or to every task, where Spark knows them
to be small), while the binaries are read where they lie and never shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def store(rows: DataFrame, table: str, key: str, n_buckets: int = 64, path: str | None = None) -> None:
    """Writes ``rows`` as the table of that name, in ``path`` if given; rows with a null key can't be asked for and are left out."""
    kept = rows.where(F.col(key).isNotNull())
    # one file a bucket: without the repartition every task would write one for each
    writer = kept.repartition(n_buckets, key).write.bucketBy(n_buckets, key).sortBy(key).mode("overwrite").format("parquet")
    (writer.option("path", path) if path else writer).saveAsTable(table)


def fetched(spark: SparkSession, table: str, wanted: DataFrame, key: str) -> DataFrame:
    """The rows of ``table`` whose key is in ``wanted``, each once."""
    keys = wanted.select(F.col(key)).where(F.col(key).isNotNull()).distinct()
    return spark.table(table).join(keys, key, "left_semi")


def attached(spark: SparkSession, table: str, wanted: DataFrame, key: str) -> DataFrame:
    """``wanted`` with the columns of ``table``, a row for each binary of a row's key; rows without one aren't in the result.

    Repeated keys in ``wanted`` share a bucket with their binaries. ``wanted`` should hold
    ids and what is small; wider columns are better joined afterwards.
    """
    return spark.table(table).join(wanted, key)
