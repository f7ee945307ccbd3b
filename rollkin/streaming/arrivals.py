"""Register loads from a folder that files arrive in.

Each micro-batch is upserted into a store that commits by manifest
(``rollkin/sources/store.py``). Of rows with one natural key the last wins: by the time
and name of their file, then by their row in it. That order is stored with the rows, so a
batch that is replayed after a failure, or all files after a lost checkpoint, change
nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from rollkin.sources import registry as rg
from rollkin.sources import store as st

ARRIVING = T.StructType([T.StructField(c, T.StringType()) for c in (*rg.TEXT_COLUMNS, "serial_no", "age")])


def arrivals(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of extracted rows from Parquet files, with the file's name and the order of arrival."""
    arrived = F.struct(F.col("_metadata.file_modification_time").alias("time"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    return spark.readStream.schema(ARRIVING).parquet(folder).select("*", F.col("_metadata.file_name").alias("source_file"), arrived.alias(st.ORDER))


def upsert_batch(batch: DataFrame, store: str, year: int | None = None) -> int:
    """Puts a batch into ``store`` and gives the version. Without a ``year``, a file's name tells it."""
    new = rg.prepare_ingest(batch.withColumn("ingest_order", F.col(st.ORDER)), F.col("source_file"), year)
    return st.upsert(store, new.drop("ingest_order"), rg.NATURAL_KEY)


def load(spark: SparkSession, folder: str, store: str, checkpoint: str, year: int | None = None) -> StreamingQuery:
    """Loads what is in ``folder`` now, a version for each micro-batch that changes something, and stops."""

    def put(batch: DataFrame, number: int) -> None:
        upsert_batch(batch, store, year)

    return arrivals(spark, folder).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
