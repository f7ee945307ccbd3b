"""Intermediate tables in the folder that driver and executors share.

Iterative jobs cut their lineage by writing a table and reading it back. The folder is
``spark.checkpoint.dir`` of the session, else the checkpoint folder that was set on the
context. A session in one JVM (tests, a notebook) may do without: it gets a temporary
folder, which goes with the process. On a cluster there is no such way out, since every
executor would write to a disk of its own.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables, without a trailing slash."""
    context = spark.sparkContext
    given = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if given:
        return given.rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all nodes of {context.master} share")
    app = context.applicationId
    if app not in _OWN:
        own = tempfile.mkdtemp(prefix="spark-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        _OWN[app] = f"file://{own}"
    return _OWN[app]


def own_dir(spark: SparkSession) -> str:
    """The folder of this application in the shared one."""
    return f"{shared_dir(spark)}/rollkin-{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder.

    What is returned has no lineage beyond the files, so a lost executor costs a
    re-read only. An empty ``df`` gives an empty table with the same columns.
    """
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` returned and that nothing reads any more; other frames are left alone."""
    for df in tables:
        path = _PATHS.pop(df, None)
        if path:
            _delete(df.sparkSession, path)


def cleanup(spark: SparkSession) -> None:
    """Deletes all that this application wrote here: call it when the results of its queries are stored."""
    _delete(spark, own_dir(spark))


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def sorted_join(df: DataFrame) -> DataFrame:
    """``df``, of a row for each record, text or gram, with a hint that joins with it sort and merge.

    Spark judges a stored table by its compressed size and rows by those before they were
    exploded; without the hint it broadcasts what is many times larger in memory, and the
    driver has to hold it.
    """
    return df.hint("merge")


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` with a broadcast hint if a count proves it has at most ``max_rows`` rows.

    Above the bound ``df`` comes back as it is and Spark shuffles the join.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
