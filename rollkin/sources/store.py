"""A register store with upserts that are committed by a manifest.

Rows lie in buckets by the hash of their natural key. An upsert rewrites only the buckets
that its rows fall into, into files that no reader knows yet, and then adds a manifest that
names the files of every bucket. A manifest is created under the next number, which fails
if another writer was faster; readers take the last one, so they see an upsert whole or
not at all.

Each row keeps the order in which it arrived: time and name of its file, row in the file.
Of rows with one key the latest wins, in whatever order, and however often, they are
loaded: a batch that is replayed, or a whole folder after a lost checkpoint, changes
nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns that tell when a row arrived, as one sortable value.
ORDER = "arrived"


class CommitConflict(Exception):
    """Another writer has committed this version."""


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def versions(spark: SparkSession, store: str) -> list[int]:
    fs, folder = _fs(spark, f"{store}/manifest")
    if not fs.exists(folder):
        return []
    return sorted(int(s.getPath().getName().removesuffix(".json")) for s in fs.listStatus(folder) if s.getPath().getName().endswith(".json"))


def manifest(spark: SparkSession, store: str, version: int | None = None) -> dict:
    """The manifest of a version, by default the last: number of buckets, schema and a folder for each bucket that has rows."""
    known = versions(spark, store)
    if not known:
        return {"version": 0, "buckets": {}, "schema": None, "key": None, "n_buckets": None}
    path = f"{store}/manifest/{version or known[-1]:08d}.json"
    return json.loads("".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))  # one small file


def _commit(spark: SparkSession, store: str, new: dict) -> None:
    fs, target = _fs(spark, f"{store}/manifest/{new['version']:08d}.json")
    jvm = spark.sparkContext._jvm
    draft = jvm.org.apache.hadoop.fs.Path(f"{store}/manifest/.{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(new).encode()))
    out.close()
    if fs.exists(target) or not fs.rename(draft, target):
        fs.delete(draft, False)
        raise CommitConflict(f"version {new['version']} of {store} is there already")


def read(spark: SparkSession, store: str, version: int | None = None) -> DataFrame:
    """The rows of a version, without the columns of the store; an empty store has none to read."""
    now = manifest(spark, store, version)
    if not now["version"]:
        raise ValueError(f"{store} has no version yet")
    return _files(spark, now, list(now["buckets"].values())).drop(ORDER)


def _files(spark: SparkSession, now: dict, folders: list[str]) -> DataFrame:
    schema = T.StructType.fromJson(now["schema"])
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def latest(rows: DataFrame, key: list[str]) -> DataFrame:
    """Of the rows of one key the one that arrived last; null key parts are equal. Combines before it shuffles."""
    kept = F.max_by(F.struct(*[F.col(c) for c in rows.columns]), F.col(ORDER))
    return rows.groupBy(*[F.col(k).alias(f"_{k}") for k in key]).agg(kept.alias("r")).select("r.*")


def upsert(store: str, rows: DataFrame, key: list[str], n_buckets: int = 64) -> int:
    """Puts ``rows`` (with ``arrived``) into the store and gives the version, the same as before if there was nothing to change.

    The first upsert fixes the number of buckets, the key and the schema; later rows may
    lack columns, which become null.
    """
    spark = rows.sparkSession
    now = manifest(spark, store)
    n, key = now["n_buckets"] or n_buckets, now["key"] or key
    schema = T.StructType.fromJson(now["schema"]) if now["schema"] else rows.schema
    bucket = F.pmod(F.xxhash64(*[F.coalesce(F.col(k).cast("string"), F.lit("\0")) for k in key]), F.lit(n))
    whole = rows.select(*[F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema])
    touched = sorted(r[0] for r in whole.select(bucket.alias("b")).distinct().collect())  # a number for each bucket at most
    if not touched:
        return now["version"]
    now |= {"schema": json.loads(schema.json()), "key": key, "n_buckets": n}
    old = _files(spark, now, [now["buckets"][str(b)] for b in touched if str(b) in now["buckets"]])
    folder = f"{store}/data/{now['version'] + 1:08d}-{uuid.uuid4().hex}"
    merged = latest(old.unionByName(whole), key).withColumn("_bucket", bucket)
    merged.repartition("_bucket").sortWithinPartitions("_bucket", *key).write.partitionBy("_bucket").parquet(folder)
    _commit(spark, store, now | {"version": now["version"] + 1, "buckets": now["buckets"] | {str(b): f"{folder}/_bucket={b}" for b in touched}})
    return now["version"] + 1


def vacuum(spark: SparkSession, store: str, keep: int = 2) -> int:
    """Deletes the manifests before the last ``keep`` and the bucket folders that only they name; gives the number of folders deleted."""
    known = versions(spark, store)
    live = {p for v in known[-keep:] for p in manifest(spark, store, v)["buckets"].values()}
    dead = {p for v in known[:-keep] for p in manifest(spark, store, v)["buckets"].values()} - live
    for path in [*dead, *(f"{store}/manifest/{v:08d}.json" for v in known[:-keep])]:
        fs, target = _fs(spark, path)
        fs.delete(target, True)
    return len(dead)
