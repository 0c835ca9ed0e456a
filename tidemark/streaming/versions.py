"""Keyed tables in numbered versions; a version counts once its writer has left the success mark.

Rows lie in buckets by a hash of their keys. How many is chosen when a table is first written, so that a batch
touches a small part of them, and stands in every manifest. A version is a manifest that names for each bucket
the folder that holds it, so a batch writes the buckets it touches and carries the others over by name. A large
bucket is written by several tasks. A reader never sees half a version, and a batch that is replayed after a crash
writes the same version again from the same predecessor. ``remove_old`` frees what no kept version names.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 64
_BUCKET = "__bucket"


class Manifest(NamedTuple):
    """The schema of a version's rows, its number of buckets and the folder of each bucket that has rows."""

    schema: T.StructType
    buckets: int
    folders: dict[int, str]


def name(generation: int, batch: int = -1) -> str:
    """Folder name of a rebuild (``batch`` -1) or of a stream batch after it; names sort in time order."""
    return f"v{generation:08d}-{batch + 1:012d}"


def _files(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def complete(spark: SparkSession, path: str) -> list[str]:
    """Names of the complete versions below ``path``, oldest first."""
    pattern, files = _files(spark, f"{path}/v*/_SUCCESS")
    found = files.globStatus(pattern)
    return sorted(status.getPath().getParent().getName() for status in found or [])


def latest(spark: SparkSession, path: str, before: str | None = None) -> str | None:
    names = [n for n in complete(spark, path) if before is None or n < before]
    return names[-1] if names else None


def generation_of(version: str) -> int:
    return int(version[1:9])


def bucket(keys: list[str], buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def manifest(spark: SparkSession, path: str, version: str) -> Manifest:
    where, files = _files(spark, f"{path}/{version}/manifest.json")
    opened = files.open(where)
    try:
        held = json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(opened, "UTF-8"))
    finally:
        opened.close()
    folders = {int(b): f for b, f in held["folders"].items()}
    return Manifest(T.StructType.fromJson(held["schema"]), held["buckets"], folders)


def _commit(spark: SparkSession, path: str, version: str, made: Manifest) -> None:
    """Write a manifest, a line per bucket at most, and then its mark; no Spark job."""
    held = {"schema": made.schema.jsonValue(), "buckets": made.buckets, "folders": made.folders}
    for file, text in (("manifest.json", json.dumps(held)), ("_SUCCESS", "")):
        where, files = _files(spark, f"{path}/{version}/{file}")
        out = files.create(where, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()


def read(
    spark: SparkSession, path: str, version: str | None = None, only: set[int] | None = None
) -> DataFrame:
    """The rows of a version (default: the latest), or of some of its buckets."""
    chosen = version or latest(spark, path)
    if chosen is None:
        raise FileNotFoundError(f"no complete version in {path}")
    return _rows(spark, path, manifest(spark, path, chosen), only)


def _rows(spark: SparkSession, path: str, held: Manifest, only: set[int] | None = None) -> DataFrame:
    folders = [f"{path}/{f}" for b, f in sorted(held.folders.items()) if only is None or b in only]
    return spark.read.schema(held.schema).parquet(*folders) if folders else spark.createDataFrame([], held.schema)


def write(
    df: DataFrame,
    path: str,
    version: str,
    keys: list[str],
    buckets: int = BUCKETS,
    carried: dict[int, str] | None = None,
) -> None:
    """Write ``df`` as the buckets it has rows in, next to the ``carried`` ones, and commit the version.

    The rows are rebalanced by bucket: small buckets share a task, and adaptive execution deals a large one out
    to as many tasks as it fills.
    """
    spark = df.sparkSession
    place = f"rows-{version}"
    bucketed = df.withColumn(_BUCKET, bucket(keys, buckets)).hint("rebalance", _BUCKET)
    # Files may appear one by one, as nothing reads them before the manifest names them.
    writer = bucketed.write.mode("overwrite").option("mapreduce.fileoutputcommitter.algorithm.version", "2")
    writer.partitionBy(_BUCKET).parquet(f"{path}/{place}")
    where, files = _files(spark, f"{path}/{place}/{_BUCKET}=*")
    folders = dict(carried or {})
    for status in files.globStatus(where) or []:
        folder = status.getPath().getName()
        folders[int(folder.split("=")[1])] = f"{place}/{folder}"
    _commit(spark, path, version, Manifest(df.schema, buckets, folders))


def update(
    path: str, version: str, touched: DataFrame, keys: list[str], change: Callable[[DataFrame], DataFrame]
) -> None:
    """Commit ``version``: the version before with ``change`` applied to the buckets that ``touched`` has keys in."""
    spark = touched.sparkSession
    before = manifest(spark, path, latest(spark, path, before=version))
    rows = touched.select(bucket(keys, before.buckets).alias("b")).distinct().collect()
    chosen = {r["b"] for r in rows}
    carried = {b: f for b, f in before.folders.items() if b not in chosen}
    write(change(_rows(spark, path, before, only=chosen)), path, version, keys, before.buckets, carried)


def remove_old(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Delete all but the last ``keep`` versions and the rows only they name; returns what was deleted.

    Keep at least two: a batch that is replayed starts from the version before the last.
    """
    names = complete(spark, path)
    old, kept = names[:-keep], names[-keep:]
    used = {f.split("/")[0] for n in kept for f in manifest(spark, path, n).folders.values()}
    gone = [*old, *[f"rows-{n}" for n in old if f"rows-{n}" not in used]]
    for folder in gone:
        where, files = _files(spark, f"{path}/{folder}")
        files.delete(where, True)
    return gone
