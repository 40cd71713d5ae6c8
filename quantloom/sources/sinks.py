"""Writes: append-only logs, partition snapshots, all-or-nothing batches, reports."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def replace_snapshot(df: DataFrame, path: str, keys: list[str]) -> None:
    """Rows of the key values in df replace what is stored for them; other
    partitions stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def token() -> str:
    """A name that no other write has."""
    return uuid.uuid4().hex


def deleted(spark: SparkSession, path: str) -> None:
    where, fs = _file_system(spark, path)
    fs.delete(where, True)


class Conflict(RuntimeError):
    """Another writer has published since the version that a write builds on."""


def publish(spark: SparkSession, tables: dict[str, DataFrame], root: str, after: int | None = None) -> str:
    """Writes all tables as one version and then names it in a manifest of the
    next number: readers take the newest manifest, so they see all of the tables
    or those before, at any moment. A manifest comes into being by one rename,
    which fails if another writer was first; it then takes the next number. With
    `after`, the number that the tables were made from, it raises Conflict
    instead, and nothing is published."""
    version = uuid.uuid4().hex
    for name, df in tables.items():
        df.write.parquet(f"{root}/{version}/{name}")
    line = json.dumps({"version": version, "tables": sorted(tables)})
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.text(f"{root}/_new-{version}")
    source, fs = _file_system(spark, f"{root}/_new-{version}")
    for _ in range(1000):
        number = newest(spark, root) + 1
        if after is not None and number != after + 1:
            fs.delete(source, True)
            deleted(spark, f"{root}/{version}")
            raise Conflict(f"{root}: {number - 1} is published, not {after}")
        target, _ = _file_system(spark, f"{root}/_manifest-{number:012d}")
        # a rename onto an existing folder would move into it: only a new name counts
        if not fs.exists(target) and fs.rename(source, target) and not fs.exists(_file_system(spark, f"{target}/_new-{version}")[0]):
            return version
        if not fs.exists(source):
            source = _file_system(spark, f"{target}/_new-{version}")[0]
    raise OSError(f"could not publish {version}")


def newest(spark: SparkSession, root: str) -> int:
    """The number of the newest manifest, 0 if there is none."""
    where, fs = _file_system(spark, f"{root}/_manifest-*")
    found = fs.globStatus(where)
    return max((int(f.getPath().getName().rpartition("-")[2]) for f in found), default=0) if found is not None else 0


def published(spark: SparkSession, root: str, table: str, number: int | None = None) -> DataFrame:
    """A table of the newest version, or of that of a number."""
    at = newest(spark, root) if number is None else number
    version = json.loads(spark.read.text(f"{root}/_manifest-{at:012d}").first()[0])["version"]
    return spark.read.parquet(f"{root}/{version}/{table}")


def updated(spark: SparkSession, root: str, change: Callable[[Callable[[str, str], DataFrame]], dict[str, DataFrame]], tries: int = 10) -> str:
    """Publishes what `change` makes of the newest version. change is given a
    function (table, schema) that reads a table of that version, empty if nothing
    is published, and runs anew on what is there whenever another writer was first."""
    for _ in range(tries):
        at = newest(spark, root)

        def read(table: str, schema: str) -> DataFrame:
            return published(spark, root, table, at) if at else spark.createDataFrame([], schema)

        try:
            return publish(spark, change(read), root, after=at)
        except Conflict:
            continue
    raise Conflict(f"{root}: others were first {tries} times")


def json_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys and payload: the rest of each row as JSON, decimals as strings."""
    plain = [F.col(c).cast("string").alias(c) if t.startswith("decimal") else F.col(c) for c, t in df.dtypes if c not in keys]
    return df.select(*keys, F.to_json(F.struct(*plain)).alias("payload"))
