"""Model artifacts: contents named by their hash, manifests, and pointers that say
which version is active for a symbol, algorithm and horizon.

Contents are written and checked in tasks. Manifests and pointers are two tables
that are published together, so a change of many pointers is seen whole or not at
all, and two writers never undo each other's.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quantloom.sources import sinks
from quantloom.sources.shared import opened, ship

#: Fixed patterns and bounds of artifacts.
VERSION, SYMBOL, ALGORITHM = r"^[A-Za-z0-9._-]{1,64}$", r"^[0-9A-Z.-]{1,16}$", r"^[A-Za-z0-9._-]{1,64}$"
MOST_DAYS, MOST_BYTES = 365, 512 << 20
SCOPE = ["symbol", "algorithm", "horizon_days"]
MANIFESTS = "version string, symbol string, algorithm string, horizon_days int, sha256 string, size bigint, validation_status string, metrics map<string,double>, created_at timestamp"
POINTERS = "symbol string, algorithm string, horizon_days int, version string, previous_version string, activated_at timestamp"
BLOCK = 1 << 20


class ArtifactError(ValueError):
    """Nothing was changed: some artifact or pointer can't be taken."""


def columns(schema: str) -> list[str]:
    return StructType.fromDDL(schema).fieldNames()


def fault() -> Column:
    """Why a model (version, SCOPE, payload) can't be staged, null if it can."""
    bad = lambda c, pattern: ~F.coalesce(F.rlike(c, F.lit(pattern)), F.lit(False))
    size = F.coalesce(F.length("payload"), F.lit(0))
    return F.when(bad("version", VERSION), "version").when(bad("symbol", SYMBOL), "symbol").when(bad("algorithm", ALGORITHM), "algorithm").when(~F.coalesce(F.col("horizon_days").between(1, MOST_DAYS), F.lit(False)), "horizon").when(size == 0, "empty artifact").when(size > MOST_BYTES, "artifact too large")


def written(models: DataFrame, root: str) -> DataFrame:
    """models with sha256 and size, their payloads stored under that hash. A content
    appears by one rename and never changes, so a task that runs twice is harmless."""
    ship(models.sparkSession)
    carry = ["version", *SCOPE, "validation_status", "metrics"]
    kinds = dict(models.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = opened(f"{root}/content")
        for batch in batches:
            payloads = [x.as_py() for x in batch.column(len(carry))]
            digests = [hashlib.sha256(x).hexdigest() for x in payloads]
            for digest, payload in zip(digests, payloads):
                folder, name = f"{base}/{digest[:2]}", f"{base}/{digest[:2]}/{digest}"
                files.create_dir(folder)
                part = f"{folder}/.{digest}-{uuid.uuid4().hex}"
                with files.open_output_stream(part) as out:
                    out.write(payload)
                files.move(part, name)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carry)], pa.array(digests), pa.array([len(x) for x in payloads], pa.int64())], [*carry, "sha256", "size"])

    return models.select(*carry, "payload").mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in carry) + ", sha256 string, size bigint")


def checked(manifests: DataFrame, root: str) -> DataFrame:
    """manifests with error: `missing`, `size` or `checksum`, null where the stored
    content is what the manifest says. Contents are read a block at a time."""
    ship(manifests.sparkSession)
    names = [*manifests.columns, "error"]
    place = [names.index(c) for c in ("sha256", "size")]

    def state(files, base: str, digest: str, size: int) -> str | None:
        try:
            with files.open_input_stream(f"{base}/{digest[:2]}/{digest}") as f:
                found, length = hashlib.sha256(), 0
                while block := f.read(BLOCK):
                    found.update(block)
                    length += len(block)
        except FileNotFoundError:
            return "missing"
        return "size" if length != size else None if found.hexdigest() == digest else "checksum"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = opened(f"{root}/content")
        for batch in batches:
            errors = [state(files, base, d, n) for d, n in zip(*(batch.column(k).to_pylist() for k in place))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(errors, pa.string())], names)

    kinds = ", ".join(f"{c} {t}" for c, t in manifests.dtypes)
    return manifests.mapInArrow(run, f"{kinds}, error string")


def refuse(bad: DataFrame, what: str) -> None:
    """Raises if there are bad rows, and names some."""
    some = [tuple(r) for r in bad.limit(5).collect()]
    if some:
        raise ArtifactError(f"{what}: {some}")


def stage(spark: SparkSession, root: str, models: DataFrame) -> str:
    """Stores models (version, symbol, algorithm, horizon_days, payload,
    validation_status, metrics) and publishes their manifests, all or none.

    A version that is stored already stays as it is, if its scope is the same and
    its content sound, and is refused otherwise; so is one that stands twice among
    the models in different ways, and one with a fault. Contents of a refused call
    may remain stored, but no manifest names them.
    """
    models = models.withColumn("horizon_days", F.col("horizon_days").cast("int"))
    refuse(models.withColumn("fault", fault()).where("fault is not null").select("version", "fault"), "models that can't be staged")
    found = written(models, root).dropDuplicates(["version", *SCOPE, "sha256"])
    path = f"{root}/_staging-{uuid.uuid4().hex}"
    found.withColumn("created_at", F.current_timestamp()).select(*columns(MANIFESTS)).write.parquet(path)
    new = spark.read.schema(MANIFESTS).parquet(path)
    refuse(new.groupBy("version").agg(F.count("*").alias("n")).where("n > 1"), "versions that differ")

    def change(read):
        stored = read("manifests", MANIFESTS)
        own = new.select("version", *[F.col(c).alias(f"_{c}") for c in SCOPE])
        again = stored.join(own, "version")
        same = (F.col("symbol") == F.col("_symbol")) & (F.col("algorithm") == F.col("_algorithm")) & (F.col("horizon_days") == F.col("_horizon_days"))
        refuse(again.where(~same).select("version", *SCOPE), "versions stored for another scope")
        refuse(checked(again.where(same).select(*stored.columns), root).where("error is not null").select("version", "error"), "stored versions that are broken")
        return {"manifests": stored.unionByName(new.join(stored.select("version"), "version", "left_anti")), "pointers": read("pointers", POINTERS)}

    try:
        return sinks.updated(spark, root, change)
    finally:
        sinks.deleted(spark, path)


def sound(wanted: DataFrame, manifests: DataFrame, root: str) -> DataFrame:
    """wanted (version, SCOPE) with error: null where the version is stored for that
    scope and its content is sound."""
    own = checked(manifests.join(wanted.select("version").distinct(), "version", "left_semi"), root)
    m = own.select("version", *[F.col(c).alias(f"_{c}") for c in SCOPE], F.col("error").alias("_error"), F.lit(True).alias("_there"))
    same = (F.col("symbol") == F.col("_symbol")) & (F.col("algorithm") == F.col("_algorithm")) & (F.col("horizon_days") == F.col("_horizon_days"))
    error = F.when(F.col("_there").isNull(), "unknown version").when(~F.coalesce(same, F.lit(False)), "another scope").otherwise(F.col("_error"))
    return wanted.join(m, "version", "left").select(*wanted.columns, error.alias("error"))


def point(read, wanted: DataFrame, root: str) -> dict[str, DataFrame]:
    """The tables with the pointers of the wanted scopes at their versions."""
    manifests, pointers = read("manifests", MANIFESTS), read("pointers", POINTERS)
    refuse(sound(wanted, manifests, root).where("error is not null").select("version", "error"), "versions that can't be active")
    old = pointers.select(*SCOPE, F.col("version").alias("previous_version"))
    moved = wanted.join(old, SCOPE, "left").select(*SCOPE, "version", "previous_version", F.current_timestamp().alias("activated_at"))
    return {"manifests": manifests, "pointers": pointers.join(wanted.select(*SCOPE), SCOPE, "left_anti").select(*columns(POINTERS)).unionByName(moved)}


def activate(spark: SparkSession, root: str, wanted: DataFrame) -> str:
    """Makes versions (version, symbol, algorithm, horizon_days) the active ones of
    their scopes, in one publication; what was active is remembered. One that isn't
    stored for its scope, or whose content isn't sound, and a scope that is wanted
    twice, refuse the call, and every pointer stays."""
    wanted = wanted.select("version", "symbol", "algorithm", F.col("horizon_days").cast("int").alias("horizon_days"))
    refuse(wanted.groupBy(*SCOPE).agg(F.count("*").alias("n")).where("n > 1"), "scopes that are wanted twice")
    return sinks.updated(spark, root, lambda read: point(read, wanted, root))


def rollback(spark: SparkSession, root: str, scopes: DataFrame) -> str:
    """Makes the versions that were active before in the scopes active again, in one
    publication; rolled back once more they change places again. A scope without an
    active version or one before, or whose one before isn't sound any more, refuses
    the call."""
    asked = scopes.select("symbol", "algorithm", F.col("horizon_days").cast("int").alias("horizon_days")).distinct()

    def change(read):
        pointers = read("pointers", POINTERS)
        found = asked.join(pointers.select(*SCOPE, F.col("previous_version").alias("version")), SCOPE, "left")
        refuse(found.where("version is null").select(*SCOPE), "scopes without a version before")
        return point(read, found.select("version", *SCOPE), root)

    return sinks.updated(spark, root, change)


def current(spark: SparkSession, root: str) -> DataFrame:
    """SCOPE, version, previous_version, sha256, validation_status, metrics, error of
    every active version; error is null where its content is sound."""
    at = sinks.newest(spark, root)
    if not at:
        raise ArtifactError("nothing is published")
    manifests, pointers = (sinks.published(spark, root, t, at) for t in ("manifests", "pointers"))
    own = checked(manifests.join(pointers.select("version").distinct(), "version", "left_semi"), root)
    return pointers.join(own.drop(*SCOPE, "created_at", "size"), "version", "left").select(*SCOPE, "version", "previous_version", "sha256", "validation_status", "metrics", "error")


def payloads(manifests: DataFrame, root: str) -> DataFrame:
    """version and content of manifests (version, sha256), as they are stored."""
    ship(manifests.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = opened(f"{root}/content")
        for batch in batches:
            for version, digest in zip(*(c.to_pylist() for c in batch.columns)):
                with files.open_input_stream(f"{base}/{digest[:2]}/{digest}") as f:
                    yield pa.RecordBatch.from_arrays([pa.array([version]), pa.array([f.read()], pa.binary())], ["version", "content"])

    return manifests.select("version", "sha256").mapInArrow(run, "version string, content binary")
