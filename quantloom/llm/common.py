"""What the operators share: staged tables, Arrow text access, word splitting
on bytes, groups streamed from sorted partitions, connected components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

REPO = str(Path(__file__).resolve().parents[2])
WORD = r"[^\x20\x09-\x0D]+"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
TASK_BYTES = 4 << 20
BATCH_BYTES = 8 << 20
LEAST_LONG = -(2**63)


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package wherever the driver was started,
    and bounds the bytes of an Arrow batch, which holds whole texts."""
    env = spark.sparkContext.environment
    if REPO not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [REPO, env.get("PYTHONPATH", "")]))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


_kept: dict[str, object] = {}


def keep(kind: str, make: Callable[[], object]) -> object:
    """What a worker keeps from task to task: the tables of one operator at a
    time, so that the steps of a pipeline don't add up."""
    if kind not in _kept:
        family = kind.split(":")[0]
        for other in [k for k in _kept if k.split(":")[0] != family]:
            del _kept[other]
        _kept[kind] = make()
    return _kept[kind]


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a local session gets a folder of its own; a cluster has
    to name one.
    """
    conf = spark.sparkContext.getConf()
    if found := conf.get("spark.checkpoint.dir", None):
        return found
    if not conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not hasattr(scratch, "own"):
        scratch.own = tempfile.mkdtemp(prefix="quantloom-")
        atexit.register(shutil.rmtree, scratch.own, ignore_errors=True)
    return f"file://{scratch.own}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back.

    This cuts the lineage: a lost executor costs no recomputation beyond the
    table, and the shuffle files of the job that wrote it are freed at its end.
    The table is deleted when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def drop_stage(df: DataFrame) -> None:
    """Deletes a staged table that no later plan reads."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.staged_at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def one_by_one(rows: DataFrame, alike: list[str]) -> DataFrame:
    """alike and turn: a row for each row, those alike in all columns told apart
    by a turn from 0. They are counted where they lie, by part of the table, and
    each part's turns follow the parts before, so that no task and no array holds
    more than one part's of a large group."""
    counted = rows.select(*alike, F.pmod(F.spark_partition_id(), F.lit(1024)).alias("part")).groupBy(*alike, "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy(*alike).orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranges = counted.select(*alike, "n", before.alias("before"))
    return ranges.select(*alike, F.explode(F.sequence(F.col("before"), F.col("before") + F.col("n") - 1)).alias("turn"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows and len + 1 offsets into them; null counts as empty."""
    column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def slices(at: np.ndarray, limit: int = TASK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most limit bytes (one row may be longer)."""
    start = 0
    while start < len(at) - 1:
        end = max(start + 1, int(np.searchsorted(at, at[start] + limit, "right")) - 1)
        yield start, min(end, len(at) - 1)
        start = end


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_bounds(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words of rows laid end to end, and len + 1
    offsets of the rows into them."""
    inside = ~SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[at[:-1]] = True
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, at)


MIX = np.uint64(0x9E3779B97F4A7C15)
MIX2 = np.uint64(0xBF58476D1CE4E5B9)
S29, S32 = np.uint64(29), np.uint64(32)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> S32)) * MIX2
    h = (h ^ (h >> S29)) * MIX
    return h ^ (h >> S32)


def grouped(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Whole groups of rows with equal keys, from batches sorted by them; keys
    are not null. Holds one group and one batch at a time."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        edge = np.zeros(len(columns[0]), bool)
        for c in columns:
            edge[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(edge).tolist(), len(edge)]
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield pa.concat_tables(held)
                held = []
            held.append(table.slice(a, b - a))
            last = key
    if held:
        yield pa.concat_tables(held)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component: the smallest node reachable over undirected edges.

    Alternates large-star and small-star rounds, each a distributed join on a
    minimum per node, until a round changes no edge. Nodes without an edge to
    another node are not returned; nulls take no part.
    """
    x, y = F.col(a), F.col(b)
    now = stage(edges.where(x != y).select(F.greatest(x, y).alias("hi"), F.least(x, y).alias("lo")).distinct(), "edges")
    mark = F.struct(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")))
    seen = now.agg(mark).first()[0]
    while True:
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").where("v != m").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        small = large.groupBy("hi").agg(F.min("lo").alias("m"))
        star = large.join(small, "hi").select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e")).select("e.*").where("hi != lo").distinct()
        after = stage(star, "edges")
        drop_stage(now)
        was, seen, now = seen, after.agg(mark).first()[0], after
        if was == seen:
            break
    nodes = now.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return nodes.unionByName(nodes.select(F.col("component").alias("node"), "component").distinct())
