"""What sources need of the cluster: the package on workers, a shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyarrow import fs as filesystems
from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[2])
_own: list[str] = []


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package wherever the driver was started."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [ROOT, env.get("PYTHONPATH", "")]))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, deleted when the driver ends; a
    local session that names none gets a temporary one, a cluster has to name one."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="quantloom-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        base = f"file://{_own[0]}"
    path = f"{base}/{name}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def opened(path: str) -> tuple[filesystems.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:") and not path.startswith("file://"):
        path = path[len("file:") :]
    return filesystems.FileSystem.from_uri(path if "://" in path else str(Path(path).absolute()))
