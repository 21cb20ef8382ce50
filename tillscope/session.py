"""Session settings and the shared folder for files that outlive a stage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping
from contextlib import contextmanager

from pyspark.sql import SparkSession

# For writes whose rows are read again: the shuffle files of a write go as it ends, not when
# the driver's garbage collector comes to them; Parquet is packed closer than by default; and
# a task with rows of a few folders writes them side by side instead of sorting (and spilling).
STORING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
    "spark.sql.maxConcurrentOutputFileWriters": "4",
}


def local_session(cores: int | str = "*", name: str = "tillscope", **conf: str) -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        # Recording the Python call site of every expression takes longer than planning.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        # Local tables are single small files: without these two, one task would
        # read a whole table and carry everything up to the next shuffle alone.
        .config("spark.sql.files.openCostInBytes", str(1 << 20))
        .config("spark.sql.autoBroadcastJoinThreshold", str(1 << 18))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@contextmanager
def session_conf(spark: SparkSession, settings: Mapping[str, str]):
    """The settings for as long as the block runs; those before come back."""
    before = {key: spark.conf.get(key, None) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def storing(spark: SparkSession):
    """Writes in this block leave nothing on disk but what they write."""
    return session_conf(spark, STORING)


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    Only a local session may fall back on a temporary folder: on a cluster the
    executors could not read each other's files there.
    """
    context = spark.sparkContext
    folder = context.getCheckpointDir()
    if folder is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
            folder = tempfile.mkdtemp(prefix="tillscope-")
        context.setCheckpointDir(folder)
        folder = context.getCheckpointDir()
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a written table under the shared folder."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"
