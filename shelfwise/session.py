"""Session settings, durable checkpoints and size checks shared by every job."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")
R = TypeVar("R")

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "20000",
}


_LOCAL_DIRS: dict[str, str] = {}


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A session for tests and benches; on a cluster the submitted session is used as it is."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("shelfwise")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def durable_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    Taken from ``spark.checkpoint.dir``.  Only a local-mode session may fall back to a
    temporary folder, because there every task sees the same disk.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="shelfwise-")
    return _LOCAL_DIRS[app]


def durable_path(spark: SparkSession, name: str) -> str:
    """A new, unused folder below :func:`durable_dir`, grouped by application."""
    app = spark.sparkContext.applicationId
    return f"{durable_dir(spark).rstrip('/')}/shelfwise/{app}/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = durable_path(spark, "stage")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_count_within(df: DataFrame, limit: int) -> int | None:
    """Exact row count when it is at most ``limit``, else ``None`` (stops early)."""
    n = df.limit(limit + 1).count()
    return n if n <= limit else None


def side_by_side(spark: SparkSession, run: Callable[[T], R], inputs: Iterable[T], at_once: int = 4) -> list[R]:
    """Results in input order of independent driver steps; Spark fills idle cores with their jobs."""
    with ThreadPoolExecutor(at_once) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(run), x) for x in inputs]]
