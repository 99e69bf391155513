"""Spark session settings and the shared folder for durable intermediate data."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on: UTC wall clock, adaptive execution with skew
# handling, and no web UI (no extra port).
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "rollcall") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in BASE_CONF.items():
        builder = builder.config(key, value)
    builder = (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "8g")
        # large collects fail in this container unless the driver binds loopback
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    apply_conf(spark)
    return spark


def apply_conf(spark: SparkSession) -> None:
    """Pin the runtime SQL settings the library's semantics depend on."""
    for key, value in BASE_CONF.items():
        if key.startswith("spark.sql."):
            spark.conf.set(key, value)


def shared_dir(spark: SparkSession) -> str:
    """The cluster-wide checkpoint folder (``spark.checkpoint.dir``).

    Read from the session; only a local session without one gets a fresh
    scratch folder, since a machine-local folder is useless on a cluster.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # a client session (Spark Connect) has no SparkContext
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured:
            raise RuntimeError("spark.checkpoint.dir must name a shared folder") from None
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        configured = tempfile.mkdtemp(prefix="rollcall-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, *parts: str) -> str:
    """A path under the shared folder, for written tables and stream state."""
    return os.path.join(shared_dir(spark), "rollcall", *parts)


def _app_id(spark: SparkSession) -> str:
    """Staged tables of one application share a folder, to be dropped when it ends."""
    try:
        return spark.sparkContext.applicationId
    except Exception:  # client sessions expose no SparkContext
        return spark.conf.get("spark.app.id", "session")


# the folder that staged tables go to, if not the application's own
_AREA: ContextVar[str | None] = ContextVar("staged_area", default=None)


@contextmanager
def staged_area(spark: SparkSession):
    """Tables staged inside are dropped at the end: only for results already written elsewhere.

    A long-running stream uses one area per micro-batch, or its staged
    tables would fill the shared folder.
    """
    path = scratch_path(spark, "stage", _app_id(spark), f"area-{uuid.uuid4().hex}")
    token = _AREA.set(path)
    try:
        yield path
    finally:
        _AREA.reset(token)
        jvm = spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def durable(df: DataFrame, name: str = "stage", partition_by: str | None = None) -> DataFrame:
    """Materialise ``df`` as a parquet table in the shared folder and cut its lineage.

    A written table rather than ``checkpoint()``: one job instead of two (an
    eager checkpoint computes the plan once to count and again to write), a
    columnar copy, and size statistics on read-back so that adaptive
    execution can still choose join strategies.  Never ``localCheckpoint``:
    the data must outlive the loss of the executor that computed it.
    """
    spark = df.sparkSession
    area = _AREA.get() or scratch_path(spark, "stage", _app_id(spark))
    path = os.path.join(area, f"{name}-{uuid.uuid4().hex}")
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    # read back with the known schema: types stay exact (a partition column
    # would otherwise be re-inferred) and an empty result still has columns
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)
