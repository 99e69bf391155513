"""Profile sink (O-04) and the additive column (O-05).

Plain parquet has no MERGE, so an update produces a new snapshot version in
its own directory.  A version counts once its commit marker is there: a small
text table of its own under ``commits``, holding the version number and
written after the data.  Markers and versions are only ever added, never
replaced: a reader takes the highest committed version, so it never sees a
half-written one, and a writer that died leaves earlier versions as they were
(its unfinished directory is skipped, never written over).  Only a missing
path counts as "no version yet"; any other read error is raised.

All paths are on the shared folder (``spark.checkpoint.dir`` or a table root
the caller names), and all I/O goes through Spark, so the same code works on
HDFS / object stores.
"""

from __future__ import annotations

import os
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.sources.tables import missing_path
from rollcall.sources.zorder import clustered

COMMITS = "commits"


def with_additive_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """O-05: add any nullable column of ``schema`` that ``df`` lacks, as NULL."""
    for field in schema.fields:
        if field.name not in df.columns:
            df = df.withColumn(field.name, F.lit(None).cast(field.dataType))
    return df


def version_path(root: str, version: int) -> str:
    return os.path.join(root, f"version={version:08d}")


def current_version(spark: SparkSession, root: str) -> int | None:
    """The highest committed version; None if nothing was committed yet."""
    markers = spark.read.schema("value string").option("recursiveFileLookup", "true")
    try:
        return markers.text(os.path.join(root, COMMITS)).agg(F.max(F.col("value").cast("int"))).first()[0]
    except AnalysisException as exc:
        if missing_path(exc):
            return None
        raise


def write_snapshot(
    df: DataFrame, root: str, cluster_by: str | tuple[str, str] | None = None, bloom: tuple[str, ...] = ()
) -> int:
    """Write ``df`` as the next version and commit it; returns the version.

    ``cluster_by`` (e.g. ``"id"``) range-partitions and sorts the version by
    that column, so each file and row group covers a narrow key range and a
    key lookup (O-13) skips the rest by their min/max statistics.  A pair of
    columns (e.g. ``("created_at", "id")``) clusters by both (``zorder``).
    ``bloom`` columns get Bloom filters, by which an equality on a column that
    is not clustered skips row groups.
    """
    spark = df.sparkSession
    latest = current_version(spark, root)
    version = 0 if latest is None else latest + 1
    if isinstance(cluster_by, tuple):
        df = clustered(df, *cluster_by)
    elif cluster_by:
        df = df.repartitionByRange(cluster_by).sortWithinPartitions(cluster_by)
    while True:
        try:
            writer = df.write.mode("errorifexists")
            for column in bloom:
                writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
            writer.parquet(version_path(root, version))
            break
        except AnalysisException as exc:
            if exc.getCondition() != "PATH_ALREADY_EXISTS":
                raise
            version += 1  # left by a writer that did not commit
    marker = os.path.join(root, COMMITS, f"{version:08d}-{uuid.uuid4().hex}")
    spark.createDataFrame([(str(version),)], "value string").coalesce(1).write.mode("errorifexists").text(marker)
    return version


def current_path(spark: SparkSession, root: str) -> str:
    version = current_version(spark, root)
    if version is None:
        raise FileNotFoundError(f"no snapshot under {root}")
    return version_path(root, version)


def read_snapshot(spark: SparkSession, root: str, schema: T.StructType | None = None) -> DataFrame:
    """The current version; with a declared schema, columns the files lack are NULL (O-05)."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(current_path(spark, root))
