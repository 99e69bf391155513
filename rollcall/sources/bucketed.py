"""Directory tables stored in hash buckets of their key (O-18 .. O-23, O-28).

Back-fills, cascade deletes and login touches join the whole directory on
``id``.  Stored as ``buckets`` buckets of the key, sorted within each, the
directory is read in place for such a join: its side has no Exchange, and two
tables of the same number of buckets join without any.  The other side is
shuffled into the directory's buckets.

The catalog keeps what a path cannot: that the files are buckets.  Give at least
as many buckets as the session has shuffle partitions, or the planner prefers
to shuffle; about one gigabyte to a bucket suits large tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rollcall.session import scratch_path


def write_bucketed(df: DataFrame, name: str, buckets: int, key: str = "id", path: str | None = None) -> DataFrame:
    """``df`` as catalog table ``name``, bucketed and sorted by ``key``; one file to a bucket.

    Files go to ``path``, by default in the shared folder.
    """
    spark = df.sparkSession
    where = path or scratch_path(spark, "bucketed", name)
    dealt = df.repartition(buckets, key).sortWithinPartitions(key)
    dealt.write.bucketBy(buckets, key).sortBy(key).option("path", where).format("parquet").saveAsTable(name)
    return spark.table(name)


def read_bucketed(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def attach_bucketed(spark: SparkSession, name: str, like: DataFrame, buckets: int, path: str, key: str = "id") -> DataFrame:
    """A bucketed table written by another session, made known to this session's catalog."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in like.schema.fields)
    spark.sql(
        f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS "
        f"LOCATION '{path}'"
    )
    return spark.table(name)
