"""Distributed 1-based row positions over a total order.

``row_number() OVER (ORDER BY ...)`` without a partition moves every row
into one task.  Instead: a global sort (range-partitioned, spread over all
tasks), a per-partition index from ``monotonically_increasing_id`` (within a
sorted partition it counts rows in order), one reliable checkpoint so that
the sampled range boundaries are fixed, per-partition counts (one row per
partition), their running offsets, and a broadcast join of those offsets.
The broadcast side has exactly one row per partition of the sorted data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollcall.session import durable

_PART = "_pos_part"
_MONO = "_pos_mono"


def with_position(df: DataFrame, order: Sequence[Column], name: str = "pos") -> DataFrame:
    """``df`` sorted by ``order`` (which must be total) with column ``name`` = 1..n."""
    tagged = durable(
        df.orderBy(*order).select("*", F.spark_partition_id().alias(_PART), F.monotonically_increasing_id().alias(_MONO))
    )
    # one row per partition of the sort: the running sum over them runs in a
    # single task, on at most spark.sql.shuffle.partitions rows
    counts = tagged.groupBy(_PART).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(_PART, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    # monotonically_increasing_id() puts the partition id in the upper 31 bits
    # and the record number within the partition in the lower 33 bits (as the
    # PySpark API reference documents), so this is the row's index in its
    # sorted partition; partitions may hold up to 8 billion rows.
    local_index = F.col(_MONO) - F.shiftleft(F.col(_PART).cast("long"), 33)
    out = tagged.join(F.broadcast(offsets), _PART).withColumn(name, F.col("_offset") + local_index + F.lit(1))
    return out.drop(_PART, _MONO, "_offset")
