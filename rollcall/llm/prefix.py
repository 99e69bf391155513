"""Distributed running totals within groups of any size.

Rows carry a uniformly random 60-bit key.  Each group's key range is cut into
equal slices, so a slice holds few rows however large the group is; rows are
sorted inside their slice, and slice totals (one row per slice) are summed in
slice order.  No task ever holds a whole group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY_BITS = 60
SLICE_ROWS = 20_000


def random_key(*columns: Column) -> Column:
    """60 uniform bits from the md5 of the columns (as text, null apart from empty)."""
    text = F.concat_ws("\x01", *[F.coalesce(c.cast("string"), F.lit("\x02")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, KEY_BITS // 4), 16, 10).cast("long")


def running_total(
    df: DataFrame, group: Column, key: str, order: Sequence[Column], value: Column, name: str, rows: int
) -> DataFrame:
    """``df`` with ``name`` = total of ``value`` over the rows before this one in its group.

    ``group`` must be a non-null expression, ``key`` a column made by
    ``random_key``; rows of a group go by (key, order).  ``rows`` is the
    table's row count, which sets the number of slices.
    """
    count = max(1, -(-rows // SLICE_ROWS))
    tagged = df.withColumns(
        {
            "_group": group,
            "_slice": F.floor(F.col(key) / F.lit(float(1 << KEY_BITS)) * count).cast("int"),
            "_value": value,
        }
    )
    place = Window.partitionBy("_group", "_slice").orderBy(key, *order).rowsBetween(Window.unboundedPreceding, 0)
    inside = tagged.withColumn("_inside", F.sum("_value").over(place) - F.col("_value"))
    before = Window.partitionBy("_group").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = tagged.groupBy("_group", "_slice").agg(F.sum("_value").alias("_total"))
    offsets = totals.select("_group", "_slice", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))
    out = inside.join(offsets, ["_group", "_slice"]).withColumn(name, F.col("_before") + F.col("_inside"))
    return out.drop("_group", "_slice", "_value", "_inside", "_before")
