"""Two-column clustering: files that are narrow in both columns (O-10 with O-13).

Sorted by ``id`` alone, a directory lets a key look-up skip files, but every
file holds all days; sorted by ``created_at`` it is the other way round.  Here
each row gets the number of its quantile in either column, and rows are sorted by
the interleaved bits of the two numbers, so a file covers a narrow range of
both and a filter on either column skips most files by their statistics.

Quantile bounds come from a sample of ``SAMPLE`` rows by hash: they shape the
layout only, never the contents.  Nulls go to the first quantile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 8
SAMPLE = 20_000


def bounds(values: list, bits: int = BITS) -> list:
    """The ``2 ** bits - 1`` values that cut sorted ``values`` into equal parts; repeats stay."""
    values = sorted(v for v in values if v is not None)
    parts = 1 << bits
    return [values[len(values) * i // parts] for i in range(1, parts)] if values else []


def with_quantile(df: DataFrame, column: str, cuts: list, name: str, bits: int = BITS) -> DataFrame:
    """``df`` with ``name``: how many of ``cuts`` are at most the value, found by halving; 0 for null.

    A projection for each step, as every step reads the number so far twice.
    """
    df = df.withColumn(name, F.lit(0))
    if not cuts:
        return df
    table = F.array(*[F.lit(c) for c in cuts]).cast(f"array<{df.schema[column].dataType.simpleString()}>")
    for bit in reversed(range(bits)):
        step = 1 << bit
        more = F.when(F.col(column) >= F.element_at(table, F.col(name) + step), step).otherwise(0)
        df = df.withColumn(name, F.col(name) + more)
    return df


def interleaved(x: Column, y: Column, bits: int = BITS) -> Column:
    """Bits of ``x`` and ``y`` in turns, highest first."""
    out = F.lit(0)
    for bit in range(bits):
        for place, value in ((2 * bit + 1, x), (2 * bit, y)):
            out = out + F.shiftleft(F.shiftright(value, bit).bitwiseAND(F.lit(1)), place)
    return out


def clustered(df: DataFrame, one: str, two: str, bits: int = BITS) -> DataFrame:
    """``df`` range-partitioned and sorted by the interleaved quantiles of two columns."""
    sample = df.select(one, two).orderBy(F.xxhash64(one, two)).limit(SAMPLE).collect()
    placed = df
    for number, c in (("_q1", one), ("_q2", two)):
        placed = with_quantile(placed, c, bounds([r[c] for r in sample], bits), number, bits)
    placed = placed.select(*df.columns, interleaved(F.col("_q1"), F.col("_q2"), bits).alias("_z"))
    return placed.repartitionByRange("_z", two).sortWithinPartitions("_z", two).drop("_z")
