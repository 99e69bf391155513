"""Join and ranking building blocks that stay safe on skewed keys.

Three patterns recur in the directory jobs:

* "first row of each group" (rank 1 of a window).  A window partitioned by
  the group key sends a whole group to one task, and one base name may hold
  a third of all rows.  We instead aggregate ``min_by(key, order)`` per group
  (partial aggregation: each map task sends one row per group) and join the
  winners back on the row's unique key, which cannot be skewed.

* "look up a dimension row for each fact row" where the fact key is skewed
  (one actor files a third of all requests).  Sort-merge would put the hot
  key in one task.  ``lookup_join`` finds the hot keys with a partial
  aggregate, broadcasts only their dimension rows (bounded by the number of
  hot keys, which is bounded by ``1 / hot_fraction``) and joins the cold
  remainder with an ordinary shuffle join.  AQE's skew-join split remains on
  as a second line of defence.

* "new rows not yet in the big table" (insert-ignore, taken names).
  ``anti_join_small`` first keeps the big table's keys that a staged batch asks
  about; the planner broadcasts that batch if its stored size allows, and the
  big table is then scanned rather than shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nulls_last_key(cols: Sequence[str | Column]) -> Column:
    """An orderable struct that sorts ascending with nulls last per field."""
    fields = []
    for i, c in enumerate(cols):
        col = F.col(c) if isinstance(c, str) else c
        fields.append(col.isNull().alias(f"n{i}"))
        fields.append(col.alias(f"v{i}"))
    return F.struct(*fields)


def first_keys(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str], key: str) -> DataFrame:
    """``key`` of the first row (ascending, nulls last, then ``key``) per group."""
    order = nulls_last_key([*order_cols, key])
    return df.groupBy(*group_cols).agg(F.min_by(F.col(key), order).alias(key)).select(key)


def mark_first(
    df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str], key: str, flag: str = "is_first"
) -> DataFrame:
    """Add boolean ``flag``: the row is rank 1 of its group.  ``key`` must be unique."""
    winners = first_keys(df, group_cols, order_cols, key).withColumn(flag, F.lit(True))
    return df.join(winners, key, "left").withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))


def anti_join_small(
    small: DataFrame, big: DataFrame | Callable[[DataFrame], DataFrame], key: str, big_key: str | None = None
) -> DataFrame:
    """``small`` rows whose ``key`` does not occur in ``big`` (a left anti join), for a staged ``small``.

    Spark cannot broadcast the left side of an anti join, so ``small`` anti
    ``big`` shuffles all of ``big``.  Instead: first the keys of ``big`` that
    ``small`` asks about (a semi join), then the anti join against that
    list.  ``small`` is a stored table, so the planner knows its bytes: below
    its broadcast threshold ``big`` is only scanned, above it both sides are
    shuffled as in any large join.  No size is assumed here.

    ``big`` may also be an index: a function that takes the asked keys (one
    column) and returns the part of the big table that can hold them.
    """
    if callable(big):
        big = big(small.select(key))
    big_keys = big.select(F.col(big_key or key).alias(key))
    present = big_keys.join(small.select(key), key, "left_semi")
    return small.join(present, key, "left_anti")


# Keys holding at least this share of the fact rows are treated as hot.  At
# most 1 / HOT_FRACTION keys can hold it, which bounds the list.
HOT_FRACTION = 0.001


def hot_keys_by_column(df: DataFrame, cols: Sequence[str], fraction: float = HOT_FRACTION) -> dict[str, list]:
    """Per column, the keys holding at least ``fraction`` of the rows (and two rows), in one aggregation pass.

    At most ``1 / fraction`` keys per column can reach the threshold, so the
    list is bounded without a limit.  The columns must have one type.
    """
    total = df.count()
    threshold = max(2, math.ceil(total * fraction))
    pairs = df.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).alias("key")) for c in cols])).alias("p")
    ).select("p.col", "p.key")
    rows = pairs.where(F.col("key").isNotNull()).groupBy("col", "key").count().where(F.col("count") >= threshold)
    out: dict[str, list] = {c: [] for c in cols}
    for r in rows.select("col", "key").orderBy("col", "key").collect():
        out[r["col"]].append(r["key"])
    return out


def hot_keys(df: DataFrame, key: str, fraction: float = HOT_FRACTION) -> list:
    """Keys holding at least ``fraction`` of the rows (partial aggregate, bounded list)."""
    return hot_keys_by_column(df, [key], fraction)[key]


def lookup_join(
    facts: DataFrame,
    keys: Sequence[str],
    dim: DataFrame,
    dim_key: str,
    hot: dict[str, list] | None = None,
) -> DataFrame:
    """Each fact row with the dimension row of each of its ``keys`` (left joins on a unique ``dim_key``).

    The dimension's columns come back as structs named ``<key>_row``, null
    where there is no such row.  Hot fact keys are served by broadcasting just
    their dimension rows (at most 1 / HOT_FRACTION per key column).  In the
    shuffle join their rows, and those without a key, match nothing and go by
    a hash of the row, so no task receives a hot key.  Keys are compared as text.
    ``facts`` is read three times (count, hot keys, joins) and the dimension
    once per key: pass scans or staged tables.
    """
    if hot is None:
        hot = hot_keys_by_column(facts, keys)
    out = facts
    for key in keys:
        row = F.struct(*[F.col(c) for c in dim.columns])
        known = dim.select(F.col(dim_key).cast("string").alias("_key"), row.alias("_row"))
        found = f"{key}_row"
        cold = F.col(key).isNotNull() & (~F.col(key).isin(hot[key]) if hot[key] else F.lit(True))
        spread = F.concat(F.lit("\x00"), F.xxhash64(*facts.columns).cast("string"))
        out = out.withColumn("_cold", cold)
        out = out.withColumn("_at", F.when(F.col("_cold"), F.col(key).cast("string")).otherwise(spread))
        out = out.join(known, (out["_at"] == known["_key"]) & out["_cold"], "left")
        out = out.drop("_key", "_cold", "_at").withColumnRenamed("_row", found)
        if hot[key]:
            few = known.where(F.col("_key").isin(hot[key]))  # at most len(hot) rows: the key is unique
            out = out.join(F.broadcast(few), out[key].cast("string") == few["_key"], "left")
            out = out.withColumn(found, F.coalesce(found, "_row")).drop("_key", "_row")
    return out
