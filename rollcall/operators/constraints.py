"""Constraints of the profile table kept up to date by change sets (O-31).

``quality.constraint_report`` reads the whole directory.  Here what it counts is
kept beside the directory: how many rows each id and username has, how many
identities each id has, and how many rows break each single-row rule, by key.  A change set (rows
added and removed) adds to or takes from these counts, so they are kept as a
log of differences, and only the keys that a change set touches are checked
again; the rest of the report is carried over.

Counts, differences and reports live under one root, a folder for each batch.  A
batch is written again if it is replayed (same changes, same files), and only
batches below it are read, so a writer that dies leaves earlier batches as they were.
``compact`` adds the log up, so that a batch need not read all earlier ones.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.sources.schemas import ROLES, USERNAME_MAX

# counts are kept by (entity, key): an id, a username, or a single-row rule
ID, USERNAME = "id", "username"
_COUNTS = "entity string, key string, n bigint, identities bigint"
_REPORT = "entity string, rule string, key string, violations bigint"


def counts_of(users: DataFrame, sign: int = 1) -> DataFrame:
    """(entity, key, n, identities): what rows of the directory add to the counts."""
    i, name = F.col("id"), F.col("username")
    cases = [
        (i.isNotNull(), ID, i),
        (name.isNotNull(), USERNAME, name),
        (i.isNull(), "id_not_null", name),
        (name.isNull(), "username_not_null", i),
        (F.char_length("username") > USERNAME_MAX, "username_length", i),
        (F.col("role").isNull() | ~F.col("role").isin(*ROLES), "role_enum", i),
    ]
    rows = F.array(*[F.when(c, F.struct(F.lit(e).alias("entity"), k.alias("key"))) for c, e, k in cases])
    found = users.select(F.explode(rows).alias("r")).where("r is not null")
    return found.select("r.entity", "r.key", F.lit(sign).cast("long").alias("n"), F.lit(0).cast("long").alias("identities"))


def identity_counts(identities: DataFrame, sign: int = 1) -> DataFrame:
    zero = F.lit(0).cast("long").alias("n")
    known = identities.select("id").where("id is not null")
    return known.select(F.lit(ID).alias("entity"), F.col("id").alias("key"), zero, F.lit(sign).cast("long").alias("identities"))


def added_up(counts: DataFrame) -> DataFrame:
    total = counts.groupBy("entity", "key").agg(F.sum("n").alias("n"), F.sum("identities").alias("identities"))
    return total.where("n <> 0 or identities <> 0")


def violations(counts: DataFrame) -> DataFrame:
    """(entity, rule, key, violations) of added-up counts; violations are broken rows, or 1 for a key held twice."""
    n, one = F.col("n"), F.lit(1).cast("long")
    cases = [
        ((F.col("entity") == ID) & (n > 1), "id_unique", one),
        ((F.col("entity") == ID) & (n > 0) & (F.col("identities") <= 0), "identity_exists", n),
        ((F.col("entity") == USERNAME) & (n > 1), "username_unique", one),
    ]
    own = F.when(~F.col("entity").isin(ID, USERNAME) & (n > 0), F.struct(F.col("entity").alias("rule"), n.alias("violations")))
    rows = [F.when(c, F.struct(F.lit(rule).alias("rule"), v.alias("violations"))) for c, rule, v in cases]
    found = counts.select("entity", "key", F.explode(F.array(own, *rows)).alias("r")).where("r is not null")
    return found.select("entity", "r.rule", "key", "r.violations")


class ConstraintLog:
    """Counts and reports of a directory under ``root``; batch 0 is the directory it starts with."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _path(self, kind: str, batch: int) -> str:
        return os.path.join(self.root, kind, f"batch={batch}")

    def _read(self, kind: str, schema: str, batches) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[self._path(kind, b) for b in batches])

    def _write(self, df: DataFrame, kind: str, batch: int) -> None:
        # sorted by key, so that a few keys read few row groups
        ordered = df.repartitionByRange("entity", "key").sortWithinPartitions("entity", "key")
        ordered.write.mode("overwrite").parquet(self._path(kind, batch))

    def start(self, users: DataFrame, identities: DataFrame) -> None:
        self._write(added_up(counts_of(users).unionByName(identity_counts(identities))), "counts", 0)
        self._write(violations(self._read("counts", _COUNTS, [0])), "report", 0)

    def apply(
        self,
        batch: int,
        added: DataFrame | None = None,
        removed: DataFrame | None = None,
        identities_added: DataFrame | None = None,
        identities_removed: DataFrame | None = None,
        since: int = 0,
    ) -> None:
        """Batch 1, 2, ...: changes to the directory; ``since``: the batch that counts were last compacted at."""
        parts = [counts_of(df, s) for df, s in ((added, 1), (removed, -1)) if df is not None]
        parts += [identity_counts(df, s) for df, s in ((identities_added, 1), (identities_removed, -1)) if df is not None]
        change = self.spark.createDataFrame([], _COUNTS)
        for part in parts:
            change = change.unionByName(part)
        self._write(added_up(change), "counts", batch)
        # only the touched keys are counted and checked; the batch is stored, so its size is known to the planner
        touched = self._read("counts", _COUNTS, [batch]).select("entity", "key")
        earlier = self._counts(since, batch)
        mine = self._among(earlier, touched, "left_semi").unionByName(self._read("counts", _COUNTS, [batch]))
        kept = self._among(self._read("report", _REPORT, [batch - 1]), touched, "left_anti")
        self._write(kept.unionByName(violations(added_up(mine))), "report", batch)

    @staticmethod
    def _among(df: DataFrame, touched: DataFrame, how: str) -> DataFrame:
        asked = touched.select(F.col("entity").alias("_entity"), F.col("key").alias("_key"))
        return df.join(asked, (df["entity"] == asked["_entity"]) & df["key"].eqNullSafe(asked["_key"]), how)

    def _counts(self, since: int, below: int) -> DataFrame:
        """Differences of the batches below ``below``, with those up to ``since`` added up."""
        if not since:
            return self._read("counts", _COUNTS, range(below))
        total = self._read("compacted", _COUNTS, [since])
        return total.unionByName(self._read("counts", _COUNTS, range(since + 1, below))) if below > since + 1 else total

    def compact(self, batch: int, since: int = 0) -> None:
        """Adds up the counts of all batches up to ``batch``, which is then the next ``since``."""
        self._write(added_up(self._counts(since, batch + 1)), "compacted", batch)

    def report(self, batch: int) -> DataFrame:
        """(rule, key, violations) after a batch."""
        return self._read("report", _REPORT, [batch]).select("rule", "key", "violations")
