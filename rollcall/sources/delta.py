"""Snapshots that rewrite only what changed (O-04, for O-28 and O-30).

``snapshots`` writes the whole table for every version.  Here rows are dealt to
hash buckets of their key, a version holds the buckets that its changes fall into, and
its commit marker names for every bucket the version that it is read from.  The
rules are those of ``snapshots``: a version counts once its marker is there, versions and markers are
only added, and a reader takes the highest committed one, so a writer that dies
leaves earlier versions as they were, and every committed version stays readable.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.sources.snapshots import COMMITS, version_path
from rollcall.sources.tables import missing_path

BUCKETS = 1024


class ChangedSnapshots:
    """Versions of one table with a unique, non-null ``key`` under ``root``."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, key: str = "id", buckets: int = BUCKETS):
        self.spark, self.root, self.schema, self.key, self.buckets = spark, root, schema, key, buckets

    def _bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int").alias("bucket")

    def commits(self) -> dict[int, dict[int, int]]:
        """Committed versions: for each, the version that each of its buckets is read from."""
        markers = self.spark.read.schema("value string").option("recursiveFileLookup", "true")
        try:
            rows = markers.text(os.path.join(self.root, COMMITS)).collect()  # one row per version
        except AnalysisException as exc:
            if missing_path(exc):
                return {}
            raise
        found = [json.loads(r["value"]) for r in rows]
        return {c["version"]: {int(b): v for b, v in c["buckets"].items()} for c in found}

    def _files(self, of: dict[int, int], only: set[int] | None = None) -> DataFrame:
        paths = [f"{version_path(self.root, v)}/bucket={b}" for b, v in sorted(of.items()) if only is None or b in only]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def read(self, version: int | None = None) -> DataFrame:
        """The highest committed version, or an earlier one."""
        commits = self.commits()
        if not commits:
            raise FileNotFoundError(f"no snapshot under {self.root}")
        return self._files(commits[max(commits) if version is None else version])

    def _commit(self, df: DataFrame, before: dict[int, int], touched: set[int] | None, latest: int | None) -> int:
        version = 0 if latest is None else latest + 1
        dealt = df.select(*self.schema.names, self._bucket()).repartition("bucket").sortWithinPartitions("bucket", self.key)
        while True:
            try:
                dealt.write.mode("errorifexists").partitionBy("bucket").parquet(version_path(self.root, version))
                break
            except AnalysisException as exc:
                if exc.getCondition() != "PATH_ALREADY_EXISTS":
                    raise
                version += 1  # left by a writer that did not commit
        made = self.spark.read.schema("bucket int").parquet(version_path(self.root, version)).select("bucket").distinct()
        written = {r["bucket"] for r in made.collect()}  # at most ``buckets`` numbers
        kept = {} if touched is None else {b: v for b, v in before.items() if b not in touched}
        line = json.dumps({"version": version, "buckets": {**kept, **{b: version for b in written}}})
        marker = os.path.join(self.root, COMMITS, f"{version:08d}-{uuid.uuid4().hex}")
        self.spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("errorifexists").text(marker)
        return version

    def write(self, df: DataFrame) -> int:
        """The whole table as the next version."""
        commits = self.commits()
        return self._commit(df, {}, None, max(commits, default=None))

    def apply(self, changed: DataFrame | None = None, deleted: DataFrame | None = None) -> int:
        """The next version: rows of ``changed`` replace or join those of their key, keys of ``deleted`` go.

        Reads and writes the buckets of these keys only.
        """
        commits = self.commits()
        latest = max(commits, default=None)
        of = commits[latest] if commits else {}
        none = self.spark.createDataFrame([], self.schema)
        new = none if changed is None else changed.select(*self.schema.names)
        keys = new.select(self.key)
        if deleted is not None:
            keys = keys.unionByName(deleted.select(self.key))
        touched = {r["bucket"] for r in keys.select(self._bucket()).distinct().collect()}
        stays = self._files(of, touched).join(keys.distinct(), self.key, "left_anti").select(*self.schema.names)
        return self._commit(stays.unionByName(new), of, touched, latest)
