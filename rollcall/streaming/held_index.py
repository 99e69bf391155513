"""What a stream has granted, as an index that a batch reads in part (O-35).

Keys (ids, usernames) are kept in runs of Parquet files, partitioned by a hash
bucket of the key.  A batch appends one run, and reads only the buckets that
its own keys fall into, of the runs that are alive.

Runs are merged like the digits of a counter: the run of batch n is on level
0, and ``FAN`` neighbouring runs of a level become one of the next.  Which runs
hold the batches below n follows from n alone (its digits to base ``FAN``), so
there is no list of runs to keep right: at most ``FAN - 1`` for each level, about
log n levels.  A key is rewritten once per level.  A run counts once Spark's
success marker is there; a half-written one is written again.

A replayed batch reads the runs of the batches below it and overwrites its own,
so it grants what it granted before.  The directory that the stream starts from
is a run of its own (``BASE``), written once; later batches read its buckets
too and never scan the directory.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FAN = 8
BUCKETS = 32  # more if micro-batches hold fewer names than there are buckets
BASE = "base"


def live_runs(below: int, fan: int = FAN) -> list[tuple[int, int]]:
    """(level, number) of the runs that hold the batches 0 .. below - 1, oldest first."""
    out, level = [], 0
    while below:
        below, digit = divmod(below, fan)
        out += [(level, below * fan + i) for i in reversed(range(digit))]
        level += 1
    return out[::-1]


class HeldIndex:
    """Keys of one kind under ``root``; every process that names the same root shares it."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS, fan: int = FAN):
        self.spark, self.root, self.buckets, self.fan = spark, root, buckets, fan

    # ------------------------------------------------------------- files

    def _fs(self, path: str):
        context = self.spark.sparkContext
        at = context._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(context._jsc.hadoopConfiguration()), at

    def _done(self, path: str) -> bool:
        fs, at = self._fs(os.path.join(path, "_SUCCESS"))
        return fs.exists(at)

    def _buckets_of(self, path: str) -> set[int]:
        fs, at = self._fs(path)
        if not fs.exists(at):
            return set()
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        return {int(n.split("=")[1]) for n in names if n.startswith("bucket=")}

    def _path(self, run: tuple[int, int] | str) -> str:
        return os.path.join(self.root, run if run == BASE else f"level={run[0]}-run={run[1]}")

    def _bucket(self):
        return F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int")

    def _write(self, keys: DataFrame, run) -> None:
        placed = keys.withColumn("bucket", self._bucket()).repartition("bucket").sortWithinPartitions("bucket", "key")
        placed.write.mode("overwrite").partitionBy("bucket").parquet(self._path(run))

    # -------------------------------------------------------------- keys

    def start(self, keys: DataFrame) -> None:
        """The keys (one column) held before the first batch; done once."""
        if not self._done(self._path(BASE)):
            self._write(_as_key(keys), BASE)

    def append(self, keys: DataFrame, batch_id: int) -> None:
        """The keys that a batch granted; written again if the batch is replayed."""
        self._write(_as_key(keys), (0, batch_id))

    def merge(self, below: int) -> None:
        """Makes the merged runs that hold the batches below ``below``, and drops what they were made of."""
        for run in live_runs(below, self.fan):
            self._merged(run)

    def _merged(self, run: tuple[int, int]) -> None:
        level, number = run
        if not level or self._done(self._path(run)):
            return
        parts = [(level - 1, number * self.fan + i) for i in range(self.fan)]
        for part in parts:
            self._merged(part)
        self._write(self._read(parts, None), run)
        for part in parts:
            fs, at = self._fs(self._path(part))
            fs.delete(at, True)

    def _read(self, runs, buckets: set[int] | None) -> DataFrame:
        paths = []
        for run in runs:
            path = self._path(run)
            have = self._buckets_of(path)
            paths += [f"{path}/bucket={b}" for b in sorted(have if buckets is None else have & buckets)]
        if not paths:
            return self.spark.createDataFrame([], "key string")
        return self.spark.read.schema("key string").parquet(*paths)

    def asked_buckets(self, keys: DataFrame) -> set[int]:
        """The buckets of the keys (one column): at most ``buckets`` numbers."""
        rows = _as_key(keys).select(self._bucket().alias("b")).distinct().collect()
        return {r["b"] for r in rows}

    def among(self, keys: DataFrame, below: int) -> DataFrame:
        """(key): what is held in the buckets of ``keys``, by the start and the batches below ``below``."""
        return self._read([BASE, *live_runs(below, self.fan)], self.asked_buckets(keys))


def _as_key(keys: DataFrame) -> DataFrame:
    named = keys.toDF("key")
    return named.where(F.col("key").isNotNull())
