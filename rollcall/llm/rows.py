"""Small helpers shared by the operators."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.session import scratch_path

# The word pattern of the contracts, and its separators
SPACE_RUN = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"


def split_words(text):
    """Array of the words of ``text`` (runs outside space and \\t..\\r); null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), "")


# A batch is held whole by a Python worker, next to what is made of it
BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Fewer rows to a batch than Spark's 10,000: a row here is a whole text."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def give_back_memory() -> None:
    """Gives what the allocators of a Python worker keep back to the system."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def tidy(work):
    """A ``mapInArrow`` function that gives its memory back to the system when its partition ends.

    Workers live on between tasks; what their allocators keep would add to
    that of the next stage.
    """

    def run(batches):
        try:
            yield from work(batches)
        finally:
            give_back_memory()

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sure_small(df: DataFrame, max_rows: int) -> bool:
    """Whether the table has at most ``max_rows`` rows; counts no further than that."""
    return df.limit(max_rows + 1).count() <= max_rows


class Rewritten:
    """A table in the shared folder that every round of an algorithm writes anew.

    A round reads only the table before it, which is dropped once the new one
    is written; the last one stays.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = scratch_path(spark, "rounds", f"{name}-{uuid.uuid4().hex}")
        self.turn = 0

    def write(self, df: DataFrame) -> DataFrame:
        path = os.path.join(self.root, str(self.turn))
        df.write.parquet(path)
        if self.turn:
            jvm = self.spark.sparkContext._jvm
            old = jvm.org.apache.hadoop.fs.Path(os.path.join(self.root, str(self.turn - 1)))
            old.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)
        self.turn += 1
        return self.spark.read.schema(df.schema).parquet(path)
