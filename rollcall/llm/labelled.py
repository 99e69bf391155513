"""Bounded samples of labelled documents, for fitting on the driver."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(doc_id.cast("string")) % folds


def known_labels(labels: DataFrame, label: str, usable: Column) -> DataFrame:
    """(doc_id, label) of the labelled ids for which ``usable`` holds; of several labels the larger."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & usable)
    return known.groupBy("doc_id").agg(F.max(label).alias("label"))


def sample(docs: DataFrame, known: DataFrame, most: int, balanced: bool = False) -> DataFrame:
    """(doc_id, label, every other column of ``docs``) of at most ``most`` ids of ``known``.

    Ids are taken in hash order, so the sample is the same on every run;
    ``balanced`` takes at most half of them from either label.  ``most``
    bounds both the broadcast of the ids and what a fit brings to the driver.
    """
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    if balanced:
        ones = known.where("label = 1").orderBy(*order).limit(most // 2)
        ids = ones.unionByName(known.where("label = 0").orderBy(*order).limit(most // 2))
    else:
        ids = known.orderBy(*order).limit(most)
    return docs.join(F.broadcast(ids), "doc_id")


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of numbers, collected as lists of one length, as a matrix."""
    return np.array(column.to_pylist(), float).reshape(len(column), -1) if len(column) else np.zeros((0, 1))
