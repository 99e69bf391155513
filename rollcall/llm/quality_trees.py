"""Quality classifier: boosted trees over document statistics.

Method.  Every whole text becomes a row of statistics: its length, shares of
character classes, word shapes, and how much of its words, word pairs,
eight-word windows and lines repeats.  Histogram gradient-boosted trees are
fitted in numpy on a sample of at most ``FIT_ROWS`` labelled documents,
flattened into arrays, and every document is scored by vectorised traversal
inside Arrow batches.  The score is the probability of label 1.

No shuffle: the scan of the documents is scored where it lies.  A slice of a
batch holds a few megabytes of text at a time.

Defined results: null or empty texts have all statistics at 0 and a score;
rows that repeat are scored each; null ids are kept; without labels, or with
one class only, every score is the smoothed share of label 1; other columns
are no input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm.labelled import known_labels, matrix, sample
from rollcall.llm.rows import small_batches
from rollcall.llm.trees import Forest, fit
from rollcall.llm.words import WordHasher, mix64, slices, text_bytes

FIT_ROWS = 20_000

# Byte classes of the statistics
_CLASSES = (
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    b"abcdefghijklmnopqrstuvwxyz",
    b"0123456789",
    b"#*$%&|<>",
    b"|",
    b"!",
    b".,;:?",
    b"\n",
    b"=_/\\\"'(){}[]@",
)
_UPPER, _LOWER, _SYMBOL = 0, 1, 3


def _tables() -> np.ndarray:
    out = np.zeros((len(_CLASSES) + 1, 256), np.int64)
    for i, members in enumerate(_CLASSES):
        out[i, list(members)] = 1
    out[-1, 128:] = 1
    return out


def _distinct(row: np.ndarray, value: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of distinct values of each row, and the count of its commonest."""
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    opens = np.ones(len(row), bool)
    opens[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(opens)
    most = np.zeros(rows, np.int64)
    np.maximum.at(most, row[at], np.diff(np.append(at, len(row))))
    return np.bincount(row[at], minlength=rows), most


class Statistics:
    """Turns a column of texts into rows of statistics."""

    def __init__(self):
        self.tables, self.hasher, self.lines = _tables(), WordHasher(), WordHasher(separators=(0x0A,))

    def __call__(self, column: pa.Array) -> np.ndarray:
        data, offsets = text_bytes(column)
        n = len(column)
        size = np.diff(offsets)
        per = lambda part, whole: part / np.maximum(whole, 1)
        total = lambda marks: np.concatenate(([0], np.cumsum(marks)))
        counts = [np.diff(total(t[data])[offsets]) for t in self.tables]
        words = self.hasher.words(column)
        row, w = words.row, words.counts
        length = words.end - words.start
        sum_by = lambda x: np.bincount(row, x, n)
        letters = counts[_UPPER] + counts[_LOWER]
        distinct, most = _distinct(row, words.hash, n)
        twin = np.zeros(len(row))
        twin[1:] = (words.hash[1:] == words.hash[:-1]) & (row[1:] == row[:-1])
        last, first = data[words.end - 1], data[words.start]
        columns = [np.log1p(w), per(sum_by(length), w), np.sqrt(per(sum_by(length.astype(float) ** 2), w))]
        columns += [per(c, size) for c in counts]
        columns += [per(counts[_UPPER], letters), per(distinct, w), per(most, w), per(sum_by(twin), w)]
        for window in (2, 8):
            start, value = self.hasher.windows(words, window)
            kinds, _ = _distinct(row[start], value, n)
            columns.append(per(kinds, np.bincount(row[start], minlength=n)))
        lines = self.lines.words(column)
        kinds, _ = _distinct(lines.row, lines.hash, n)
        columns += [per(kinds, lines.counts), per(w, lines.counts), np.log1p(lines.counts)]
        columns += [per(sum_by(self.tables[_SYMBOL][last]), w), per(sum_by(self.tables[_UPPER][first]), w)]
        columns += [per(sum_by((length <= 3).astype(float)), w), per(sum_by((length >= 12).astype(float)), w)]
        return np.column_stack(columns).astype(np.float64)


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    statistics = Statistics()
    for batch in batches:
        for part in slices(batch, "text"):
            rows = pa.array(list(statistics(part.column(2))), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1).cast(pa.int32()), rows], ["doc_id", "label", "x"])


def fit_quality(docs: DataFrame, labels: DataFrame, usable, most: int = FIT_ROWS, label: str = "quality") -> Forest:
    """Trees fitted on at most ``most`` labelled documents for which ``usable`` (over labels) holds."""
    small_batches(docs.sparkSession)
    rows = sample(docs.select("doc_id", "text"), known_labels(labels, label, usable), most)
    made = rows.select(F.col("doc_id").cast("bigint"), "label", "text").mapInArrow(
        _examples, "doc_id bigint, label int, x array<double>"
    )
    # an id that repeats counts once, so at most ``most`` rows come to the driver
    got = made.groupBy("doc_id").agg(F.min(F.struct("label", "x")).alias("one")).select("one.*").toArrow()
    y = got.column("label").to_numpy().astype(float)
    x = matrix(got.column("x"))
    order = np.lexsort((*x.T, y)) if len(y) else []  # task order must not change the sums
    return fit(x[order], y[order])


def score_quality(docs: DataFrame, forest: Forest) -> DataFrame:
    """(doc_id, score) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        statistics = Statistics()
        for batch in batches:
            for part in slices(batch, "text"):
                score = forest.probability(statistics(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score)], ["doc_id", "score"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint"), "text")
    return rows.mapInArrow(run, "doc_id bigint, score double")
