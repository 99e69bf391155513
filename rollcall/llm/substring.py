"""Substring dedup: repeated runs of words are removed wherever they start later.

Method: level-wise doubling.  At the first level, ten words, only the windows
that a longer repeat would have to contain are looked at: of the ten-word
windows inside each twenty-word window, the one with the smallest hash.  Equal
twenty-word windows pick equal ten-word windows, so a twenty-word window can
only repeat if its pick does.  Windows repeated at ten words alone are
extended to twenty; those that repeat are the spans to remove.  Longer repeats
are unions of them, so the removal ends there.  ``repeat_levels`` goes on: those
repeated at twenty alone are extended to forty words, and so on until no
candidate survives, which tells how long each document's longest repeats are.

A text equal to that of a smaller doc_id is a repeat from its first word to its
last, so such copies are settled by their digests before any window is made.

Every level sorts (window hash, document, place) by hash over all tasks and
streams through the runs of equal hash, so neither a very common passage nor a
large group of copies is ever held in memory.  Before the shuffle each slice
of a batch sends a window that it has several times only once, and settles
the others itself.  Texts are fetched by document id for the levels and for
the removal; Spark reuses that one exchange.

"Earlier" means a smaller doc_id, or the same document and an earlier start.

Defined results: null text or no words gives 0 words and an empty rest; rows
with the same id and text are one document, and neither removes words of the
other; rows that share only the id are ordered by a hash of the text; a null
id counts as larger than every other, and rows without one go by a hash of the
text; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm.rows import small_batches, sure_small
from rollcall.llm.words import WordHasher, Words, mix64, signed, slices
from rollcall.session import durable

WINDOW = 20
PLACE_BITS = 40  # a place is 23 bits of the text's hash above the number of the word
WHOLE = (1 << PLACE_BITS) - 1  # in the place of a number: the whole text is a copy
BROADCAST_COPIES = 1_000_000  # 16 MB of (id, hash)

_PLACE = "place bigint"


def _picks(hasher: WordHasher, words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each window of a row: its first word, hash, and the first word and hash of its half-length pick."""
    half = window // 2
    start, value = hasher.windows(words, window)
    if not len(start):
        return start, value, start, value
    # half-length windows run to the end of the rows, so index them by word
    inner_at, inner = hasher.windows(words, half)
    by_word = np.zeros(len(words.hash), np.uint64)
    by_word[inner_at] = inner
    best, where = by_word[start], start.copy()
    for step in range(1, window - half + 1):
        other = by_word[start + step]
        less = other < best
        best = np.where(less, other, best)
        where[less] = start[less] + step
    return start, value, where, best


def _places(words: Words, at: np.ndarray, row: np.ndarray, mark: np.ndarray) -> np.ndarray:
    return (mark[row] << PLACE_BITS) + (at - words.first[row])


def _first_of_each(key: np.ndarray, doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by (key, doc, place); whether a row opens its key; size of the key's group per row."""
    order = np.lexsort((place, doc, key))
    sorted_key = key[order]
    opens = np.ones(len(order), bool)
    opens[1:] = sorted_key[1:] != sorted_key[:-1]
    group = np.cumsum(opens) - 1
    return order, opens, np.bincount(group)[group] if len(order) else group


def _own_key(doc: np.ndarray) -> np.ndarray:
    """A key for rows that are settled already: one per document, so that they pack well."""
    return mix64(doc.astype(np.uint64) ^ np.uint64(0x5851F42D4C957F2D))


def _rows(key: np.ndarray, doc: np.ndarray, place: np.ndarray, known: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [signed(key), pa.array(doc), pa.array(place), pa.array(known)], ["key", "doc", "place", "known"]
    )


_ROWS = f"key bigint, doc bigint, {_PLACE}, known boolean"


def _level_one(window: int):
    """Picked half-length windows.  ``known``: repeated within this slice already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            for part in slices(batch, "text"):
                words = hasher.words(part.column(2))
                _, _, where, best = _picks(hasher, words, window)
                new = np.ones(len(where), bool)
                new[1:] = where[1:] != where[:-1]
                at, key = where[new], best[new]
                row = words.row[at]
                doc = part.column(0).to_numpy()[row]
                place = _places(words, at, row, part.column(1).to_numpy())
                order, opens, many = _first_of_each(key, doc, place)
                first, known = np.empty(len(key), bool), np.empty(len(key), bool)
                first[order], known[order] = opens, many > 1
                # one row of a repeated window goes by its key, the others by their document's
                yield _rows(np.where(first, key, _own_key(doc)), doc, place, known)

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, place) of rows, sorted by key, whose key repeats or is known to."""
    held, last = None, None
    for batch in batches:
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        keep = batch.column(3).to_numpy(zero_copy_only=False).copy()
        same = key[1:] == key[:-1]
        keep[1:] |= same
        keep[:-1] |= same
        if last is not None:
            keep |= key == last
        if keep[-1]:
            last = key[-1]
        held = batch.slice(batch.num_rows - 1)
        done = batch.take(pa.array(np.flatnonzero(keep[:-1])))
        if done.num_rows:
            yield done.select(["doc", "place"])
    if held is not None and (held.column(3)[0].as_py() or held.column(0)[0].as_py() == last):
        yield held.select(["doc", "place"])


def _level_two(window: int):
    """Full windows around the candidate picks of each document (columns doc, mark, text, places, ...).

    ``known``: an earlier start lies in this slice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            for part in slices(batch, "text"):
                words = hasher.words(part.column(2))
                start, value, where, _ = _picks(hasher, words, window)
                marks = part.column(1).to_numpy()
                lists = part.column(3)
                row = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
                at = lists.flatten().to_numpy() & WHOLE
                at = words.first[row] + at
                candidate = np.zeros(len(words.hash) + 1, bool)
                # ids shared by several texts mix their lists; what is out of range is not this text's
                candidate[at[at < words.first[row + 1]]] = True
                use = candidate[where]
                start, key = start[use], value[use]
                row = words.row[start]
                doc, place = part.column(0).to_numpy()[row], _places(words, start, row, marks)
                order, opens, _ = _first_of_each(key, doc, place)
                lead = np.empty(len(key), np.int64)
                lead[order] = order[np.flatnonzero(opens)[np.cumsum(opens) - 1]]
                # an equal (doc, place) is the same document again, not an earlier start
                later = (doc != doc[lead]) | (place != place[lead])
                yield _rows(np.where(later, _own_key(doc), key), doc, place, later)

    return run


def _later_starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, place) of rows sorted by (key, doc, place) that are not the first start of their key."""
    key_now = doc_now = place_now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, doc, place = (batch.column(i).to_numpy() for i in range(3))
        opens = np.ones(len(key), bool)
        opens[1:] = key[1:] != key[:-1]
        lead = np.flatnonzero(opens)[np.cumsum(opens) - 1]
        lead_doc, lead_place = doc[lead], place[lead]
        if key_now is not None:
            run = key == key_now
            lead_doc[run], lead_place[run] = doc_now, place_now
        later = (doc != lead_doc) | (place != lead_place) | batch.column(3).to_numpy(zero_copy_only=False)
        key_now, doc_now, place_now = key[-1], lead_doc[-1], lead_place[-1]
        if later.any():
            yield batch.take(pa.array(np.flatnonzero(later))).select(["doc", "place"])


def _removal(window: int):
    """Per document: id, n_words, n_removed and the kept words (columns doc_id, mark, text, places)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words, removed, kept = [], [], []
                texts, marks, places = part.column(2), part.column(1).to_numpy(), part.column(3)
                for i in range(part.num_rows):
                    raw = (texts[i].as_py() or "").encode().split()  # bytes split at exactly the six separators
                    starts = places[i].values
                    n = len(raw)
                    if starts is not None and len(starts):
                        place = starts.to_numpy()
                        at = place[(place >> PLACE_BITS) == marks[i]] & WHOLE
                        if len(at) and at.max() == WHOLE:
                            at = np.arange(max(0, n - window + 1))
                        change = np.zeros(n + 1, np.int64)
                        np.add.at(change, at, 1)
                        np.add.at(change, at + window, -1)
                        keep = np.cumsum(change[:n]) == 0
                        raw = [w for w, k in zip(raw, keep.tolist()) if k]
                    words.append(n)
                    removed.append(n - len(raw))
                    kept.append(b" ".join(raw).decode())
                yield pa.RecordBatch.from_arrays(
                    [part.column(4), pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                    ["doc_id", "n_words", "n_removed", "kept_text"],
                )

    return run


class SubstringDedup:
    """Repeated windows of ``window`` words (an even number) in ``docs`` (doc_id, text)."""

    def __init__(self, docs: DataFrame, window: int = WINDOW):
        if window < 2 or window % 2:
            raise ValueError("window must be an even number of words")
        self.window = window
        small_batches(docs.sparkSession)
        mark = F.shiftrightunsigned(F.xxhash64("text"), 64 - (63 - PLACE_BITS))
        self.docs = docs.select(
            F.coalesce("doc_id", self._beyond(docs)).alias("doc"), mark.alias("mark"), "text", "doc_id"
        )

    @staticmethod
    def _beyond(docs: DataFrame):
        """Numbers above every doc_id for rows without one, by a hash of the text, so that they are documents apart."""
        room = (1 << 63) - 2 - max(docs.agg(F.max("doc_id")).first()[0] or 0, 0)
        if room < 1:
            return F.lit((1 << 63) - 1)
        # never null, or the inner join would filter its side and have an exchange of the texts for itself
        return F.coalesce(F.lit((1 << 63) - 1) - F.pmod(F.xxhash64(F.lit(9), "text"), F.lit(room)), F.lit((1 << 63) - 1))

    def _with_places(self, places: DataFrame, how: str) -> DataFrame:
        # a place tells its text, so versions of one id do not get each other's places
        lists = places.groupBy("doc", F.shiftrightunsigned("place", PLACE_BITS).alias("mark"))
        lists = lists.agg(F.collect_list("place").alias("places"))
        return self.docs.join(lists, ["doc", "mark"], how).select("doc", "mark", "text", "places", "doc_id")

    def copies(self) -> DataFrame:
        """(doc, mark) of the texts that a smaller id has too."""
        digests = durable(self.docs.where("text is not null").select("doc", "mark", F.md5("text").alias("digest")), "digests")
        ends = digests.groupBy("digest").agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
        later = digests.join(ends.where("first < last"), "digest").where("doc > first")
        return later.select("doc", "mark").distinct()

    def candidates(self, copies: DataFrame) -> DataFrame:
        """(doc, place) of the half-length picks that repeat, outside copies."""
        texts = self.docs.where("text is not null").select("doc", "mark", "text")
        small = F.broadcast(copies) if sure_small(copies, BROADCAST_COPIES) else copies
        texts = texts.join(small, ["doc", "mark"], "left_anti")
        rows = texts.mapInArrow(_level_one(self.window), _ROWS).repartition("key").sortWithinPartitions("key")
        return rows.mapInArrow(_repeated, f"doc bigint, {_PLACE}")

    def later_starts(self) -> DataFrame:
        """(doc, place) of every window that also starts earlier; a copy has one place, ``WHOLE``."""
        copies = durable(self.copies(), "copies")
        # the same columns as in ``result``, so that one exchange of the texts serves both
        rows = self._with_places(self.candidates(copies), "inner").mapInArrow(_level_two(self.window), _ROWS)
        rows = rows.repartition("key").sortWithinPartitions("key", "doc", "place")
        later = rows.mapInArrow(_later_starts, f"doc bigint, {_PLACE}")
        whole = F.shiftleft(F.col("mark"), PLACE_BITS).bitwiseOR(F.lit(WHOLE)).alias("place")
        return later.unionByName(copies.select("doc", whole))

    def result(self) -> DataFrame:
        """One row per document: doc_id, n_words, n_removed, kept_text (words joined by one space)."""
        texts = self._with_places(self.later_starts(), "left")
        return texts.mapInArrow(
            _removal(self.window), "doc_id bigint, n_words bigint, n_removed bigint, kept_text string"
        )


def _named_windows(window: int):
    """(name, doc, place) of every window (columns doc, mark, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            for part in slices(batch, "text"):
                words = hasher.words(part.column(2))
                start, name = hasher.windows(words, window)
                row = words.row[start]
                doc, place = part.column(0).to_numpy()[row], _places(words, start, row, part.column(1).to_numpy())
                yield pa.RecordBatch.from_arrays([signed(name), pa.array(doc), pa.array(place)], ["name", "doc", "place"])

    return run


def repeat_levels(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, longest) for documents with a repeat: the longest length window * 2**k at which one of its windows repeats.

    A window of twice the length is named by the names of its halves, so the
    levels above the first are joins of places; texts are read once.  Every
    level is written to the shared folder and holds repeated windows only.
    """
    job = SubstringDedup(docs, window)
    texts = job.docs.where("text is not null").select("doc", "mark", "text")
    rows = texts.mapInArrow(_named_windows(window), f"name bigint, doc bigint, {_PLACE}").distinct()
    found, length = None, window
    while True:
        twice = rows.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("name")
        level = durable(rows.join(twice, "name", "left_semi"), f"level-{length}")
        if level.isEmpty():
            break
        here = level.groupBy("doc").agg(F.lit(length).alias("length"))
        found = here if found is None else found.unionByName(here)
        behind = level.select("doc", (F.col("place") - length).alias("place"), F.col("name").alias("next"))
        rows = level.join(behind, ["doc", "place"]).select(F.xxhash64("name", "next").alias("name"), "doc", "place")
        length *= 2
    ids = job.docs.select("doc", "doc_id").distinct()
    if found is None:
        return ids.select("doc_id", F.lit(0).alias("longest")).where("false")
    return found.groupBy("doc").agg(F.max("length").alias("longest")).join(ids, "doc").select("doc_id", "longest")


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_text."""
    return SubstringDedup(docs, window).result()
