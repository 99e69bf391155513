"""SimHash near-dedup: documents whose 64-bit fingerprints differ in two bits at most.

Method.  A bit of a document's fingerprint is set if it is set in over half of
the hashes of its three-word shingles, repeats included.  Fingerprints are
compared through an inverted index on their positional bytes (a byte and where
it stands): two that differ in at most two bits share at least six of their
eight positional bytes.  Entries for one positional byte would hold one in 256
of all fingerprints, so the index files four positional bytes together, by
``LISTS``: whichever two bytes differ, one of the six lists holds the pair.
For each pair of a list the shared positional bytes are tallied; pairs that
reach six are verified by counting the differing bits, and of the lists that a
pair shares only the first one gives it out.

Equal fingerprints are one node, so a group of copies is one entry.  A list of
more than ``LIST_ROWS`` fingerprints is not paired: each of its fingerprints is
filed instead under itself and its 64 neighbours at one bit.  Two fingerprints
at most two bits apart meet under a neighbour of both; whatever meets there is
two bits apart at most, so each is linked with the smallest.  At most 65 can
meet, so this is exact and linear, whatever the list.

Components of the links are found by ``components``; hot fingerprints (a third
of all documents may have no words) are looked up by ``lookup_join``.

Defined results: null text, empty text and text without words have fingerprint
zero, linked like any other; fewer than three words are one shingle; rows that
share a doc_id are one document, so the fingerprints of its versions are
linked; a row without doc_id has its fingerprint and links, and the smallest
doc_id they reach (null if there is none); an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.llm.components import components
from rollcall.llm.rows import small_batches, sure_small
from rollcall.llm.words import WordHasher, slices, text_bytes
from rollcall.operators.joins import lookup_join
from rollcall.session import durable

SHINGLE = 3
SEED = 42
BYTES = 8
BITS = 2
LIST_ROWS = 256
CHUNK = 100_000  # shingles whose bits are counted at once
BROADCAST_KEYS = 1_000_000  # 16 MB of (list, key)

# The eight bytes in four pairs; two differing bytes spoil at most two pairs,
# so the two others are shared, and their list holds the fingerprints.
LISTS = [(2 * i, 2 * i + 1, 2 * j, 2 * j + 1) for i, j in combinations(range(BYTES // 2), 2)]


def _spans(hasher: WordHasher, column: pa.Array, size: int):
    """The words joined by single spaces, and each shingle's bytes in it, with its row."""
    data, offsets = text_bytes(column)
    word = hasher.is_word[data]
    before = np.concatenate(([False], word[:-1]))
    heads = offsets[:-1][offsets[:-1] < len(data)]
    before[heads] = False
    after = np.concatenate((word[1:], [False]))
    tails = offsets[1:][offsets[1:] > 0] - 1
    after[tails] = False
    start, end = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    first = np.searchsorted(start, offsets)
    # word k moves to its place behind k words and k spaces
    length = end - start
    begin = np.concatenate(([0], np.cumsum(length + 1)))[:-1]
    joined = np.full(int(length.sum() + len(length)), 0x20, np.uint8)
    joined[np.arange(len(data))[word] + np.repeat(begin - start, length)] = hasher.fold[data[word]]
    counts = np.diff(first)
    n = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    row = np.repeat(np.arange(len(counts)), n)
    head = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    last = np.minimum(head + size, first[row + 1]) - 1
    return joined.tobytes(), begin[head], begin[last] + length[last], n


def fingerprints_of(hasher: WordHasher, column: pa.Array, size: int, hash_of) -> np.ndarray:
    """One uint64 per row."""
    text, start, end, n = _spans(hasher, column, size)
    edge = np.concatenate(([0], np.cumsum(n)))
    ones = np.zeros((len(n), 64), np.int64)
    for at in range(0, len(start), CHUNK):
        to = min(at + CHUNK, len(start))
        spans = zip(start[at:to].tolist(), end[at:to].tolist())
        value = np.fromiter((hash_of(text[a:b], SEED) for a, b in spans), np.uint64, to - at)
        bits = np.unpackbits(value.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        rows = np.arange(np.searchsorted(edge, at, "right") - 1, np.searchsorted(edge, to, "left"))
        rows = rows[n[rows] > 0]
        ones[rows] += np.add.reduceat(bits, np.maximum(edge[rows], at) - at, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def _fingerprint(size: int):
    """(doc_id, fp) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hasher = WordHasher(fold_ascii=True)
        for batch in batches:
            for part in slices(batch, "text"):
                value = fingerprints_of(hasher, part.column(1), size, xxhash.xxh64_intdigest)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(value.view(np.int64))], ["doc_id", "fp"])

    return run


def _byte(value: Column, at: int) -> Column:
    return F.shiftrightunsigned(value, 8 * at).bitwiseAND(F.lit(255))


def _same_bytes(differ: Column, places) -> Column:
    """How many of the bytes at ``places`` are zero in the difference of two fingerprints."""
    return sum((F.when(_byte(differ, p) == 0, 1).otherwise(0) for p in places), F.lit(0))


def _mask(places) -> int:
    value = sum(255 << (8 * p) for p in places)
    return value - (1 << 64) if value >> 63 else value


def _entries(nodes: DataFrame) -> DataFrame:
    """(list, key, fp): the six index entries of each fingerprint."""
    keys = [F.struct(F.lit(i).alias("list"), F.col("fp").bitwiseAND(F.lit(_mask(p))).alias("key")) for i, p in enumerate(LISTS)]
    return nodes.select("fp", F.explode(F.array(*keys)).alias("e")).select("e.list", "e.key", "fp")


def _paired(entries: DataFrame, bits: int) -> DataFrame:
    """Links within lists of bounded length: tally the shared positional bytes, keep enough, verify."""
    x, y = entries.withColumnRenamed("fp", "a"), entries.withColumnRenamed("fp", "b")
    differ = F.col("a").bitwiseXOR(F.col("b"))
    enough = _same_bytes(differ, range(BYTES)) >= BYTES - bits
    near = F.bit_count(differ) <= bits
    # the first list the pair shares is the one that gives it out
    first = F.lit(True)
    for i, places in enumerate(LISTS):
        first = F.when(F.col("list") > i, differ.bitwiseAND(F.lit(_mask(places))) != 0).otherwise(True) & first
    return x.join(y, ["list", "key"]).where((F.col("a") < F.col("b")) & enough & near & first).select("a", "b")


def _meeting(nodes: DataFrame) -> DataFrame:
    """Links of fingerprints within two bits, through the neighbours at one bit; for any number of them."""
    flips = F.array(F.lit(0).cast("long"), *[F.shiftleft(F.lit(1).cast("long"), b) for b in range(64)])
    near = nodes.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("at"))
    met = near.groupBy("at").agg(F.min("fp").alias("b"), F.max("fp").alias("top"))
    met = met.where("b < top").select("at", "b")
    return near.join(met, "at").where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()


def fingerprint_links(nodes: DataFrame, list_rows: int = LIST_ROWS) -> DataFrame:
    """(a, b) links that connect all of ``nodes`` (fp, distinct) that differ in two bits at most."""
    entries = durable(_entries(nodes), "entries")
    lengths = entries.groupBy("list", "key").agg(F.count(F.lit(1)).alias("n"))
    long = durable(lengths.where(F.col("n") > list_rows).select("list", "key"), "long-lists")
    small = F.broadcast(long) if sure_small(long, BROADCAST_KEYS) else long
    short = entries.join(small, ["list", "key"], "left_anti")
    crowded = durable(entries.join(small, ["list", "key"], "left_semi").select("fp").distinct(), "crowded")
    return _paired(short, BITS).unionByName(_meeting(crowded))


class SimHash:
    """One run over ``docs`` (doc_id, text): fingerprints, links and components."""

    def __init__(self, docs: DataFrame, size: int = SHINGLE, list_rows: int = LIST_ROWS):
        small_batches(docs.sparkSession)
        found = docs.select("doc_id", "text").mapInArrow(_fingerprint(size), "doc_id bigint, fp bigint")
        self.rows = durable(found, "fingerprints")
        self.nodes = durable(self.rows.select("fp").distinct(), "nodes")
        self.list_rows = list_rows

    def links(self) -> DataFrame:
        """(a, b): links between distinct fingerprints, and between the versions of one document."""
        named = self.rows.where("doc_id is not null")
        versions = named.groupBy("doc_id").agg(F.min("fp").alias("b"), F.max("fp").alias("top")).where("b < top")
        own = named.join(versions, "doc_id").where("fp <> b").select(F.col("fp").alias("a"), "b")
        return fingerprint_links(self.nodes, self.list_rows).unionByName(own)

    def result(self) -> DataFrame:
        """One row per document: doc_id, fp (the fingerprint's bits as a bigint), component_id."""
        found = components(self.links())
        least = self.rows.groupBy("fp").agg(F.min("doc_id").alias("doc_id"))
        placed = least.join(found, F.col("fp") == F.col("node"), "left")
        placed = durable(placed.select("fp", "doc_id", F.coalesce("root", "fp").alias("root")), "placed")
        ids = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"))
        where = durable(placed.join(ids, "root").select("fp", "component_id"), "component-of")
        out = lookup_join(self.rows, ["fp"], where, "fp")
        return out.select("doc_id", "fp", F.col("fp_row.component_id").alias("component_id"))


def hex_digits(value: Column) -> Column:
    """The 16 lowercase hex digits of a fingerprint."""
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def simhash_components(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, fp, component_id."""
    return SimHash(docs, size).result()


def one_of_each_component(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``docs`` with only the rows of the smallest doc_id of each component; rows without doc_id stay."""
    found = SimHash(docs, size).result()
    gone = durable(found.where("doc_id <> component_id").select("doc_id").distinct(), "simhash-copies")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
