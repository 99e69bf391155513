"""Token-ID output: documents packed into fixed-length id matrices.

Method.  Texts are tokenised with a public byte-level vocabulary, an
end-of-document id is appended, and a document longer than a row is split into
pieces without loss.  Pieces are dealt by hash into groups of bounded size.
Each group is packed best-fit-decreasing: pieces by falling length, each into
the row with the least room that still holds it; a segment tree over the
remaining capacities finds that row in log(row length) steps.

A row of the result is one row of the matrix: ids padded to full length,
cumulative segment lengths, and position ids that start again from 0 at every
piece (the position resets).  ``matrices`` joins rows to id matrices.

Group numbers come from the document id, the piece number and the text only,
so a rerun on another cluster packs alike.  A task holds one group, about
``GROUP_BYTES`` of text, at a time.

Defined results: null text is an empty one and gives the end id alone; rows
that repeat are each packed; null ids are kept as null; an empty table has no
rows; further columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm.rows import small_batches, tidy

ROW_TOKENS = 2048
GROUP_BYTES = 8_000_000
PART_CHARS = 1_000_000
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: the pattern that belongs to the vocabulary's merges (possessive, so that long runs need no backtracking)
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


def read_ranks(path: str) -> dict[bytes, int]:
    """Vocabulary file: one base64 token and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Tokenizer:
    """Ids of texts as little-endian bytes.

    The pattern always starts a new piece at a space that stands between two
    characters other than white space, so a long text is cut there and encoded
    part by part, with the ids of one part as Python numbers at a time.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        import re

        import tiktoken

        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.end = max(ranks.values()) + 1
        self.dtype = id_type(self.end)
        self.cut = re.compile(r"(?<=\S) (?=\S)")

    def ids(self, text: str) -> bytes:
        out, at = [], 0
        while len(text) - at > PART_CHARS and (found := self.cut.search(text, at + PART_CHARS)):
            out.append(self._encoded(text[at : found.start()]))
            at = found.start()
        return b"".join([*out, self._encoded(text[at:] if at else text)])

    def _encoded(self, text: str) -> bytes:
        return np.array(self.encoding.encode_ordinary(text), self.dtype).tobytes()


def id_type(largest: int) -> np.dtype:
    """Two little-endian bytes, or four for numbers that do not fit."""
    return np.dtype("<u2" if largest < 1 << 16 else "<u4")


class CapacityTree:
    """Segment tree over capacities 0..size: the least capacity, from a given one up, that some row has."""

    def __init__(self, size: int):
        self.width = 1 << size.bit_length()
        self.rows: list[list[int]] = [[] for _ in range(size + 1)]
        self.count = [0] * (2 * self.width)

    def _add(self, capacity: int, n: int) -> None:
        node = capacity + self.width
        while node:
            self.count[node] += n
            node >>= 1

    def put(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        self._add(capacity, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """(capacity, row) of the best fit, removed from the tree."""
        node = least + self.width
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.width:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        capacity = node - self.width
        row = self.rows[capacity].pop()
        self._add(capacity, -1)
        return capacity, row


def best_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Rows of item numbers; ``lengths`` fall and are at most ``size``."""
    tree, rows = CapacityTree(size), []
    for item, length in enumerate(lengths):
        fit = tree.take(length)
        if fit is None:
            fit = (size, len(rows))
            rows.append([])
        capacity, row = fit
        rows[row].append(item)
        if capacity > length:
            tree.put(capacity - length, row)
    return rows


_PIECES = "doc_id bigint, mark bigint, piece int, begin bigint, n int, ids binary"


def _tokenise(ranks, size: int):
    """Pieces of each document (columns doc_id, mark, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokenizer(ranks.value)
        end, width = np.array([tokens.end], tokens.dtype).tobytes(), tokens.dtype.itemsize
        for batch in batches:
            out: list[tuple] = []
            held = 0
            docs, marks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for doc, mark, text in zip(docs, marks, batch.column(2)):
                ids = tokens.ids(text.as_py() or "") + end
                for piece, at in enumerate(range(0, len(ids), size * width)):
                    part = ids[at : at + size * width]
                    out.append((doc, mark, piece, at // width, len(part) // width, part))
                    held += len(part)
                if held > 4_000_000:
                    yield _pieces(out)
                    out, held = [], 0
            if out:
                yield _pieces(out)

    return run


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
    names = ["doc_id", "mark", "piece", "begin", "n", "ids"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


PACKED = (
    "shard int, row int, n_tokens int, doc_ids array<bigint>, pieces array<int>, begins array<bigint>, "
    "cu_seqlens array<int>, input_ids binary, position_ids binary"
)


def _pack(size: int, dtype: str, pad: int):
    """Packed rows of groups; rows come sorted by group, falling length, and the piece's own order."""

    def rows_of(group: int, pieces: pa.Table) -> pa.RecordBatch:
        doc, piece, begin, n, ids = (pieces.column(c).to_pylist() for c in ("doc_id", "piece", "begin", "n", "ids"))
        kind, steps, out = np.dtype(dtype), id_type(size - 1), []
        for row, items in enumerate(best_fit(n, size)):
            ends = np.cumsum([0, *(n[i] for i in items)])
            matrix = np.full(size, pad, kind)
            matrix[: ends[-1]] = np.frombuffer(b"".join(ids[i] for i in items), kind)
            place = np.zeros(size, steps)
            place[: ends[-1]] = np.arange(ends[-1]) - np.repeat(ends[:-1], np.diff(ends))
            out.append(
                (
                    group, row, int(ends[-1]), [doc[i] for i in items], [piece[i] for i in items],
                    [begin[i] for i in items], ends.tolist(), matrix.tobytes(), place.tobytes(),
                )
            )
        kinds = [
            pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()),
            pa.list_(pa.int32()), pa.binary(), pa.binary(),
        ]
        names = [c.split()[0] for c in PACKED.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            groups = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(groups[1:] != groups[:-1]) + 1).tolist(), len(groups)]
            for at, to in zip(cuts, cuts[1:]):
                if at == to:
                    continue
                if held and groups[at] != now:
                    yield rows_of(int(now), pa.Table.from_batches(held))
                    held = []
                now = groups[at]
                held.append(batch.slice(at, to - at))
        if held:
            yield rows_of(int(now), pa.Table.from_batches(held))

    return run


def pack(
    docs: DataFrame, vocabulary: str = VOCABULARY, size: int = ROW_TOKENS, group_bytes: int = GROUP_BYTES
) -> DataFrame:
    """Packed rows (schema ``PACKED``) of ``docs`` (doc_id, text).

    ``input_ids`` and ``position_ids`` hold ``size`` little-endian numbers of two
    bytes (four for vocabularies of more than 65,535 tokens, or rows of more than 65,536 ids); the end id also pads.
    ``pieces`` and ``begins`` place each segment in its document.
    """
    spark = docs.sparkSession
    small_batches(spark)
    ranks = read_ranks(vocabulary)  # a vocabulary file, a few MB
    end = max(ranks.values()) + 1
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-total // group_bytes))
    rows = docs.select("doc_id", F.xxhash64("text").alias("mark"), "text")
    pieces = rows.mapInArrow(tidy(_tokenise(spark.sparkContext.broadcast(ranks), size)), _PIECES)
    group = F.pmod(F.xxhash64("doc_id", "mark", "piece"), F.lit(groups)).cast("int").alias("shard")
    dealt = pieces.select(group, "*").repartition("shard")
    ordered = dealt.sortWithinPartitions("shard", F.desc("n"), "doc_id", "mark", "piece")
    return ordered.drop("mark").mapInArrow(tidy(_pack(size, id_type(end).str, end)), PACKED)


def matrices(packed: DataFrame, rows: int = 256) -> DataFrame:
    """Id matrices: per (shard, block) the ids and positions of up to ``rows`` rows one after another."""
    block = F.floor(F.col("row") / rows).cast("int").alias("block")
    part = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", c))), lambda r: F.hex(r[c])), "")
    return packed.groupBy("shard", block).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.unhex(part("input_ids")).alias("input_ids"),
        F.unhex(part("position_ids")).alias("position_ids"),
        F.transform(F.array_sort(F.collect_list(F.struct("row", "cu_seqlens"))), lambda r: r["cu_seqlens"]).alias(
            "cu_seqlens"
        ),
    )


def write_matrices(packed: DataFrame, path: str, rows: int = 256) -> None:
    """The matrices as a Parquet table of binary columns, one file set per shard order."""
    matrices(packed, rows).write.parquet(path)
