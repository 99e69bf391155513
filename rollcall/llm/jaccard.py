"""N-gram Jaccard join: documents whose sets of word 5-grams are near equal.

Method.  A document's set holds the hashes of its distinct 5-word shingles.
Documents with the same set are one class; only one member goes on.  Shingles
are ordered rare-first by a frequency sketch.  Two sets of similarity t share
a shingle within their first n - ceil(t n) + 1 (prefix filter), so the join is
on prefix shingles only, under the length filter and the positional filter.  A
surviving pair is verified once: first by the suffix filter (both sets are
partitioned by hash range and the smaller counts of the parts bound the
overlap), then by the exact overlap.

A group of n near copies has n^2 / 2 pairs, which are never emitted.  The
join runs in rounds on what is still apart.  First every prefix bucket
compares its rows with one leader, the row with the fewest rarer shingles; the
links found are contracted to components.  Buckets that lie within one
component are then done, since nothing in them can join anything new.  While
the others still hold far more pairs than rows and leaders still find many
links, another leader is taken (at most ``LEADER_ROUNDS`` times); last, all pairs that still lie in different
components are compared.  So no link between different components is missed,
and the components are those of all links.

These links only span the components.  The number of links of each document is
counted afterwards: a link never leaves a component, so the members of each are
dealt to blocks by hash, and all pairs of every two blocks are compared by a
matrix of overlaps, of which only a count per document goes on.  Small
components share a block.  This costs the square of a component's members, in
blocks of bounded size.

The sketch counts all shingles of all documents in 2**18 buckets whatever the
input; it only orders shingles, so collisions cost speed, not results.

Defined results: null text or no words gives an empty set, linked with
nothing; one to four words are one shingle; rows that share a doc_id are one
document with several versions, linked if any version is; a row without
doc_id has its set size, but is linked with nothing and its component is null;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm.components import components
from rollcall.llm.rows import small_batches, sure_small, tidy
from rollcall.llm.words import WordHasher, mix64, signed, slices
from rollcall.session import durable

SHINGLE = 5
SIMILARITY = Fraction(3, 4)
SKETCH_BITS = 18
PARTS = 16
LEADER_ROUNDS = 8
PAIRS_PER_ROW = 4
GAIN = 16  # a round that links fewer than one in so many documents is the last with a leader
BLOCK = 1_000  # documents of a block at about this many bytes of text at most
BLOCK_BYTES = 4_000_000
BROADCAST_IDS = 1_000_000  # 8 MB of ids


def shingle_sets(hasher: WordHasher, column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each row's distinct shingles, by row and hash."""
    words = hasher.words(column)
    start, value = hasher.windows(words, size)
    row = words.row[start]
    short = np.flatnonzero((words.counts > 0) & (words.counts < size))
    row = np.concatenate((row, short))
    value = np.concatenate((value, hasher.sequences(words, short)))
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[new], value[new]


def _bounds(row: np.ndarray, rows: int) -> np.ndarray:
    return np.searchsorted(row, np.arange(rows + 1))


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))
    return total[bounds[1:]] - total[bounds[:-1]]


def _set_keys(row: np.ndarray, value: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and a 128-bit key of each row's set: two sums of independent hashes."""
    bounds = _bounds(row, rows)
    other = mix64(value ^ np.uint64(0xA5A5A5A55A5A5A5A))
    return np.diff(bounds), mix64(_sums(value, bounds)), mix64(_sums(other, bounds))


def _scan(size: int):
    """Two kinds of rows: (0, doc_id, k1, k2, n) per document; (1, bucket, count, 0, 0) of the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, sketch = WordHasher(fold_ascii=True), np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                row, value = shingle_sets(hasher, part.column(1), size)
                n, k1, k2 = _set_keys(row, value, part.num_rows)
                sketch += np.bincount(value >> np.uint64(64 - SKETCH_BITS), minlength=len(sketch))
                kind = pa.array(np.zeros(part.num_rows, np.int32))
                yield pa.RecordBatch.from_arrays(
                    [kind, part.column(0), signed(k1), signed(k2), pa.array(n.astype(np.int64))],
                    ["kind", "id", "k1", "k2", "n"],
                )
        used = np.flatnonzero(sketch)
        zero = pa.array(np.zeros(len(used), np.int64))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.ones(len(used), np.int32)), pa.array(used), pa.array(sketch[used]), zero, zero],
            ["kind", "id", "k1", "k2", "n"],
        )

    return run


def _least_overlap(n1: np.ndarray, n2: np.ndarray, t: Fraction) -> np.ndarray:
    """Smallest overlap of sets of these sizes that reaches the similarity."""
    p, q = t.numerator, t.denominator
    return -(-(p * (n1 + n2)) // (p + q))


def _prefixes(size: int, t: Fraction, sketch):
    """(token, doc_id, n, at) for the prefix of each document in rare-first order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(fold_ascii=True)
        often = np.frombuffer(sketch.value, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                row, value = shingle_sets(hasher, part.column(1), size)
                order = np.lexsort((value, often[value >> np.uint64(64 - SKETCH_BITS)], row))
                value = value[order]
                bounds = _bounds(row, part.num_rows)
                at = np.arange(len(row)) - bounds[row]
                n = np.diff(bounds)[row]
                keep = np.flatnonzero(at < n + (-n * t.numerator) // t.denominator + 1)
                ids = part.column(0).take(pa.array(row[keep]))
                yield pa.RecordBatch.from_arrays(
                    [signed(value[keep]), ids, pa.array(n[keep].astype(np.int32)), pa.array(at[keep].astype(np.int32))],
                    ["token", "id", "n", "at"],
                )

    return run


def _shared_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by token, less those whose token occurs once.

    Holds back one row at a time, so a token with any number of rows streams.
    """
    held, last = None, None  # the last row, not yet known to have an equal neighbour; the last token given out
    for batch in batches:
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        token = batch.column(0).to_numpy()
        if not len(token):
            continue
        same = token[1:] == token[:-1]
        keep = np.zeros(len(token), bool)
        keep[1:] |= same
        keep[:-1] |= same
        if last is not None:
            keep |= token == last
        held = batch.slice(len(token) - 1)
        done = np.flatnonzero(keep[:-1])
        if keep[-1]:
            last = token[-1]
        if len(done):
            yield batch.take(pa.array(done))
    if held is not None and last is not None and held.column(0)[0].as_py() == last:
        yield held


def _verify(size: int, t: Fraction):
    """(a, b) of the pairs whose texts reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(fold_ascii=True)
        edges = (np.arange(1, PARTS, dtype=np.uint64) * np.uint64((1 << 64) // PARTS)).astype(np.uint64)

        def sets(part: pa.RecordBatch, ids: str, texts: str) -> list[tuple[np.ndarray, np.ndarray]]:
            """Sorted set and part sizes of each row; neighbours with the same id and text are worked out once."""
            id_list = part.column(part.schema.get_field_index(ids)).to_pylist()
            column = part.column(part.schema.get_field_index(texts))
            same = pc.equal(column.slice(1), column.slice(0, max(0, len(column) - 1))).to_pylist()
            first = [i for i, x in enumerate(id_list) if not i or x != id_list[i - 1] or not same[i - 1]]
            column = column.take(pa.array(first, pa.int64()))
            row, value = shingle_sets(hasher, column, size)
            bounds = _bounds(row, len(first))
            made = []
            for i in range(len(first)):
                own = value[bounds[i] : bounds[i + 1]]
                made.append((own, np.diff(np.concatenate(([0], np.searchsorted(own, edges), [len(own)])))))
            return [made[np.searchsorted(first, i, side="right") - 1] for i in range(len(id_list))]

        for batch in batches:
            for part in slices(batch, "text_b"):
                good = []
                for i, ((x, cx), (y, cy)) in enumerate(zip(sets(part, "a", "text_a"), sets(part, "b", "text_b"))):
                    least = int(_least_overlap(np.int64(len(x)), np.int64(len(y)), t))
                    if np.minimum(cx, cy).sum() < least:  # suffix filter
                        continue
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if both and both * t.denominator >= t.numerator * (len(x) + len(y) - both):
                        good.append(i)
                yield part.take(pa.array(good, pa.int64())).select(["a", "b"])

    return run


def _overlaps(row: np.ndarray, value: np.ndarray, n: int, one: slice, two: slice) -> np.ndarray:
    """Number of shingles that each row of ``one`` shares with each of ``two``; (row, value) in any order."""
    order = np.lexsort((row, value))
    row, value = row[order], value[order]
    start = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1]))) if len(value) else np.empty(0, int)
    often = np.diff(np.append(start, len(value)))
    out = np.zeros((one.stop - one.start, two.stop - two.start), np.float32)
    # shingles of many rows by matrix product, some columns at a time
    dense = np.flatnonzero(often * 16 > n)
    for at in range(0, len(dense), 512):
        some = dense[at : at + 512]
        has = np.zeros((n, len(some)), np.float32)
        for column, token in enumerate(some):
            has[row[start[token] : start[token] + often[token]], column] = 1
        out += has[one] @ has[two].T
    # the others pair by pair, those with equally many rows at once
    rare = np.flatnonzero((often > 1) & (often * 16 <= n))
    for k in np.unique(often[rare]).tolist():
        tokens, step = rare[often[rare] == k], max(1, 200_000 // (k * k))
        for at in range(0, len(tokens), step):
            rows = row[start[tokens[at : at + step]][:, None] + np.arange(k)]
            a, b = np.repeat(rows, k, axis=1).ravel(), np.tile(rows, k).ravel()
            use = (a >= one.start) & (a < one.stop) & (b >= two.start) & (b < two.stop)
            np.add.at(out, (a[use] - one.start, b[use] - two.start), 1)
    return out


def _degrees(size: int, t: Fraction):
    """(id, links) of the documents of two blocks, or of one, for the pairs that lie across."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("block", "ascending"), ("id", "ascending")])
        hasher, at, rows, values = WordHasher(fold_ascii=True), 0, [], []
        for batch in table.select(["text"]).combine_chunks().to_batches():
            for part in slices(batch, "text"):
                row, value = shingle_sets(hasher, part.column(0), size)
                rows.append(row + at)
                values.append(value)
                at += part.num_rows
        row, value, n = np.concatenate(rows), np.concatenate(values), at
        sizes = np.bincount(row, minlength=n)
        ids, block = table.column("id").to_numpy(), table.column("block").to_numpy()
        lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        if lo == hi:
            one = two = slice(0, n)
        else:
            cut = int(np.searchsorted(block, hi))
            one, two = slice(0, cut), slice(cut, n)
        both = _overlaps(row, value, n, one, two)
        linked = np.zeros(both.shape, bool)
        for i in range(len(both)):
            shared = both[i].astype(np.int64)
            union = sizes[one][i] + sizes[two] - shared
            linked[i] = (shared > 0) & (shared * t.denominator >= t.numerator * union) & (ids[two] != ids[one][i])
        # the versions of one id are one document
        first1 = np.flatnonzero(np.diff(ids[one], prepend=ids[one][:1] - 1)) if len(both) else np.empty(0, int)
        first2 = np.flatnonzero(np.diff(ids[two], prepend=ids[two][:1] - 1)) if both.shape[1] else np.empty(0, int)
        if both.size:
            linked = np.logical_or.reduceat(np.logical_or.reduceat(linked, first1, axis=0), first2, axis=1)
        else:
            linked = np.zeros((len(first1), len(first2)), bool)
        out, count = ids[one][first1], linked.sum(axis=1)
        if lo != hi:
            out, count = np.concatenate((out, ids[two][first2])), np.concatenate((count, linked.sum(axis=0)))
        return pa.table({"id": pa.array(out, pa.int64()), "links": pa.array(count, pa.int64())})

    return run


class JaccardJoin:
    """One run over ``docs`` (doc_id, text): sets, components and numbers of links."""

    def __init__(self, docs: DataFrame, size: int = SHINGLE, t: Fraction = SIMILARITY, rounds: int = LEADER_ROUNDS):
        self.docs, self.size, self.t, self.rounds = docs.select("doc_id", "text"), size, t, rounds
        self.spark = docs.sparkSession
        small_batches(self.spark)
        self.narrow = durable(
            self.docs.mapInArrow(tidy(_scan(size)), "kind int, id bigint, k1 bigint, k2 bigint, n bigint"), "sets"
        )
        self.sets = self.narrow.where("kind = 0").drop("kind").withColumnRenamed("id", "doc_id")
        named = self.sets.where("n > 0 and doc_id is not null")
        self.classes = durable(
            named.groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("members")),
            "classes",
        )

    def _representatives(self) -> DataFrame:
        """(id, text) of one document per class."""
        own = self.sets.join(self.classes.where("members > 1"), ["k1", "k2", "n"])
        first = self.classes.select(F.col("class_id").alias("doc_id"))
        # an id that is first of another class stays: its versions differ
        copies = own.where("doc_id <> class_id").select("doc_id").distinct().join(first, "doc_id", "left_anti")
        copies = durable(copies, "copies")
        out = self.docs.where("text is not null and doc_id is not null")
        small = F.broadcast(copies) if sure_small(copies, BROADCAST_IDS) else copies
        return out.join(small, "doc_id", "left_anti").select(F.col("doc_id").alias("id"), "text")

    def _sketch(self):
        """Shingle counts per sketch bucket: 2**SKETCH_BITS numbers, 2 MB, for any input."""
        sums = self.narrow.where("kind = 1").groupBy("id").agg(F.sum("k1").alias("n")).toArrow()
        often = np.zeros(1 << SKETCH_BITS, np.int64)
        often[sums.column("id").to_numpy()] = sums.column("n").to_numpy()
        return self.spark.sparkContext.broadcast(often.tobytes())

    def links(self) -> tuple[DataFrame, DataFrame]:
        """(links a, b that span the components; components node, root) among class representatives."""
        t = self.t
        texts = self._representatives()
        prefix = texts.mapInArrow(tidy(_prefixes(self.size, t, self._sketch())), "token bigint, id bigint, n int, at int")
        sorted_rows = prefix.repartition("token").sortWithinPartitions("token")
        rows = durable(sorted_rows.mapInArrow(tidy(_shared_rows), "token bigint, id bigint, n int, at int"), "shared")
        ids = durable(rows.select("id").distinct(), "shared-ids")
        small = F.broadcast(ids) if sure_small(ids, BROADCAST_IDS) else ids
        self.known = known = durable(texts.join(small, "id", "left_semi"), "shared-texts")

        links = self.spark.createDataFrame([], "a bigint, b bigint")
        tested, found = links, self.spark.createDataFrame([], "node bigint, root bigint")
        now = rows.withColumn("root", F.col("id"))
        nodes, gained = ids.count(), 0
        for turn in range(self.rounds + 1):
            # another leader is worth its round while buckets hold far more pairs
            # than rows and the last one linked many documents
            exact = turn == self.rounds
            if turn:
                now, open_pairs = self._apart(rows, found)
                exact = exact or open_pairs <= PAIRS_PER_ROW * now.count() or gained * GAIN < nodes
            if now.isEmpty():
                break
            x = now.select("token", *[F.col(c).alias(f"{c}1") for c in ("id", "n", "at", "root")])
            y = now.select("token", *[F.col(c).alias(f"{c}2") for c in ("id", "n", "at", "root")])
            if not exact:
                # first the row with the fewest rarer shingles: of near copies, the least changed one
                order = F.xxhash64("id1", F.lit(turn)) if turn else F.struct("at1", F.xxhash64("id1"))
                best = F.min_by(F.struct("id1", "n1", "at1", "root1"), order).alias("lead")
                x = x.groupBy("token").agg(best).select("token", "lead.*")
            pairs = x.join(y, "token").where(self._may_link())
            if exact:
                pairs = pairs.where("id1 < id2")
            pairs = pairs.select(F.least("id1", "id2").alias("a"), F.greatest("id1", "id2").alias("b")).distinct()
            pairs = durable(pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
            new = durable(self._verified(pairs, known).distinct(), "verified")
            tested, links, gained = tested.unionByName(pairs), links.unionByName(new), new.count()
            stars = found.select(F.col("node").alias("a"), F.col("root").alias("b"))
            found = durable(components(stars.unionByName(new)), "components")
            if exact:
                break
        return links, found

    def _apart(self, rows: DataFrame, found: DataFrame) -> tuple[DataFrame, int]:
        """The rows of buckets that touch several components, and how many pairs lie across."""
        placed = rows.join(found, rows["id"] == found["node"], "left")
        placed = placed.select("token", "id", "n", "at", F.coalesce("root", "id").alias("root"))
        parts = placed.groupBy("token", "root").agg(F.count(F.lit(1)).alias("m"))
        across = (F.pow(F.sum("m"), F.lit(2.0)) - F.sum(F.col("m") * F.col("m"))) / 2
        open_tokens = parts.groupBy("token").agg(across.alias("pairs")).where("pairs > 0")
        open_tokens = durable(open_tokens, "open")
        now = durable(placed.join(open_tokens.select("token"), "token", "left_semi"), "apart")
        return now, int(open_tokens.agg(F.sum("pairs")).first()[0] or 0)

    def _least(self):
        p, q = self.t.numerator, self.t.denominator
        return F.ceil((F.col("n1") + F.col("n2")) * p / F.lit(p + q))

    def _may_link(self):
        """Length and positional filter on rows x, y of one bucket, and not yet in one component."""
        p, q = self.t.numerator, self.t.denominator
        n1, n2 = F.col("n1"), F.col("n2")
        least = self._least()
        left = F.least(n1 - F.col("at1"), n2 - F.col("at2"))
        return (
            (F.col("root1") != F.col("root2"))
            & (F.least(n1, n2) * q >= F.greatest(n1, n2) * p)
            & (left >= least)
        )

    def _verified(self, pairs: DataFrame, texts: DataFrame) -> DataFrame:
        one = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
        two = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
        whole = pairs.join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b")
        return whole.mapInArrow(tidy(_verify(self.size, self.t)), "a bigint, b bigint")

    def degrees(self, found: DataFrame) -> DataFrame:
        """(id, n_links): the exact number of other representatives that each linked one is similar to."""
        weight = self.known.groupBy("id").agg(F.sum(F.octet_length("text")).alias("bytes"))
        placed = found.join(weight, found["node"] == weight["id"]).select("id", "root", "bytes")
        parts = placed.groupBy("root").agg(F.count(F.lit(1)).alias("m"), F.sum("bytes").alias("bytes"))
        need = F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES))
        parts = durable(parts.withColumn("blocks", need), "parts")
        few = parts.where("blocks = 1").agg(F.sum("m").alias("m"), F.sum("bytes").alias("bytes")).first()
        bundles = max(1, -(-(few["m"] or 0) // BLOCK), -(-(few["bytes"] or 0) // BLOCK_BYTES))
        # a bundle of small components has no links between them, so it is one block
        alone = F.col("blocks") > 1
        keyed = placed.drop("bytes").join(parts.select("root", "blocks"), "root").select(
            "id",
            F.when(alone, F.col("root")).otherwise(F.pmod(F.xxhash64("root"), F.lit(bundles))).alias("part"),
            "blocks",
            F.when(alone, F.pmod(F.xxhash64("id"), F.col("blocks"))).otherwise(F.lit(0).cast("long")).alias("block"),
        )
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
        keyed = keyed.select("id", "part", (F.col("blocks") > 1).alias("alone"), "block", other)
        keyed = keyed.select(
            "id", "part", "alone", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")
        )
        pairs = self.known.join(keyed, "id").select("id", "text", "part", "alone", "block", "lo", "hi")
        counted = pairs.groupBy("part", "alone", "lo", "hi").applyInArrow(_degrees(self.size, self.t), "id bigint, links bigint")
        return counted.groupBy("id").agg(F.sum("links").alias("n_links"))

    def result(self, count: bool = True) -> DataFrame:
        """One row per document: doc_id, n_shingles, component_id, n_links.

        n_links is the number of other sets that the set of its class is
        similar to; without ``count`` the column is left out.
        """
        links, found = self.links()
        degree = durable(self.degrees(found), "degrees") if count else None
        member = self.sets.join(self.classes.drop("members"), ["k1", "k2", "n"], "left")
        member = member.withColumn("_class", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")))
        # the versions of one document belong together even if their sets differ
        versions = self.sets.groupBy("doc_id").agg(F.count(F.lit(1)).alias("m")).where("m > 1 and doc_id is not null")
        if not versions.isEmpty():
            own = member.select(F.col("doc_id").alias("a"), F.col("_class").alias("b")).where("a <> b")
            found = components(links.unionByName(own))
        out = member.join(found, F.col("_class") == F.col("node"), "left")
        columns = ["doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "_class").alias("component_id")]
        if not count:
            return out.select(*columns)
        out = out.join(degree.withColumnRenamed("id", "_end"), F.col("_class") == F.col("_end"), "left")
        return out.select(*columns, F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def jaccard_components(docs: DataFrame, size: int = SHINGLE, t: Fraction = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, n_links."""
    return JaccardJoin(docs, size, t).result()


def one_of_each_group(docs: DataFrame, size: int = SHINGLE, t: Fraction = SIMILARITY) -> DataFrame:
    """``docs`` with only the smallest doc_id of each component; empty texts and null ids stay.

    Documents go by their id: rows that repeat under a kept id all stay, rows under a dropped id all go.
    """
    found = JaccardJoin(docs, size, t).result(count=False)
    gone = durable(found.where("doc_id <> component_id").select("doc_id").distinct(), "near-copies")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
