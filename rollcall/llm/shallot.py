"""Centroid clustering: exact k-means with the Shallot search for the nearest centroid.

Vectors are integers (floor of 1024 x), so distances and sums are exact and a
run can be repeated anywhere.  Each round assigns every vector to its nearest
centroid (ties: the smaller number) and moves every non-empty centroid to the
floor of its vectors' mean.

Method.  Each vector remembers its centroid, its second-nearest one, an upper
bound of the distance to the first and a lower bound of the distance to all
others.  When centroids move, the bounds give way by the distances moved, and a
vector whose upper bound stays below the lower one, or below half the distance
from its centroid to the next, keeps its centroid unlooked at.  For the others
the distance to the own centroid is worked out, then that to the remembered
second.  The scan starts from the closer of the two: its neighbours come in
order of their distance from it, and the search ball, of radius (distance to
it + distance to the second-nearest so far), shrinks whenever a nearer second
is found; centroids outside it are never compared.  What survives is compared
in integers.  Bounds are floats rounded away from a decision by ``SLACK``, which
is far more than their rounding errors.

A round is one pass over the rows in Arrow batches: each task holds one batch
and per-centroid changes of sums (rows that moved in, less those that moved
out), which Spark adds up; only these k rows reach the driver.  Vectors and
their bounds are written for the next round in the shared folder, so a lost executor
costs its own tasks only; the table before last is dropped.

Defined results: only vectors with exactly ``dim`` components, none null or
non-finite, are kept; |1024 x| must be at most 2**27 (squared distances would
not fit a bigint), and vectors beyond are left out like non-finite ones.  Rows
that repeat are vectors of their own.  A null vec_id counts as an empty text in the seeds' order and is
kept.  Equal seeds give equal centroids, of which the smaller number takes the
vectors; fewer vectors than k give that many centroids; an empty table gives
no rows.  Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm.rows import Rewritten
from rollcall.session import durable

DIM = 64
CLUSTERS = 8
ROUNDS = 10
SCALE = 1024
LARGEST = 1 << 27
SLACK = 1e-9

_STATE = "vec_id bigint, vector array<int>, own int, second int, upper double, lower double"
_PASS = f"kind int, {_STATE}, centroid int, n bigint, total array<bigint>, looked bigint"


class Geometry(NamedTuple):
    """Centroids, how far they moved at most, and each one's neighbours in order of distance."""

    centroids: np.ndarray  # k x dim, int64
    moved: np.ndarray  # upper bounds
    moved_others: np.ndarray  # the largest move of any other centroid
    order: np.ndarray  # k x (k - 1): neighbours, nearest first
    apart: np.ndarray  # their distances, lower bounds
    half: np.ndarray  # half the distance to the nearest, lower bound


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of integers."""
    differ = x - y
    return np.einsum("ij,ij->i", differ, differ)


def geometry(centroids: np.ndarray, before: np.ndarray) -> Geometry:
    k = len(centroids)
    moved = np.sqrt(squared(centroids, before).astype(float)) * (1 + SLACK)
    others = np.array([np.delete(moved, i).max(initial=0.0) for i in range(k)])
    apart = np.sqrt(np.array([squared(centroids, c) for c in centroids], float)) * (1 - SLACK)
    order = np.array([[j for j in np.argsort(apart[i], kind="stable") if j != i] for i in range(k)], np.int64)
    order = order.reshape(k, k - 1)
    apart = np.take_along_axis(apart, order, axis=1)
    half = apart[:, 0] / 2 if k > 1 else np.full(k, np.inf)
    return Geometry(centroids, moved, others, order, apart, half)


class Bounds(NamedTuple):
    own: np.ndarray
    second: np.ndarray
    upper: np.ndarray
    lower: np.ndarray


def unbounded(n: int, k: int) -> Bounds:
    """Before the first round: nothing is known."""
    return Bounds(np.zeros(n, np.int32), np.full(n, min(1, k - 1), np.int32), np.full(n, np.inf), np.full(n, -np.inf))


def assign(x: np.ndarray, old: Bounds, g: Geometry) -> tuple[Bounds, int]:
    """New bounds of the vectors ``x``, and how many distances were worked out."""
    k = len(g.centroids)
    own, second = old.own.copy(), old.second.copy()
    if k == 1:
        return Bounds(own, second, old.upper + g.moved[own], np.full(len(x), np.inf)), 0
    upper, lower = old.upper + g.moved[own], old.lower - g.moved_others[own]
    look = np.flatnonzero(~(upper < np.maximum(lower, g.half[own])))
    first = squared(x[look], g.centroids[own[look]])
    looked = len(look)
    upper[look] = np.sqrt(first.astype(float)) * (1 + SLACK)
    still = ~(upper[look] < np.maximum(lower[look], g.half[own[look]]))
    look, first = look[still], first[still]
    if not len(look):
        return Bounds(own, second, upper, lower), looked

    v, start, other = x[look], own[look].astype(np.int64), second[look].astype(np.int64)
    next_ = squared(v, g.centroids[other])
    looked += len(look)
    turn = (next_ < first) | ((next_ == first) & (other < start))
    start, other = np.where(turn, other, start), np.where(turn, start, other)
    first, next_ = np.where(turn, next_, first), np.where(turn, first, next_)
    known, best = other.copy(), start.copy()  # ``known`` was compared already
    reach = np.sqrt(first.astype(float)) * (1 + SLACK)
    active = np.arange(len(look))
    for rank in range(k - 1):
        # the ball has shrunk to the second-nearest so far; neighbours come in rising distance
        radius = reach[active] + np.sqrt(next_[active].astype(float)) * (1 + SLACK)
        active = active[g.apart[start[active], rank] <= radius]
        if not len(active):
            break
        candidate = g.order[start[active], rank]
        fresh = candidate != known[active]
        rows, c = active[fresh], candidate[fresh]
        d = squared(v[rows], g.centroids[c])
        looked += len(rows)
        nearest = (d < first[rows]) | ((d == first[rows]) & (c < best[rows]))
        closer = ~nearest & ((d < next_[rows]) | ((d == next_[rows]) & (c < other[rows])))
        r = rows[nearest]
        next_[r], other[r] = first[r], best[r]
        first[r], best[r] = d[nearest], c[nearest]
        r = rows[closer]
        next_[r], other[r] = d[closer], c[closer]
    own[look], second[look] = best, other
    upper[look] = np.sqrt(first.astype(float)) * (1 + SLACK)
    lower[look] = np.sqrt(next_.astype(float)) * (1 - SLACK)
    return Bounds(own, second, upper, lower), looked


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), dim).astype(np.int64)


def _round(dim: int, centroids: np.ndarray, before: np.ndarray, first: bool):
    """Rows of kind 0: vectors with new bounds; of kind 1: changes of a centroid's count and sums in this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = geometry(centroids, before)
        k, looked = len(centroids), 0
        count, total = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        kinds = [pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.float64(), pa.float64(),
                 pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.int64()]
        names = [c.split()[0] for c in _PASS.split(", ")]

        def rows(size: int, /, **columns) -> pa.RecordBatch:
            made = {c: v if isinstance(v, pa.Array) else pa.array(v) for c, v in columns.items()}
            whole = [made[c] if c in made else pa.nulls(size, t) for c, t in zip(names, kinds)]
            return pa.RecordBatch.from_arrays(whole, names)

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = _vectors(batch.column(1), dim)
            if first:
                old = unbounded(n, k)
            else:
                old = Bounds(*(batch.column(i).to_numpy() for i in range(2, 6)))
            new, seen = assign(x, old, g)
            looked += seen
            moved = np.arange(n) if first else np.flatnonzero(new.own != old.own)
            for c in np.unique(np.concatenate((new.own[moved], old.own[moved]))):
                come = moved[new.own[moved] == c]
                gone = moved[:0] if first else moved[old.own[moved] == c]
                count[c] += len(come) - len(gone)
                total[c] += x[come].sum(axis=0) - x[gone].sum(axis=0)
            kept = {"vec_id": batch.column(0), "vector": batch.column(1), **new._asdict()}
            yield rows(n, kind=np.zeros(n, np.int32), **kept)
        yield rows(
            k,
            kind=np.ones(k, np.int32),
            centroid=np.arange(k, dtype=np.int32),
            n=count,
            total=list(total),
            looked=np.array([looked] + [0] * (k - 1)),
        )

    return run


def _distances(dim: int, centroids: np.ndarray):
    """Exact squared distance of each vector to its centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = batch.column(2).to_numpy()
                d = squared(_vectors(batch.column(1), dim), centroids[own])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(2), pa.array(d)], ["vec_id", "cluster", "distance"]
                )

    return run


def integer_vectors(embeddings: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(vec_id, vector array<int>) of the usable rows of ``embeddings`` (vec_id, embedding)."""
    raw = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    fits = F.forall("embedding", lambda x: ~F.isnan(x) & F.floor(x * scale).between(-LARGEST, LARGEST))
    scaled = F.transform("embedding", lambda x: F.floor(x * scale).cast("int"))
    return raw.where((F.size("embedding") == dim) & fits).select("vec_id", scaled.alias("vector"))


class KMeans(NamedTuple):
    centroids: np.ndarray
    assigned: DataFrame  # vec_id, vector, own, second, upper, lower
    looked: list[int]  # distances to candidates worked out in each pass


def seeds(vectors: DataFrame, k: int) -> np.ndarray:
    """The k vectors with the smallest sha256 of ``3:<vec_id>``, in that order (ties: by vector)."""
    key = F.sha2(F.concat(F.lit("3:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(key.alias("key"), "vector").orderBy("key", "vector").limit(k).collect()
    return np.array([r["vector"] for r in rows], np.int64)


def kmeans(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS) -> KMeans | None:
    """``rounds`` rounds over ``vectors`` (vec_id, vector), and a last assignment; None without vectors."""
    start = seeds(vectors, k)
    if not len(start):
        return None
    dim = start.shape[1]
    centroids = before = start
    counts, sums = [0] * len(start), [[0] * dim for _ in start]
    state, looked, table = vectors, [], Rewritten(vectors.sparkSession, "kmeans")
    for turn in range(rounds + 1):
        done = table.write(state.mapInArrow(_round(dim, centroids, before, turn == 0), _PASS))
        state = done.where("kind = 0").select(*[c.split()[0] for c in _STATE.split(", ")])
        change = done.where("kind = 1").groupBy("centroid").agg(
            F.sum("n").alias("n"),
            F.sum("looked").alias("looked"),
            F.array(*[F.sum(F.col("total")[i].cast("decimal(38,0)")) for i in range(dim)]).alias("total"),
        )
        rows = change.collect()  # k rows
        looked.append(sum(r["looked"] for r in rows))
        if turn == rounds:
            break
        after = centroids.copy()
        for r in rows:
            c = r["centroid"]
            counts[c] += r["n"]
            sums[c] = [a + int(b) for a, b in zip(sums[c], r["total"])]
            if counts[c]:
                after[c] = [s // counts[c] for s in sums[c]]
        before, centroids = centroids, after
    return KMeans(centroids, state, looked)


def centroid_digest(centroid: np.ndarray) -> str:
    """sha256 of the components as decimal integers joined by commas."""
    return hashlib.sha256(",".join(str(int(x)) for x in centroid).encode()).hexdigest()


RESULT = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"


def cluster_vectors(embeddings: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM) -> DataFrame:
    """One row (schema ``RESULT``) per kept vector of ``embeddings`` (vec_id, embedding).

    Inertias that do not fit a bigint are null.
    """
    spark = embeddings.sparkSession
    found = kmeans(durable(integer_vectors(embeddings, dim), "vectors"), k, rounds)
    if found is None:
        return spark.createDataFrame([], RESULT)
    ends = found.assigned.select("vec_id", "vector", "own").mapInArrow(
        _distances(dim, found.centroids), "vec_id bigint, cluster int, distance bigint"
    )
    ends = durable(ends, "distances")
    sums = ends.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # k rows
    of = {r["cluster"]: int(r["s"]) for r in sums}
    fits = lambda n: n if n < 1 << 63 else None
    rows = [(c, fits(s), fits(sum(of.values())), centroid_digest(found.centroids[c])) for c, s in of.items()]
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return ends.join(F.broadcast(facts), "cluster").select(*[c.split()[0] for c in RESULT.split(", ")])
