"""Centroid clustering against plain k-means on integers."""

import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rollcall.llm import shallot

SCHEMA = "vec_id bigint, embedding array<float>, label int, vector string, own int, cluster string"


def as_embeddings(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(i, v, 1, "x", 2, "y") for i, v in rows], schema)


def seed_key(vec_id, vector):
    text = "3:" + ("" if vec_id is None else str(vec_id))
    return hashlib.sha256(text.encode()).hexdigest(), vector


def plain(rows, k, rounds, dim):
    """Sorted result rows for (vec_id, vector) rows."""
    usable = [
        (i, [math.floor(1024 * float(x)) for x in v])
        for i, v in rows
        if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)
    ]
    usable = [(i, v) for i, v in usable if all(abs(x) <= 1 << 27 for x in v)]
    centroids = [v for _, v in sorted(((seed_key(*r), r[1]) for r in usable))[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, v in usable:
            groups.setdefault(nearest(v)[1], []).append(v)
        for j, vs in groups.items():
            centroids[j] = [sum(x) // len(vs) for x in zip(*vs)]
    ends = [(i, *nearest(v)) for i, v in usable]
    inertia = sum(d for _, d, _ in ends)
    out = []
    for i, d, c in ends:
        own = sum(e for _, e, b in ends if b == c)
        digest = hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()
        out.append((i, c, d, own, inertia, digest))
    return sorted(out, key=repr)


def f32(x):
    return float(np.float32(x))


def some_vectors(seed, n, dim, centres=12):
    rng = random.Random(seed)
    middle = [[rng.uniform(-1, 1) for _ in range(dim)] for _ in range(centres)]
    return [(i, [f32(x + rng.gauss(0, 0.15)) for x in rng.choice(middle)]) for i in range(n)]


@pytest.mark.parametrize("k,dim,n", [(8, 64, 300), (25, 3, 400), (1, 4, 20), (2, 1, 50)])
def test_equals_plain_kmeans(spark, k, dim, n):
    rows = some_vectors(k, n, dim)
    got = shallot.cluster_vectors(as_embeddings(spark, rows), k, 10, dim).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain(rows, k, 10, dim)


def test_odd_rows(spark):
    dim = 4
    rows = some_vectors(3, 40, dim)
    rows += [(7, rows[7][1]), (8, rows[9][1])] + [(100 + i, [0.0] * dim) for i in range(30)]  # repeats, copies
    rows += [(None, [0.5] * dim), (None, None), (200, None), (201, []), (202, [1.0] * 5), (203, [1.0, None, 1.0, 1.0])]
    rows += [(204, [float("nan")] * dim), (205, [1.0, float("inf"), 0.0, 0.0]), (206, [1.0, float("-inf"), 0.0, 0.0])]
    rows += [(207, [131072.0, -131072.0, 0.0, 0.0]), (208, [131073.0, 0.0, 0.0, 0.0]), (209, [3.0e38, 0.0, 0.0, 0.0])]
    got = shallot.cluster_vectors(as_embeddings(spark, rows), 8, 10, dim).collect()
    want = plain(rows, 8, 10, dim)
    assert sorted((tuple(r) for r in got), key=repr) == want and len(want) == len(rows) - 10
    few = rows[:3]
    got = shallot.cluster_vectors(as_embeddings(spark, few), 8, 10, dim).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain(few, 8, 10, dim)
    none = shallot.cluster_vectors(as_embeddings(spark, []), 8, 10, dim)
    assert none.collect() == [] and none.columns == [c.split()[0] for c in shallot.RESULT.split(", ")]


def test_equal_seeds_leave_the_larger_number_empty(spark):
    rows = [(i, [1.0, 2.0]) for i in range(12)] + [(50, [5.0, 5.0])]
    got = shallot.cluster_vectors(as_embeddings(spark, rows), 8, 3, 2).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain(rows, 8, 3, 2)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.integers(2, 12), st.integers(1, 3), st.integers(1, 6))
def test_bounds_never_lose_the_nearest(seed, k, dim, spread):
    """On small grids, full of ties, bounds carried over rounds of moving centroids give the plain answer."""
    rng = np.random.default_rng(seed)
    x = rng.integers(-spread, spread + 1, (200, dim))
    now = before = rng.integers(-spread, spread + 1, (k, dim))
    bounds = shallot.unbounded(len(x), k)
    for _ in range(6):
        bounds, _ = shallot.assign(x, bounds, shallot.geometry(now, before))
        d = ((x[:, None, :] - now[None]) ** 2).sum(axis=2)
        assert (bounds.own == d.argmin(axis=1)).all()
        rest = np.where(np.arange(k)[None] == bounds.own[:, None], np.inf, d)
        assert (bounds.upper >= np.sqrt(d.min(axis=1)) * (1 - 1e-12)).all()
        assert (bounds.lower <= np.sqrt(rest.min(axis=1)) * (1 + 1e-12)).all()
        before, now = now, now + rng.integers(-1, 2, now.shape)


def test_search_skips_most_distances(spark):
    rows = some_vectors(5, 2000, 8, centres=30)
    vectors = shallot.integer_vectors(as_embeddings(spark, rows), 8)
    found = shallot.kmeans(vectors, 30, 10)
    assert len(found.looked) == 11
    assert sum(found.looked) < 0.25 * 2000 * 30 * 11
    assert found.looked[-1] < found.looked[0]
