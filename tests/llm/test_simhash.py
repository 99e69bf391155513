"""SimHash near-dedup against a plain-Python model."""

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from rollcall.llm import simhash
from rollcall.llm.components import components
from rollcall.llm.queries import QUERIES
from tests.llm import brute
from tests.llm.conftest import as_docs, prose

SMALL = "/root/testdata/sf0.001"


def fingerprint(text, size=3):
    w = brute.words(brute.fold(text))
    parts = [w[i : i + size] for i in range(len(w) - size + 1)] if len(w) >= size else ([w] if w else [])
    h = [xxhash.xxh64(" ".join(p).encode(), seed=42).intdigest() for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(values):
    """Smallest index reachable by links of at most two bits."""
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(values):
        for j in range(i):
            if (a ^ values[j]).bit_count() <= 2:
                low, high = sorted((find(i), find(j)))
                root[high] = low
    return [find(i) for i in range(len(values))]


def check(found, rows):
    """``found`` (doc_id, fp, component_id) for (doc_id, text) rows, against brute force over the versions."""
    prints = [fingerprint(t) for _, t in rows]
    got = sorted(((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in found.collect()), key=repr)
    # versions of one id hang together
    nodes = groups(prints)
    while True:
        least = {}
        for (d, _), n in zip(rows, nodes):
            if d is not None:
                least[d] = min(least.get(d, n), n)
        new = [least.get(d, n) for (d, _), n in zip(rows, nodes)]
        low = {}
        for old, n in zip(nodes, new):
            low[old] = min(low.get(old, n), n)
        new = [low[n] for n in nodes]
        if new == nodes:
            break
        nodes = new
    first = {}
    for (d, _), n in zip(rows, nodes):
        if d is not None:
            first[n] = min(first.get(n, d), d)
    want = sorted(((d, p, first.get(n)) for (d, _), p, n in zip(rows, prints, nodes)), key=repr)
    assert got == want
    return want


def near_copies(seed, n=60):
    rng = random.Random(seed)
    base = prose(rng, 400, 5000).split()
    for i in range(n):
        copy = list(base)
        for _ in range(i % 4):
            copy[rng.randrange(len(copy))] = "changed"
        yield " ".join(copy)


def test_odd_rows(spark, odd_rows, odd_docs, repeated_docs, no_docs):
    check(simhash.simhash_components(odd_docs), [r[:2] for r in odd_rows])
    rows = [(r["doc_id"], r["text"]) for r in repeated_docs.select("doc_id", "text").collect()]
    check(simhash.simhash_components(repeated_docs), rows)
    assert simhash.simhash_components(no_docs).collect() == []
    kept = simhash.one_of_each_component(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({r[2] for r in check(simhash.simhash_components(odd_docs), [r[:2] for r in odd_rows])})


def test_near_copies(spark):
    rows = [(i, t, "en", "a") for i, t in enumerate(near_copies(1))]
    found = check(simhash.simhash_components(as_docs(spark, rows)), [r[:2] for r in rows])
    assert len({p for _, p, _ in found}) > 3 and len({c for _, _, c in found}) < len({p for _, p, _ in found})


@pytest.mark.parametrize("list_rows", [0, 3, 256])
def test_links_of_random_fingerprints(spark, list_rows):
    """Lists paired and lists too long to pair give the same components, at every place of the differing bits."""
    rng = random.Random(9)
    values = set()
    for _ in range(25):
        v = rng.getrandbits(64)
        values.add(v)
        for bits in (1, 2, 2, 2, 3, 4):
            for b in rng.sample(range(64), bits):
                v ^= 1 << b
            values.add(v)
    values = sorted(values, key=brute.signed)
    nodes = spark.createDataFrame([(brute.signed(v),) for v in values], "fp bigint")
    links = simhash.fingerprint_links(nodes, list_rows)
    at = {r["node"]: r["root"] for r in components(links).collect()}
    want = [brute.signed(values[g]) for g in groups(values)]
    assert [at.get(brute.signed(v), brute.signed(v)) for v in values] == want
    assert all(((r["a"] ^ r["b"]) % (1 << 64)).bit_count() <= 2 for r in links.collect())


def test_pairs_are_given_once(spark):
    values = [0, 1, 3, 1 << 63, (1 << 63) | 1]
    nodes = spark.createDataFrame([(brute.signed(v),) for v in values], "fp bigint")
    got = [tuple(sorted((r["a"], r["b"]))) for r in simhash.fingerprint_links(nodes).collect()]
    near = [(a, b) for i, a in enumerate(values) for b in values[:i] if (a ^ b).bit_count() <= 2]
    assert sorted(got) == sorted(tuple(sorted((brute.signed(a), brute.signed(b)))) for a, b in near)


def test_long_texts_in_chunks(monkeypatch, odd_rows):
    monkeypatch.setattr(simhash, "CHUNK", 7)
    from rollcall.llm.words import WordHasher

    import pyarrow as pa

    texts = [t for _, t, _, _ in odd_rows][:13]
    got = simhash.fingerprints_of(WordHasher(fold_ascii=True), pa.array(texts).slice(1), 3, xxhash.xxh64_intdigest)
    assert got.tolist() == [fingerprint(t) for t in texts[1:]]


def test_query(spark):
    got = QUERIES["op13_simhash"](spark, SMALL)
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    back = got.select("doc_id", F.conv("fingerprint", 16, -10).cast("long").alias("fp"), "component_id")
    check(back, rows)
    assert got.where(~F.col("fingerprint").rlike("^[0-9a-f]{16}$")).isEmpty()
