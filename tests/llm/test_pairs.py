"""Jaccard join, substring dedup and sharding against plain-Python models."""

import heapq
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rollcall.llm import components, jaccard, sharding, substring
from rollcall.llm.words import WordHasher, slices
from tests.llm import brute
from tests.llm.conftest import as_docs, prose


def test_word_spans_are_the_pattern(odd_rows, monkeypatch):
    monkeypatch.setattr("rollcall.llm.words.PIECE_BYTES", 64)
    texts = [t for _, t, _, _ in odd_rows]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts)})
    got, hasher = [], WordHasher()
    for part in slices(batch.slice(1), "text", 500):
        found = hasher.words(part.column(0))
        data = "".join(t.as_py() or "" for t in part.column(0)).encode()
        spans = [data[a:b].decode() for a, b in zip(found.start, found.end)]
        got += [spans[a:b] for a, b in zip(found.first, found.first[1:])]
        assert len(set(found.hash.tolist())) == len(set(spans))
    assert got == [brute.words(t) for t in texts[1:]]


def test_windows_are_equal_when_their_words_are(odd_rows):
    texts = [t for _, t, _, _ in odd_rows]
    hasher = WordHasher()
    found = hasher.words(pa.array(texts))
    start, value = hasher.windows(found, 3)
    flat = [w for t in texts for w in brute.words(t)]
    keys = [tuple(flat[i : i + 3]) for i in start]
    assert Counter(Counter(keys).values()) == Counter(Counter(value.tolist()).values())
    assert len(start) == sum(max(0, len(brute.words(t)) - 2) for t in texts)


def check_jaccard(docs):
    got = jaccard.jaccard_components(docs).collect()
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    want = brute.jaccard_groups([r for r in rows if r[0] is not None])
    assert sorted(((g["doc_id"], g["n_shingles"], g["component_id"]) for g in got), key=repr) == sorted(
        ((d, len(brute.shingles(t)), want.get(d)) for d, t in rows), key=repr
    )
    return want


def test_jaccard(odd_docs, repeated_docs, no_docs):
    groups = check_jaccard(odd_docs)
    assert len(set(groups.values())) < len(groups)
    check_jaccard(repeated_docs)
    check_jaccard(no_docs)


def test_jaccard_on_chains_and_near_misses(spark):
    """Similarities on either side of 0.75, and chains that only neighbours link."""
    rng = random.Random(3)
    rows, d = [], 0
    for n in (8, 12, 40, 100):
        base = prose(rng, n, 10_000).split()
        for _ in range(25):
            rows.append((d, " ".join(base), "en", "a"))
            d += rng.randrange(1, 4)
            spot = rng.randrange(len(base))
            base = [*base[:spot], f"v{d}", *base[spot + rng.randrange(2) :]]
    rng.shuffle(rows)
    groups = check_jaccard(as_docs(spark, rows))
    assert 4 < len(set(groups.values())) < len(groups)


def test_jaccard_without_leader_rounds_finds_the_same(odd_docs):
    one = jaccard.JaccardJoin(odd_docs, rounds=0).result().drop("n_links").collect()
    assert sorted(one) == sorted(jaccard.JaccardJoin(odd_docs, rounds=3).result().drop("n_links").collect())


def test_links_are_counted_exactly(spark, odd_rows, monkeypatch):
    """A group of different near copies, chains and an id with two texts, in one block and in many."""
    rng = random.Random(9)
    base = prose(rng, 60).split()
    rows = [(1000 + i, " ".join([*base[:k], f"v{i}", *base[k + 1 :]]), "en", "a") for i, k in enumerate(range(0, 60, 2))]
    rows += [(1003, prose(rng, 30), "en", "a"), *odd_rows]
    docs = as_docs(spark, rows)
    sets = {}
    for d, t, _, _ in rows:
        sets.setdefault(d, []).append(brute.shingles(t))
    classes = {}
    for d, own in sets.items():
        for x in own:
            classes[frozenset(x)] = min(d, classes.get(frozenset(x), d))
    of = {d: [x for x in own if x and classes[frozenset(x)] == d] for d, own in sets.items()}
    near = lambda x, y: len(x & y) and 100 * len(x & y) >= 75 * len(x | y)
    want = {a: sum(a != b and any(near(x, y) for x in of[a] for y in of[b]) for b in of) for a in of}
    assert max(want.values()) > 20
    for block in (2000, 7):
        monkeypatch.setattr(jaccard, "BLOCK", block)
        for r in jaccard.jaccard_components(docs).collect():
            if len(sets[r["doc_id"]]) == 1:
                x = frozenset(sets[r["doc_id"]][0])
                assert r["n_links"] == (want[classes[x]] if x else 0)


def test_each_version_of_an_id_is_verified():
    """Only the second text of id 1 equals that of id 2; the rows come in either order."""
    texts = ["a b c d e f g", "one two three four five six"]
    for order in ((0, 1), (1, 0)):
        batch = pa.RecordBatch.from_pydict(
            {"a": [1, 1], "b": [2, 2], "text_a": [texts[i] for i in order], "text_b": [texts[1]] * 2}
        )
        got = [r for part in jaccard._verify(5, Fraction(3, 4))(iter([batch])) for r in part.to_pylist()]
        assert got == [{"a": 1, "b": 2}]


def test_least_overlap_is_the_threshold():
    for a in range(1, 30):
        for b in range(1, 30):
            need = int(jaccard._least_overlap(np.int64(a), np.int64(b), Fraction(3, 4)))
            assert all((100 * c >= 75 * (a + b - c)) == (c >= need) for c in range(min(a, b) + 1))


def test_one_of_each_group(odd_docs):
    left = jaccard.one_of_each_group(odd_docs)
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.select("doc_id", "text").collect()]
    groups = brute.jaccard_groups(rows)
    assert left.columns == odd_docs.columns
    assert {r["doc_id"] for r in left.collect()} == {d for d, c in groups.items() if d == c}


def test_shared_rows_stream_over_batches():
    tokens = [1, 2, 2, 3, 4, 4, 4, 4, 5, 6, 6]
    for cut in ([1, 2, 3, 5, 6, 7, 8, 10], [0, 3, 4, 6], [2, 9], []):
        ends = [0, *cut, len(tokens)]
        batches = [
            pa.RecordBatch.from_pydict({"token": pa.array(tokens[a:b], pa.int64()), "id": pa.array(range(a, b), pa.int64())})
            for a, b in zip(ends, ends[1:])
        ]
        got = [t for b in jaccard._shared_rows(iter(batches)) for t in b.column(0).to_pylist()]
        assert got == [2, 2, 4, 4, 4, 4, 6, 6]


def test_components(spark):
    rng = random.Random(8)
    links = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(90)]
    links += [(5, 5), (None, 3), (400, 401), (400, 401)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    assert got == {x: find(x) for x in root}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def check_repeats(docs, window=20):
    got = substring.remove_repeats(docs, window).collect()
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert sorted(tuple(g) for g in got) == sorted(brute.repeats(rows, window))
    return sum(g["n_removed"] for g in got)


def test_repeats(odd_docs, no_docs):
    assert check_repeats(odd_docs) > 800
    assert check_repeats(odd_docs, 4) > 800
    check_repeats(no_docs)


def test_repeats_in_small_slices(spark, odd_rows, monkeypatch):
    """Repeats within and across slices and tasks, many windows per document."""
    rng = random.Random(2)
    rows = [(i, prose(rng, rng.randrange(10, 90), 3), "en", "a") for i in range(80)]
    rows += [(200 + i, prose(random.Random(9), 70), "en", "a") for i in range(30)]
    assert check_repeats(as_docs(spark, rows).repartition(9), 6) > 1000


def test_repeats_of_repeated_rows(repeated_docs, odd_docs):
    """Equal rows are one document; texts that share an id each lose what starts earlier."""
    once = {g["doc_id"]: tuple(g) for g in substring.remove_repeats(odd_docs).collect()}
    again = brute.by(substring.remove_repeats(repeated_docs).collect(), "doc_id")
    assert len(again[1]) == 2 and {tuple(g) for g in again[1]} == {once[1]}
    assert len(again[None]) == 2 and len(again[3]) == 3
    assert sorted(g["n_words"] for g in again[3]) == [50, 200, 200]


def test_levels_double_until_nothing_repeats(odd_docs, odd_rows, no_docs):
    got = {r["doc_id"]: r["longest"] for r in substring.repeat_levels(odd_docs, 4).collect()}
    want, length = {}, 4
    while True:
        places = {}
        for d, t, _, _ in odd_rows:
            w = brute.words(t)
            for i in range(len(w) - length + 1):
                places.setdefault(tuple(w[i : i + length]), []).append(d)
        again = {d for docs in places.values() if len(docs) > 1 for d in docs}
        if not again:
            break
        want.update(dict.fromkeys(again, length))
        length *= 2
    assert got == want and max(got.values()) >= 128
    assert substring.repeat_levels(no_docs).count() == 0


def test_window_must_be_even(odd_docs):
    with pytest.raises(ValueError):
        substring.SubstringDedup(odd_docs, 7)


def longest_first(weights, shards):
    """Loads, and how many items of each weight each shard has, by scheduling items one after another."""
    loads, has = [0] * shards, Counter()
    for weight in sorted(weights, reverse=True):
        shard = loads.index(min(loads))
        loads[shard] += weight
        has[weight, shard] += 1
    return loads, has


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 12), st.integers(1, 60)), max_size=12), st.integers(1, 7))
def test_runs_are_scheduled_like_their_items(runs, shards):
    """Runs longer and shorter than the number of shards, and a heap over single items."""
    runs = sorted(dict(runs).items(), reverse=True)
    weights = [w for w, n in runs for _ in range(n)]
    got = Counter()
    for weight, ends, of in sharding.schedule(runs, shards):
        for shard, low, high in zip(of, [0, *ends], ends):
            got[weight, shard] += high - low
    loads, want = longest_first(weights, shards)
    assert got == want
    heap = [(0, s) for s in range(shards)]
    for weight in weights:
        load, s = heap[0]
        heapq.heapreplace(heap, (load + weight, s))
    assert sorted(load for load, _ in heap) == sorted(loads)


def test_a_run_of_very_many_groups_is_placed_at_once():
    loads = [5, 0, 11]
    taken = sharding.place_run(loads, 3, 10**12)
    assert sum(taken) == 10**12 and max(loads) - min(loads) <= 3


def check_shards(docs, shards=40):
    rows = sharding.shard_documents(docs, shards).collect()
    texts = [(r["text"] or "").encode() for r in docs.select("text").collect()]
    assert sorted((r["size"], r["text_crc32"]) for r in rows) == sorted((len(t) + 16, zlib.crc32(t)) for t in texts)
    for shard, members in brute.by(rows, "shard").items():
        assert 0 <= shard < shards and sorted(m["slot"] for m in members) == list(range(len(members)))
    for members in brute.by(rows, "text_crc32").values():
        assert len({m["shard"] for m in members}) == 1
    # the whole schedule, over all groups
    groups = Counter()
    for t in texts:
        groups[t] += len(t) + 16
    loads, want = longest_first(groups.values(), shards)
    weight = {zlib.crc32(t): w for t, w in groups.items()}
    got = {(m["text_crc32"], m["shard"]) for m in rows}
    assert Counter((weight[crc], shard) for crc, shard in got) == want
    mine = Counter()
    for r in rows:
        mine[r["shard"]] += r["size"]
    assert sorted(mine.values()) == sorted(x for x in loads if x)
    return rows


def test_shards(odd_docs, repeated_docs, no_docs):
    check_shards(odd_docs)
    check_shards(repeated_docs, 3)
    assert check_shards(no_docs) == []


def test_shards_of_a_whole_table(spark):
    check_shards(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_shards_are_even(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK", 7)  # the plan in several blocks
    monkeypatch.setattr(sharding, "BROADCAST_RUNS", 0)  # and joined instead of broadcast
    rng = random.Random(4)
    docs = as_docs(spark, [(i, prose(rng, rng.randrange(20, 60)), "en", "a") for i in range(3000)])
    rows = check_shards(docs, 4)
    loads = Counter()
    for r in rows:
        loads[r["shard"]] += r["size"]
    assert max(loads.values()) - min(loads.values()) < 0.02 * sum(loads.values())


def test_texts_without_id_do_not_share_places(spark):
    """Rows without id, and versions of one id, are documents apart in the joins."""
    rng = random.Random(8)
    passage = prose(rng, 30)
    rows = [(None if i % 2 else 7, f"{prose(rng, 25)} y{i} {passage} x{i}", "en", "a") for i in range(60)]
    job = substring.SubstringDedup(as_docs(spark, rows))
    places = job._with_places(job.later_starts(), "left").selectExpr("coalesce(size(places), 0) n").collect()
    assert sorted(r["n"] for r in places)[1:] == [11] * 59  # each its own eleven starts
    got = job.result().collect()
    assert sorted(r["n_removed"] for r in got)[1:] == [30] * 59
    top = as_docs(spark, [(2**63 - 1, passage, "en", "a"), (None, passage + " y", "en", "a"), (1, "z", "en", "a")])
    assert sorted(r["n_removed"] for r in substring.remove_repeats(top).collect()) == [0, 0, 30]


def test_texts_are_shuffled_once(spark):
    """The levels and the removal share one exchange of the texts."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = substring.remove_repeats(docs)
        found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "ReusedExchange" in plan.split("== Initial")[0]
