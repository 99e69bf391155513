"""The index of granted names and ids that the profile stream asks (O-35)."""

import os

import pytest
from pyspark.sql import functions as F

from rollcall.operators import identity as I
from rollcall.plans import catalog as C
from rollcall.sources.schemas import AUTH_USERS, USERS
from rollcall.streaming import jobs as J
from rollcall.streaming.held_index import BASE, HeldIndex, live_runs


def keys(spark, values):
    return spark.createDataFrame([(v,) for v in values], "name string")


def held(index, spark, values, below):
    asked = keys(spark, values)
    return {r["key"] for r in index.among(asked, below).join(asked, F.col("key") == F.col("name"), "left_semi").collect()}


@pytest.mark.parametrize("fan", [2, 3, 8])
def test_live_runs_hold_each_batch_once(fan):
    for below in range(200):
        seen = []
        for level, number in live_runs(below, fan):
            seen += range(number * fan**level, (number + 1) * fan**level)
        assert seen == list(range(below))
        levels = [level for level, _ in live_runs(below, fan)]
        assert all(levels.count(x) < fan for x in levels)


def test_index_answers_for_the_batches_below(spark, scratch):
    index = HeldIndex(spark, os.path.join(scratch, "names"), buckets=5, fan=2)
    index.start(keys(spark, ["base0", "base1", None]))
    for n in range(7):
        index.merge(n)
        assert held(index, spark, ["base0", f"n{n - 1}", f"n{n}", "n0"], n) == {"base0", *(["n0"] if n else []), *([f"n{n - 1}"] if n else [])}
        index.append(keys(spark, [f"n{n}", f"m{n}"]), n)
        # a replay of the batch does not see itself, and writes its run again
        assert f"n{n}" not in held(index, spark, [f"n{n}"], n)
        index.append(keys(spark, [f"n{n}", f"m{n}"]), n)
    index.merge(7)
    everything = {"base0", "base1", *(f"{c}{n}" for c in "nm" for n in range(7))}
    assert held(index, spark, [*everything, "other"], 7) == everything
    # batches 0..3, 4..5 and 6 are three runs; what they were made of is gone
    assert sorted(os.listdir(index.root)) == ["base", "level=0-run=6", "level=1-run=2", "level=2-run=0"]


def test_a_half_written_merge_is_made_again(spark, scratch):
    index = HeldIndex(spark, os.path.join(scratch, "names"), buckets=2, fan=2)
    index.append(keys(spark, ["a"]), 0)
    index.append(keys(spark, ["b"]), 1)
    os.makedirs(os.path.join(index.root, "level=1-run=0", "bucket=0"))  # no success marker
    index.merge(2)
    assert held(index, spark, ["a", "b", "c"], 2) == {"a", "b"}


def test_a_batch_reads_only_the_buckets_it_asks_about(spark, scratch):
    index = HeldIndex(spark, os.path.join(scratch, "names"), buckets=64)
    index.start(keys(spark, [f"name{i}" for i in range(2000)]))
    index.append(keys(spark, [f"more{i}" for i in range(500)]), 0)
    asked = keys(spark, ["name3", "more4", "nobody"])
    found = index.among(asked, 1)
    buckets = index.asked_buckets(asked)
    files = {os.path.basename(os.path.dirname(f)) for f in found.inputFiles()}
    assert len(buckets) <= 3 and files <= {f"bucket={b}" for b in buckets}
    assert found.count() < 3 * 2500 / 64 * 3
    assert held(index, spark, ["name3", "more4", "nobody"], 1) == {"name3", "more4"}


def test_resolving_against_an_index_is_resolving_against_the_directory(spark, scratch):
    sf = "/root/testdata/sf0.001"
    crowd = C.stored_users(spark, C.V.crowded_directory(spark, sf))
    ids, names = (HeldIndex(spark, os.path.join(scratch, k), 16) for k in ("ids", "names"))
    ids.start(crowd.select("id"))
    names.start(crowd.select("username"))
    index = I.Directory(
        lambda asked: ids.among(asked, 0).withColumnRenamed("key", "id"),
        lambda asked: names.among(asked, 0).withColumnRenamed("key", "username"),
    )
    auth = C.V.auth_users(spark, sf)
    for variant in ("v1", "v2"):
        one, two = (I.build_profiles(auth, held, variant, C.AS_OF) for held in (crowd, index))
        assert sorted(map(tuple, one.profiles.collect()), key=repr) == sorted(map(tuple, two.profiles.collect()), key=repr)
        assert sorted(map(tuple, one.rejected.collect()), key=repr) == sorted(map(tuple, two.rejected.collect()), key=repr)


def test_a_replayed_batch_grants_the_same(spark, scratch):
    """The last batch's commit is lost: the restarted stream makes it again, with the same names."""
    sf = "/root/testdata/sf0.001"
    folder = os.path.join(scratch, "in")
    C.V.auth_users(spark, sf).repartition(2).write.parquet(folder)
    out, rej, ckpt = (os.path.join(scratch, x) for x in ("out", "rej", "ckpt"))
    base = C.stored_users(spark, C.users_existing(spark, sf))

    def run():
        stream = J.file_stream(spark, folder, AUTH_USERS, files_per_trigger=1)
        J.run_profile_stream(stream, base, out, rej, ckpt, as_of=C.as_of_col(), buckets=8)
        return sorted(map(tuple, J.read_batches(spark, out, USERS).collect()))

    made = run()
    last = max(int(f) for f in os.listdir(os.path.join(ckpt, "commits")) if f.isdigit())
    for name in (str(last), f".{last}.crc"):
        path = os.path.join(ckpt, "commits", name)
        os.path.exists(path) and os.remove(path)
    assert run() == made
    assert os.path.exists(os.path.join(f"{out}-held", "names", BASE, "_SUCCESS"))
