"""Trigram index, bucketed tables, two-column clustering, Bloom filters, the policy view, the section registry."""

import datetime as dt
import glob
import os
import random
import uuid
from contextlib import contextmanager

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from rollcall.operators import access as A
from rollcall.operators import identity as I
from rollcall.operators import search as S
from rollcall.operators import trigrams as G
from rollcall.plans import catalog as C
from rollcall.sources import bucketed as B
from rollcall.sources import snapshots as SN
from rollcall.sources import views as V
from rollcall.sources import zorder as Z
from rollcall.sources.schemas import USERS

SF = "/root/testdata/sf0.01"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


@contextmanager
def many_files(spark):
    """Range partitions that adaptive execution does not coalesce on small data."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "8")


@pytest.fixture(scope="module")
def users(spark):
    return C.stored_users(spark, V.users(spark, SF), cluster_by="id")


# ------------------------------------------------------------- trigrams


def test_literal_runs():
    assert G.literal_runs("Team") == ["team"]
    assert G.literal_runs("a_b%cde") == ["a", "b", "cde"]
    assert G.literal_runs("a\\_b\\c") == ["a_bc"]
    assert G.literal_runs("a_b", literal=True) == ["a_b"]
    assert G.literal_runs("abcéDEF") == ["abc", "def"]
    assert G.trigrams_of("ab") == [] and G.trigrams_of("abab") == ["aba", "bab"]


def test_index_equals_the_scan(spark, scratch):
    """Random requests with wildcards, escapes and characters whose case mapping is special."""
    rng = random.Random(2)
    alphabet = "aabbcAB_%\\1é İK"
    names = {"".join(rng.choice(alphabet) for _ in range(rng.randrange(9))) for _ in range(400)}
    rows = [(str(i), n, "USER", dt.datetime(2024, 1, 1), None, None) for i, n in enumerate(sorted(names))]
    users = spark.createDataFrame([*rows, ("none", "", "USER", None, None, None)], USERS).cache()
    G.write_index(users, f"{scratch}/index")
    index = G.read_index(spark, f"{scratch}/index")
    helped = 0
    for _ in range(40):
        q = "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 7)))
        req = S.SearchRequest(q=q, literal=rng.random() < 0.3)
        near = G.narrowed(users, index, req)
        helped += near is not users
        assert ids(G.search_indexed(users, index, req)) == ids(S.search_unsorted(users, req)), q
    assert helped >= 5


@pytest.mark.parametrize("few", [0, 1000])
def test_rare_and_common_runs(spark, users, scratch, few, monkeypatch):
    monkeypatch.setattr(G, "FEW_IDS", few)
    G.write_index(users, f"{scratch}/index")
    index = G.read_index(spark, f"{scratch}/index")
    for q in ("00123", "machinery_team", "zzz", "user", "#0%14"):
        req = S.SearchRequest(q=q)
        assert ids(G.search_indexed(users, index, req)) == ids(S.search_unsorted(users, req)), q
    found = G.search_indexed(users, index, S.SearchRequest(q="00123"))
    # few ids reach the scan as a list, many by a join
    assert ("In(id," in plan(found)) == bool(few)
    assert ("Join" in plan(found)) == (not few)


def test_a_posting_look_up_reads_its_row_groups(spark, users, scratch):
    with many_files(spark):
        G.write_index(users, f"{scratch}/index")
    found = G.read_index(spark, f"{scratch}/index").postings.where(F.col("trigram").isin("012"))
    assert "PushedFilters: [In(trigram" in plan(found) or "EqualTo(trigram" in plan(found)
    touched = 0
    files = glob.glob(f"{scratch}/index/postings/*.parquet")
    for f in files:
        meta = pq.ParquetFile(f).metadata
        at = meta.schema.names.index("trigram")
        stats = [meta.row_group(g).column(at).statistics for g in range(meta.num_row_groups)]
        touched += any(s.min <= "012" <= s.max for s in stats)
    assert len(files) > 20 and touched <= 2


# ------------------------------------------------------------- bucketed


def bucketed(spark, df, buckets=8):
    return B.write_bucketed(df, f"t_{uuid.uuid4().hex}", buckets)


def test_joins_on_the_key_read_buckets_in_place(spark, monkeypatch):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        users, auth = bucketed(spark, C.users_existing(spark, SF)), bucketed(spark, V.auth_users(spark, SF))
        events = V.auth_events(spark, SF)
        missing = auth.join(users.select("id"), "id", "left_anti")
        assert "hashpartitioning" not in plan(missing)
        assert missing.count() == V.auth_users(spark, SF).join(C.users_existing(spark, SF), "id", "left_anti").count()
        kept = I.cascade_delete(users, auth)
        assert "hashpartitioning" not in plan(kept)
        assert ids(kept) == ids(I.cascade_delete(C.users_existing(spark, SF), V.auth_users(spark, SF)))
        # the sign-ins alone are shuffled, into the directory's buckets
        touched = I.login_touch(users, events)
        text = plan(touched)
        assert text.count("hashpartitioning") == 1 and "hashpartitioning(id" in text and ", 8)" in text
        plain = I.login_touch(C.stored_users(spark, C.users_existing(spark, SF)), events)
        assert plan(plain).count("hashpartitioning") == 2
        assert sorted(map(tuple, touched.collect())) == sorted(map(tuple, plain.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_bucketed_table_is_known_to_another_catalog(spark, scratch):
    df = V.users(spark, "/root/testdata/sf0.001")
    B.write_bucketed(df, "one_table", 8, path=f"{scratch}/t")
    again = B.attach_bucketed(spark, "other_table", df, 8, f"{scratch}/t")
    assert ids(again) == ids(df)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "hashpartitioning" not in plan(again.join(B.read_bucketed(spark, "one_table").select("id"), "id", "left_semi"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


# ------------------------------------------------------------- clustering


def files_touched(root, column, low, high):
    """(files whose statistics may hold a value from low to high, files)."""
    files = glob.glob(f"{root}/version=*/*.parquet")
    touched = 0
    for f in files:
        meta = pq.ParquetFile(f).metadata
        at = meta.schema.names.index(column)
        stats = [meta.row_group(g).column(at).statistics for g in range(meta.num_row_groups)]
        touched += any(s is not None and s.has_min_max and s.min <= high and s.max >= low for s in stats)
    return touched, len(files)


def test_quantiles_and_bits(spark):
    cuts = Z.bounds(list(range(100)), 3)
    assert cuts == [12, 25, 37, 50, 62, 75, 87]
    df = spark.createDataFrame([(x,) for x in [None, -5, 0, 11, 12, 50, 99, 1000]], "x bigint")
    got = {r["x"]: r["q"] for r in Z.with_quantile(df, "x", cuts, "q", 3).collect()}
    assert got == {None: 0, -5: 0, 0: 0, 11: 0, 12: 1, 50: 4, 99: 7, 1000: 7}
    row = spark.range(1).select(Z.interleaved(F.lit(0b101), F.lit(0b011), 3).alias("z")).first()
    assert row["z"] == 0b100111


def test_two_columns_skip_files(spark, scratch):
    users = V.users(spark, "/root/testdata/sf0.1")
    with many_files(spark):
        SN.write_snapshot(users, f"{scratch}/by_id", "id")
        SN.write_snapshot(users, f"{scratch}/both", ("created_at", "id"))
    assert ids(SN.read_snapshot(spark, f"{scratch}/both")) == ids(users)
    days = dt.datetime(1995, 6, 1), dt.datetime(1995, 6, 30)
    share = {}
    for root in ("by_id", "both"):
        for column, low, high in (("created_at", *days), ("id", "7000", "7000")):
            touched, files = files_touched(f"{scratch}/{root}", column, low, high)
            share[root, column] = touched / files
    assert share["by_id", "created_at"] > 0.9 and share["by_id", "id"] <= 0.05
    assert share["both", "created_at"] < 0.5 and share["both", "id"] < 0.35


def rows_read(df):
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_bloom_filters_skip_row_groups(spark, scratch):
    users = V.users(spark, SF).repartition(8)
    SN.write_snapshot(users, f"{scratch}/plain")
    SN.write_snapshot(users, f"{scratch}/bloom", bloom=("id", "username"))
    plain, bloom = (SN.read_snapshot(spark, f"{scratch}/{x}", USERS) for x in ("plain", "bloom"))
    total = plain.count()
    assert rows_read(S.by_id(plain, "700")) > 0.8 * total
    assert rows_read(S.by_id(bloom, "700")) < 0.4 * total
    assert S.by_id(bloom, "700").collect() == S.by_id(plain, "700").collect()
    name = S.by_id(plain, "700").first()["username"]
    assert rows_read(bloom.where(F.col("username") == name)) < 0.4 * total
    assert rows_read(S.by_id(bloom, "no such id")) < 0.4 * total


# ------------------------------------------------------------- policy


def test_reads_go_through_the_policy(spark, users):
    directory = A.SessionDirectory(users, "policy_test")
    with pytest.raises(A.NoSession):
        directory.read()
    with pytest.raises(A.NoSession):
        directory.sign_in(None)
    for actor in ("7", "11", "50", "nobody"):  # USER, ADMIN, SUPER_ADMIN, no profile
        directory.sign_in(actor)
        want = A.visible_to(users, actor)
        assert ids(directory.read()) == ids(want)
        assert ids(S.search(directory.read(), S.SearchRequest(q="er"))) == ids(S.search(want, S.SearchRequest(q="er")))
        assert S.list_directory(directory.read()).collect() == S.list_directory(want).collect()
        assert S.directory_count(directory.read()).first() == S.directory_count(want).first()
    directory.sign_in("7")
    assert "EqualTo(id,7)" in plan(directory.read())  # the user's rule reaches the scan
    directory.sign_in("11")
    assert "PushedFilters: []" in plan(directory.read())
    directory.sign_out()
    with pytest.raises(A.NoSession):
        directory.read()


def test_applied_changes_return_the_row(spark, users):
    requests = spark.createDataFrame(
        [(1, "50", "7", "promote"), (2, "7", "8", "promote"), (3, "50", "11", "demote"), (4, "50", "none", "demote")],
        "request_id bigint, actor_id string, target_id string, action string",
    )
    outcomes = A.role_change_outcomes(requests, users.select("id", "role"))
    rows = {r["request_id"]: r for r in A.changed_rows(outcomes, users).collect()}
    assert {k: (r["id"], r["role"]) for k, r in rows.items()} == {1: ("7", "ADMIN"), 3: ("11", "USER")}
    after = {r["id"]: r for r in A.apply_role_changes(users, outcomes).collect()}
    assert all(after[r["id"]].asDict() == {k: v for k, v in r.asDict().items() if k != "request_id"} for r in rows.values())


def test_registry(users):
    req = S.request_for("users", "  er ", {"role": "ADMIN", "joinedAfter": "1993-01-01"}, sort_by="username", sort_dir="asc")
    assert req == S.SearchRequest(q="er", role="ADMIN", joined_after="1993-01-01", sort_by="username", sort_dir="asc")
    with pytest.raises(S.InvalidFilter, match="Invalid filter: 'avatar'"):
        S.request_for("users", "", {"avatar": "x"})
    with pytest.raises(S.InvalidSection):
        S.request_for("posts")
    with pytest.raises(S.InvalidRole):
        S.search(users, S.request_for("users", "", {"role": "OWNER"}))
    assert S.empty_message("users", 0) == "No users matched your search." and S.empty_message("users", 3) is None
    assert [key for key, _ in S.SECTIONS["users"]["sorts"]] == ["username", "createdAt", "lastLogin"]
