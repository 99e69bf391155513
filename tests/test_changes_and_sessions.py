"""Snapshots that rewrite what changed (O-04), and sessions with the profile attached in the stream (O-37)."""

import datetime as dt
import os

import pytest

from rollcall.plans import catalog as C
from rollcall.sources import delta as D
from rollcall.sources import snapshots as SN
from rollcall.sources import views as V
from rollcall.sources.schemas import AUTH_EVENTS, USERS
from rollcall.streaming import jobs as J
from rollcall.streaming import session_state as SS

SF = "/root/testdata/sf0.01"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def buckets_of(root, version):
    return {f for f in os.listdir(SN.version_path(root, version)) if f.startswith("bucket=")}


def test_a_batch_writes_its_own_buckets(spark, scratch):
    root = f"{scratch}/users"
    users = V.users(spark, SF).cache()
    table = D.ChangedSnapshots(spark, root, USERS, buckets=300)
    with pytest.raises(FileNotFoundError):
        table.read()
    assert table.write(users) == 0 and rows(table.read()) == rows(users)
    some = users.where("cast(id as bigint) % 100 = 3").selectExpr("id", "username", "'ADMIN' role", "created_at", "last_login", "avatar_url")
    assert table.apply(changed=some) == 1
    touched = buckets_of(root, 1)
    assert 0 < len(touched) <= some.count() < len(buckets_of(root, 0)) / 10
    want = {r["id"]: r for r in users.collect()}
    want.update({r["id"]: r for r in some.collect()})
    assert rows(table.read()) == sorted(map(tuple, want.values()), key=repr)
    new = spark.createDataFrame([("new", "newcomer", "USER", dt.datetime(2025, 1, 1), None, None)], USERS)
    assert table.apply(changed=new, deleted=users.where("id in ('1', '2', 'none')").select("id")) == 2
    want["new"] = new.first()
    for gone in ("1", "2"):
        del want[gone]
    assert rows(table.read()) == sorted(map(tuple, want.values()), key=repr)
    assert len(buckets_of(root, 2)) <= 4
    assert rows(table.read(0)) == rows(users)  # earlier versions stay readable


def test_a_torn_commit_is_not_seen(spark, scratch):
    root = f"{scratch}/users"
    users = V.users(spark, "/root/testdata/sf0.001")
    table = D.ChangedSnapshots(spark, root, USERS, buckets=8)
    table.write(users)
    before = rows(table.read())
    users.limit(2).write.parquet(SN.version_path(root, 1))  # a writer died before its marker
    assert rows(table.read()) == before
    assert table.apply(deleted=users.select("id").limit(1)) == 2  # skipped, not written over
    assert table.read().count() == users.count() - 1
    assert table.apply(deleted=users.select("id")) == 3 and table.read().count() == 0
    assert table.apply(changed=users) == 4 and rows(table.read()) == before


def test_a_late_profile_clears_the_error(spark, scratch):
    out, ckpt, events, profiles = (os.path.join(scratch, x) for x in ("out", "ckpt", "events", "profiles"))
    at = dt.datetime(2024, 1, 1)
    said = [(1, "a", "SIGNED_IN", at), (2, "b", "SIGNED_IN", at), (3, None, "SIGNED_IN", at)]
    spark.createDataFrame([{"event_id": i, "id": u, "event": e, "ts": t} for i, u, e, t in said], AUTH_EVENTS).write.parquet(events)
    spark.createDataFrame([("a", "ada", "ADMIN", at, None, None)], USERS).write.parquet(profiles)

    def run():
        J.run_attached_stream(J.file_stream(spark, events, AUTH_EVENTS), J.file_stream(spark, profiles, USERS), out, ckpt)
        return {r["id"]: r for r in J.read_attached(spark, out).collect()}

    first = run()
    assert set(first) == {"a", "b"} and first["a"]["signed_in"] and first["a"]["landing"] == "/admin-dashboard"
    assert not first["b"]["signed_in"] and first["b"]["auth_error"] == SS.PROFILE_ERROR
    spark.createDataFrame([("b", "bob", "USER", at, None, None), ("c", "cy", "USER", at, None, None)], USERS).write.mode("append").parquet(profiles)
    second = run()  # a restart from the checkpoint
    assert second["b"]["signed_in"] and second["b"]["auth_error"] is None and second["b"]["username"] == "bob"
    assert second["a"] == first["a"] and set(second) == {"a", "b"}


def test_attached_stream_equals_the_batch(spark):
    sf = "/root/testdata/sf0.001"
    batch = SS.session_state(SS.latest_events(V.auth_events(spark, sf)), C.users_existing(spark, sf))
    assert rows(C.QUERIES["session_attached_stream"](spark, sf)) == rows(batch)
