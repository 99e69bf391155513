"""Streaming = batch, replay safety, snapshots, plan shape and the driver contract."""

import os

import pytest
from pyspark.sql import functions as F

from rollcall.operators import search as S
from rollcall.plans import catalog as C
from rollcall.session import scratch_path
from rollcall.sources import snapshots as SN
from rollcall.sources import views as V
from rollcall.sources.schemas import AUTH_USERS, EVENTS, USERS
from rollcall.streaming import jobs as J
from rollcall.streaming import session_state as SS

SF = "/root/testdata/sf0.01"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def split_events(spark, scratch, parts=3):
    """The events table re-written as several files, so a stream sees several batches."""
    folder = os.path.join(scratch, "events")
    spark.read.parquet(f"{SF}/events.parquet").repartition(parts).write.parquet(folder)
    return folder


def event_stream(spark, folder, files=1):
    return V.auth_events_from(J.file_stream(spark, folder, EVENTS, files))


def test_session_stream_equals_batch_over_several_batches(spark, scratch):
    folder = split_events(spark, scratch)
    out, ckpt = os.path.join(scratch, "out"), os.path.join(scratch, "ckpt")
    J.run_session_stream(event_stream(spark, folder), out, ckpt)
    assert J.read_batches(spark, out, J.LATEST).count() > 0
    users = V.users(spark, SF)
    streamed = SS.session_state(J.read_session_latest(spark, out), users)
    batch = SS.session_state(SS.latest_events(V.auth_events(spark, SF)), users)
    assert rows(streamed) == rows(batch)
    # a second run on the same checkpoint finds nothing new and changes nothing
    J.run_session_stream(event_stream(spark, folder), out, ckpt)
    assert rows(SS.session_state(J.read_session_latest(spark, out), users)) == rows(batch)


def test_login_stream_equals_batch(spark, scratch):
    from rollcall.operators.identity import login_touch

    folder = split_events(spark, scratch, parts=2)
    out, ckpt = os.path.join(scratch, "out"), os.path.join(scratch, "ckpt")
    J.run_login_stream(event_stream(spark, folder), out, ckpt)
    users = V.users(spark, SF).withColumn("last_login", F.lit(None).cast("timestamp_ntz"))
    assert rows(J.apply_login_updates(spark, users, out)) == rows(login_touch(users, V.auth_events(spark, SF)))


def test_profile_stream_over_several_batches_keeps_names_unique(spark, scratch):
    folder = os.path.join(scratch, "identities")
    V.auth_users(spark, SF).repartition(3).write.parquet(folder)
    out, rej, ckpt = (os.path.join(scratch, x) for x in ("out", "rej", "ckpt"))
    base = C.stored_users(spark, C.users_existing(spark, SF))
    stage = os.path.join(scratch_path(spark, "stage"), spark.sparkContext.applicationId)
    before = len(os.listdir(stage.removeprefix("file:")))

    def run():
        identities = J.file_stream(spark, folder, AUTH_USERS, files_per_trigger=1)
        J.run_profile_stream(identities, base, out, rej, ckpt, as_of=C.as_of_col())
        return J.read_batches(spark, out, USERS)

    made = run()
    assert len(os.listdir(out)) >= 3
    assert len(os.listdir(stage.removeprefix("file:"))) == before  # what batches staged is gone
    expected = V.auth_users(spark, SF).join(base, "id", "left_anti").select("id")
    assert rows(made.select("id")) == rows(expected)
    everyone = base.select("username").unionByName(made.select("username"))
    assert everyone.distinct().count() == everyone.count()
    # running again on the same checkpoint is a no-op (exactly once)
    names = rows(made)
    assert rows(run()) == names
    compacted = os.path.join(scratch, "compacted")
    J.compact(spark, out, USERS, compacted)
    assert rows(spark.read.parquet(compacted)) == names


def test_streams_without_batches_give_empty_results(spark, scratch):
    out = os.path.join(scratch, "never")
    assert J.read_session_latest(spark, out).count() == 0
    users = V.users(spark, "/root/testdata/sf0.001")
    assert rows(J.apply_login_updates(spark, users, out)) == rows(users)


def test_unreadable_batch_output_is_an_error(spark, scratch):
    out = os.path.join(scratch, "out")
    spark.createDataFrame([("1", None)], J.TOUCHES).write.parquet(J._batch_dir(out, 0))
    part = next(f for f in os.listdir(J._batch_dir(out, 0)) if f.startswith("part-"))
    path = os.path.join(J._batch_dir(out, 0), part)
    crc = os.path.join(J._batch_dir(out, 0), f".{part}.crc")
    open(path, "wb").write(b"torn")
    os.path.exists(crc) and os.remove(crc)
    with pytest.raises(Exception):
        J.read_batches(spark, out, J.TOUCHES).collect()


def test_streams_leave_the_session_settings_alone(spark, scratch):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    folder = split_events(spark, scratch, parts=1)
    J.run_session_stream(event_stream(spark, folder), os.path.join(scratch, "o"), os.path.join(scratch, "c"))
    assert spark.conf.get(key, None) == before


def test_torn_commit_keeps_every_version(spark, scratch):
    root = os.path.join(scratch, "users")
    df = V.users(spark, "/root/testdata/sf0.001")
    SN.write_snapshot(df, root)
    SN.write_snapshot(df.where("role = 'ADMIN'"), root)
    # a writer died between the data and its marker, another while writing the marker
    df.limit(3).write.parquet(SN.version_path(root, 2))
    os.makedirs(os.path.join(root, SN.COMMITS, "00000003-torn"))
    assert SN.current_version(spark, root) == 1
    assert SN.write_snapshot(df.where("role = 'USER'"), root) == 3
    for version, want in ((0, df), (1, df.where("role = 'ADMIN'")), (2, None), (3, df.where("role = 'USER'"))):
        stored = spark.read.parquet(SN.version_path(root, version))
        assert stored.count() == 3 if want is None else rows(stored) == rows(want)
    assert rows(SN.read_snapshot(spark, root, USERS)) == rows(df.where("role = 'USER'"))


def test_registered_lookups_push_the_id(spark):
    for name in ("profile_by_id", "visible_rows_user"):
        assert "EqualTo(id," in plan_text(C.QUERIES[name](spark, "/root/testdata/sf0.001")), name


def test_visible_rows_are_a_subset(spark):
    from rollcall.operators import access as A

    users = V.users(spark, "/root/testdata/sf0.001")
    for actor in ("2", "11", "50", "no-such-user"):
        seen = A.visible_to(users, actor)
        assert seen.exceptAll(users).count() == 0


def test_snapshot_versions(spark, scratch):
    root = os.path.join(scratch, "users")
    df = spark.createDataFrame([("1", "a", "USER", None, None)], "id string, username string, role string, created_at timestamp_ntz, last_login timestamp_ntz")
    assert SN.write_snapshot(df, root) == 0
    assert SN.write_snapshot(df.withColumn("role", F.lit("ADMIN")), root) == 1
    cur = SN.read_snapshot(spark, root, USERS)
    assert cur.first()["role"] == "ADMIN" and "avatar_url" in cur.columns  # O-05 additive column


def test_table_readers_fill_the_additive_column(spark, scratch):
    from rollcall.sources.tables import read_auth_users, read_users

    old_users = os.path.join(scratch, "users_v0")
    V.users(spark, "/root/testdata/sf0.001").drop("avatar_url").write.parquet(old_users)
    users = read_users(spark, old_users)
    assert users.columns[-1] == "avatar_url" and users.where("avatar_url IS NOT NULL").count() == 0
    auth_path = os.path.join(scratch, "auth")
    V.auth_users(spark, "/root/testdata/sf0.001").write.parquet(auth_path)
    auth = read_auth_users(spark, auth_path)
    assert auth.columns == ["id", "email", "raw_user_meta_data", "created_at", "last_sign_in_at"]
    assert auth.count() == 150


def test_clustered_snapshot_lookup_is_pushed(spark, scratch):
    root = os.path.join(scratch, "users")
    users = V.users(spark, "/root/testdata/sf0.01")
    SN.write_snapshot(users, root, cluster_by="id")
    snap = SN.read_snapshot(spark, root, USERS)
    assert rows(snap) == rows(users)
    lookup = S.by_id(snap, "7")
    assert "PushedFilters: [IsNotNull(id), EqualTo(id,7)]" in plan_text(lookup)
    assert lookup.count() == 1


def plan_text(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_search_plan_pushes_filters_and_prunes(spark):
    users = spark.read.parquet(f"{SF}/orders.parquet").select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.col("o_orderpriority").alias("username"),
        F.col("o_orderstatus").alias("role"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_orderdate").alias("last_login"),
    )
    req = S.SearchRequest(joined_after="1995-01-01", joined_before="1995-12-31")
    text = plan_text(S.search_unsorted(users, req))
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in text
    assert "LessThanOrEqual(o_orderdate" in text
    assert "o_totalprice" not in text  # unread columns are pruned
    assert "PythonUDF" not in text and "BatchEvalPython" not in text


def test_no_python_udfs_in_registered_plans(spark):
    for name in ("search_combined", "derive_username", "signup_check", "permission_flags", "session_state"):
        text = plan_text(C.QUERIES[name](spark, "/root/testdata/sf0.001"))
        assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text, name


def test_entry_contract(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.columns == ["id", "username", "role", "created_at", "last_login", "pos"]
    df.collect()
    assert set(E.oracle_sql()) <= set(E.queries())


def test_session_state_rules(spark):
    import datetime as dt

    from rollcall.sources.schemas import USERS as U

    D = dt.datetime
    users = spark.createDataFrame(
        [("a", "ann", "ADMIN", None, None, None), ("u", "uma", "USER", None, None, None), ("o", "oli", "USER", None, None, None)], U
    )
    events = spark.createDataFrame(
        [
            (1, "a", D(2024, 1, 1), "SIGNED_IN"),
            (2, "u", D(2024, 1, 1), "SIGNED_IN"),
            (3, "u", D(2024, 1, 2), "SIGNED_OUT"),
            (4, "u", D(2024, 1, 3), "OTHER"),  # ignored
            (5, "ghost", D(2024, 1, 1), "SIGNED_IN"),  # no profile
            (6, "o", D(2024, 1, 5), "SIGNED_OUT"),
            (7, "o", D(2024, 1, 5), "SIGNED_IN"),  # same time: the later event id wins
        ],
        "event_id long, id string, ts timestamp_ntz, event string",
    )
    got = {r["id"]: r for r in SS.session_state(SS.latest_events(events), users).collect()}
    assert got["a"]["signed_in"] and got["a"]["landing"] == "/admin-dashboard" and got["a"]["username"] == "ann"
    assert not got["u"]["signed_in"] and got["u"]["last_event"] == "SIGNED_OUT" and got["u"]["auth_error"] is None
    assert got["u"]["username"] is None
    assert not got["ghost"]["signed_in"] and got["ghost"]["auth_error"] == SS.PROFILE_ERROR
    assert got["o"]["signed_in"] and got["o"]["landing"] == "/dashboard"


def test_session_stream_with_a_continuous_trigger(spark, scratch):
    folder = split_events(spark, scratch, parts=2)
    out, ckpt = os.path.join(scratch, "out"), os.path.join(scratch, "ckpt")
    query = J.run_session_stream(event_stream(spark, folder), out, ckpt, trigger={"processingTime": "1 second"})
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    users = V.users(spark, SF)
    batch = SS.session_state(SS.latest_events(V.auth_events(spark, SF)), users)
    assert rows(SS.session_state(J.read_session_latest(spark, out), users)) == rows(batch)


def test_small_batch_probes_the_directory_without_shuffling_it(spark):
    import re

    from rollcall.operators.identity import insert_ignore

    directory = spark.read.parquet(f"{SF}/customer.parquet").selectExpr("cast(c_custkey as string) as id")
    batch = spark.createDataFrame([(str(i * 100), f"n{i}") for i in range(5)] + [("new-1", "x")], "id string, name string")
    out = insert_ignore(batch, directory)
    assert [r["id"] for r in out.collect()] == ["new-1"]
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    lines = [l.strip() for l in plan.split("\n")]
    semi = next(i for i, l in enumerate(lines) if re.search(r"BroadcastHashJoin .*LeftSemi, BuildRight", l))
    # between the semi join and the directory's scan there is no exchange
    scan = next(i for i in range(semi, len(lines)) if "FileScan parquet" in lines[i])
    assert not any("Exchange" in l for l in lines[semi:scan]), lines[semi:scan]
