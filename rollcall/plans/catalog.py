"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Every query reads the given tables through the derived views, so its work
grows with the data.  Sorted results carry ``pos`` (the row's place in the
full order) so that an order-insensitive comparison still checks the sort.
"""

from __future__ import annotations

import datetime as dt
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.functions.identity import add_base_username, signup_email
from rollcall.operators import access as A
from rollcall.operators import constraints as N
from rollcall.operators import identity as I
from rollcall.operators import quality as Q
from rollcall.operators import search as S
from rollcall.operators import trigrams as G
from rollcall.plans.positions import with_position
from rollcall.session import durable, scratch_path
from rollcall.sources import bucketed as B
from rollcall.sources import delta as D
from rollcall.sources import snapshots as SN
from rollcall.sources import tables as T
from rollcall.sources import views as V
from rollcall.sources.schemas import AUTH_EVENTS, AUTH_USERS, USERS
from rollcall.streaming import jobs as J
from rollcall.streaming import session_state as SS

AS_OF = dt.datetime(2025, 1, 1, 0, 0, 0)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn

    return deco


def as_of_col() -> F.Column:
    return F.lit(AS_OF.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")


# ---------------------------------------------------------------- search

SEARCHES = {
    "search_default": S.SearchRequest(),
    "search_q": S.SearchRequest(q="team"),
    "search_role": S.SearchRequest(role="ADMIN"),
    "search_joined_range": S.SearchRequest(joined_after="1993-01-01", joined_before="1995-06-30"),
    "search_combined": S.SearchRequest(
        q="team", role="USER", joined_after="1992-01-01", joined_before="1996-12-31", sort_by="last_login"
    ),
    "search_fallback_sort": S.SearchRequest(sort_by="lastLogin", sort_dir="asc"),
    "search_mapped_sort": S.SearchRequest(sort_by="lastLogin", sort_aliases="mapped"),
    "search_wildcard": S.SearchRequest(q="r_0"),
    "search_literal": S.SearchRequest(q="r_0", literal=True),
    "sort_role_enum": S.SearchRequest(sort_by="role", sort_dir="asc"),
    "sort_last_login_nulls": S.SearchRequest(sort_by="last_login", sort_dir="asc"),
    "search_from_ui": S.SearchRequest.from_ui(q="  team ", role="USER", joined_after="", sort_by="username", sort_dir="asc"),
}

# Neutral seeds of the O-03 scenario; a user passes their own
SEEDS = (("Ada", "USER"), ("Noor", "ADMIN"), ("Kim", "USER"), ("Root", "SUPER_ADMIN"))


def table_root(spark, name):
    return scratch_path(spark, "tables", f"{name}-{uuid.uuid4().hex}")


def stored_users(spark, df, cluster_by=None, bloom=()):
    """A derived directory written once through the sink (O-04) and read back as stored table (O-01)."""
    root = table_root(spark, "users")
    SN.write_snapshot(df, root, cluster_by, bloom)
    return T.read_users(spark, SN.current_path(spark, root))


def stored_identities(spark, df):
    """Derived identities written once and read back as stored table (O-02)."""
    root = table_root(spark, "auth")
    SN.write_snapshot(df, root)
    return T.read_auth_users(spark, SN.current_path(spark, root))


def run_search(spark: SparkSession, sf_dir: str, req: S.SearchRequest) -> DataFrame:
    users = V.users(spark, sf_dir)
    key, ascending = S.sort_key(req)
    return with_position(S.search_unsorted(users, req), S.order_columns(key, ascending))


def _search_query(req: S.SearchRequest):
    return lambda spark, sf_dir: run_search(spark, sf_dir, req)


for _name, _req in SEARCHES.items():
    QUERIES[_name] = _search_query(_req)


# requests that a trigram index serves: a rare run, and runs between wildcards
INDEXED = {
    "search_indexed": S.SearchRequest(q="00123"),
    "search_indexed_wildcard": S.SearchRequest(q="ER#0%12_", sort_by="username", sort_dir="asc"),
}


def _indexed_query(req: S.SearchRequest):
    def run(spark, sf_dir):
        users = stored_users(spark, V.users(spark, sf_dir), cluster_by="id")
        root = table_root(spark, "trigrams")
        G.write_index(users, root)
        key, ascending = S.sort_key(req)
        return with_position(G.search_indexed(users, G.read_index(spark, root), req), S.order_columns(key, ascending))

    return run


for _name, _req in INDEXED.items():
    QUERIES[_name] = _indexed_query(_req)


@register("scan_users")
def q_scan_users(spark, sf_dir):
    """O-01 on a snapshot written before the avatar column existed (O-05)."""
    root = table_root(spark, "users")
    SN.write_snapshot(V.users(spark, sf_dir).drop("avatar_url"), root)
    return T.read_users(spark, SN.current_path(spark, root))


@register("scan_auth_users")
def q_scan_auth_users(spark, sf_dir):
    return stored_identities(spark, V.auth_users(spark, sf_dir))


@register("list_directory")
def q_list_directory(spark, sf_dir):
    # the operator's order, and each row's place in it
    listed = S.list_directory(V.users(spark, sf_dir))
    return with_position(listed, S.order_columns("created_at", True))


@register("directory_count")
def q_directory_count(spark, sf_dir):
    return S.directory_count(V.users(spark, sf_dir, ("id",)))


def _day_range(users):
    """The joined-range search over a stored directory."""
    return S.search_unsorted(users, SEARCHES["search_joined_range"])


@register("clustered_range")
def q_clustered_range(spark, sf_dir):
    """O-10 over a snapshot clustered by creation time and id."""
    return _day_range(stored_users(spark, V.users(spark, sf_dir), cluster_by=("created_at", "id")))


@register("clustered_profile")
def q_clustered_profile(spark, sf_dir):
    """O-13 over the same layout."""
    return S.by_id(stored_users(spark, V.users(spark, sf_dir), cluster_by=("created_at", "id")), "7")


@register("profile_by_bloom")
def q_profile_by_bloom(spark, sf_dir):
    """O-13 over a snapshot that is not clustered, with Bloom filters on its keys."""
    return S.by_id(stored_users(spark, V.users(spark, sf_dir), bloom=("id", "username")), "7")


@register("profile_by_id")
def q_profile_by_id(spark, sf_dir):
    return S.by_id(stored_users(spark, V.users(spark, sf_dir), cluster_by="id"), "7")


@register("profile_display")
def q_profile_display(spark, sf_dir):
    return S.profile_display(V.users(spark, sf_dir))


# -------------------------------------------------------------- identity


def users_existing(spark, sf_dir):
    """Directory snapshot missing every 7th profile (the back-fill scenario)."""
    return V.users(spark, sf_dir).where(F.col("id").cast("long") % 7 != 0)


@register("derive_username")
def q_derive_username(spark, sf_dir):
    return I.derive_usernames(V.auth_users(spark, sf_dir))


def _profiles_v1(spark, sf_dir):
    crowd = stored_users(spark, V.crowded_directory(spark, sf_dir))
    return I.build_profiles(V.shared_identities(spark, sf_dir), crowd, "v1", as_of_col())


def _profiles_v2(spark, sf_dir):
    crowd = stored_users(spark, V.crowded_directory(spark, sf_dir))
    return I.build_profiles(V.auth_users(spark, sf_dir), crowd, "v2", as_of_col())


@register("profiles_v1")
def q_profiles_v1(spark, sf_dir):
    return _profiles_v1(spark, sf_dir).profiles


@register("profiles_v2")
def q_profiles_v2(spark, sf_dir):
    return _profiles_v2(spark, sf_dir).profiles


@register("profiles_rejected")
def q_profiles_rejected(spark, sf_dir):
    """Every identity without a profile, under either rule, and why."""
    v1 = _profiles_v1(spark, sf_dir).rejected.withColumn("variant", F.lit("v1"))
    return v1.unionByName(_profiles_v2(spark, sf_dir).rejected.withColumn("variant", F.lit("v2")))


@register("resolve_collisions")
def q_resolve_collisions(spark, sf_dir):
    crowd = stored_users(spark, V.crowded_directory(spark, sf_dir))
    claims = durable(add_base_username(V.auth_users(spark, sf_dir), "base").select("id", "base", "created_at"), "claims")
    res = I.resolve_collisions(claims, crowd.select("username"), stage_input=False)
    ok = res.accepted.join(claims.select("id", "base"), "id").select(
        "id", "base", "username", "attempt", F.lit("ok").alias("status")
    )
    bad = res.rejected.select(
        "id",
        "base",
        F.lit(None).cast("string").alias("username"),
        F.lit(None).cast("long").alias("attempt"),
        F.lit("rejected").alias("status"),
    )
    return ok.unionByName(bad)


def _backfilled(spark, sf_dir):
    existing = stored_users(spark, users_existing(spark, sf_dir))
    return I.backfill_missing_profiles(V.auth_users(spark, sf_dir), existing, as_of_col())


@register("backfill_missing_profiles")
def q_backfill_missing_profiles(spark, sf_dir):
    return _backfilled(spark, sf_dir)[0]


@register("backfill_rejected")
def q_backfill_rejected(spark, sf_dir):
    crowd = stored_users(spark, V.crowded_directory(spark, sf_dir))
    return I.backfill_missing_profiles(V.shared_identities(spark, sf_dir), crowd, as_of_col())[1]


@register("backfill_avatar")
def q_backfill_avatar(spark, sf_dir):
    return I.backfill_avatar(V.users(spark, sf_dir), V.auth_users(spark, sf_dir))


@register("login_touch")
def q_login_touch(spark, sf_dir):
    return I.login_touch(_backfilled(spark, sf_dir)[0], V.auth_events(spark, sf_dir))


@register("cascade_delete")
def q_cascade_delete(spark, sf_dir):
    kept = V.auth_users(spark, sf_dir).where(F.col("id").cast("long") % 11 != 0)
    return I.cascade_delete(V.users(spark, sf_dir), kept)


BUCKETS = 64


def _bucketed(spark, df, name):
    """A derived table stored in buckets of its id; 64 or as many as the session shuffles into."""
    buckets = max(BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return B.write_bucketed(df, f"{name}_{uuid.uuid4().hex}", buckets)


@register("bucketed_backfill")
def q_bucketed_backfill(spark, sf_dir):
    """O-18 on bucketed tables: the anti join reads both in place."""
    existing = _bucketed(spark, users_existing(spark, sf_dir), "users")
    identities = _bucketed(spark, V.auth_users(spark, sf_dir), "auth")
    return I.backfill_missing_profiles(identities, existing, as_of_col())[0]


@register("bucketed_cascade_delete")
def q_bucketed_cascade_delete(spark, sf_dir):
    """O-23 on bucketed tables."""
    kept = V.auth_users(spark, sf_dir).where(F.col("id").cast("long") % 11 != 0)
    return I.cascade_delete(_bucketed(spark, V.users(spark, sf_dir), "users"), _bucketed(spark, kept, "auth"))


@register("bucketed_login_touch")
def q_bucketed_login_touch(spark, sf_dir):
    """O-28 on a bucketed directory: only the sign-ins are shuffled."""
    users = _bucketed(spark, V.users(spark, sf_dir), "users")
    return I.login_touch(users, V.auth_events(spark, sf_dir))


def _seeded(spark, sf_dir):
    directory = V.users(spark, sf_dir).unionByName(V.seed_holders(spark, sf_dir))
    users = stored_users(spark, directory)
    auth = stored_identities(spark, V.auth_users(spark, sf_dir))
    return I.seed_upsert(V.seed_batch(spark, sf_dir, SEEDS), auth, users, as_of_col())


@register("seed_upsert")
def q_seed_upsert(spark, sf_dir):
    return _seeded(spark, sf_dir).users


@register("seed_report")
def q_seed_report(spark, sf_dir):
    return _seeded(spark, sf_dir).report


@register("seed_identities")
def q_seed_identities(spark, sf_dir):
    return _seeded(spark, sf_dir).auth


# ---------------------------------------------------------------- access


@register("visible_rows_user")
def q_visible_rows_user(spark, sf_dir):
    return A.visible_to(stored_users(spark, V.users(spark, sf_dir), cluster_by="id"), "2")


@register("visible_rows_admin")
def q_visible_rows_admin(spark, sf_dir):
    return A.visible_to(stored_users(spark, V.users(spark, sf_dir), cluster_by="id"), "11")


@register("visible_counts")
def q_visible_counts(spark, sf_dir):
    return A.visible_counts(V.users(spark, sf_dir, ("id", "role")))


def _roles(spark, sf_dir):
    """What role look-ups need of the directory, staged once."""
    return durable(V.users(spark, sf_dir, ("id", "role")), "roles")


@register("permission_flags")
def q_permission_flags(spark, sf_dir):
    return A.permission_flags(V.role_requests(spark, sf_dir), _roles(spark, sf_dir))


@register("change_roles")
def q_change_roles(spark, sf_dir):
    return A.role_change_outcomes(V.role_requests(spark, sf_dir), _roles(spark, sf_dir))


@register("change_roles_snapshot")
def q_change_roles_snapshot(spark, sf_dir):
    users = stored_users(spark, V.users(spark, sf_dir))
    return A.apply_role_changes(users, A.role_change_outcomes(V.role_requests(spark, sf_dir), users.select("id", "role")))


@register("change_roles_returning")
def q_change_roles_returning(spark, sf_dir):
    """O-30 with the changed row (O-06 d) of each applied request."""
    users = stored_users(spark, V.users(spark, sf_dir))
    return A.changed_rows(A.role_change_outcomes(V.role_requests(spark, sf_dir), users.select("id", "role")), users)


def _session(spark, sf_dir, actor):
    directory = A.SessionDirectory(stored_users(spark, V.users(spark, sf_dir), cluster_by="id"), f"d{uuid.uuid4().hex}")
    directory.sign_in(actor)
    return directory.read()


@register("policy_search_user")
def q_policy_search_user(spark, sf_dir):
    """O-29 as a view: a user's search sees their own row."""
    return S.search_unsorted(_session(spark, sf_dir, "7"), S.SearchRequest())


@register("policy_search_admin")
def q_policy_search_admin(spark, sf_dir):
    return S.search_unsorted(_session(spark, sf_dir, "11"), S.SearchRequest(q="team"))


@register("policy_count_user")
def q_policy_count_user(spark, sf_dir):
    return S.directory_count(_session(spark, sf_dir, "7"))


# --------------------------------------------------------------- quality


def _flatten_errors(df):
    return df.select(
        "form_id",
        "username",
        F.array_join("errors", "|").alias("errors"),
        F.size("errors").cast("long").alias("n_errors"),
        "valid",
    )


@register("signup_check")
def q_signup_check(spark, sf_dir):
    return _flatten_errors(Q.signup_check(V.signup_forms(spark, sf_dir)))


@register("login_check")
def q_login_check(spark, sf_dir):
    return _flatten_errors(Q.login_check(V.signup_forms(spark, sf_dir)))


@register("constraint_report")
def q_constraint_report(spark, sf_dir):
    directory = durable(V.broken_directory(stored_users(spark, V.users(spark, sf_dir))), "broken")
    kept = V.auth_users(spark, sf_dir).select("id").where(F.col("id").cast("long") % 11 != 0)
    return Q.constraint_report(directory, kept)


@register("constraint_report_incremental")
def q_constraint_report_incremental(spark, sf_dir):
    """O-31 by change sets: rows that break every rule arrive, then identities go."""
    users, identities = stored_users(spark, V.users(spark, sf_dir)), V.auth_users(spark, sf_dir)
    log = N.ConstraintLog(spark, table_root(spark, "constraints"))
    log.start(users, identities)
    log.apply(1, added=V.breaking_rows(users))
    log.apply(2, identities_removed=identities.where(F.col("id").cast("long") % 11 == 0))
    return log.report(2)


# --------------------------------------------------------------- session


@register("session_state")
def q_session_state(spark, sf_dir):
    return SS.session_state(SS.latest_events(V.auth_events(spark, sf_dir)), users_existing(spark, sf_dir))


# ------------------------------------------------------------- streaming


BATCHES = 4


def _stream_dirs(spark, name):
    run = scratch_path(spark, "streams", f"{name}-{uuid.uuid4().hex}")
    return os.path.join(run, "out"), os.path.join(run, "checkpoint")


def _arriving(spark, df, part, name):
    """``df`` arriving in a folder, part by part (0..BATCHES - 1); yields the folder after each arrival."""
    folder = table_root(spark, name)
    staged = durable(df.withColumn("_part", part), name, partition_by="_part")
    for i in range(BATCHES):
        staged.where(F.col("_part") == i).drop("_part").write.mode("append").parquet(folder)
        yield folder


def _event_streams(spark, sf_dir):
    events = V.auth_events(spark, sf_dir)
    for folder in _arriving(spark, events, F.pmod("event_id", F.lit(BATCHES)), "events"):
        yield J.file_stream(spark, folder, AUTH_EVENTS)


@register("session_state_stream")
def q_session_state_stream(spark, sf_dir):
    out, ckpt = _stream_dirs(spark, "session")
    for events in _event_streams(spark, sf_dir):  # a restart from the checkpoint for each arrival
        J.run_session_stream(events, out, ckpt)
    return SS.session_state(J.read_session_latest(spark, out), users_existing(spark, sf_dir))


@register("session_attached_stream")
def q_session_attached_stream(spark, sf_dir):
    """O-37 from two streams; the profiles of the users with k % 4 = 3 arrive first, those with 0 after all sign-ins."""
    out, ckpt = _stream_dirs(spark, "attached")
    events = V.auth_events(spark, sf_dir)
    folders = zip(
        _arriving(spark, events, F.pmod("event_id", F.lit(BATCHES)), "events"),
        _arriving(spark, users_existing(spark, sf_dir), F.lit(BATCHES - 1) - F.pmod(F.col("id").cast("long"), F.lit(BATCHES)), "profiles"),
    )
    for event_folder, profile_folder in folders:
        streams = J.file_stream(spark, event_folder, AUTH_EVENTS), J.file_stream(spark, profile_folder, USERS)
        J.run_attached_stream(*streams, out, ckpt)
    return J.read_attached(spark, out)


@register("login_touch_stream")
def q_login_touch_stream(spark, sf_dir):
    out, ckpt = _stream_dirs(spark, "login")
    for events in _event_streams(spark, sf_dir):
        J.run_login_stream(events, out, ckpt)
    return J.apply_login_updates(spark, _backfilled(spark, sf_dir)[0], out)


def _profile_stream(spark, sf_dir):
    """All identities in four micro-batches (by ``k % 4``) against the crowded directory; returns the output folder."""
    out, ckpt = _stream_dirs(spark, "profiles")
    crowd = stored_users(spark, V.crowded_directory(spark, sf_dir))
    part = F.pmod(F.col("id").cast("long"), F.lit(BATCHES))
    for folder in _arriving(spark, V.auth_users(spark, sf_dir), part, "identities"):
        J.run_profile_stream(J.file_stream(spark, folder, AUTH_USERS), crowd, out, out + "-rejects", ckpt, as_of=as_of_col())
    return out


@register("profiles_stream")
def q_profiles_stream(spark, sf_dir):
    return J.read_batches(spark, _profile_stream(spark, sf_dir), USERS)


@register("profiles_stream_rejected")
def q_profiles_stream_rejected(spark, sf_dir):
    """The identities to which no batch could give a profile, and why."""
    return J.read_batches(spark, _profile_stream(spark, sf_dir) + "-rejects", J.REJECTS)


# ------------------------------------------------- more reads and sinks


@register("username_taken")
def q_username_taken(spark, sf_dir):
    names = durable(I.derive_usernames(V.auth_users(spark, sf_dir)), "names")  # read several times by the lookup
    taken = durable(users_existing(spark, sf_dir).select("username"), "held")
    return I.existence(taken, names, "base_username")


@register("signup_accounts")
def q_signup_accounts(spark, sf_dir):
    checked = Q.signup_check(V.signup_forms(spark, sf_dir)).where(F.col("valid"))
    return checked.select("form_id", "username", signup_email("username").alias("email"))


@register("changed_snapshots")
def q_changed_snapshots(spark, sf_dir):
    """O-04 with O-30 and O-23: a batch of role changes, then a cascade delete, each rewriting its own buckets only."""
    users = V.users(spark, sf_dir)
    table = D.ChangedSnapshots(spark, table_root(spark, "changed"), USERS, buckets=BUCKETS)
    table.write(users)
    before = table.read()
    outcomes = A.role_change_outcomes(V.role_requests(spark, sf_dir), before.select("id", "role"))
    last = outcomes.where("status = 'applied'").groupBy("target_id").agg(F.max("request_id").alias("request_id"))
    rows = A.changed_rows(outcomes.join(last, ["target_id", "request_id"], "left_semi"), before)
    table.apply(changed=rows.drop("request_id"))
    table.apply(deleted=before.where(F.col("id").cast("long") % 11 == 0).select("id"))
    return table.read()


@register("profile_sink")
def q_profile_sink(spark, sf_dir):
    """O-04 / O-05: a snapshot written before the avatar column existed, read
    back with the column added, back-filled, written as the next version."""
    root = table_root(spark, "users")
    SN.write_snapshot(V.users(spark, sf_dir).drop("avatar_url"), root)
    before = SN.read_snapshot(spark, root, USERS)
    SN.write_snapshot(I.backfill_avatar(before, V.auth_users(spark, sf_dir)), root, cluster_by="id")
    return SN.read_snapshot(spark, root, USERS)
