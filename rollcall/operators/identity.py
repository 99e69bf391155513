"""Identity derivation, profile creation and back-fills (O-03, O-18 .. O-28).

All operators take and return DataFrames; ``as_of`` replaces the database's
``NOW()`` so that reruns agree.  Joins are on the unique ``id`` (or on the
unique username / e-mail), so none of them can concentrate a hot key; the
only grouping on a possibly hot key (the base name in O-27) is a partial
``min_by`` aggregate.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollcall.functions.display import role_rank
from rollcall.functions.identity import add_base_username, avatar_from_meta, seed_email, v1_username
from rollcall.functions.text import hex_suffix
from rollcall.operators.joins import anti_join_small, first_keys, lookup_join, nulls_last_key
from rollcall.session import durable
from rollcall.sources.schemas import DEFAULT_ROLE, USER_COLUMNS, USERNAME_MAX

# Fixed value of the reference's collision loop.
MAX_ATTEMPTS = 10
DEFAULT_AS_OF = dt.datetime(2025, 1, 1)


def _ts(as_of: dt.datetime | Column) -> Column:
    if isinstance(as_of, Column):
        return as_of
    return F.lit(as_of.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


def profile_frame(
    id_col: Column, username: Column, created_at: Column, avatar: Column | None = None, role: Column | None = None
) -> list[Column]:
    """Columns of a profile row in the declared order."""
    return [
        id_col.alias("id"),
        username.alias("username"),
        (role if role is not None else F.lit(DEFAULT_ROLE)).alias("role"),
        created_at.alias("created_at"),
        F.lit(None).cast("timestamp_ntz").alias("last_login"),
        (avatar if avatar is not None else F.lit(None).cast("string")).alias("avatar_url"),
    ]


def derive_usernames(auth: DataFrame) -> DataFrame:
    """O-25 for every identity: (id, base_username)."""
    return add_base_username(auth.select("id", "email", "raw_user_meta_data")).select("id", "base_username")


def first_per_id(auth: DataFrame) -> DataFrame:
    """O-21 within a batch: one identity row per id, the earliest created (ties: e-mail, metadata)."""
    rest = [c for c in auth.columns if c != "id"]
    order = nulls_last_key(["created_at", "email", "raw_user_meta_data"])
    picked = auth.groupBy("id").agg(F.min_by(F.struct(*rest), order).alias("_row"))
    # keep the grouping column itself so the hash partitioning on id carries
    # into the following join on id (no second shuffle)
    return picked.select("id", *[F.col(f"_row.{c}").alias(c) for c in rest])


@dataclass
class Directory:
    """What new profiles are checked against: an ``ids`` (id) and a ``names`` (username) table, or an index of either.

    An index is a function from the asked keys (a table of one column) to the held ones
    that may be among them, with the column named as in the table.
    """

    ids: DataFrame | Callable[[DataFrame], DataFrame]
    names: DataFrame | Callable[[DataFrame], DataFrame]


def as_directory(users: DataFrame | Directory) -> Directory:
    if isinstance(users, Directory):
        return users
    return Directory(users.select("id"), users.select("username").where(F.col("username").isNotNull()))


def insert_ignore(new_rows: DataFrame, target) -> DataFrame:
    """O-21 ``ON CONFLICT (id) DO NOTHING``: drop rows whose id the target already has.

    A batch of new rows is usually small next to the directory, so it is
    staged and the directory is probed for its ids.
    """
    return anti_join_small(durable(new_rows, "batch"), target, "id")


@dataclass
class Resolution:
    accepted: DataFrame  # id, username, attempt (0 = the base itself)
    rejected: DataFrame  # id, base, last_candidate


def resolve_collisions(
    claims: DataFrame, taken, rounds: int = MAX_ATTEMPTS, stage_input: bool = True
) -> Resolution:
    """O-27 in set form.

    ``claims`` (id, base, created_at): new identities and their base names,
    one row per id (``build_profiles`` ensures it); ``taken`` (username):
    names already in the directory, or an index of them (``Directory``).  Claimants are
    served in (created_at, id) order within each name, like rows arriving one
    by one.  Round 0: the first claimant of a free base keeps it.  Round k
    (1..rounds): the rest try ``base_<4 hex of md5(id:k)>``; a candidate is
    granted if nobody holds it yet and the claimant is first among those
    asking for it in that round.  Whoever is left after ``rounds`` rounds is
    returned in ``rejected`` (never as a duplicate name).

    The directory is probed twice, whatever the number of rounds: for the
    distinct bases, and for all tries of everyone still waiting.  The rounds
    are then settled on the free tries alone (at most ``rounds`` rows for a
    claimant), one staged table per turn (shared folder: lineage cut, executor
    loss survivable).
    """
    claims = claims.select("id", "base", "created_at")
    if stage_input:
        claims = durable(claims, "claims")

    # round 0: the first claimant of each free base keeps it.  Rank first
    # (partial aggregate: one row per base), then check only those distinct
    # bases against the directory, so a base claimed by millions never
    # meets the directory as millions of rows in one task.
    firsts = claims.groupBy("base").agg(F.min_by("id", nulls_last_key(["created_at", "id"])).alias("id"))
    granted = durable(
        anti_join_small(durable(firsts, "firsts"), taken, "base", "username").select(
            "id", F.col("base").alias("cand"), F.lit(0).cast("long").alias("attempt")
        ),
        "round0",
    )
    rest = claims.join(granted.select("id"), "id", "left_anti")
    tries = free_tries(rest, taken, rounds)
    served = _serve(tries.join(granted.select("cand"), "cand", "left_anti"))
    accepted = granted.unionByName(served).select("id", F.col("cand").alias("username"), "attempt")
    rejected = rest.join(served.select("id"), "id", "left_anti").select(
        "id",
        "base",
        F.concat(F.col("base"), F.lit("_"), hex_suffix(F.col("id"), rounds)).alias("last_candidate"),
    )
    return Resolution(accepted, rejected)


def free_tries(waiting: DataFrame, taken, rounds: int) -> DataFrame:
    """(id, created_at, attempt, cand): all suffixed tries of ``waiting`` (id, base, created_at) that ``taken`` (username) lacks."""
    names = [F.concat(F.col("base"), F.lit("_"), hex_suffix(F.col("id"), k)) for k in range(1, rounds + 1)]
    tries = waiting.select("id", "created_at", F.posexplode(F.array(*names)).alias("at", "cand"))
    tries = tries.select("id", "created_at", (F.col("at") + 1).cast("long").alias("attempt"), "cand")
    return anti_join_small(durable(tries, "tries"), taken, "cand", "username")


def _serve(tries: DataFrame) -> DataFrame:
    """(id, cand, attempt) of the claimants that get one of their free ``tries`` (``free_tries``).

    A name goes to the try with the smallest (attempt, created_at, id), if its
    claimant comes to ask for it; so whoever comes first for the first name on
    its own list has it, whatever happens to the others.  All of those are
    served at once, then their names are struck off the lists of the rest.  Each turn serves at
    least all winners of the lowest attempt left, so there are as many turns as
    attempts at most, and two or three as a rule.
    """
    order = nulls_last_key(["attempt", "created_at", "id"])
    served = None
    while True:
        comes_first = order == F.min(order).over(Window.partitionBy("cand"))
        listed = tries.withColumn("mine", comes_first).groupBy("id", "created_at")
        listed = listed.agg(F.array_sort(F.collect_list(F.struct("attempt", "cand", "mine"))).alias("list"))
        listed = durable(listed, "turn")
        got = listed.where("list[0].mine").select("id", F.col("list")[0]["cand"].alias("cand"), F.col("list")[0]["attempt"].alias("attempt"))
        served = got if served is None else served.unionByName(got)
        waiting = listed.where("not list[0].mine")
        if waiting.isEmpty():
            return served
        tries = waiting.select("id", "created_at", F.explode("list").alias("t")).select("id", "created_at", "t.attempt", "t.cand")
        tries = tries.join(got.select("cand"), "cand", "left_anti")


# Why a profile could not be stored
NAME_TAKEN = "username_unique"
NAME_MISSING = "username_not_null"
NAME_LONG = "username_length"


@dataclass
class BuildResult:
    profiles: DataFrame  # new profile rows (USERS columns)
    rejected: DataFrame  # id, username (the last one tried), reason


def build_profiles(
    auth_new: DataFrame, users: DataFrame | Directory, variant: str = "v2", as_of: dt.datetime | Column | None = None
) -> BuildResult:
    """O-26: profiles for newly inserted identities, under either sign-up rule.

    v2 (documented): cascade (O-25), collision resolution (O-27), avatar from
    the metadata, default role, ``created_at`` = as_of.  v1 (the later fix
    file): ``coalesce(meta.username, e-mail local part)`` as is, default
    role, ``created_at`` = as_of.  Both ignore ids already present (O-21).
    Rows that the table's constraints refuse are in ``rejected`` with the
    constraint's name (v2 names longer than the column are kept and reported
    by O-31, T-7).
    """
    as_of = _ts(DEFAULT_AS_OF if as_of is None else as_of)
    held = as_directory(users)
    fresh = insert_ignore(first_per_id(auth_new), held.ids)
    if variant == "v1":
        named = fresh.select("id", "created_at", v1_username().alias("username"))
        return _as_is(named, held.names, lambda: profile_frame(F.col("id"), F.col("username"), as_of))
    if variant != "v2":
        raise ValueError(f"unknown variant {variant!r}")
    fresh = durable(add_base_username(fresh, "base", avatar="avatar").select("id", "created_at", "base", "avatar"), "fresh")
    res = resolve_collisions(fresh, held.names, stage_input=False)
    rows = res.accepted.join(fresh.select("id", "avatar"), "id").select(
        *profile_frame(F.col("id"), F.col("username"), as_of, F.col("avatar"))
    )
    rejected = res.rejected.select("id", F.col("last_candidate").alias("username"), F.lit(NAME_TAKEN).alias("reason"))
    return BuildResult(rows, rejected)


def _as_is(named: DataFrame, taken, columns) -> BuildResult:
    """Profiles for (id, created_at, username) rows under the table's constraints on names.

    The first claimant (created_at, id) of a free name gets it, as if rows
    were inserted one by one; the others are rejected with the reason.
    """
    bad = F.when(F.col("username").isNull(), NAME_MISSING).when(F.char_length("username") > USERNAME_MAX, NAME_LONG)
    named = durable(named.withColumn("reason", bad), "named")
    firsts = first_keys(named.where("reason is null"), ["username"], ["created_at"], "id")
    firsts = durable(firsts.join(named.select("id", "username"), "id"), "firsts")
    granted = anti_join_small(firsts, taken, "username")
    granted = durable(granted.select("id", F.lit(True).alias("_granted")), "granted")
    out = named.join(granted, "id", "left")
    profiles = out.where("_granted").select(*columns())
    refused = out.where("_granted is null").select("id", "username", F.coalesce("reason", F.lit(NAME_TAKEN)).alias("reason"))
    return BuildResult(profiles, refused)


def backfill_missing_profiles(
    auth: DataFrame, users: DataFrame, as_of: dt.datetime | Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """O-18: add a v1 profile for each identity without one; returns (the new snapshot, the rejected rows)."""
    as_of = _ts(DEFAULT_AS_OF if as_of is None else as_of)
    missing = auth.join(users.select("id"), "id", "left_anti").select("id", "created_at", v1_username().alias("username"))
    joined = F.coalesce(F.col("created_at"), as_of)
    built = _as_is(missing, as_directory(users).names, lambda: profile_frame(F.col("id"), F.col("username"), joined))
    return users.select(*USER_COLUMNS).unionByName(built.profiles), built.rejected


def backfill_avatar(users: DataFrame, auth: DataFrame) -> DataFrame:
    """O-19: fill a missing avatar from the identity's metadata."""
    avatars = auth.select("id", avatar_from_meta().alias("_meta_avatar"))
    out = users.join(avatars, "id", "left")
    return out.select(
        *[
            F.coalesce(F.col("avatar_url"), F.col("_meta_avatar")).alias("avatar_url") if c == "avatar_url" else F.col(c)
            for c in USER_COLUMNS
        ]
    )


def login_touch(users: DataFrame, events: DataFrame) -> DataFrame:
    """O-28: each sign-in moves ``last_login`` to the event time (never back).

    The reference writes ``NOW()`` at each sign-in; using the event's own time
    with ``max`` makes replays and late events harmless.
    """
    touches = events.where(F.col("event") == "SIGNED_IN").groupBy("id").agg(F.max("ts").alias("_touch"))
    return apply_touches(users, touches)


def apply_touches(users: DataFrame, touches: DataFrame) -> DataFrame:
    out = users.join(touches, "id", "left")
    return out.select(
        *[
            F.greatest(F.col("last_login"), F.col("_touch")).alias("last_login") if c == "last_login" else F.col(c)
            for c in USER_COLUMNS
        ]
    )


def cascade_delete(users: DataFrame, auth: DataFrame) -> DataFrame:
    """O-23: profiles whose identity is gone vanish with it."""
    return users.join(auth.select("id"), "id", "left_semi")


def existence(users: DataFrame, names: DataFrame, col: str = "username") -> DataFrame:
    """O-20: for each row of ``names``, whether a profile already holds ``names[col]``.

    Usernames are unique in the directory, so this is a lookup; many rows may
    ask about the same (popular) name, which ``lookup_join`` serves without
    sending them all to one task.
    """
    held = users.select("username").where(F.col("username").isNotNull())
    out = lookup_join(names, [col], held, "username")
    return out.withColumn("taken", F.col(f"{col}_row").isNotNull()).drop(f"{col}_row")


@dataclass
class SeedResult:
    auth: DataFrame
    users: DataFrame
    report: DataFrame  # email, id, status ('created' | 'existing' | 'rejected'), role


def seed_upsert(seeds: DataFrame, auth: DataFrame, users: DataFrame, as_of: dt.datetime | Column | None = None) -> SeedResult:
    """O-03 / O-22: idempotent bulk seed of (username, role).

    E-mail = lower(username)@app.local.  An identity that already has the
    e-mail (compared case-insensitively, as the auth service does) is kept;
    otherwise one is created, with id = md5(e-mail) and ``{"username": ...}``
    metadata, and its profile is built by the v2 rule.  Roles other than
    USER are then patched onto the profile.  A repeated e-mail keeps the
    highest role.  A seed whose profile is refused (every name it tries is
    taken) is reported as ``rejected`` and leaves no identity either, as the
    trigger's failure undoes the whole insert.
    """
    as_of = _ts(DEFAULT_AS_OF if as_of is None else as_of)
    batch = (
        seeds.select("username", "role", seed_email().alias("email"))
        .groupBy("email")
        .agg(F.min("username").alias("username"), F.max_by("role", role_rank("role")).alias("role"))
    )
    # only identities whose e-mail is in the batch: a small batch then never
    # shuffles the identity table (the semi join can broadcast the batch)
    known = (
        auth.select(F.lower(F.col("email")).alias("email"), F.col("id"))
        .where(F.col("email").isNotNull())
        .join(batch.select("email"), "email", "left_semi")
        .groupBy("email")
        .agg(F.min("id").alias("id"))
    )
    matched = batch.join(known, "email", "inner")
    created = batch.join(known, "email", "left_anti").select(
        F.md5(F.col("email")).alias("id"),
        F.col("email"),
        F.to_json(F.struct(F.col("username"))).alias("raw_user_meta_data"),
        as_of.alias("created_at"),
        F.lit(None).cast("timestamp_ntz").alias("last_sign_in_at"),
        F.col("role"),
    )
    created = durable(created, "seeds")
    built = build_profiles(created.drop("role"), users, "v2", as_of)
    refused = durable(built.rejected.select("id"), "refused")
    status = F.when(F.col("_refused"), F.lit("rejected")).otherwise(F.lit("created")).alias("status")
    outcome = created.join(refused.withColumn("_refused", F.lit(True)), "id", "left")
    created = created.join(refused, "id", "left_anti")
    new_auth = auth.unionByName(created.drop("role"))
    patches = (
        matched.select("id", "role")
        .unionByName(created.select("id", "role"))
        .where(F.col("role") != DEFAULT_ROLE)
        .withColumnRenamed("role", "_patch")
    )
    snapshot = users.select(*USER_COLUMNS).unionByName(built.profiles).join(patches, "id", "left")
    snapshot = snapshot.select(
        *[F.coalesce(F.col("_patch"), F.col("role")).alias("role") if c == "role" else F.col(c) for c in USER_COLUMNS]
    )
    report = matched.select("email", "id", F.lit("existing").alias("status"), "role").unionByName(
        outcome.select("email", "id", status, "role")
    )
    return SeedResult(new_auth, snapshot, report)
