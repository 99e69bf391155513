"""Session state (O-37), the same expressions in batch and in streaming.

The latest SIGNED_IN / SIGNED_OUT event per user decides: signed in with the
profile attached (a missing profile leaves no user and the message "Failed
to load user profile."), or signed out.  Other events are ignored.  The
latest event is a ``max_by`` over (ts, event_id): associative, so partial
aggregation and streaming state (one row per user) both work, and any
number of partial results merge into the same answer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.operators.access import landing_page

# Fixed event names and the message shown when a profile cannot be loaded.
SIGNED_IN = "SIGNED_IN"
SIGNED_OUT = "SIGNED_OUT"
PROFILE_ERROR = "Failed to load user profile."


def _order():
    return F.struct(F.col("ts"), F.col("event_id"))


def latest_events(events: DataFrame) -> DataFrame:
    """(id, event, ts, event_id) of each user's latest session event."""
    picked = (
        events.where(F.col("event").isin(SIGNED_IN, SIGNED_OUT) & F.col("id").isNotNull())
        .groupBy("id")
        .agg(F.max_by(F.struct("event", "ts", "event_id"), _order()).alias("_last"))
    )
    return picked.select("id", "_last.event", "_last.ts", "_last.event_id")


def merge_latest(partials: DataFrame) -> DataFrame:
    """Merge several partial ``latest_events`` results (e.g. stream batches)."""
    return latest_events(partials.select("id", "event", "ts", "event_id"))


def tagged(events: DataFrame, profiles: DataFrame) -> DataFrame:
    """Session events and profile rows in one table: who, the event with its order, the profile with its order."""
    session = F.struct("event", "ts", "event_id")
    wanted = F.col("event").isin(SIGNED_IN, SIGNED_OUT) & F.col("id").isNotNull()
    said = events.where(wanted).select("id", session.alias("session"))
    row = F.struct("username", "role")
    known = profiles.where("id is not null").select("id", F.struct("created_at", row.alias("row")).alias("profile"))
    return said.unionByName(known, allowMissingColumns=True)


def latest_of_both(both: DataFrame) -> DataFrame:
    """(id, session, profile): the latest event and the latest profile row of each user; associative like ``latest_events``."""
    order = F.struct("session.ts", "session.event_id")
    return both.groupBy("id").agg(
        F.max_by("session", F.when(F.col("session").isNotNull(), order)).alias("session"),
        F.max("profile").alias("profile"),
    )


def attached(latest: DataFrame) -> DataFrame:
    """``session_state`` from ``latest_of_both``: one row per user with a session event."""
    events = latest.where("session is not null").select("id", "session.*")
    profiles = latest.where("profile is not null").select("id", "profile.row.username", "profile.row.role")
    return session_state(events, profiles)


def session_state(latest: DataFrame, users: DataFrame) -> DataFrame:
    """One row per user with a session event: signed_in, profile fields, error, landing page."""
    profiles = users.select("id", "username", "role")
    out = latest.join(profiles, "id", "left")
    signed_in = (F.col("event") == SIGNED_IN) & F.col("role").isNotNull()
    return out.select(
        "id",
        F.col("event").alias("last_event"),
        F.col("ts").alias("last_event_at"),
        signed_in.alias("signed_in"),
        F.when(signed_in, F.col("username")).alias("username"),
        F.when(signed_in, F.col("role")).alias("role"),
        F.when((F.col("event") == SIGNED_IN) & F.col("role").isNull(), F.lit(PROFILE_ERROR)).alias("auth_error"),
        F.when(signed_in, landing_page("role")).alias("landing"),
    )
