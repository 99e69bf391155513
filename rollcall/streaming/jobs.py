"""Structured Streaming jobs (O-35, O-36, O-37).

Each job takes a stream (of identity rows, ``schemas.AUTH_USERS``, or of
session events, ``schemas.AUTH_EVENTS``), keeps at most one row of state per
user, and writes every micro-batch through ``foreachBatch`` into
``<out>/batch_id=<n>``, overwriting that directory only.  A replayed batch
(after a failure between write and commit) therefore rewrites the same rows,
and readers merge the batch outputs with an associative reduction (``max``,
``max_by``), so replay and late events are harmless and no watermark is
needed.  Checkpoints and outputs live in the shared folder.
"""

from __future__ import annotations

import datetime as dt
import os
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.operators.identity import Directory, apply_touches, build_profiles
from rollcall.session import staged_area
from rollcall.sources import schemas as S
from rollcall.sources.tables import missing_path
from rollcall.streaming.held_index import BUCKETS, HeldIndex
from rollcall.streaming.session_state import SIGNED_IN, attached, latest_events, latest_of_both, merge_latest, tagged

BATCH_COL = "batch_id"

LATEST = T.StructType([S.AUTH_EVENTS[c] for c in ("id", "event", "ts", "event_id")])
REJECTS = T.StructType([S.AUTH_USERS["id"], *(T.StructField(c, T.StringType(), True) for c in ("username", "reason"))])
_SESSION = T.StructType([S.AUTH_EVENTS[c] for c in ("event", "ts", "event_id")])
_PROFILE = T.StructType(
    [S.USERS["created_at"], T.StructField("row", T.StructType([S.USERS[c] for c in ("username", "role")]), True)]
)
ATTACHED = T.StructType(
    [S.AUTH_EVENTS["id"], T.StructField("session", _SESSION, True), T.StructField("profile", _PROFILE, True)]
)
TOUCHES = T.StructType([S.AUTH_EVENTS["id"], T.StructField("_touch", T.TimestampNTZType(), True)])


def _batch_dir(out: str, batch_id: int) -> str:
    return os.path.join(out, f"{BATCH_COL}={batch_id}")


# Per-user state can reach one row per account; RocksDB keeps it off the JVM
# heap and checkpoints it incrementally.  Applied only to new checkpoints.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def _state_store(spark: SparkSession):
    """The state store's settings while a query starts (it keeps a copy); the session's own afterwards."""
    before = {key: spark.conf.get(key, None) for key in STATE_CONF}
    for key, value in STATE_CONF.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def _run(stream_df: DataFrame, out: str, checkpoint: str, mode: str, write=None, trigger: dict | None = None):
    """Start a stream that writes each batch under ``out``.

    By default (``availableNow``) it processes everything present and
    returns when done; pass e.g. ``trigger={"processingTime": "1 minute"}``
    to keep it running, in which case the started query is returned.
    """
    trigger = trigger or {"availableNow": True}

    def sink(batch_df: DataFrame, batch_id: int) -> None:
        if write:
            write(batch_df, batch_id)
        else:
            batch_df.write.mode("overwrite").parquet(_batch_dir(out, batch_id))

    with _state_store(stream_df.sparkSession):
        query = (
            stream_df.writeStream.outputMode(mode)
            .foreachBatch(sink)
            .option("checkpointLocation", checkpoint)
            .trigger(**trigger)
            .start()
        )
    if trigger.get("availableNow") or trigger.get("once"):
        query.awaitTermination()
    return query


def read_batches(spark: SparkSession, out: str, schema: T.StructType, below: int | None = None) -> DataFrame:
    """All batch outputs under ``out`` (only batches < ``below`` if given); none if no batch was written.

    Any read error other than a missing folder is raised: treating it as
    "nothing written" would grant names twice and lose touches.
    """
    typed = T.StructType([*schema.fields, T.StructField(BATCH_COL, T.LongType())])
    try:
        df = spark.read.schema(typed).parquet(out)
    except AnalysisException as exc:
        if not missing_path(exc):
            raise
        df = spark.createDataFrame([], typed)
    if below is not None:
        df = df.where(F.col(BATCH_COL) < below)
    return df.select(*schema.names)


def file_stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """A parquet file stream over a directory; a single file streams as its folder filtered to that name."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if path.endswith(".parquet"):
        folder, name = os.path.split(path)
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


# ----------------------------------------------------------------- O-37


def run_session_stream(events: DataFrame, out: str, checkpoint: str, trigger: dict | None = None):
    """Latest session event per user, updated per batch (state: one row per user)."""
    return _run(latest_events(events), out, checkpoint, "update", trigger=trigger)


def read_session_latest(spark: SparkSession, out: str) -> DataFrame:
    return merge_latest(read_batches(spark, out, LATEST))


def run_attached_stream(events: DataFrame, profiles: DataFrame, out: str, checkpoint: str, trigger: dict | None = None):
    """O-37 with the profile attached inside the stream, whichever of the two arrives first.

    Both streams feed one state row per user (latest event, latest profile), so a
    profile that arrives after the sign-in updates the user's row and clears its error.
    A stream-stream outer join would hold the sign-in back until a watermark
    passes and lose later profiles; here nothing is late.
    """
    return _run(latest_of_both(tagged(events, profiles)), out, checkpoint, "update", trigger=trigger)


def read_attached(spark: SparkSession, out: str) -> DataFrame:
    """The session state after all batches."""
    return attached(latest_of_both(read_batches(spark, out, ATTACHED)))


# ----------------------------------------------------------------- O-36


def run_login_stream(events: DataFrame, out: str, checkpoint: str, trigger: dict | None = None):
    """Latest sign-in time per user, updated per batch."""
    touches = events.where(F.col("event") == SIGNED_IN).groupBy("id").agg(F.max("ts").alias("_touch"))
    return _run(touches, out, checkpoint, "update", trigger=trigger)


def apply_login_updates(spark: SparkSession, users: DataFrame, out: str) -> DataFrame:
    """O-28 with the stream's output: users' last_login moved forward."""
    batches = read_batches(spark, out, TOUCHES)
    return apply_touches(users, batches.groupBy("id").agg(F.max("_touch").alias("_touch")))


# ----------------------------------------------------------------- O-35


def run_profile_stream(
    identities: DataFrame,
    base_users: DataFrame,
    out: str,
    rejects: str,
    checkpoint: str,
    variant: str = "v2",
    as_of: dt.datetime | F.Column | None = None,
    trigger: dict | None = None,
    index: str | None = None,
    buckets: int = BUCKETS,
):
    """Profiles for identities as they arrive, with collisions resolved across batches.

    Each batch is checked against ``base_users`` and what earlier batches granted
    (not its own, so a replay rebuilds the same rows), through an index of ids and
    names under ``index`` (by default beside ``out``): it reads the buckets that it asks about, not the directory or the
    earlier output.  ``base_users`` must be the same on every restart; it is indexed once.  What a batch
    stages on the way is dropped once its profiles and rejects are written.
    """
    spark = identities.sparkSession
    root = index or f"{out.rstrip('/')}-held"
    ids, names = (HeldIndex(spark, os.path.join(root, kind), buckets) for kind in ("ids", "names"))
    ids.start(base_users.select("id"))
    names.start(base_users.select("username"))

    def write(batch_df: DataFrame, batch_id: int) -> None:
        for held in (ids, names):
            held.merge(batch_id)
        existing = Directory(
            lambda asked: ids.among(asked, batch_id).withColumnRenamed("key", "id"),
            lambda asked: names.among(asked, batch_id).withColumnRenamed("key", "username"),
        )
        with staged_area(spark):
            built = build_profiles(batch_df, existing, variant, as_of)
            built.rejected.write.mode("overwrite").parquet(_batch_dir(rejects, batch_id))
            built.profiles.write.mode("overwrite").parquet(_batch_dir(out, batch_id))
        made = spark.read.schema(S.USERS).parquet(_batch_dir(out, batch_id))
        ids.append(made.select("id"), batch_id)
        names.append(made.select("username"), batch_id)

    return _run(identities, out, checkpoint, "append", write, trigger=trigger)


def compact(spark: SparkSession, out: str, schema: T.StructType, target: str) -> None:
    """Rewrite a stopped stream's batch outputs as one table, e.g. the next directory snapshot.

    A later stream takes that table as its base (with an output and a
    checkpoint of its own), so its cost does not grow with the age of the
    stream.
    """
    read_batches(spark, out, schema).write.mode("errorifexists").parquet(target)
