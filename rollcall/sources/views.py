"""Directory tables derived from the given TPC-H-style tables.

The given data has no account tables, so identities, profiles, session
events, sign-up forms and role requests are derived from ``customer``,
``orders`` and ``events`` (rules in FIXTURES.md §3).  Everything here is
plain DataFrame code: column pruning and filters reach the parquet scans,
the per-customer aggregates are partial (map-side) aggregations, and the
"first claimant of a base name" rank avoids a window over a hot group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.functions.identity import add_base_username
from rollcall.functions.text import hex_suffix
from rollcall.operators.joins import mark_first
from rollcall.sources.schemas import USER_COLUMNS
from rollcall.sources.tables import base_table


def _first_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = base_table(spark, sf_dir, "orders")
    return orders.groupBy(F.col("o_custkey").alias("k")).agg(F.min("o_orderdate").alias("created_at"))


def _last_click(spark: SparkSession, sf_dir: str) -> DataFrame:
    # one plan shared by both views (same names), so a query reading both
    # reuses its shuffle instead of aggregating the events twice
    events = base_table(spark, sf_dir, "events")
    return (
        events.where(F.col("event_type") == "click")
        .groupBy(F.col("user_id").alias("k"))
        .agg(F.max("ts").alias("last_click"))
    )


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customer_keys(base_table(spark, sf_dir, "customer"))


def auth_users_from(customers: DataFrame, first_order: DataFrame, last_click: DataFrame) -> DataFrame:
    """Identity rows for the given customer rows (k, c_name, c_mktsegment).

    ``first_order`` (k, created_at) and ``last_click`` (k, last_click) are
    per-customer aggregates.
    """
    k = F.col("k")
    email = F.when(k % 2 == 0, F.concat(F.lit("User"), k, F.lit("@app.local"))).otherwise(
        F.concat(F.lit("c"), k, F.lit("@example.com"))
    )
    r = k % 5
    meta = (
        F.when(r == 0, F.concat(F.lit('{"username":" '), F.col("c_name"), F.lit(' "}')))
        .when(r == 1, F.concat(F.lit('{"name":"'), F.col("c_mktsegment"), F.lit(' - Team"}')))
        .when(
            r == 2,
            F.concat(
                F.lit('{"full_name":"'),
                F.replace(F.col("c_name"), F.lit("#"), F.lit(" ")),
                F.lit('","avatar_url":"https://img.example/'),
                k,
                F.lit('.png"}'),
            ),
        )
        .when(r == 3, F.lit('{"name":"--"}'))
    )
    return (
        customers.join(first_order, "k", "left")
        .join(last_click, "k", "left")
        .select(
            k.cast("string").alias("id"),
            email.alias("email"),
            meta.alias("raw_user_meta_data"),
            "created_at",
            F.col("last_click").alias("last_sign_in_at"),
        )
    )


def customer_keys(customers: DataFrame) -> DataFrame:
    return customers.select(F.col("c_custkey").alias("k"), "c_name", "c_mktsegment")


def auth_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity rows: id, email, raw_user_meta_data (JSON), created_at, last_sign_in_at."""
    return auth_users_from(_customers(spark, sf_dir), _first_order(spark, sf_dir), _last_click(spark, sf_dir))


def users(spark: SparkSession, sf_dir: str, columns: tuple[str, ...] = USER_COLUMNS) -> DataFrame:
    """Profile rows, usernames made unique by appending the id to later claimants.

    Only what ``columns`` need is derived: the name rank and the order and
    click aggregates are joins, which the optimizer cannot drop by itself.
    """
    k = F.col("k")
    rows = _customers(spark, sf_dir)
    if {"username", "created_at"} & set(columns):
        rows = rows.join(_first_order(spark, sf_dir), "k", "left")
    if "last_login" in columns:
        rows = rows.join(_last_click(spark, sf_dir), "k", "left").withColumnRenamed("last_click", "last_login")
    if "username" in columns:
        r = k % 5
        name = F.lower(F.col("c_name"))
        base = (
            F.when(r == 0, name)
            .when(r == 1, F.concat(F.lower(F.col("c_mktsegment")), F.lit("_team")))
            .when(r == 2, F.replace(name, F.lit("#"), F.lit("_")))
            .when(k % 2 == 0, F.concat(F.lit("user"), k))
            .otherwise(F.concat(F.lit("user_"), F.substring(k.cast("string"), 1, 8)))
        )
        rows = mark_first(rows.withColumn("base", base), ["base"], ["created_at"], "k", "is_first")
        later = F.concat(F.col("base"), F.lit("_"), k.cast("string"))
        rows = rows.withColumn("username", F.when(F.col("is_first"), F.col("base")).otherwise(later))
    role = F.when(k % 50 == 0, "SUPER_ADMIN").when(k % 10 == 1, "ADMIN").otherwise("USER")
    rows = rows.withColumns({"id": k.cast("string"), "role": role, "avatar_url": F.lit(None).cast("string")})
    return rows.select(*columns)


def auth_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session events: clicks are sign-ins, errors are sign-outs, the rest other."""
    return auth_events_from(base_table(spark, sf_dir, "events"))


def auth_events_from(events: DataFrame) -> DataFrame:
    """The session-event projection of raw events (batch or streaming)."""
    kind = F.when(F.col("event_type") == "click", "SIGNED_IN").when(F.col("event_type") == "error", "SIGNED_OUT")
    return events.select(
        "event_id",
        F.col("user_id").cast("string").alias("id"),
        "ts",
        kind.otherwise("OTHER").alias("event"),
    )


def signup_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate sign-up records covering every combination of the form rules."""
    c = base_table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    username = (
        F.when(k % 5 == 0, F.col("c_name"))
        .when(k % 5 == 1, F.replace(F.col("c_name"), F.lit("#"), F.lit("_")))
        .when(k % 5 == 2, F.lit("ab"))
        .when(k % 5 == 3, F.concat(F.lit("a_very_long_name_"), k, F.lit("_x_y_z")))
        .otherwise(F.concat(F.lit("user_"), k))
    )
    pw_by_six = (
        F.when(k % 6 == 0, "Password1")
        .when(k % 6 == 1, "password1")
        .when(k % 6 == 2, "PASSWORD1")
        .when(k % 6 == 3, "Password")
        .when(k % 6 == 4, "Pa1")
        .otherwise("")
    )
    confirm = F.when(k % 7 == 0, F.lit("Different1")).otherwise(pw_by_six)
    return c.select(
        k.alias("form_id"),
        username.alias("username"),
        pw_by_six.alias("password"),
        confirm.alias("confirm_password"),
    )


def role_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Promote/demote requests; actor '50' files a third of them (a hot key)."""
    c = base_table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select(
        k.alias("request_id"),
        F.when(k % 3 == 0, F.lit("50")).otherwise((k % 97).cast("string")).alias("actor_id"),
        F.when(k % 13 == 0, F.lit("no-such-id")).otherwise(k.cast("string")).alias("target_id"),
        F.when(k % 4 < 2, F.lit("promote")).otherwise(F.lit("demote")).alias("action"),
    )


def seed_batch(spark: SparkSession, sf_dir: str, fixed: tuple[tuple[str, str], ...]) -> DataFrame:
    """Seed list for O-03: the given (username, role) seeds plus one per customer.

    Per customer: username ``User<k>``; the lower-cased e-mail matches an
    existing identity for even ``k`` and is new for odd ``k``.
    """
    c = base_table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    role = F.when(k % 4 == 1, "ADMIN").when(k % 4 == 3, "SUPER_ADMIN").otherwise("USER")
    derived = c.select(F.concat(F.lit("User"), k).alias("username"), role.alias("role"))
    return spark.createDataFrame(list(fixed), "username string, role string").unionByName(derived)


def _profiles(rows: DataFrame, id_col, username, role="USER") -> DataFrame:
    """Further directory rows for the scenarios: declared columns, no login and no avatar."""
    as_col = lambda c: F.lit(c) if isinstance(c, str) else c
    return rows.select(
        id_col.alias("id"),
        username.alias("username"),
        as_col(role).alias("role"),
        F.lit(None).cast("timestamp_ntz").alias("created_at"),
        F.lit(None).cast("timestamp_ntz").alias("last_login"),
        F.lit(None).cast("string").alias("avatar_url"),
    )


def _holders(bases: DataFrame, last) -> DataFrame:
    """Profiles that hold names 0..``last`` (0: the base) of each (id, base): what a claimant would try."""
    tries = bases.select("id", "base", F.explode(F.sequence(F.lit(0), last)).alias("j"))
    name = F.when(F.col("j") == 0, F.col("base")).otherwise(
        F.concat(F.col("base"), F.lit("_"), hex_suffix("id", F.col("j")))
    )
    return _profiles(tries, F.concat_ws("-", F.lit("held"), "id", F.col("j").cast("string")), name)


def crowded_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A directory without the identities, in which many of the names they would try are held.

    Of every third identity the base and the next ``k % 23`` tries (ten at
    most) are held, so attempts above 2 occur and some run out of tries.
    """
    bases = add_base_username(auth_users(spark, sf_dir), "base").select("id", "base")
    k = F.col("id").cast("long")
    return _holders(bases.where(k % 3 == 0), F.least(k % 23, F.lit(10)))


def seed_holders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles that hold every name the new seed of each customer with ``k % 10 = 5`` would try."""
    k = F.col("c_custkey")
    base = F.concat(F.lit("user"), k)
    bases = base_table(spark, sf_dir, "customer").where(k % 10 == 5).select(
        F.md5(F.concat(base, F.lit("@app.local"))).alias("id"), base.alias("base")
    )
    return _holders(bases, F.lit(10))


def shared_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities that the v1 rule cannot all serve: shared, missing and over-long names."""
    k = F.col("id").cast("long")
    email = (
        F.when(k % 31 == 0, F.lit(None))
        .when(k % 29 == 0, F.concat(F.lit("someone_with_a_long_name_"), "id", F.lit("@example.com")))
        .when(k % 3 == 0, F.concat(F.lit("team"), k % 40, F.lit("@example.com")))
        .otherwise(F.col("email"))
    )
    meta = F.when((k % 31 != 0) & (k % 29 != 0) & (k % 3 != 0), F.col("raw_user_meta_data"))
    return auth_users(spark, sf_dir).withColumns({"email": email, "raw_user_meta_data": meta})


def broken_directory(directory: DataFrame) -> DataFrame:
    """A directory with further rows that break each constraint of O-31."""
    return directory.unionByName(breaking_rows(directory))


def breaking_rows(directory: DataFrame) -> DataFrame:
    """Rows that break each constraint of O-31 once they are added to the directory."""
    k, own = F.col("id").cast("long"), F.col("id")
    with_id = lambda c: F.concat(F.lit(c), own)
    none = F.lit(None).cast("string")
    cases = [
        (101, none, with_id("noid_"), "USER"),
        (103, with_id("x"), none, "USER"),
        (107, with_id("y"), with_id("a_very_long_username_"), "USER"),
        (109, with_id("z"), with_id("z"), "OWNER"),
        (113, own, with_id("dup_"), "USER"),
        (127, with_id("w"), F.col("username"), "USER"),
    ]
    out = None
    for modulus, id_col, username, role in cases:
        rows = _profiles(directory.where(k % modulus == 1), id_col, username, role)
        out = rows if out is None else out.unionByName(rows)
    return out
