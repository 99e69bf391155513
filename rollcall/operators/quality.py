"""Bulk data-quality jobs: sign-up and login checks (O-33, O-34) and the
table-constraint report (O-31).

The reference checks one form at a time in the browser and leaves table
constraints to the database; here both become one pass over a table.  The
uniqueness checks are partial aggregates, so a heavily repeated value costs
one row per map task, not one task holding every copy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.functions.validation import login_errors, signup_errors
from rollcall.sources.schemas import ROLES, USERNAME_MAX


def signup_check(forms: DataFrame) -> DataFrame:
    """O-33: form_id, username, errors (messages in rule order), valid.  Passwords are dropped."""
    return (
        forms.select("form_id", "username", signup_errors().alias("errors"))
        .withColumn("valid", F.size("errors") == 0)
    )


def login_check(forms: DataFrame) -> DataFrame:
    """O-34: both fields must be non-empty."""
    return (
        forms.select("form_id", "username", login_errors().alias("errors"))
        .withColumn("valid", F.size("errors") == 0)
    )


def _dupes(users: DataFrame, col: str, rule: str) -> DataFrame:
    return (
        users.where(F.col(col).isNotNull())
        .groupBy(col)
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > 1)
        .select(F.lit(rule).alias("rule"), F.col(col).alias("key"))
    )


def constraint_report(users: DataFrame, auth: DataFrame | None = None) -> DataFrame:
    """O-31: one (rule, key) row per violation of the profile table's constraints.

    Rules: id_not_null (key: username), id_unique (key: id), username_not_null
    (key: id), username_unique (key: username), username_length (> 20
    characters; key: id), role_enum (key: id), identity_exists (foreign key
    to the identity table; key: id).
    """
    checks = [
        (F.col("id").isNull(), "id_not_null", F.col("username")),
        (F.col("username").isNull(), "username_not_null", F.col("id")),
        (F.char_length("username") > USERNAME_MAX, "username_length", F.col("id")),
        (F.col("role").isNull() | ~F.col("role").isin(*ROLES), "role_enum", F.col("id")),
    ]
    # one pass: each row yields its per-row violations (a plain explode and
    # filter, which stay in generated code, rather than a lambda filter)
    single_row = (
        users.select(
            F.explode(
                F.array(*[F.when(bad, F.struct(F.lit(rule).alias("rule"), key.alias("key"))) for bad, rule, key in checks])
            ).alias("v")
        )
        .where(F.col("v").isNotNull())
        .select("v.rule", "v.key")
    )
    parts = [single_row, _dupes(users, "id", "id_unique"), _dupes(users, "username", "username_unique")]
    if auth is not None:
        orphans = users.where(F.col("id").isNotNull()).join(auth.select("id"), "id", "left_anti")
        parts.append(orphans.select(F.lit("identity_exists").alias("rule"), F.col("id").alias("key")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
