"""Username derivation as single column expressions (O-25, the v1 rule)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.functions.text import _c, email_local_part, id_prefix_name, is_blank, sanitize_name
from rollcall.sources.schemas import APP_EMAIL_DOMAIN

# The metadata keys the profile rules read (F-01), parsed in one pass per row:
# strings, booleans and integers as ``->>`` gives them, JSON null and missing
# keys as NULL, and a repeated key keeps its last value, as Postgres JSONB
# does.  Limit: an object or array comes back without the space that JSONB's
# text has after ``:`` and ``,``, and a decimal loses trailing zeros.  None of
# the four keys holds such values in the sign-up flow.  Unused keys are pruned
# from the parse by Catalyst.
META_SCHEMA = "username string, name string, full_name string, avatar_url string"


def meta_fields(meta: str | Column = "raw_user_meta_data") -> Column:
    return F.from_json(_c(meta), META_SCHEMA)


def base_username(
    meta: str | Column = "raw_user_meta_data", email: str | Column = "email", id_col: str | Column = "id"
) -> Column:
    """O-25, the four-step cascade, first step that yields a value wins.

    1. ``username`` from the metadata if not blank: lower(trim()), not sanitised.
    2. ``coalesce(name, full_name)`` if not blank, sanitised, kept when length >= 3.
       An empty-string ``name`` hides ``full_name`` (coalesce skips only NULL).
    3. An ``@app.local`` e-mail whose local part has length >= 3, lower-cased.
    4. ``'user_'`` + the first 8 characters of the id.
    """
    fields, email, id_col = meta_fields(meta), _c(email), _c(id_col)
    given = fields.getField("username")
    step1 = F.when(~is_blank(given), F.lower(F.trim(given)))
    display = F.coalesce(fields.getField("name"), fields.getField("full_name"))
    clean = sanitize_name(display)
    step2 = F.when(~is_blank(display) & (F.char_length(clean) >= 3), clean)
    local = email_local_part(email)
    step3 = F.when(
        email.isNotNull() & email.endswith(APP_EMAIL_DOMAIN) & (F.char_length(local) >= 3), F.lower(local)
    )
    return F.coalesce(step1, step2, step3, id_prefix_name(id_col))


def add_base_username(
    df: DataFrame,
    out: str = "base_username",
    meta: str = "raw_user_meta_data",
    email: str = "email",
    id_col: str = "id",
    avatar: str | None = None,
) -> DataFrame:
    """O-25 on a DataFrame, with each costly piece evaluated once per row.

    Written as one expression, the cascade re-parses the JSON and re-runs the
    sanitising regexes inside its branches (subexpression elimination does
    not reach into CASE / COALESCE branches).  Here the parsed metadata and
    the sanitised name are their own projection steps; Catalyst does not
    merge a projection when that would repeat an expensive expression, so
    each is computed once.  ``avatar`` optionally names a column for the
    metadata's avatar_url, read from the same parse.
    """
    d = df.withColumn("_meta", meta_fields(meta))
    d = d.withColumn("_display", F.coalesce(F.col("_meta.name"), F.col("_meta.full_name")))
    d = d.withColumn("_clean", sanitize_name("_display")).withColumn("_local", email_local_part(email))
    given = F.col("_meta.username")
    display, clean, email_c, local = F.col("_display"), F.col("_clean"), F.col(email), F.col("_local")
    step1 = F.when(~is_blank(given), F.lower(F.trim(given)))
    step2 = F.when(~is_blank(display) & (F.char_length(clean) >= 3), clean)
    step3 = F.when(
        email_c.isNotNull() & email_c.endswith(APP_EMAIL_DOMAIN) & (F.char_length(local) >= 3), F.lower(local)
    )
    d = d.withColumn(out, F.coalesce(step1, step2, step3, id_prefix_name(id_col)))
    if avatar:
        d = d.withColumn(avatar, F.col("_meta.avatar_url"))
    return d.drop("_meta", "_display", "_clean", "_local")


def v1_username(meta: str | Column = "raw_user_meta_data", email: str | Column = "email") -> Column:
    """The earlier rule: metadata ``username`` as is, else the e-mail local part."""
    return F.coalesce(meta_fields(meta).getField("username"), email_local_part(_c(email)))


def avatar_from_meta(meta: str | Column = "raw_user_meta_data") -> Column:
    return meta_fields(meta).getField("avatar_url")


def seed_email(username: str | Column = "username") -> Column:
    """F-12 as the seed script builds it: lower(username) + '@app.local'."""
    return F.concat(F.lower(_c(username)), F.lit(APP_EMAIL_DOMAIN))


def signup_email(username: str | Column = "username") -> Column:
    """F-12 as sign-up builds it: the username kept as typed + '@app.local'."""
    return F.concat(_c(username), F.lit(APP_EMAIL_DOMAIN))
