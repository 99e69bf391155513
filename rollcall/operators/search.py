"""Directory search and reads (O-06 .. O-17, O-24).

A search request is plain driver-side data; ``search`` turns it into a lazy
DataFrame whose predicates Catalyst pushes into the parquet scan (role and
date bounds reach ``PushedFilters``; the substring match runs right after
the scan).  Only the predicates that are set are added.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.functions.display import initial, joined_label, last_login_label, role_rank
from rollcall.functions.text import like_pattern
from rollcall.sources.schemas import ROLES, SORT_FIELDS


class InvalidSection(ValueError):
    pass


class InvalidRole(ValueError):
    pass


class InvalidDate(ValueError):
    pass


class NotFound(LookupError):
    pass


class NotUnique(LookupError):
    pass


class InvalidFilter(ValueError):
    pass


@dataclass(frozen=True)
class Filter:
    """A filter that a section declares: the request field it sets, the UI's name and label, and its kind."""

    field: str
    key: str
    label: str
    kind: str  # 'select' (equal to one of the options), 'from' or 'to' (UTC day bounds, inclusive)
    column: str
    options: tuple[str, ...] = ()


# O-15: the section registry.  Each section declares its projection, the
# column that its text search reads, its filters and sorts, and what to say
# when nothing matches; the reference has one section (labels and message are fixed values).
SECTIONS = {
    "users": {
        "label": "Users",
        "columns": ("id", "username", "role", "created_at", "last_login"),
        "search_column": "username",
        "empty_message": "No users matched your search.",
        "filters": (
            Filter("role", "role", "Role", "select", "role", ROLES),
            Filter("joined_after", "joinedAfter", "Joined After", "from", "created_at"),
            Filter("joined_before", "joinedBefore", "Joined Before", "to", "created_at"),
        ),
        "sorts": (("username", "Username"), ("createdAt", "Date Joined"), ("lastLogin", "Last Login")),
    }
}

# O-16: UI sort keys.  ``strict`` passes them through unmapped (so two of them
# hit the whitelist fallback, as in the reference); ``mapped`` translates.
UI_SORT_ALIASES = {"createdAt": "created_at", "lastLogin": "last_login"}


@dataclass(frozen=True)
class SearchRequest:
    section: str = "users"
    q: str = ""
    role: str | None = None
    joined_after: str | None = None
    joined_before: str | None = None
    sort_by: str = "created_at"
    sort_dir: str = "desc"
    sort_aliases: str = "strict"
    literal: bool = False

    @classmethod
    def from_ui(cls, **params) -> SearchRequest:
        """O-08: the search bar trims the text; empty filters are dropped (O-11)."""
        q = (params.pop("q", "") or "").strip()
        cleaned = {k: v for k, v in params.items() if v not in (None, "")}
        return cls(q=q, **cleaned)


def request_for(section: str, q: str = "", filters: dict[str, str] | None = None, **sort) -> SearchRequest:
    """O-15: a request from the UI's names of filters; one that the section does not declare is refused."""
    declared = {f.key: f.field for f in check_section(section)["filters"]}
    for key in filters or {}:
        if key not in declared:
            raise InvalidFilter(f"Invalid filter: '{key}'")
    return SearchRequest.from_ui(section=section, q=q, **{declared[k]: v for k, v in (filters or {}).items()}, **sort)


def empty_message(section: str, rows: int) -> str | None:
    """What a section says when no row matches; None if there are rows."""
    return None if rows else check_section(section)["empty_message"]


def _day(value: str) -> dt.date:
    try:
        return dt.date.fromisoformat(value)
    except ValueError as exc:
        raise InvalidDate(f"Invalid date: '{value}'") from exc


def _ts_literal(moment: dt.datetime, data_type: T.DataType) -> Column:
    text = moment.strftime("%Y-%m-%d %H:%M:%S.%f")
    if isinstance(data_type, T.TimestampNTZType):
        return F.to_timestamp_ntz(F.lit(text))
    return F.to_timestamp(F.lit(text))


def predicates(df: DataFrame, req: SearchRequest) -> list[Column]:
    """O-07, O-09, O-10, O-11: the predicates a request sets, to be ANDed."""
    out: list[Column] = []
    section = SECTIONS[req.section]
    if req.q:
        out.append(F.col(section["search_column"]).ilike(like_pattern(req.q, req.literal)))
    for declared in section["filters"]:
        value, column = getattr(req, declared.field), F.col(declared.column)
        if not value:
            continue
        if declared.kind == "select":
            if value not in declared.options:
                raise InvalidRole(f"Invalid {declared.field}: '{value}'")
            out.append(column == F.lit(value))
            continue
        ts_type = df.schema[declared.column].dataType
        if declared.kind == "from":
            out.append(column >= _ts_literal(dt.datetime.combine(_day(value), dt.time(0, 0, 0)), ts_type))
        else:
            # inclusive end of day to the millisecond, as the reference sends it
            out.append(column <= _ts_literal(dt.datetime.combine(_day(value), dt.time(23, 59, 59, 999000)), ts_type))
    return out


def sort_key(req: SearchRequest) -> tuple[str, bool]:
    """O-12 / O-16: whitelisted column and direction (ascending only for 'asc')."""
    key = req.sort_by
    if req.sort_aliases == "mapped":
        key = UI_SORT_ALIASES.get(key, key)
    if key not in SORT_FIELDS:
        key = "created_at"
    return key, req.sort_dir == "asc"


def order_columns(key: str, ascending: bool) -> list[Column]:
    """Postgres order: nulls last ascending, first descending; role by enum; id breaks ties."""
    expr = role_rank("role") if key == "role" else F.col(key)
    primary = expr.asc_nulls_last() if ascending else expr.desc_nulls_first()
    return [primary, F.col("id").asc()]


def check_section(section: str) -> dict:
    if section not in SECTIONS:
        raise InvalidSection(f"Invalid section: '{section}'")
    return SECTIONS[section]


def search_unsorted(users: DataFrame, req: SearchRequest) -> DataFrame:
    """Filtered projection of a search, before ordering."""
    section = check_section(req.section)
    preds = predicates(users, req)
    df = users.where(reduce(lambda a, b: a & b, preds)) if preds else users
    return df.select(*section["columns"])


def search(users: DataFrame, req: SearchRequest) -> DataFrame:
    """The full search: section check, optional predicates, projection, order."""
    key, ascending = sort_key(req)
    return search_unsorted(users, req).orderBy(*order_columns(key, ascending))


def list_directory(users: DataFrame) -> DataFrame:
    """O-17: every profile, oldest first (projection (b))."""
    return users.select("id", "username", "role", "created_at").orderBy(*order_columns("created_at", True))


def directory_count(users: DataFrame) -> DataFrame:
    """O-24: number of visible rows (0 for an empty directory)."""
    return users.agg(F.count(F.lit(1)).alias("total_users"))


def by_id(users: DataFrame, user_id: str) -> DataFrame:
    """O-13: key lookup, projection (a); on a stored directory the equality reaches the parquet scan."""
    return users.where(F.col("id") == F.lit(user_id)).select("id", "username", "role", "created_at", "last_login")


def single(df: DataFrame) -> dict:
    """O-14: exactly one row or an error; reads at most two rows."""
    rows = df.limit(2).collect()
    if not rows:
        raise NotFound("No rows found")
    if len(rows) > 1:
        raise NotUnique("More than one row returned")
    return rows[0].asDict()


def profile_display(users: DataFrame) -> DataFrame:
    """F-13 / F-14 for every profile: initial, joined date or N/A, last login or Never."""
    return users.select(
        "id",
        "username",
        initial("username").alias("initial"),
        joined_label("created_at").alias("joined"),
        last_login_label("last_login").alias("last_seen"),
    )
