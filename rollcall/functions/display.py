"""Display columns (F-13, F-14) and role helpers (O-12 rank, O-32 flags)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rollcall.functions.text import _c
from rollcall.sources.schemas import ADMIN_ROLES, ROLES

# Fixed display strings of the profile page.
NO_DATE = "N/A"
NEVER = "Never"
DATE_FORMAT = "yyyy-MM-dd"
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"


def initial(username: str | Column = "username") -> Column:
    """F-13: upper-cased first character of the username."""
    return F.upper(F.substring(_c(username), 1, 1))


def joined_label(ts: str | Column = "created_at") -> Column:
    """F-14: the joined date, or ``N/A``."""
    return F.coalesce(F.date_format(_c(ts), DATE_FORMAT), F.lit(NO_DATE))


def last_login_label(ts: str | Column = "last_login") -> Column:
    """F-14: the last login with its time of day, or ``Never``."""
    return F.coalesce(F.date_format(_c(ts), TIME_FORMAT), F.lit(NEVER))


def role_rank(role: str | Column = "role") -> Column:
    """Enum position of a role (1-based); roles sort in declared order, not by name."""
    return F.array_position(F.array(*[F.lit(r) for r in ROLES]), _c(role))


def is_admin(role: str | Column = "role") -> Column:
    return _c(role).isin(*ADMIN_ROLES)
