"""Scalar text helpers (F-01 .. F-10), all built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def is_blank(x: str | Column) -> Column:
    """F-04: null, or nothing but spaces (tabs are kept, as Postgres ``trim``)."""
    x = _c(x)
    return x.isNull() | (F.char_length(F.trim(x)) == 0)


def sanitize_name(x: str | Column) -> Column:
    """F-05 / F-06: lower, spaces and hyphens to ``_``, drop the rest, collapse, strip ``_``.

    The patterns and their order are fixed values: together they decide the name.
    """
    s = F.lower(F.trim(_c(x)))
    s = F.regexp_replace(s, r"[\s\-]+", "_")
    s = F.regexp_replace(s, r"[^a-z0-9_]", "")
    s = F.regexp_replace(s, r"_+", "_")
    return F.btrim(s, F.lit("_"))


def email_local_part(email: str | Column) -> Column:
    """F-08 ``split_part(email, '@', 1)``; without ``@`` the whole string."""
    return F.split_part(_c(email), F.lit("@"), F.lit(1))


def id_prefix_name(id_col: str | Column) -> Column:
    """F-09: ``'user_'`` followed by the first 8 characters of the id."""
    return F.concat(F.lit("user_"), F.substring(_c(id_col), 1, 8))


def hex_suffix(key: str | Column, attempt: int | Column) -> Column:
    """F-10: four hex digits for a retry, from md5 of ``key:attempt``.

    The reference draws them from ``random()``; hashing the id and attempt
    keeps reruns identical and lets an SQL oracle reproduce them.
    """
    a = attempt if isinstance(attempt, Column) else F.lit(attempt)
    return F.substring(F.md5(F.concat(_c(key), F.lit(":"), a.cast("string"))), 1, 4)


def like_pattern(q: str, literal: bool = False) -> str:
    """Substring pattern ``%q%`` for ``ilike`` with Postgres escape rules (T-4).

    ``%`` and ``_`` in ``q`` stay wildcards.  A backslash escapes the next
    character; before an ordinary character Postgres simply drops it, while
    Spark rejects it, so we drop it here.  A final backslash escapes the
    closing ``%``, as it does in Postgres.  ``literal=True`` escapes all.
    """
    if literal:
        body = "".join("\\" + ch if ch in "\\%_" else ch for ch in q)
        return f"%{body}%"
    pattern = f"%{q}%"
    out = []
    i = 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            nxt = pattern[i + 1]
            if nxt in "\\%_":
                out.append(ch + nxt)
            else:
                out.append(nxt)
            i += 2
            continue
        out.append(ch)
        i += 1
    return "".join(out)
