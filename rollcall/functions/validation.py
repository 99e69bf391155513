"""Sign-up and login checks as array-of-messages expressions (O-33, O-34)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rollcall.functions.text import _c

# Fixed messages and limits of the reference's form rules, in declared order.
USERNAME_MIN = 3
USERNAME_MAX = 20
PASSWORD_MIN = 6
MSG_USERNAME_SHORT = "Username must be at least 3 characters."
MSG_USERNAME_LONG = "Username must be under 20 characters."
MSG_USERNAME_CHARS = "Only letters, numbers, and underscores allowed."
MSG_PASSWORD_SHORT = "Password must be at least 6 characters."
MSG_PASSWORD_UPPER = "Must contain one uppercase letter."
MSG_PASSWORD_LOWER = "Must contain one lowercase letter."
MSG_PASSWORD_DIGIT = "Must contain one number."
MSG_MISMATCH = "Passwords don't match"
MSG_USERNAME_REQUIRED = "Username is required."
MSG_PASSWORD_REQUIRED = "Password is required."
# JavaScript's `$` (no m flag) is the true end of input; Java's `$` also matches
# before a final line break, so the anchor is `\z`.
USERNAME_PATTERN = r"^[a-zA-Z0-9_]+\z"


def js_length(x: Column) -> Column:
    """String length as JavaScript counts it: UTF-16 code units.

    A character outside the Basic Multilingual Plane (an emoji, say) counts
    as 2, where ``char_length`` counts 1; the form rules use this length.
    """
    return (F.octet_length(F.encode(x, "UTF-16BE")) / 2).cast("int")


def _messages(rules: list[tuple[Column, str]]) -> Column:
    """Messages of the failed rules, in rule order.

    Passing rules yield "" and ``array_remove`` drops them (messages are never
    empty).  This stays in generated code; dropping NULLs with ``filter`` /
    ``array_compact`` is a lambda function and about twice as slow.
    """
    arr = F.array(*[F.when(bad, F.lit(msg)).otherwise(F.lit("")) for bad, msg in rules])
    return F.array_remove(arr, "")


def signup_errors(
    username: str | Column = "username",
    password: str | Column = "password",
    confirm: str | Column = "confirm_password",
) -> Column:
    """Every failed sign-up rule's message, in declared order (all rules reported).

    A null field counts as the empty string.
    """
    u = F.coalesce(_c(username), F.lit(""))
    p = F.coalesce(_c(password), F.lit(""))
    c = F.coalesce(_c(confirm), F.lit(""))
    return _messages(
        [
            (js_length(u) < USERNAME_MIN, MSG_USERNAME_SHORT),
            (js_length(u) > USERNAME_MAX, MSG_USERNAME_LONG),
            (~u.rlike(USERNAME_PATTERN), MSG_USERNAME_CHARS),
            (js_length(p) < PASSWORD_MIN, MSG_PASSWORD_SHORT),
            (~p.rlike("[A-Z]"), MSG_PASSWORD_UPPER),
            (~p.rlike("[a-z]"), MSG_PASSWORD_LOWER),
            (~p.rlike("[0-9]"), MSG_PASSWORD_DIGIT),
            (p != c, MSG_MISMATCH),
        ]
    )


def login_errors(username: str | Column = "username", password: str | Column = "password") -> Column:
    u = F.coalesce(_c(username), F.lit(""))
    p = F.coalesce(_c(password), F.lit(""))
    return _messages(
        [
            (js_length(u) < 1, MSG_USERNAME_REQUIRED),
            (js_length(p) < 1, MSG_PASSWORD_REQUIRED),
        ]
    )
