"""Table schemas and the fixed domain values of the account directory."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values that must equal the reference's: the role enum in declared
# order (this order is also the sort order), the default role, the sort
# whitelist, and the e-mail domain of password sign-ups.
ROLES = ("USER", "ADMIN", "SUPER_ADMIN")
DEFAULT_ROLE = "USER"
ADMIN_ROLES = ("ADMIN", "SUPER_ADMIN")
SORT_FIELDS = ("username", "created_at", "last_login", "role")
APP_EMAIL_DOMAIN = "@app.local"
USERNAME_MAX = 20

# Profile rows (public.users); avatar_url is the one additive column.
USERS = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("username", T.StringType(), False),
        T.StructField("role", T.StringType(), False),
        T.StructField("created_at", T.TimestampNTZType(), True),
        T.StructField("last_login", T.TimestampNTZType(), True),
        T.StructField("avatar_url", T.StringType(), True),
    ]
)
USER_COLUMNS = tuple(f.name for f in USERS.fields)

# Identity rows (auth.users); raw_user_meta_data is JSON text.
AUTH_USERS = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("email", T.StringType(), True),
        T.StructField("raw_user_meta_data", T.StringType(), True),
        T.StructField("created_at", T.TimestampNTZType(), True),
        T.StructField("last_sign_in_at", T.TimestampNTZType(), True),
    ]
)

# Session events (SIGNED_IN / SIGNED_OUT / anything else).
AUTH_EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType(), False),
        T.StructField("id", T.StringType(), True),
        T.StructField("ts", T.TimestampNTZType(), True),
        T.StructField("event", T.StringType(), True),
    ]
)

# The given base tables the views are derived from (only the columns read).
CUSTOMER = T.StructType(
    [
        T.StructField("c_custkey", T.LongType()),
        T.StructField("c_name", T.StringType()),
        T.StructField("c_nationkey", T.IntegerType()),
        T.StructField("c_acctbal", T.DoubleType()),
        T.StructField("c_mktsegment", T.StringType()),
    ]
)
ORDERS = T.StructType(
    [
        T.StructField("o_orderkey", T.LongType()),
        T.StructField("o_custkey", T.LongType()),
        T.StructField("o_orderstatus", T.StringType()),
        T.StructField("o_totalprice", T.DoubleType()),
        T.StructField("o_orderdate", T.TimestampNTZType()),
        T.StructField("o_orderpriority", T.StringType()),
    ]
)
EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)
BASE_TABLES = {"customer": CUSTOMER, "orders": ORDERS, "events": EVENTS}
