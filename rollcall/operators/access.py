"""Row visibility, permission flags and role changes (O-29, O-30, O-32).

Rules (from the reference's documentation and UI): a USER sees only their
own row, ADMIN and SUPER_ADMIN see every row; only a SUPER_ADMIN may change
roles, and only USER -> ADMIN (promote) or ADMIN -> USER (demote).

Batches of (actor, target) pairs look up both roles with ``lookup_join``: a
single actor can file a large share of all requests (and a target can be
named by many), so hot keys are served by a broadcast of their (few)
profile rows instead of a shuffle that would put all their requests into
one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.functions.display import is_admin
from rollcall.operators.joins import lookup_join
from rollcall.operators.search import NotFound, single
from rollcall.session import durable
from rollcall.sources.schemas import ADMIN_ROLES, USER_COLUMNS

# The role each action sets and the role it requires first,
# and the landing pages chosen by the admin test.
ACTIONS = {"promote": ("ADMIN", "USER"), "demote": ("USER", "ADMIN")}
CHANGER_ROLE = "SUPER_ADMIN"
ADMIN_LANDING = "/admin-dashboard"
USER_LANDING = "/dashboard"


class NoSession(PermissionError):
    pass


def actor_role(users: DataFrame, actor_id: str | None) -> str | None:
    """Role of one signed-in actor (reads at most two rows); None if no profile."""
    if not actor_id:
        raise NoSession("No active session")
    try:
        return single(users.where(F.col("id") == F.lit(actor_id)).select("role"))["role"]
    except NotFound:
        return None


def visible_to(users: DataFrame, actor_id: str | None, role: str | None = None) -> DataFrame:
    """O-29 for one session: the rows the actor may read.

    The result is ``users`` with at most one extra predicate, so filters
    applied afterwards still reach the scan.
    """
    role = actor_role(users, actor_id) if role is None else role
    if role in ("ADMIN", "SUPER_ADMIN"):
        return users
    return users.where(F.col("id") == F.lit(actor_id))


def visible_counts(users: DataFrame) -> DataFrame:
    """O-29 + O-24 for every profile as actor: how many rows that actor sees.

    Admins see the whole directory (one global count, a scalar in the plan),
    users their own row.  Nothing pairs actors with rows.
    """
    total = users.select(F.lit(1).alias("one")).agg(F.count("one")).scalar()
    return users.select(
        F.col("id").alias("actor_id"),
        F.when(is_admin("role"), total).otherwise(F.lit(1)).cast("long").alias("visible_rows"),
    )


def _with_roles(requests: DataFrame, users: DataFrame) -> DataFrame:
    """Requests with actor_role, target_role and target_found; both roles in one pass over the requests."""
    out = lookup_join(requests, ["actor_id", "target_id"], users.select("id", "role"), "id")
    return out.select(
        *requests.columns,
        F.col("actor_id_row.role").alias("actor_role"),
        F.col("target_id_row.role").alias("target_role"),
        F.col("target_id_row").isNotNull().alias("target_found"),
    )


def permission_flags(requests: DataFrame, users: DataFrame) -> DataFrame:
    """O-32 per (actor, target): is_admin, can_promote, can_demote."""
    out = _with_roles(requests, users)
    super_admin = F.coalesce(F.col("actor_role") == CHANGER_ROLE, F.lit(False))
    return out.select(
        "request_id",
        "actor_id",
        "target_id",
        F.coalesce(is_admin("actor_role"), F.lit(False)).alias("is_admin"),
        (super_admin & F.coalesce(F.col("target_role") == "USER", F.lit(False))).alias("can_promote"),
        (super_admin & F.coalesce(F.col("target_role") == "ADMIN", F.lit(False))).alias("can_demote"),
    )


def role_change_outcomes(requests: DataFrame, users: DataFrame) -> DataFrame:
    """O-30 per request: status and the role it leaves.

    Status, first that applies: ``forbidden`` (actor not SUPER_ADMIN or has no
    profile), ``not_found`` (no such target), ``invalid`` (unknown action, or
    the target's role is not the one the action changes), else ``applied``.
    Actor roles come from the snapshot before the batch.
    """
    out = _with_roles(requests, users)
    action = F.col("action")
    new_role = F.when(action == "promote", F.lit(ACTIONS["promote"][0])).when(
        action == "demote", F.lit(ACTIONS["demote"][0])
    )
    needed = F.when(action == "promote", F.lit(ACTIONS["promote"][1])).when(
        action == "demote", F.lit(ACTIONS["demote"][1])
    )
    status = (
        F.when(F.coalesce(F.col("actor_role") != CHANGER_ROLE, F.lit(True)), F.lit("forbidden"))
        .when(~F.col("target_found"), F.lit("not_found"))
        .when(new_role.isNull() | (F.col("target_role") != needed), F.lit("invalid"))
        .otherwise(F.lit("applied"))
    )
    # status is its own column, so the rule chain is evaluated once per row
    return out.withColumn("status", status).select(
        "request_id",
        "actor_id",
        "target_id",
        "action",
        "status",
        F.col("target_role").alias("old_role"),
        F.when(F.col("status") == "applied", new_role).otherwise(F.col("target_role")).alias("new_role"),
    )


def changed_rows(outcomes: DataFrame, users: DataFrame) -> DataFrame:
    """O-30 with O-06 (d): for each applied request, its id and the whole profile row it leaves."""
    applied = outcomes.where(F.col("status") == "applied").select("request_id", "target_id", "new_role")
    found = lookup_join(durable(applied, "applied"), ["target_id"], users.select(*USER_COLUMNS), "id")
    return found.select(
        "request_id",
        *[F.col("new_role" if c == "role" else f"target_id_row.{c}").alias(c) for c in USER_COLUMNS],
    )


class SessionDirectory:
    """O-29 as a view: every read of the directory goes through the signed-in actor's policy.

    ``directory`` is a temporary view of ``users`` whose predicate reads two
    session variables, the actor and their role.  They are constants when a query is
    planned, so an admin's query has no predicate and a user's one on ``id``,
    which reaches the scan.  Without a session there is no view to read.
    """

    ACTOR, ROLE = "rollcall_actor", "rollcall_actor_role"

    def __init__(self, users: DataFrame, name: str = "directory"):
        self.users, self.name, self.spark = users, name, users.sparkSession
        users.createOrReplaceTempView(f"{name}_rows")
        self.sign_out()

    def _set(self, actor: str | None, role: str | None) -> None:
        for variable, value in ((self.ACTOR, actor), (self.ROLE, role)):
            self.spark.sql(f"DECLARE OR REPLACE VARIABLE {variable} STRING")
            self.spark.sql(f"SET VAR {variable} = CAST(:value AS STRING)", args={"value": value})

    def sign_in(self, actor_id: str | None) -> None:
        role = actor_role(self.users, actor_id)
        self._set(actor_id, role)
        admins = ", ".join(f"'{r}'" for r in ADMIN_ROLES)
        self.spark.sql(
            f"CREATE OR REPLACE TEMPORARY VIEW {self.name} AS SELECT * FROM {self.name}_rows "
            f"WHERE coalesce({self.ROLE} IN ({admins}), false) OR id = {self.ACTOR}"
        )

    def sign_out(self) -> None:
        self._set(None, None)
        self.spark.catalog.dropTempView(self.name)

    def read(self) -> DataFrame:
        if not self.spark.catalog.tableExists(self.name):
            raise NoSession("No active session")
        return self.spark.table(self.name)


def apply_role_changes(users: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The snapshot after a batch: applied changes, last request per target wins."""
    changes = (
        outcomes.where(F.col("status") == "applied")
        .groupBy(F.col("target_id").alias("id"))
        .agg(F.max_by("new_role", "request_id").alias("_new_role"))
    )
    out = users.join(changes, "id", "left")
    return out.select(
        *[F.coalesce(F.col("_new_role"), F.col("role")).alias("role") if c == "role" else F.col(c) for c in USER_COLUMNS]
    )


def landing_page(role_col: str = "role") -> F.Column:
    """Where sign-in leads: the admin dashboard for admins, else the user dashboard."""
    return F.when(F.coalesce(is_admin(role_col), F.lit(False)), F.lit(ADMIN_LANDING)).otherwise(F.lit(USER_LANDING))
