"""Independent SQL for every registered query (DuckDB dialect, shared subset).

The driver runs these next to the Spark jobs at sf0.01.  The derived views
are inlined as CTEs over the given base tables; every rank here is written
as an ordinary window so that it checks the Spark side's aggregate-based
ranks independently.
"""

from __future__ import annotations

from rollcall.sources.schemas import ROLES

AS_OF_SQL = "TIMESTAMP '2025-01-01 00:00:00'"

VIEWS = {
    "auth_users": """
SELECT CAST(c.c_custkey AS VARCHAR) AS id,
       CASE WHEN c.c_custkey % 2 = 0 THEN concat('User', c.c_custkey, '@app.local')
            ELSE concat('c', c.c_custkey, '@example.com') END AS email,
       CASE c.c_custkey % 5
            WHEN 0 THEN concat('{"username":" ', c.c_name, ' "}')
            WHEN 1 THEN concat('{"name":"', c.c_mktsegment, ' - Team"}')
            WHEN 2 THEN concat('{"full_name":"', replace(c.c_name, '#', ' '), '","avatar_url":"https://img.example/', c.c_custkey, '.png"}')
            WHEN 3 THEN '{"name":"--"}'
            ELSE NULL END AS raw_user_meta_data,
       o.created_at AS created_at,
       e.last_sign_in_at AS last_sign_in_at
FROM customer c
LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS created_at FROM orders GROUP BY o_custkey) o
       ON o.o_custkey = c.c_custkey
LEFT JOIN (SELECT user_id, max(ts) AS last_sign_in_at FROM events
           WHERE event_type = 'click' GROUP BY user_id) e
       ON e.user_id = c.c_custkey""",
    "users": """
SELECT id,
       CASE WHEN row_number() OVER (PARTITION BY base ORDER BY created_at NULLS LAST, k) = 1
            THEN base ELSE concat(base, '_', id) END AS username,
       CASE WHEN k % 50 = 0 THEN 'SUPER_ADMIN' WHEN k % 10 = 1 THEN 'ADMIN' ELSE 'USER' END AS role,
       created_at, last_login, CAST(NULL AS VARCHAR) AS avatar_url
FROM (SELECT c.c_custkey AS k, CAST(c.c_custkey AS VARCHAR) AS id,
             CASE WHEN c.c_custkey % 5 = 0 THEN lower(c.c_name)
                  WHEN c.c_custkey % 5 = 1 THEN concat(lower(c.c_mktsegment), '_team')
                  WHEN c.c_custkey % 5 = 2 THEN replace(lower(c.c_name), '#', '_')
                  WHEN c.c_custkey % 2 = 0 THEN concat('user', c.c_custkey)
                  ELSE concat('user_', substr(CAST(c.c_custkey AS VARCHAR), 1, 8)) END AS base,
             o.created_at, e.last_login
      FROM customer c
      LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS created_at FROM orders GROUP BY o_custkey) o
             ON o.o_custkey = c.c_custkey
      LEFT JOIN (SELECT user_id, max(ts) AS last_login FROM events
                 WHERE event_type = 'click' GROUP BY user_id) e
             ON e.user_id = c.c_custkey) x""",
    "auth_events": """
SELECT event_id, CAST(user_id AS VARCHAR) AS id, ts,
       CASE event_type WHEN 'click' THEN 'SIGNED_IN' WHEN 'error' THEN 'SIGNED_OUT'
            ELSE 'OTHER' END AS event
FROM events""",
    "signup_forms": """
SELECT c_custkey AS form_id,
       CASE c_custkey % 5 WHEN 0 THEN c_name WHEN 1 THEN replace(c_name, '#', '_')
            WHEN 2 THEN 'ab' WHEN 3 THEN concat('a_very_long_name_', c_custkey, '_x_y_z')
            ELSE concat('user_', c_custkey) END AS username,
       CASE c_custkey % 6 WHEN 0 THEN 'Password1' WHEN 1 THEN 'password1' WHEN 2 THEN 'PASSWORD1'
            WHEN 3 THEN 'Password' WHEN 4 THEN 'Pa1' ELSE '' END AS password,
       CASE WHEN c_custkey % 7 = 0 THEN 'Different1'
            WHEN c_custkey % 6 = 0 THEN 'Password1' WHEN c_custkey % 6 = 1 THEN 'password1'
            WHEN c_custkey % 6 = 2 THEN 'PASSWORD1' WHEN c_custkey % 6 = 3 THEN 'Password'
            WHEN c_custkey % 6 = 4 THEN 'Pa1' ELSE '' END AS confirm_password
FROM customer""",
    "role_requests": """
SELECT c_custkey AS request_id,
       CASE WHEN c_custkey % 3 = 0 THEN '50' ELSE CAST(c_custkey % 97 AS VARCHAR) END AS actor_id,
       CASE WHEN c_custkey % 13 = 0 THEN 'no-such-id' ELSE CAST(c_custkey AS VARCHAR) END AS target_id,
       CASE WHEN c_custkey % 4 < 2 THEN 'promote' ELSE 'demote' END AS action
FROM customer""",
    # snapshots used by the back-fill, cascade and collision scenarios
    "users_existing": "SELECT * FROM users WHERE CAST(id AS BIGINT) % 7 <> 0",
    "auth_kept": "SELECT * FROM auth_users WHERE CAST(id AS BIGINT) % 11 <> 0",
    # identities the v1 rule cannot all serve: shared, missing and over-long names
    "shared": """
SELECT id, CASE WHEN k % 31 = 0 THEN NULL
                WHEN k % 29 = 0 THEN concat('someone_with_a_long_name_', id, '@example.com')
                WHEN k % 3 = 0 THEN concat('team', k % 40, '@example.com') ELSE email END AS email,
       CASE WHEN k % 31 <> 0 AND k % 29 <> 0 AND k % 3 <> 0 THEN raw_user_meta_data END AS raw_user_meta_data,
       created_at, last_sign_in_at
FROM (SELECT *, CAST(id AS BIGINT) AS k FROM auth_users) x""",
}


def with_views(body: str, *names: str) -> str:
    """Prefix ``body`` with the named views (in the order given) as CTEs."""
    if not names:
        return body
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]}\n)" for n in names)
    return f"WITH {ctes}\n{body}"


def role_rank_sql(col: str = "role") -> str:
    whens = " ".join(f"WHEN '{r}' THEN {i}" for i, r in enumerate(ROLES, start=1))
    return f"CASE {col} {whens} END"


def search_sql(where: str = "", order: str = "created_at DESC NULLS FIRST") -> str:
    cond = f"WHERE {where}" if where else ""
    body = f"""SELECT id, username, role, created_at, last_login,
       row_number() OVER (ORDER BY {order}, id ASC) AS pos
FROM users {cond}"""
    return with_views(body, "users")


# Username cascade (O-25) in SQL, for oracle use.
BASE_USERNAME_SQL = """
CASE
  WHEN json_extract_string(raw_user_meta_data, '$.username') IS NOT NULL
       AND length(trim(json_extract_string(raw_user_meta_data, '$.username'))) > 0
    THEN lower(trim(json_extract_string(raw_user_meta_data, '$.username')))
  WHEN coalesce(json_extract_string(raw_user_meta_data, '$.name'), json_extract_string(raw_user_meta_data, '$.full_name')) IS NOT NULL
       AND length(trim(coalesce(json_extract_string(raw_user_meta_data, '$.name'), json_extract_string(raw_user_meta_data, '$.full_name')))) > 0
       AND length(trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(coalesce(json_extract_string(raw_user_meta_data, '$.name'), json_extract_string(raw_user_meta_data, '$.full_name')))), '[\\s\\-]+', '_', 'g'), '[^a-z0-9_]', '', 'g'), '_+', '_', 'g'), '_')) >= 3
    THEN trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(coalesce(json_extract_string(raw_user_meta_data, '$.name'), json_extract_string(raw_user_meta_data, '$.full_name')))), '[\\s\\-]+', '_', 'g'), '[^a-z0-9_]', '', 'g'), '_+', '_', 'g'), '_')
  WHEN email IS NOT NULL AND email LIKE '%@app.local' AND length(split_part(email, '@', 1)) >= 3
    THEN lower(split_part(email, '@', 1))
  ELSE concat('user_', substr(id, 1, 8))
END"""

# the crowded directory: of every third identity, names 0..k % 23 (ten at most) are held
VIEWS["crowd"] = f"""
SELECT concat('held-', id, '-', j) AS id,
       CASE WHEN j = 0 THEN base ELSE concat(base, '_', substr(md5(concat(id, ':', j)), 1, 4)) END AS username
FROM (SELECT id, CAST(id AS BIGINT) AS k, {BASE_USERNAME_SQL} AS base FROM auth_users) a, range(0, 11) t(j)
WHERE k % 3 = 0 AND j <= k % 23"""

V1_USERNAME_SQL = "coalesce(json_extract_string(raw_user_meta_data, '$.username'), split_part(email, '@', 1))"


def collision_sql(new_rel: str, existing_rel: str, rounds: int = 10, p: str = "") -> str:
    """O-27 as unrolled SQL: returns CTE text defining ``resolved(id, base, username, attempt)``.

    ``new_rel`` has (id, base, created_at); ``existing_rel`` has (username);
    ``p`` prefixes the CTE names, so that batches can follow each other.
    """
    parts = [
        f"""{p}w0 AS (
  SELECT id, base AS username, 0 AS attempt FROM (
    SELECT id, base, row_number() OVER (PARTITION BY base ORDER BY created_at NULLS LAST, id) AS rn
    FROM {new_rel} n
    WHERE NOT EXISTS (SELECT 1 FROM {existing_rel} e WHERE e.username = n.base)) t
  WHERE rn = 1)""",
        f"""{p}rest AS (SELECT * FROM {new_rel} n WHERE NOT EXISTS (SELECT 1 FROM {p}w0 w WHERE w.id = n.id))""",
        f"""{p}cands AS (
  SELECT r.id, r.created_at, t.k,
         concat(r.base, '_', substr(md5(concat(r.id, ':', CAST(t.k AS VARCHAR))), 1, 4)) AS cand
  FROM {p}rest r, range(1, {rounds + 1}) t(k))""",
        f"""{p}freec AS (
  SELECT * FROM {p}cands c
  WHERE NOT EXISTS (SELECT 1 FROM {existing_rel} e WHERE e.username = c.cand)
    AND NOT EXISTS (SELECT 1 FROM {p}w0 w WHERE w.username = c.cand))""",
    ]
    for k in range(1, rounds + 1):
        prior = " UNION ALL ".join(f"SELECT id, username FROM {p}a{j}" for j in range(1, k))
        extra = ""
        if prior:
            extra = (
                f"\n      AND NOT EXISTS (SELECT 1 FROM ({prior}) o WHERE o.id = f.id)"
                f"\n      AND NOT EXISTS (SELECT 1 FROM ({prior}) o WHERE o.username = f.cand)"
            )
        parts.append(
            f"""{p}a{k} AS (
  SELECT id, cand AS username, {k} AS attempt FROM (
    SELECT f.id, f.cand, row_number() OVER (PARTITION BY f.cand ORDER BY f.created_at NULLS LAST, f.id) AS rn
    FROM {p}freec f
    WHERE f.k = {k}{extra}) t
  WHERE rn = 1)"""
        )
    accepted = " UNION ALL ".join([f"SELECT * FROM {p}w0"] + [f"SELECT * FROM {p}a{k}" for k in range(1, rounds + 1)])
    parts.append(
        f"""{p}resolved AS (
  SELECT n.id, n.base, acc.username, acc.attempt,
         concat(n.base, '_', substr(md5(concat(n.id, ':', '{rounds}')), 1, 4)) AS last_candidate
  FROM {new_rel} n LEFT JOIN ({accepted}) acc ON acc.id = n.id)"""
    )
    return ",\n".join(parts)


# ------------------------------------------------------------ registered SQL

_DAY_RANGE = "created_at >= TIMESTAMP '{a} 00:00:00' AND created_at <= TIMESTAMP '{b} 23:59:59.999'"

ORACLE: dict[str, str] = {
    "search_default": search_sql(),
    "search_q": search_sql("username ILIKE '%team%'"),
    "search_role": search_sql("role = 'ADMIN'"),
    "search_joined_range": search_sql(_DAY_RANGE.format(a="1993-01-01", b="1995-06-30")),
    "search_combined": search_sql(
        "username ILIKE '%team%' AND role = 'USER' AND " + _DAY_RANGE.format(a="1992-01-01", b="1996-12-31"),
        "last_login DESC NULLS FIRST",
    ),
    "search_fallback_sort": search_sql("", "created_at ASC NULLS LAST"),
    "search_mapped_sort": search_sql("", "last_login DESC NULLS FIRST"),
    "search_wildcard": search_sql("username ILIKE '%r_0%'"),
    "search_literal": search_sql("username ILIKE '%r\\_0%' ESCAPE '\\'"),
    "sort_role_enum": search_sql("", f"{role_rank_sql()} ASC NULLS LAST"),
    "sort_last_login_nulls": search_sql("", "last_login ASC NULLS LAST"),
    "search_from_ui": search_sql("username ILIKE '%team%' AND role = 'USER'", "username ASC NULLS LAST"),
    "list_directory": with_views(
        """SELECT id, username, role, created_at,
       row_number() OVER (ORDER BY created_at ASC NULLS LAST, id ASC) AS pos
FROM users""",
        "users",
    ),
    "directory_count": with_views("SELECT count(*) AS total_users FROM users", "users"),
    "profile_by_id": with_views(
        "SELECT id, username, role, created_at, last_login FROM users WHERE id = '7'", "users"
    ),
    "profile_display": with_views(
        """SELECT id, username, upper(substr(username, 1, 1)) AS initial,
       coalesce(strftime(created_at, '%Y-%m-%d'), 'N/A') AS joined,
       coalesce(strftime(last_login, '%Y-%m-%d %H:%M:%S'), 'Never') AS last_seen
FROM users""",
        "users",
    ),
}


def with_ctes(body: str, views: tuple[str, ...] = (), extra: tuple[str, ...] = ()) -> str:
    """Views (by name) then extra ``name AS (...)`` CTE texts, then ``body``."""
    parts = [f"{n} AS ({VIEWS[n]}\n)" for n in views] + list(extra)
    return ("WITH " + ",\n".join(parts) + "\n" + body) if parts else body


_PROFILE_NULLS = "CAST(NULL AS TIMESTAMP) AS last_login"
_CLAIMS_V2 = f"claims AS (SELECT id, {BASE_USERNAME_SQL} AS base, created_at FROM auth_users)"


def v1_sql(new_rel: str, existing_rel: str) -> str:
    """v1 rule as CTE text ``v1(id, created_at, username, reason)``: reason is NULL for what is stored."""
    return f"""v1 AS (
  SELECT id, created_at, username, CASE
           WHEN username IS NULL THEN 'username_not_null' WHEN length(username) > 20 THEN 'username_length'
           WHEN rn > 1 OR EXISTS (SELECT 1 FROM {existing_rel} e WHERE e.username = x.username) THEN 'username_unique'
         END AS reason
  FROM (SELECT *, row_number() OVER (PARTITION BY username ORDER BY created_at NULLS LAST, id) AS rn
        FROM (SELECT id, created_at, {V1_USERNAME_SQL} AS username FROM {new_rel} a
              WHERE NOT EXISTS (SELECT 1 FROM {existing_rel} u WHERE u.id = a.id)) n) x)"""


_BACKFILL_CTE = v1_sql("auth_users", "users_existing")
_BACKFILL = f"""SELECT id, username, role, created_at, last_login, avatar_url FROM users_existing
UNION ALL
SELECT id, username, 'USER' AS role, coalesce(created_at, {AS_OF_SQL}) AS created_at,
       {_PROFILE_NULLS}, CAST(NULL AS VARCHAR) AS avatar_url
FROM v1 WHERE reason IS NULL"""
_SEEDS = f"""seeds AS (
  SELECT * FROM (VALUES ('Ada', 'USER'), ('Noor', 'ADMIN'), ('Kim', 'USER'), ('Root', 'SUPER_ADMIN')) v(username, role)
  UNION ALL
  SELECT concat('User', c_custkey) AS username,
         CASE WHEN c_custkey % 4 = 1 THEN 'ADMIN' WHEN c_custkey % 4 = 3 THEN 'SUPER_ADMIN' ELSE 'USER' END AS role
  FROM customer),
directory AS (
  SELECT id, username, role, created_at, last_login, avatar_url FROM users
  UNION ALL
  SELECT concat('held-', id, '-', j), CASE WHEN j = 0 THEN base ELSE concat(base, '_', substr(md5(concat(id, ':', j)), 1, 4)) END,
         'USER', NULL, NULL, NULL
  FROM (SELECT concat('user', c_custkey) AS base, md5(concat('user', c_custkey, '@app.local')) AS id
        FROM customer WHERE c_custkey % 10 = 5) h, range(0, 11) t(j)),
batch AS (SELECT concat(lower(username), '@app.local') AS email, min(username) AS username,
                 arg_max(role, {role_rank_sql()}) AS role
          FROM seeds GROUP BY concat(lower(username), '@app.local')),
known AS (SELECT lower(email) AS email, min(id) AS id FROM auth_users WHERE email IS NOT NULL GROUP BY lower(email)),
matched AS (SELECT b.email, k.id, b.role FROM batch b JOIN known k ON k.email = b.email),
fresh AS (SELECT md5(b.email) AS id, b.email, concat('{{"username":"', b.username, '"}}') AS raw_user_meta_data,
                 {AS_OF_SQL} AS created_at, b.role
          FROM batch b WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.email = b.email)),
claims AS (SELECT id, {BASE_USERNAME_SQL} AS base, created_at FROM fresh c
           WHERE NOT EXISTS (SELECT 1 FROM directory u WHERE u.id = c.id)),
{collision_sql("claims", "directory")},
created AS (SELECT c.* FROM fresh c WHERE NOT EXISTS (SELECT 1 FROM resolved r WHERE r.id = c.id AND r.username IS NULL))"""

ORACLE.update(
    {
        "derive_username": with_views(
            f"SELECT id, {BASE_USERNAME_SQL} AS base_username FROM auth_users", "auth_users"
        ),
        "profiles_v1": with_ctes(
            f"""SELECT id, username, 'USER' AS role, {AS_OF_SQL} AS created_at, {_PROFILE_NULLS}, CAST(NULL AS VARCHAR) AS avatar_url
FROM v1 WHERE reason IS NULL""",
            ("auth_users", "crowd", "shared"),
            (v1_sql("shared", "crowd"),),
        ),
        "profiles_v2": with_ctes(
            f"""SELECT r.id, r.username, 'USER' AS role, {AS_OF_SQL} AS created_at, {_PROFILE_NULLS},
       json_extract_string(n.raw_user_meta_data, '$.avatar_url') AS avatar_url
FROM resolved r JOIN auth_users n ON n.id = r.id
WHERE r.username IS NOT NULL""",
            ("auth_users", "crowd"),
            (_CLAIMS_V2, collision_sql("claims", "crowd")),
        ),
        "profiles_rejected": with_ctes(
            """SELECT id, username, reason, 'v1' AS variant FROM v1 WHERE reason IS NOT NULL
UNION ALL
SELECT id, last_candidate, 'username_unique', 'v2' FROM resolved WHERE username IS NULL""",
            ("auth_users", "crowd", "shared"),
            (v1_sql("shared", "crowd"), _CLAIMS_V2, collision_sql("claims", "crowd")),
        ),
        "resolve_collisions": with_ctes(
            """SELECT id, base, username, CAST(attempt AS BIGINT) AS attempt,
       CASE WHEN username IS NULL THEN 'rejected' ELSE 'ok' END AS status
FROM resolved""",
            ("auth_users", "crowd"),
            (_CLAIMS_V2, collision_sql("claims", "crowd")),
        ),
        "backfill_missing_profiles": with_ctes(_BACKFILL, ("users", "auth_users", "users_existing"), (_BACKFILL_CTE,)),
        "backfill_rejected": with_ctes(
            "SELECT id, username, reason FROM v1 WHERE reason IS NOT NULL",
            ("auth_users", "crowd", "shared"),
            (v1_sql("shared", "crowd"),),
        ),
        "backfill_avatar": with_views(
            """SELECT u.id, u.username, u.role, u.created_at, u.last_login,
       coalesce(u.avatar_url, json_extract_string(a.raw_user_meta_data, '$.avatar_url')) AS avatar_url
FROM users u LEFT JOIN auth_users a ON a.id = u.id""",
            "users",
            "auth_users",
        ),
        "login_touch": with_ctes(
            """SELECT s.id, s.username, s.role, s.created_at, greatest(s.last_login, t.touch) AS last_login, s.avatar_url
FROM snap s LEFT JOIN t ON t.id = s.id""",
            ("users", "auth_users", "users_existing", "auth_events"),
            (
                _BACKFILL_CTE,
                f"snap AS ({_BACKFILL})",
                "t AS (SELECT id, max(ts) AS touch FROM auth_events WHERE event = 'SIGNED_IN' GROUP BY id)",
            ),
        ),
        "cascade_delete": with_views(
            """SELECT id, username, role, created_at, last_login, avatar_url FROM users u
WHERE EXISTS (SELECT 1 FROM auth_kept a WHERE a.id = u.id)""",
            "users",
            "auth_users",
            "auth_kept",
        ),
        "seed_upsert": with_ctes(
            f"""SELECT s.id, s.username, coalesce(p.role, s.role) AS role, s.created_at, s.last_login, s.avatar_url
FROM snap s LEFT JOIN patches p ON p.id = s.id""",
            ("users", "auth_users"),
            (
                _SEEDS,
                f"""snap AS (
  SELECT id, username, role, created_at, last_login, avatar_url FROM directory
  UNION ALL
  SELECT r.id, r.username, 'USER' AS role, {AS_OF_SQL} AS created_at, {_PROFILE_NULLS},
         json_extract_string(c.raw_user_meta_data, '$.avatar_url') AS avatar_url
  FROM resolved r JOIN created c ON c.id = r.id WHERE r.username IS NOT NULL)""",
                """patches AS (
  SELECT id, role FROM matched WHERE role <> 'USER'
  UNION ALL
  SELECT id, role FROM created WHERE role <> 'USER')""",
            ),
        ),
    }
)


_ADMINS = "('ADMIN', 'SUPER_ADMIN')"
_BROKEN = """broken AS (
  SELECT id, username, role FROM users
  UNION ALL SELECT NULL, concat('noid_', id), 'USER' FROM users WHERE CAST(id AS BIGINT) % 101 = 1
  UNION ALL SELECT concat('x', id), NULL, 'USER' FROM users WHERE CAST(id AS BIGINT) % 103 = 1
  UNION ALL SELECT concat('y', id), concat('a_very_long_username_', id), 'USER' FROM users WHERE CAST(id AS BIGINT) % 107 = 1
  UNION ALL SELECT concat('z', id), concat('z', id), 'OWNER' FROM users WHERE CAST(id AS BIGINT) % 109 = 1
  UNION ALL SELECT id, concat('dup_', id), 'USER' FROM users WHERE CAST(id AS BIGINT) % 113 = 1
  UNION ALL SELECT concat('w', id), username, 'USER' FROM users WHERE CAST(id AS BIGINT) % 127 = 1)"""
_OUTCOMES = """SELECT request_id, actor_id, target_id, action, status, old_role,
       CASE WHEN status = 'applied' THEN CASE action WHEN 'promote' THEN 'ADMIN' ELSE 'USER' END
            ELSE old_role END AS new_role
FROM (SELECT r.request_id, r.actor_id, r.target_id, r.action, t.role AS old_role,
             CASE WHEN coalesce(a.role <> 'SUPER_ADMIN', true) THEN 'forbidden'
                  WHEN t.id IS NULL THEN 'not_found'
                  WHEN NOT coalesce(r.action IN ('promote', 'demote'), false)
                       OR t.role <> CASE r.action WHEN 'promote' THEN 'USER' ELSE 'ADMIN' END THEN 'invalid'
                  ELSE 'applied' END AS status
      FROM role_requests r
      LEFT JOIN users a ON a.id = r.actor_id
      LEFT JOIN users t ON t.id = r.target_id) x"""


def _form_check_sql(rules: list[tuple[str, str]]) -> str:
    cols = ",\n       ".join(f"CASE WHEN {cond} THEN '{msg}' END AS m{i}" for i, (cond, msg) in enumerate(rules))
    names = [f"m{i}" for i in range(len(rules))]
    count = " + ".join(f"CAST({n} IS NOT NULL AS BIGINT)" for n in names)
    return with_views(
        f"""SELECT form_id, username, concat_ws('|', {", ".join(names)}) AS errors,
       CAST({count} AS BIGINT) AS n_errors, ({count}) = 0 AS valid
FROM (SELECT form_id, username,
       {cols}
      FROM (SELECT form_id, username, coalesce(username, '') AS u, coalesce(password, '') AS p,
                   coalesce(confirm_password, '') AS c FROM signup_forms) f) g""",
        "signup_forms",
    )


_SIGNUP_RULES = [
    ("length(u) < 3", "Username must be at least 3 characters."),
    ("length(u) > 20", "Username must be under 20 characters."),
    ("NOT regexp_full_match(u, '[a-zA-Z0-9_]+')", "Only letters, numbers, and underscores allowed."),
    ("length(p) < 6", "Password must be at least 6 characters."),
    ("NOT regexp_matches(p, '[A-Z]')", "Must contain one uppercase letter."),
    ("NOT regexp_matches(p, '[a-z]')", "Must contain one lowercase letter."),
    ("NOT regexp_matches(p, '[0-9]')", "Must contain one number."),
    ("p <> c", "Passwords don''t match"),
]
_LOGIN_RULES = [("length(u) < 1", "Username is required."), ("length(p) < 1", "Password is required.")]

_SESSION = f"""SELECT l.id, l.event AS last_event, l.ts AS last_event_at,
       (l.event = 'SIGNED_IN' AND u.role IS NOT NULL) AS signed_in,
       CASE WHEN l.event = 'SIGNED_IN' AND u.role IS NOT NULL THEN u.username END AS username,
       CASE WHEN l.event = 'SIGNED_IN' AND u.role IS NOT NULL THEN u.role END AS role,
       CASE WHEN l.event = 'SIGNED_IN' AND u.role IS NULL THEN 'Failed to load user profile.' END AS auth_error,
       CASE WHEN l.event = 'SIGNED_IN' AND u.role IS NOT NULL
            THEN CASE WHEN u.role IN {_ADMINS} THEN '/admin-dashboard' ELSE '/dashboard' END END AS landing
FROM (SELECT id, event, ts FROM (
        SELECT id, event, ts, row_number() OVER (PARTITION BY id ORDER BY ts DESC NULLS LAST, event_id DESC) AS rn
        FROM auth_events WHERE event IN ('SIGNED_IN', 'SIGNED_OUT') AND id IS NOT NULL) e
      WHERE rn = 1) l
LEFT JOIN users_existing u ON u.id = l.id"""

ORACLE.update(
    {
        "visible_rows_user": with_views("SELECT * FROM users WHERE id = '2'", "users"),
        "visible_rows_admin": with_views("SELECT * FROM users", "users"),
        "visible_counts": with_views(
            f"""SELECT id AS actor_id,
       CAST(CASE WHEN role IN {_ADMINS} THEN (SELECT count(*) FROM users) ELSE 1 END AS BIGINT) AS visible_rows
FROM users""",
            "users",
        ),
        "permission_flags": with_views(
            f"""SELECT r.request_id, r.actor_id, r.target_id,
       coalesce(a.role IN {_ADMINS}, false) AS is_admin,
       coalesce(a.role = 'SUPER_ADMIN', false) AND coalesce(t.role = 'USER', false) AS can_promote,
       coalesce(a.role = 'SUPER_ADMIN', false) AND coalesce(t.role = 'ADMIN', false) AS can_demote
FROM role_requests r LEFT JOIN users a ON a.id = r.actor_id LEFT JOIN users t ON t.id = r.target_id""",
            "users",
            "role_requests",
        ),
        "change_roles": with_views(_OUTCOMES, "users", "role_requests"),
        "change_roles_snapshot": with_ctes(
            """SELECT u.id, u.username, coalesce(c.new_role, u.role) AS role, u.created_at, u.last_login, u.avatar_url
FROM users u LEFT JOIN (SELECT target_id, arg_max(new_role, request_id) AS new_role
                        FROM outcomes WHERE status = 'applied' GROUP BY target_id) c ON c.target_id = u.id""",
            ("users", "role_requests"),
            (f"outcomes AS ({_OUTCOMES})",),
        ),
        "signup_check": _form_check_sql(_SIGNUP_RULES),
        "login_check": _form_check_sql(_LOGIN_RULES),
        "constraint_report": with_ctes(
            """SELECT 'id_not_null' AS rule, username AS key FROM broken WHERE id IS NULL
UNION ALL SELECT 'username_not_null', id FROM broken WHERE username IS NULL
UNION ALL SELECT 'username_length', id FROM broken WHERE length(username) > 20
UNION ALL SELECT 'role_enum', id FROM broken WHERE role IS NULL OR role NOT IN ('USER', 'ADMIN', 'SUPER_ADMIN')
UNION ALL SELECT 'id_unique', id FROM broken WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'username_unique', username FROM broken WHERE username IS NOT NULL GROUP BY username HAVING count(*) > 1
UNION ALL SELECT 'identity_exists', id FROM broken u
          WHERE id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM auth_kept a WHERE a.id = u.id)""",
            ("users", "auth_users", "auth_kept"),
            (_BROKEN,),
        ),
        "session_state": with_views(_SESSION, "users", "users_existing", "auth_events"),
    }
)

# streaming jobs must agree with their batch counterparts
ORACLE["session_state_stream"] = ORACLE["session_state"]
ORACLE["session_attached_stream"] = ORACLE["session_state"]
ORACLE["login_touch_stream"] = ORACLE["login_touch"]


def _stream_sql(batches: int = 4, rejects: bool = False) -> str:
    """v2 profiles (or rejects) of the identities with k % batches = 0, then 1, ...: each batch sees the names before it."""
    ctes = [_CLAIMS_V2]
    for i in range(batches):
        earlier = "".join(f" UNION ALL SELECT username FROM b{j}_resolved WHERE username IS NOT NULL" for j in range(i))
        ctes.append(f"b{i}_new AS (SELECT * FROM claims WHERE CAST(id AS BIGINT) % {batches} = {i})")
        ctes.append(f"b{i}_held AS (SELECT username FROM crowd{earlier})")
        ctes.append(collision_sql(f"b{i}_new", f"b{i}_held", p=f"b{i}_"))
    if rejects:
        parts = [f"SELECT id, last_candidate FROM b{i}_resolved WHERE username IS NULL" for i in range(batches)]
        body = f"SELECT id, last_candidate AS username, 'username_unique' AS reason FROM ({' UNION ALL '.join(parts)})"
        return with_ctes(body, ("auth_users", "crowd"), tuple(ctes))
    made = " UNION ALL ".join(f"SELECT id, username FROM b{i}_resolved WHERE username IS NOT NULL" for i in range(batches))
    body = f"""SELECT r.id, r.username, 'USER' AS role, {AS_OF_SQL} AS created_at, {_PROFILE_NULLS},
       json_extract_string(n.raw_user_meta_data, '$.avatar_url') AS avatar_url
FROM ({made}) r JOIN auth_users n ON n.id = r.id"""
    return with_ctes(body, ("auth_users", "crowd"), tuple(ctes))


ORACLE["profiles_stream"] = _stream_sql()
ORACLE["profiles_stream_rejected"] = _stream_sql(rejects=True)

ORACLE.update(
    {
        "seed_report": with_ctes(
            """SELECT email, id, 'existing' AS status, role FROM matched
UNION ALL
SELECT email, id, CASE WHEN EXISTS (SELECT 1 FROM created c WHERE c.id = f.id) THEN 'created' ELSE 'rejected' END, role
FROM fresh f""",
            ("users", "auth_users"),
            (_SEEDS,),
        ),
        "seed_identities": with_ctes(
            """SELECT id, email, raw_user_meta_data, created_at, last_sign_in_at FROM auth_users
UNION ALL
SELECT id, email, raw_user_meta_data, created_at, NULL FROM created""",
            ("users", "auth_users"),
            (_SEEDS,),
        ),
        "scan_users": with_views("SELECT * FROM users", "users"),
        "scan_auth_users": with_views("SELECT * FROM auth_users", "auth_users"),
        "username_taken": with_views(
            f"""SELECT a.id, a.base_username,
       EXISTS (SELECT 1 FROM users_existing u WHERE u.username = a.base_username) AS taken
FROM (SELECT id, {BASE_USERNAME_SQL} AS base_username FROM auth_users) a""",
            "users",
            "auth_users",
            "users_existing",
        ),
        "signup_accounts": f"""SELECT form_id, username, concat(username, '@app.local') AS email
FROM ({_form_check_sql(_SIGNUP_RULES)}) s WHERE valid""",
        "profile_sink": ORACLE["backfill_avatar"],
    }
)

_report = ORACLE["constraint_report"]
_split = _report.index("SELECT 'id_not_null' AS rule")
ORACLE["constraint_report_incremental"] = (
    f"{_report[:_split]} SELECT rule, key, count(*) AS violations FROM ({_report[_split:]}) GROUP BY rule, key"
)

# the same questions over other storage: index, layout, buckets, policy view
_ROW = "SELECT id, username, role, created_at, last_login FROM users"
ORACLE.update(
    {
        "search_indexed": search_sql("username ILIKE '%00123%'"),
        "search_indexed_wildcard": search_sql("username ILIKE '%ER#0%12_%'", "username ASC NULLS LAST"),
        "clustered_range": with_views(f"{_ROW} WHERE {_DAY_RANGE.format(a='1993-01-01', b='1995-06-30')}", "users"),
        "clustered_profile": ORACLE["profile_by_id"],
        "profile_by_bloom": ORACLE["profile_by_id"],
        "bucketed_backfill": ORACLE["backfill_missing_profiles"],
        "bucketed_cascade_delete": ORACLE["cascade_delete"],
        "bucketed_login_touch": with_ctes(
            """SELECT s.id, s.username, s.role, s.created_at, greatest(s.last_login, t.touch) AS last_login, s.avatar_url
FROM users s LEFT JOIN t ON t.id = s.id""",
            ("users", "auth_events"),
            ("t AS (SELECT id, max(ts) AS touch FROM auth_events WHERE event = 'SIGNED_IN' GROUP BY id)",),
        ),
        "change_roles_returning": with_ctes(
            """SELECT o.request_id, u.id, u.username, o.new_role AS role, u.created_at, u.last_login, u.avatar_url
FROM outcomes o JOIN users u ON u.id = o.target_id WHERE o.status = 'applied'""",
            ("users", "role_requests"),
            (f"outcomes AS ({_OUTCOMES})",),
        ),
        "policy_search_user": with_views(f"{_ROW} WHERE id = '7'", "users"),
        "policy_search_admin": with_views(f"{_ROW} WHERE username ILIKE '%team%'", "users"),
        "policy_count_user": with_views("SELECT count(*) AS total_users FROM users WHERE id = '7'", "users"),
    }
)
ORACLE["changed_snapshots"] = f"SELECT * FROM ({ORACLE['change_roles_snapshot']}) WHERE CAST(id AS BIGINT) % 11 <> 0"
