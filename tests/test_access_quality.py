"""Visibility, role changes, permission flags, form checks and constraints."""

import datetime as dt

import pytest

from rollcall.functions import validation as M
from rollcall.operators import access as A
from rollcall.operators import quality as Q
from rollcall.operators.joins import hot_keys, hot_keys_by_column, lookup_join
from rollcall.sources.schemas import USERS

D = dt.datetime


@pytest.fixture()
def people(spark):
    rows = [
        ("s", "sam", "SUPER_ADMIN", D(2020, 1, 1), None, None),
        ("a", "ann", "ADMIN", D(2020, 1, 2), None, None),
        ("u", "uma", "USER", D(2020, 1, 3), None, None),
        ("v", "vic", "USER", D(2020, 1, 4), None, None),
    ]
    return spark.createDataFrame(rows, USERS)


def test_visibility(people):
    assert A.visible_to(people, "u").count() == 1
    assert A.visible_to(people, "a").count() == 4
    assert A.visible_to(people, "s").count() == 4
    assert A.visible_to(people, "ghost").count() == 0
    with pytest.raises(A.NoSession, match="No active session"):
        A.visible_to(people, None)
    counts = {r["actor_id"]: r["visible_rows"] for r in A.visible_counts(people).collect()}
    assert counts == {"s": 4, "a": 4, "u": 1, "v": 1}


def requests(spark, rows):
    return spark.createDataFrame(rows, "request_id long, actor_id string, target_id string, action string")


def test_role_changes(spark, people):
    reqs = requests(
        spark,
        [
            (1, "s", "u", "promote"),
            (2, "s", "a", "demote"),
            (3, "a", "v", "promote"),  # only SUPER_ADMIN may
            (4, "s", "nobody", "promote"),
            (5, "s", "s", "demote"),  # SUPER_ADMIN -> USER is not allowed
            (6, "s", "v", "delete"),
            (7, None, "v", "promote"),
        ],
    )
    out = {r["request_id"]: (r["status"], r["new_role"]) for r in A.role_change_outcomes(reqs, people).collect()}
    assert out == {
        1: ("applied", "ADMIN"),
        2: ("applied", "USER"),
        3: ("forbidden", "USER"),
        4: ("not_found", None),
        5: ("invalid", "SUPER_ADMIN"),
        6: ("invalid", "USER"),
        7: ("forbidden", "USER"),
    }
    snap = {r["id"]: r["role"] for r in A.apply_role_changes(people, A.role_change_outcomes(reqs, people)).collect()}
    assert snap == {"s": "SUPER_ADMIN", "a": "USER", "u": "ADMIN", "v": "USER"}


def test_permission_flags(spark, people):
    reqs = requests(spark, [(1, "s", "u", None), (2, "s", "a", None), (3, "a", "u", None), (4, "u", "a", None), (5, "x", "u", None)])
    flags = {r["request_id"]: (r["is_admin"], r["can_promote"], r["can_demote"]) for r in A.permission_flags(reqs, people).collect()}
    assert flags == {
        1: (True, True, False),
        2: (True, False, True),
        3: (True, False, False),
        4: (False, False, False),
        5: (False, False, False),
    }


def test_lookup_join_with_hot_keys(spark, people):
    # one actor files most requests: it is served by broadcasting its single profile row
    rows = [(i, "s" if i % 3 else "u", "v", "promote") for i in range(3000)] + [(3000, None, "a", None), (3001, "x", None, None)]
    reqs = requests(spark, rows)
    hot = hot_keys_by_column(reqs, ["actor_id", "target_id"])
    assert hot == {"actor_id": ["s", "u"], "target_id": ["v"]} and hot_keys(reqs, "actor_id") == ["s", "u"]
    dim = people.select("id", "role")
    role = {r["id"]: r["role"] for r in dim.collect()}
    want = sorted((i, role.get(a), role.get(t)) for i, a, t, _ in rows)
    for some in (hot, {"actor_id": ["s"], "target_id": []}, {"actor_id": [], "target_id": []}):
        out = lookup_join(reqs, ["actor_id", "target_id"], dim, "id", hot=some)
        got = out.selectExpr("request_id", "actor_id_row.role as a", "target_id_row.role as t").collect()
        assert sorted(map(tuple, got)) == want
    plan = out._sc._jvm.PythonSQLUtils.explainString(
        lookup_join(reqs, ["actor_id"], dim, "id", hot=hot)._jdf.queryExecution(), "formatted"
    )
    assert "BroadcastExchange" in plan


def test_all_hot_keys_are_kept(spark):
    """1,499 keys of two rows among 2,998: all reach a floored threshold; the ceiling keeps the list bounded and whole."""
    df = spark.range(2998).selectExpr("cast(id % 1499 as string) as k")
    assert hot_keys(df, "k", fraction=0.001) == []  # ceil(2.998) = 3 rows are needed
    many = df.unionByName(spark.range(1499).selectExpr("cast(id as string) as k"))
    assert len(hot_keys(many, "k", fraction=3 / 4497)) == 1499


def forms(spark, rows):
    return spark.createDataFrame(rows, "form_id long, username string, password string, confirm_password string")


def test_signup_rules(spark):
    df = forms(
        spark,
        [
            (1, "ab", "Password1", "Password1"),
            (2, "abc", "Password1", "Password1"),
            (3, "a" * 20, "Password1", "Password1"),
            (4, "a" * 21, "Password1", "Password1"),
            (5, "bad name!", "Password1", "Password1"),
            (6, "good", "Pa1", "Pa1"),
            (7, "good", "password1", "password1"),
            (8, "good", "PASSWORD1", "PASSWORD1"),
            (9, "good", "Password", "Password"),
            (10, "good", "Password1", "Password2"),
            (11, "line\n", "Password1", "Password1"),
            (12, None, None, None),
            (13, "good", "Pa1\U0001F600\U0001F600", "Pa1\U0001F600\U0001F600"),  # 7 UTF-16 units: long enough
            (14, "good", "Pa1\U0001F600", "Pa1\U0001F600"),  # 5 units: too short
        ],
    )
    got = {r["form_id"]: (r["errors"], r["valid"]) for r in Q.signup_check(df).collect()}
    assert got[2] == ([], True) and got[3] == ([], True)
    assert got[1] == ([M.MSG_USERNAME_SHORT], False)
    assert got[4] == ([M.MSG_USERNAME_LONG], False)
    assert got[5] == ([M.MSG_USERNAME_CHARS], False)
    assert got[6] == ([M.MSG_PASSWORD_SHORT], False)
    assert got[7] == ([M.MSG_PASSWORD_UPPER], False)
    assert got[8] == ([M.MSG_PASSWORD_LOWER], False)
    assert got[9] == ([M.MSG_PASSWORD_DIGIT], False)
    assert got[10] == ([M.MSG_MISMATCH], False)
    assert got[11] == ([M.MSG_USERNAME_CHARS], False)  # JavaScript's '$' does not match before '\n'
    assert got[13] == ([], True) and got[14] == ([M.MSG_PASSWORD_SHORT], False)
    assert got[12][0] == [
        M.MSG_USERNAME_SHORT,
        M.MSG_USERNAME_CHARS,
        M.MSG_PASSWORD_SHORT,
        M.MSG_PASSWORD_UPPER,
        M.MSG_PASSWORD_LOWER,
        M.MSG_PASSWORD_DIGIT,
    ]
    assert "password" not in Q.signup_check(df).columns


def test_login_rules(spark):
    df = forms(spark, [(1, "", "x", None), (2, "x", "", None), (3, "x", "y", None)])
    got = {r["form_id"]: r["errors"] for r in Q.login_check(df).collect()}
    assert got == {1: [M.MSG_USERNAME_REQUIRED], 2: [M.MSG_PASSWORD_REQUIRED], 3: []}


def test_constraint_report(spark):
    rows = [
        ("1", "dup", "USER", None, None, None),
        ("2", "dup", "USER", None, None, None),
        ("2", "x" * 21, "ROOT", None, None, None),
        ("4", "ok", "ADMIN", None, None, None),
    ]
    users = spark.createDataFrame(rows, "id string, username string, role string, created_at timestamp_ntz, last_login timestamp_ntz, avatar_url string")
    auth = spark.createDataFrame([("1",), ("2",)], "id string")
    got = sorted(tuple(r) for r in Q.constraint_report(users, auth).collect())
    assert got == sorted(
        [
            ("username_unique", "dup"),
            ("id_unique", "2"),
            ("username_length", "2"),
            ("role_enum", "2"),
            ("identity_exists", "4"),
        ]
    )
