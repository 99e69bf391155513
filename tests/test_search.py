"""Search, sort and reads on hand-made rows: traps T-1, T-2, T-4, T-5, T-8."""

import datetime as dt

import pytest

from rollcall.operators import search as S
from rollcall.plans.positions import with_position
from rollcall.sources.schemas import USERS

D = dt.datetime


def users_df(spark, rows):
    full = [(r + (None,) * (6 - len(r))) for r in rows]
    return spark.createDataFrame(full, USERS)


@pytest.fixture()
def people(spark):
    return users_df(
        spark,
        [
            ("1", "alice", "USER", D(2024, 1, 1), D(2024, 3, 1)),
            ("2", "bob", "ADMIN", D(2024, 1, 2), None),
            ("3", "carol", "SUPER_ADMIN", None, D(2024, 2, 1)),
            ("4", "a_b", "USER", D(2024, 1, 3), None),
            ("5", "aXb", "USER", D(2024, 1, 4), D(2024, 1, 5)),
            ("6", "a%b", "ADMIN", D(2024, 1, 5), None),
            ("7", "a\\b", "USER", D(2024, 1, 6), None),
        ],
    )


def ids(df):
    return [r["id"] for r in df.collect()]


def test_default_sort_is_created_desc_nulls_first(people):
    out = ids(S.search(people, S.SearchRequest()))
    assert out == ["3", "7", "6", "5", "4", "2", "1"]


def test_ascending_puts_nulls_last(people):
    out = ids(S.search(people, S.SearchRequest(sort_by="created_at", sort_dir="asc")))
    assert out[-1] == "3" and out[0] == "1"
    out = ids(S.search(people, S.SearchRequest(sort_by="last_login", sort_dir="asc")))
    assert out[:3] == ["5", "3", "1"]  # then the nulls, by id
    assert out[3:] == ["2", "4", "6", "7"]


def test_descending_puts_nulls_first(people):
    out = ids(S.search(people, S.SearchRequest(sort_by="last_login", sort_dir="desc")))
    assert out[:4] == ["2", "4", "6", "7"] and out[4:] == ["1", "3", "5"]


def test_role_sorts_in_enum_order(people):
    out = S.search(people, S.SearchRequest(sort_by="role", sort_dir="asc")).collect()
    roles = [r["role"] for r in out]
    assert roles == ["USER"] * 4 + ["ADMIN"] * 2 + ["SUPER_ADMIN"]
    out = S.search(people, S.SearchRequest(sort_by="role")).collect()
    assert out[0]["role"] == "SUPER_ADMIN" and out[-1]["role"] == "USER"


def test_unknown_sort_key_falls_back_and_ui_aliases(people):
    strict = ids(S.search(people, S.SearchRequest(sort_by="lastLogin", sort_dir="asc")))
    by_created = ids(S.search(people, S.SearchRequest(sort_by="created_at", sort_dir="asc")))
    assert strict == by_created
    mapped = ids(S.search(people, S.SearchRequest(sort_by="lastLogin", sort_dir="asc", sort_aliases="mapped")))
    assert mapped == ids(S.search(people, S.SearchRequest(sort_by="last_login", sort_dir="asc")))
    # any direction other than exactly 'asc' is descending
    assert ids(S.search(people, S.SearchRequest(sort_dir="ASC"))) == ids(S.search(people, S.SearchRequest()))


def test_ilike_is_case_insensitive_and_keeps_wildcards(people):
    assert sorted(ids(S.search(people, S.SearchRequest(q="ALI")))) == ["1"]
    # '_' matches any character
    assert sorted(ids(S.search(people, S.SearchRequest(q="a_b")))) == ["4", "5", "6", "7"]
    # '%' matches anything
    assert len(ids(S.search(people, S.SearchRequest(q="%")))) == 7
    # literal mode escapes them
    assert ids(S.search(people, S.SearchRequest(q="a_b", literal=True))) == ["4"]


def test_backslash_rules(people):
    # '\' before an ordinary character is dropped (Postgres), so 'a\b' looks for 'ab'
    assert ids(S.search(people, S.SearchRequest(q="a\\b"))) == []
    # '\\' is a literal backslash
    assert ids(S.search(people, S.SearchRequest(q="\\\\"))) == ["7"]
    # a final backslash escapes the closing '%': usernames ending in 'a%'
    assert ids(S.search(people, S.SearchRequest(q="a\\"))) == []


def test_like_pattern_text():
    from rollcall.functions.text import like_pattern

    assert like_pattern("team") == "%team%"
    assert like_pattern("a\\b") == "%ab%"
    assert like_pattern("a\\_b") == "%a\\_b%"
    assert like_pattern("a\\") == "%a\\%"
    assert like_pattern("a_%", literal=True) == "%a\\_\\%%"


def test_day_bounds_are_inclusive_to_the_millisecond(spark):
    df = users_df(
        spark,
        [
            ("1", "a", "USER", D(2024, 5, 1, 23, 59, 59, 999000)),
            ("2", "b", "USER", D(2024, 5, 1, 23, 59, 59, 999500)),
            ("3", "c", "USER", D(2024, 5, 2, 0, 0, 0)),
            ("4", "d", "USER", D(2024, 5, 1, 0, 0, 0)),
            ("5", "e", "USER", D(2024, 4, 30, 23, 59, 59, 999999)),
            ("6", "f", "USER", None),
        ],
    )
    out = sorted(ids(S.search(df, S.SearchRequest(joined_after="2024-05-01", joined_before="2024-05-01"))))
    assert out == ["1", "4"]
    assert sorted(ids(S.search(df, S.SearchRequest(joined_after="2024-05-02")))) == ["3"]


def test_role_filter_and_errors(people):
    assert sorted(ids(S.search(people, S.SearchRequest(role="ADMIN")))) == ["2", "6"]
    with pytest.raises(S.InvalidRole):
        S.search(people, S.SearchRequest(role="ROOT"))
    with pytest.raises(S.InvalidSection, match="Invalid section: 'posts'"):
        S.search(people, S.SearchRequest(section="posts"))
    with pytest.raises(S.InvalidDate):
        S.search(people, S.SearchRequest(joined_after="2024-13-40"))


def test_ui_request_trims_and_drops_empty():
    req = S.SearchRequest.from_ui(q="  bob  ", role="", joined_after=None)
    assert req.q == "bob" and req.role is None


def test_filters_commute(people):
    a = S.search(people, S.SearchRequest(q="a", role="USER"))
    b = S.search(people.where("role = 'USER'"), S.SearchRequest(q="a"))
    assert ids(a) == ids(b)


def test_projection_and_lookup(people):
    out = S.search(people, S.SearchRequest())
    assert out.columns == ["id", "username", "role", "created_at", "last_login"]
    row = S.single(S.by_id(people, "2"))
    assert row["username"] == "bob"
    with pytest.raises(S.NotFound, match="No rows found"):
        S.single(S.by_id(people, "nope"))
    with pytest.raises(S.NotUnique):
        S.single(people.where("role = 'USER'"))


def test_count_and_display(spark, people):
    assert S.directory_count(people).first()["total_users"] == 7
    assert S.directory_count(people.limit(0)).first()["total_users"] == 0
    disp = {r["id"]: r for r in S.profile_display(people).collect()}
    assert disp["2"]["last_seen"] == "Never" and disp["1"]["last_seen"] == "2024-03-01 00:00:00"
    assert disp["3"]["joined"] == "N/A" and disp["1"]["initial"] == "A"


def test_positions_match_sorted_order(spark, people):
    order = S.order_columns("last_login", True)
    pos = with_position(people, order).orderBy("pos").collect()
    assert [r["pos"] for r in pos] == list(range(1, 8))
    assert [r["id"] for r in pos] == ids(S.search(people, S.SearchRequest(sort_by="last_login", sort_dir="asc")))


def test_positions_over_many_partitions(spark):
    df = spark.range(0, 5000, numPartitions=13).selectExpr("cast(id as string) as id", "(id * 7919) % 5000 as v")
    import pyspark.sql.functions as F

    out = with_position(df, [F.col("v").asc(), F.col("id").asc()])
    rows = out.select("v", "pos").collect()
    assert sorted(r["pos"] for r in rows) == list(range(1, 5001))
    assert all(r["pos"] == r["v"] + 1 for r in rows)  # v is a permutation of 0..4999


def test_positions_with_many_sorted_partitions_descending_nulls(spark):
    import pyspark.sql.functions as F

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        df = spark.range(0, 3000, numPartitions=5).select(
            F.format_string("id%05d", "id").alias("id"),
            F.when(F.col("id") % 10 == 0, F.lit(None)).otherwise((F.col("id") * 7) % 1000).alias("v"),
        )
        order = [F.col("v").desc_nulls_first(), F.col("id").asc()]
        out = with_position(df, order)
        # the sort really spreads over several partitions here
        assert df.orderBy(*order).select(F.spark_partition_id().alias("p")).distinct().count() > 1
        got = [r["id"] for r in out.orderBy("pos").collect()]
        expected = [r["id"] for r in df.orderBy(*order).collect()]
        assert got == expected
        assert sorted(r["pos"] for r in out.select("pos").collect()) == list(range(1, 3001))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_day_bounds_on_a_zoned_timestamp_column(spark):
    import pyspark.sql.functions as F

    df = users_df(
        spark,
        [
            ("1", "a", "USER", D(2024, 5, 1, 23, 59, 59, 999000)),
            ("2", "b", "USER", D(2024, 5, 1, 23, 59, 59, 999500)),
            ("3", "c", "USER", D(2024, 5, 2, 0, 0, 0)),
        ],
    ).withColumn("created_at", F.col("created_at").cast("timestamp"))  # session zone is UTC
    assert dict(df.dtypes)["created_at"] == "timestamp"
    out = sorted(ids(S.search(df, S.SearchRequest(joined_after="2024-05-01", joined_before="2024-05-01"))))
    assert out == ["1"]
