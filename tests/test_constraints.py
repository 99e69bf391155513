"""Constraints kept by change sets equal the report over the whole directory (O-31)."""

import datetime as dt
import random

from pyspark.sql import functions as F

from rollcall.operators import constraints as N
from rollcall.operators import quality as Q
from rollcall.sources.schemas import USERS

LOOSE = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in USERS.fields)


def table(spark, rows):
    return spark.createDataFrame(rows, LOOSE)


def whole(users, identities):
    report = Q.constraint_report(users, identities)
    return sorted(map(tuple, report.groupBy("rule", "key").agg(F.count(F.lit(1)).alias("n")).collect()), key=repr)


def some_row(rng):
    key = rng.choice([None, *(str(i) for i in range(12))])
    name = rng.choice([None, "a_name_of_more_than_twenty", *(f"n{i}" for i in range(9))])
    return (key, name, rng.choice(["USER", "ADMIN", "OWNER", None]), dt.datetime(2024, 1, 1), None, None)


def test_random_changes(spark, scratch):
    rng = random.Random(7)
    held = [some_row(rng) for _ in range(25)]
    known = [(str(i),) for i in range(0, 12, 2)]
    identities = lambda rows: spark.createDataFrame(rows, "id string")
    log = N.ConstraintLog(spark, f"{scratch}/log")
    log.start(table(spark, held), identities(known))
    assert sorted(map(tuple, log.report(0).collect()), key=repr) == whole(table(spark, held), identities(known))
    since = 0
    for batch in range(1, 5):
        gone = rng.sample(held, 4)
        for row in gone:
            held.remove(row)
        new = [some_row(rng) for _ in range(5)]
        held += new
        come, left = [(str(rng.randrange(12)),)], [known[0]] if known else []
        come = [c for c in come if c not in known]
        known = [k for k in known if k not in left] + come
        for _ in range(2):  # a batch that is written again changes nothing
            log.apply(batch, table(spark, new), table(spark, gone), identities(come), identities(left), since=since)
        got = sorted(map(tuple, log.report(batch).collect()), key=repr)
        assert got == whole(table(spark, held), identities(known))
        if batch == 2:
            log.compact(2)
            since = 2
    assert sorted(map(tuple, log.report(0).collect()), key=repr)  # earlier reports are as they were


def test_only_touched_keys_are_written(spark, scratch):
    rows = [(str(i), f"n{i}", "USER", None, None, None) for i in range(500)]
    log = N.ConstraintLog(spark, f"{scratch}/log")
    log.start(table(spark, rows), spark.createDataFrame([(str(i),) for i in range(500)], "id string"))
    log.apply(1, added=table(spark, [("7", "n8", "USER", None, None, None)]))
    changed = spark.read.parquet(f"{scratch}/log/counts/batch=1")
    assert sorted((r["entity"], r["key"]) for r in changed.collect()) == [("id", "7"), ("username", "n8")]
    assert sorted(map(tuple, log.report(1).collect())) == [("id_unique", "7", 1), ("username_unique", "n8", 1)]
