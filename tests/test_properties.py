"""Operators against brute-force Python models on random fixtures.

Each test builds a few hundred random rows in one DataFrame (one Spark job),
so the comparison is cheap while still covering many combinations.
"""

import datetime as dt
import hashlib
import json
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from rollcall.functions.identity import add_base_username, base_username
from rollcall.functions.text import like_pattern
from rollcall.operators import identity as I
from rollcall.sources.schemas import AUTH_USERS

# Postgres's \s in the C locale: space, \t, \n, \v, \f, \r.
PG_SPACE_OR_DASH = re.compile(r"[ \t\n\x0b\f\r\-]+")


def model_base(meta, email, id_):
    fields = json.loads(meta) if meta else {}
    given = fields.get("username")
    if given is not None and given.strip(" "):
        return given.strip(" ").lower()
    display = fields.get("name")
    if display is None:
        display = fields.get("full_name")
    if display is not None and display.strip(" "):
        s = display.strip(" ").lower()
        s = PG_SPACE_OR_DASH.sub("_", s)
        s = re.sub(r"[^a-z0-9_]", "", s)
        s = re.sub(r"_+", "_", s)
        s = s.strip("_")
        if len(s) >= 3:
            return s
    if email is not None and email.endswith("@app.local"):
        local = email.split("@")[0]
        if len(local) >= 3:
            return local.lower()
    return "user_" + id_[:8]


def random_text(rng, alphabet, n):
    return "".join(rng.choice(alphabet) for _ in range(rng.randint(0, n)))


def test_cascade_matches_model(spark):
    rng = random.Random(7)
    alphabet = ["a", "B", "z", "0", "7", " ", "\t", "-", "_", "#", "é", "Ö", "."]
    rows = []
    for i in range(400):
        fields = {}
        for key in ("username", "name", "full_name"):
            pick = rng.random()
            if pick < 0.35:
                fields[key] = random_text(rng, alphabet, 8)
            elif pick < 0.45:
                fields[key] = None
        meta = None if rng.random() < 0.1 else json.dumps(fields)
        local = random_text(rng, ["a", "B", "1"], 5)
        email = rng.choice([None, f"{local}@app.local", f"{local}@else.where", local])
        rows.append((f"{i:08d}-{rng.randint(0, 99)}", email, meta))
    df = spark.createDataFrame([r + (None, None) for r in rows], AUTH_USERS)
    got = {r["id"]: r["b"] for r in df.select("id", base_username().alias("b")).collect()}
    staged = {r["id"]: r["b"] for r in add_base_username(df, "b").select("id", "b").collect()}
    for id_, email, meta in rows:
        assert got[id_] == model_base(meta, email, id_), (id_, email, meta)
        assert staged[id_] == got[id_], (id_, email, meta)


def suffix(id_, k):
    return hashlib.md5(f"{id_}:{k}".encode()).hexdigest()[:4]


def model_resolve(claims, taken, rounds=10):
    def key(c):
        return (c[2] is None, c[2] or dt.datetime.min, c[0])

    granted = {}
    names = set(taken)
    by_base = defaultdict(list)
    for c in claims:
        by_base[c[1]].append(c)
    for base, members in by_base.items():
        if base not in names:
            granted[min(members, key=key)[0]] = (base, 0)
    names |= {n for n, _ in granted.values()}
    for k in range(1, rounds + 1):
        asking = defaultdict(list)
        for c in claims:
            if c[0] in granted:
                continue
            cand = f"{c[1]}_{suffix(c[0], k)}"
            if cand not in names:
                asking[cand].append(c)
        for cand, members in asking.items():
            granted[min(members, key=key)[0]] = (cand, k)
            names.add(cand)
    return granted


def test_collisions_match_model(spark):
    rng = random.Random(11)
    for trial in range(3):
        bases = ["x", "y", "x_" + suffix("c0", 1), "z"]
        claims = []
        for i in range(60):
            created = None if rng.random() < 0.2 else dt.datetime(2024, 1, 1 + rng.randint(0, 3))
            claims.append((f"c{i}", rng.choice(bases), created))
        # the directory holds some bases and many first/second candidates
        taken = {"x", "z"}
        for c_id, base, _ in claims:
            for k in (1, 2, 3):
                if rng.random() < 0.4:
                    taken.add(f"{base}_{suffix(c_id, k)}")
        cdf = spark.createDataFrame(claims, "id string, base string, created_at timestamp_ntz")
        tdf = spark.createDataFrame([(t,) for t in sorted(taken)], "username string")
        res = I.resolve_collisions(cdf, tdf)
        got = {r["id"]: (r["username"], r["attempt"]) for r in res.accepted.collect()}
        expected = model_resolve(claims, taken)
        assert got == expected, trial
        rejected = {r["id"] for r in res.rejected.collect()}
        assert rejected == {c[0] for c in claims} - set(expected)


def model_ilike(pattern, text):
    out, i = [], 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            out.append(re.escape(pattern[i + 1]))
            i += 2
            continue
        out.append(".*" if ch == "%" else "." if ch == "_" else re.escape(ch))
        i += 1
    return re.fullmatch("".join(out), text, flags=re.IGNORECASE | re.DOTALL) is not None


def test_ilike_matches_postgres_model(spark):
    rng = random.Random(5)
    alphabet = ["a", "A", "b", "_", "%", "\\"]
    names = sorted({random_text(rng, alphabet, 5) for _ in range(80)})
    queries = sorted({random_text(rng, alphabet, 3) for _ in range(40)} - {""})
    df = spark.createDataFrame([(n,) for n in names], "username string")
    cols = [F.col("username").ilike(like_pattern(q)).alias(f"q{i}") for i, q in enumerate(queries)]
    for row in df.select("username", *cols).collect():
        for i, q in enumerate(queries):
            assert row[f"q{i}"] == model_ilike(f"%{q}%", row["username"]), (q, row["username"])
