"""Conversation repair against exhaustive search and a plain-Python model."""

import hashlib
import random
import re
import zlib
from itertools import product

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rollcall.llm import repair
from rollcall.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
SCHEMA = "conv_id bigint, turn bigint, role string, text string, seq bigint, place string, digest string, first int"
GOOD = re.compile(r"(s?(ua)+)?\Z")
SOME = re.compile("[^\x20\x09-\x0d]")


def as_turns(spark, rows):
    return spark.createDataFrame([(*r, 1, "p", "d", 2) for r in rows], SCHEMA)


def cheapest(codes):
    """(cost, audit, roles) by trying every edit sequence with at most two inserts in a row and two in excess."""
    found = []
    initial = [" sua"[c & 3] for c in codes]
    for edits in product("DKR", repeat=len(codes)):
        if any(e != "D" and c & repair.GONE for e, c in zip(edits, codes)):
            continue
        for gaps in product(range(3), repeat=len(codes) + 1):
            cost = 2 * sum(gaps) + sum({"D": 3, "K": 0, "R": 2}[e] + (e != "D" and bool(c & repair.CUT)) for e, c in zip(edits, codes))
            audit = "".join("I" * gaps[i] + (edits[i] if i < len(codes) else "") for i in range(len(codes) + 1))
            if found and (cost, audit) >= found[0][:2]:
                continue
            free = [i for i, e in enumerate(audit) if e in "IR"]
            at = iter(initial)
            own = [next(at) if e in "DKR" else "" for e in audit]
            for roles in product("ua", repeat=len(free)):
                pick = dict(zip(free, roles))
                final = "".join("" if e == "D" else pick.get(i, own[i]) for i, e in enumerate(audit))
                if GOOD.match(final):
                    found = [(cost, audit, final)]
                    break
    return found[0]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([0, 1, 2, 3, 4, 6, 9, 10, 11]), max_size=4))
def test_walk_is_the_cheapest_and_ascii_least(codes):
    codes = bytes(codes)
    cost, audit, roles = cheapest(codes)
    assert repair.walk(codes, repair.END, repair.START, True)[0] == audit
    assert repair.backward(codes, repair.END)[repair.START] == cost
    made = repair.replay(codes, audit, repair.START)
    assert "".join(r[0] if r else " sua"[codes[at] & 3] for at, e, r in made if e != "D") == roles


def forward(codes):
    """(cost, audit) by a forward search that carries whole audits."""
    best = {0: (0, "")}

    def inserts(best):
        for _ in range(3):
            for s, (c, a) in list(best.items()):
                t = repair.TURN_TO[s]
                best[t] = min(best.get(t, (10**9, "")), (c + 2, a + "I"))
        return best

    for code in codes:
        new = {}
        for s, (c, a) in inserts(best).items():
            ways = [(s, 3, "D")]
            if not code & repair.GONE:
                more = bool(code & repair.CUT)
                ways.append((repair.TURN_TO[s], 2 + more, "R"))
                if (code & 3) in repair.KEPT[s]:
                    ways.append((repair.KEPT[s][code & 3], more, "K"))
            for t, cost, e in ways:
                new[t] = min(new.get(t, (10**9, "")), (c + cost, a + e))
        best = new
    best = inserts(best)
    return min(best[s] for s in (0, 3) if s in best)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from([0, 1, 2, 3, 2, 3, 4, 6, 9, 10, 11]), max_size=120))
def test_checkpoints_do_not_change_the_walk(codes):
    codes = bytes(codes)
    cost, audit = forward(codes)
    assert repair.walk(codes, repair.END, repair.START, True)[0] == audit
    assert repair.backward(codes, repair.END)[repair.START] == cost


def test_checkpoints_are_few():
    codes = bytes([2, 3] * 5000)
    step = 101
    kept = repair.checkpoints(codes, repair.END, step)
    assert len(kept) == 1 + -(-len(codes) // step)
    assert all(kept[i] == repair.backward(codes[i * step :], repair.END) for i in (0, 5, 99))


def model(rows):
    """{conv_id: result row} of damaged and repaired conversations, for (conv_id, turn, role, text) rows."""
    kept = {}
    for conv, turn, role, text in rows:
        mine = kept.setdefault(conv, [])
        kind = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        role = "user" if kind == 4 else role
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        mine += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)

    def mark(r):
        return hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()

    out = {}
    for conv, mine in kept.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, mark(r)))
        seen, codes, counts = set(), [], [0, 0, 0]
        for _, role, text in mine:
            code = {"s": 1, "u": 2, "a": 3}.get(role[:1], 0)
            if not SOME.search(text):
                counts[0], code = counts[0] + 1, code + 4
            elif (role, text) in seen:
                counts[1], code = counts[1] + 1, code + 4
            elif SOME.findall(text)[-1] not in ".!?":
                counts[2], code = counts[2] + 1, code + 8
            seen.add((role, text))
            codes.append(code)
        pairs = zip(mine, mine[1:])
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in pairs)
        cost, audit = forward(codes)
        lines = []
        for at, edit, role in repair.replay(bytes(codes), audit, 0):
            if edit == "I":
                lines.append(f"{role}:")
            elif edit != "D":
                lines.append(f"{role or mine[at][1]}:{mine[at][2]}")
        turns = [t for t, _, _ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, *counts, illegal, cost, audit, sha)
    return out


def results(df):
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    rows = df.collect()
    found = {r["conv_id"]: tuple(r[n] for n in names) for r in rows}
    assert len(found) == len(rows)
    return found


def talk(rng, conv, n):
    for turn in range(n):
        role = rng.choice(["user", "assistant"]) if rng.random() < 0.2 else ("user", "assistant")[turn % 2]
        text = rng.choice(["Yes.", "No!", "a b c", "", " \t", "Why? ", f"word {turn}.", f"line {rng.randrange(30)}.\n"])
        yield conv, turn + rng.randrange(2) * (rng.random() < 0.1), role, text


@pytest.fixture(scope="module")
def odd_turns():
    rng = random.Random(4)
    rows = [r for conv in range(60) for r in talk(rng, conv, rng.randrange(9))]
    rows += [(100, t, "system", "You are.") for t in range(3)]
    rows += [(101, None, "user", "Hm."), (101, None, None, None), (101, 3, None, "Text."), (101, 9, "", "x.")]
    rows += [(None, 0, "user", "Hi."), (None, None, "assistant", "Ho."), (None, 5, "tool", "run")]
    rows += [(102, None, None, None)] * 3 + [(103, t, "user", "same.") for t in range(6)]
    rows += [(104, 2, r, f"{t}.") for r in ("user", "assistant", "system") for t in range(4)]  # ties
    rows += [(105, -(2**62), "user", "Far."), (105, 2**62, "assistant", "Off.")]
    rows += [(106, 0, "user", "w " * 200_000 + "end."), (106, 1, "assistant", "É" * 1000 + "!"), (106, 1, "uncle", "Ok.")]
    rows += list(talk(rng, 107, 400)) + rows[:20]
    rows += [(200 + i, 0, "user", "gone.") for i in range(40)]  # some lose their only turn
    return rows


def test_odd_rows(spark, odd_turns):
    got = results(repair.repair_conversations(as_turns(spark, odd_turns)))
    want = model(odd_turns)
    assert got == want
    assert any(w[6] == "" and w[5] == 0 for w in want.values()) and any("R" in w[6] for w in want.values())
    assert results(repair.repair_conversations(as_turns(spark, []))) == {}


@pytest.mark.parametrize("block", [1, 7])
def test_blocks_do_not_change_the_result(spark, odd_turns, block):
    """Conversations cut into blocks of few turns: tables, end vectors and entry states are composed."""
    rows = [r for r in odd_turns if r[0] is None or r[0] >= 50]
    got = results(repair.Repair(repair.damage(as_turns(spark, rows)), block).summary())
    assert got == {c: w for c, w in model(rows).items() if c in got}
    assert len(got) > 20


def test_repaired_turns_have_the_structure(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    found = repair.Repair(repair.damage(turns)).repaired()
    order = F.array_sort(F.collect_list(F.struct("place", F.substring("role", 1, 1).alias("i"))))
    line = F.array_join(F.transform(order, lambda r: r["i"]), "").alias("line")
    assert found.groupBy("conv_id").agg(line).where(~F.col("line").rlike("^s?(ua)+$")).isEmpty()


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert results(QUERIES["op12_repair"](spark, SF)) == model(rows)
