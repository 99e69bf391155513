"""Conversation structure repair: the cheapest edits that make the turns alternate.

A repaired conversation is empty, or an optional system turn followed by pairs
of a user and an assistant turn.  Edits, in order of the turns: Keep (0),
Rerole to user or assistant (2), Delete (3; required for blank and duplicate
turns) and Insert an empty user or assistant turn (2); a truncated turn that
is not deleted adds 1.  Of the cheapest edit sequences the one whose initials
are ASCII-least is taken.

Method.  Four states tell which role may come next: START, SYSTEM, USER and
ASSISTANT (the role before).  A backward pass gives, before each turn, the least
cost to the end from each state.  Only the vectors at every sqrt(n)-th turn are
kept (checkpoints).  The forward walk works out each stretch between two
checkpoints again from its end and then takes, turn by turn, the first edit in
ASCII order that is tight (its cost and the cost behind it make up the cost
before it).  So a conversation of n turns needs memory for 2 sqrt(n) vectors.

Conversations are cut into blocks of at most ``BLOCK`` turns in task order, so
one that holds a third of all turns is worked on by many tasks.  For those with several blocks, a block's
4 x 4 table of least costs between states is made first; the tables, one per
block, are composed backwards to give each block its end vector, and the exits of each
block, one per state, are composed forwards to give its entry state.

Sorting uses ids, turns and digests only.  Duplicates are found by the first
place of each (conversation, digest), a partial aggregate, joined back on the
unique place.  Texts are moved once, for the digest of the repaired text, which
streams through one task per conversation (a hash of a whole text is serial).

Defined results: a null role or text counts as one space (so the turn is blank
or has a role that must be changed); null turns come first; a null conv_id is a
conversation of its own; turns of one conversation that share their number go
by a digest of role and text; rows that repeat are duplicates of the first; a
role is told by its first character, and an empty role is neither of the three.
An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import inf, isqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.session import durable

BLOCK = 65_536
DAMAGE_KINDS = 20

# White space and sentence ends of the contract
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
ENDS = (".", "!", "?")

START, SYSTEM, USER, ASSISTANT = range(4)
ROLE_OF = {USER: "user", ASSISTANT: "assistant"}
INITIALS = {"s": 1, "u": 2, "a": 3}  # 0: any other
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2

# the state that an inserted or reroled turn leads to, and the one that a kept turn leads to
TURN_TO = [USER, USER, ASSISTANT, USER]
KEPT = [
    {1: SYSTEM, 2: USER},
    {2: USER},
    {3: ASSISTANT},
    {2: USER},
]
END = (0, 4, 2, 0)  # least cost from each state once no turn is left

# a turn's code: initial (0..3) + 4 if it must be deleted + 8 if it is truncated
GONE, CUT = 4, 8


def step_back(code: int, v: tuple) -> tuple:
    """Costs before a turn from the costs behind it."""
    start, system, user, assistant = (cost + DELETE for cost in v)
    if not code & GONE:
        more = 1 if code & CUT else 0
        to_user, to_assistant = v[USER] + REROLE + more, v[ASSISTANT] + REROLE + more
        start, system = min(start, to_user), min(system, to_user)
        user, assistant = min(user, to_assistant), min(assistant, to_user)
        initial = code & 3
        if initial == 1:
            start = min(start, v[SYSTEM] + more)
        elif initial == 2:
            kept = v[USER] + more
            start, system, assistant = min(start, kept), min(system, kept), min(assistant, kept)
        elif initial == 3:
            user = min(user, v[ASSISTANT] + more)
    user, assistant = min(user, assistant + INSERT), min(assistant, user + INSERT)
    return min(start, user + INSERT), min(system, user + INSERT), user, assistant


def backward(codes: bytes, v: tuple) -> tuple:
    for code in reversed(codes):
        v = step_back(code, v)
    return v


def checkpoints(codes: bytes, end: tuple, step: int) -> list[tuple]:
    """The vectors before turns 0, step, 2 step, ... and behind the last one."""
    out = [end]
    for at in range((len(codes) - 1) // step * step, -1, -step) if codes else ():
        out.append(backward(codes[at : at + step], out[-1]))
    return out[::-1]


def walk(codes: bytes, end: tuple, state: int, last: bool) -> tuple[str, int]:
    """(initials of the ASCII-least tight edits, state behind them); ``last``: the conversation ends here."""
    step = isqrt(len(codes)) + 1
    kept = checkpoints(codes, end, step)
    out: list[str] = []
    for block, at in enumerate(range(0, len(codes), step)):
        part = codes[at : at + step]
        vectors = [kept[block + 1]]
        for code in reversed(part):
            vectors.append(step_back(code, vectors[-1]))
        vectors.reverse()
        for i, code in enumerate(part):
            here, behind = vectors[i], vectors[i + 1]
            more = 1 if code & CUT else 0
            while here[state] != behind[state] + DELETE:
                nxt = TURN_TO[state]
                if here[state] == here[nxt] + INSERT:
                    out.append("I")
                    state = nxt
                    continue
                to = KEPT[state].get(code & 3)
                if to is not None and here[state] == behind[to] + KEEP + more:
                    out.append("K")
                    state = to
                else:
                    out.append("R")
                    state = nxt
                break
            else:
                out.append("D")
    while last and state in (SYSTEM, USER):
        out.append("I")
        state = TURN_TO[state]
    return "".join(out), state


def replay(codes: bytes, edits: str, state: int) -> list[tuple[int, str, str | None]]:
    """(turn the edit stands at, edit, role behind it) of each edit; a deleted turn has none, a kept one its own."""
    out, at = [], 0
    for edit in edits:
        if edit == "K":
            state = KEPT[state][codes[at] & 3]
        elif edit != "D":
            state = TURN_TO[state]
        out.append((at, edit, ROLE_OF[state] if edit in "IR" else None))
        at += edit != "I"
    return out


# --------------------------------------------------------------- rows


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with one fault in every fourth row or so, by crc32 of its place; nulls are one space."""
    place = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = whole(conversations).withColumn("_kind", F.crc32(place) % DAMAGE_KINDS).where("_kind <> 0")
    kind = F.col("_kind")
    rows = rows.select(
        "conv_id",
        "turn",
        F.when(kind == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.translate("text", "".join(ENDS), "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
    )
    return rows.drop("_copy")


def whole(turns: DataFrame) -> DataFrame:
    """The four columns, with nulls of role and text as one space."""
    return turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")],
    )


def digest() -> Column:
    return F.md5(F.concat(F.char_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")))


def _places(turns: DataFrame) -> DataFrame:
    """Rows in order, without their texts: seq (rising over all tasks), conv_id, turn, digest, initial, blank, cut."""
    rest = F.rtrim(F.col("text"), F.lit(SPACES))
    narrow = turns.select(
        "conv_id",
        "turn",
        digest().alias("digest"),
        F.substring("role", 1, 1).alias("initial"),
        (F.char_length(rest) == 0).alias("blank"),
        (~F.substring(rest, -1, 1).isin(*ENDS)).alias("cut"),
        # equal rows may be many: the salt deals them out, and they may go in any order
        F.monotonically_increasing_id().alias("salt"),
    )
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "digest", "salt")]
    ordered = narrow.repartitionByRange(*order).sortWithinPartitions(*order)
    return durable(ordered.drop("salt").withColumn("seq", F.monotonically_increasing_id()), "turns")


_BLOCK = (
    "conv_id bigint, seq bigint, n bigint, codes binary, turns array<bigint>, digests array<string>, "
    "blank bigint, duplicate bigint, truncated bigint, illegal bigint, head string, tail string"
)


def _blocks(most: int):
    """Blocks of the rows of one conversation, from rows in order (seq, conv_id, turn, digest, initial, blank, cut, first)."""

    def made(conv, seq, rows: list[tuple]) -> tuple:
        codes, blank, duplicate, truncated, illegal, before = bytearray(), 0, 0, 0, 0, None
        for _, _, initial, is_blank, is_cut, is_first in rows:
            code = INITIALS.get(initial, 0)
            if is_blank:
                blank, code = blank + 1, code + GONE
            elif not is_first:
                duplicate, code = duplicate + 1, code + GONE
            elif is_cut:
                truncated, code = truncated + 1, code + CUT
            codes.append(code)
            illegal += before is not None and (before, initial) not in LEGAL
            before = initial
        turns, digests = [r[0] for r in rows], [r[1] for r in rows]
        counts = (blank, duplicate, truncated, illegal)
        return (conv, seq, len(rows), bytes(codes), turns, digests, *counts, rows[0][2], rows[-1][2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        now, first, out, size = None, None, [], 0
        for batch in batches:
            seqs, convs, *rest = (c.to_pylist() for c in batch.columns)
            for seq, conv, row in zip(seqs, convs, zip(*rest)):
                if held and (conv != now or len(held) == most):
                    out.append(made(now, first, held))
                    size, held = size + len(held), []
                    if size > 20_000:
                        yield _records(out, _BLOCK)
                        out, size = [], 0
                if not held:
                    now, first = conv, seq
                held.append(row)
        if held:
            out.append(made(now, first, held))
        if out:
            yield _records(out, _BLOCK)

    return run


_KINDS = {
    "bigint": pa.int64(),
    "int": pa.int32(),
    "string": pa.string(),
    "binary": pa.binary(),
    "array<bigint>": pa.list_(pa.int64()),
    "array<double>": pa.list_(pa.float64()),
    "array<int>": pa.list_(pa.int32()),
    "array<string>": pa.list_(pa.string()),
}


def _records(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(field.split() for field in schema.split(", ")))
    columns = zip(*rows) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(list(c), _KINDS[k]) for c, k in zip(columns, kinds)], list(names))


def _mapped(df: DataFrame, work, schema: str) -> DataFrame:
    """``work`` maps a row's columns to a tuple of ``schema`` (or to several in a list)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                found = work(*row)
                out += found if isinstance(found, list) else [found]
            yield _records(out, schema)

    return df.mapInArrow(run, schema)


def _composed(df: DataFrame, initial, step, schema: str, ascending: bool) -> DataFrame:
    """Rows (conv_id, seq, ...) of each conversation in order, one after another, with a state handed on.

    ``step(state, row)`` gives (new state, result tuple).  One row per block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, begun = None, None, False
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if not begun or row[0] != now:
                    now, state, begun = row[0], initial, True
                state, result = step(state, row)
                out.append(result)
            yield _records(out, schema)

    order = F.col("seq").asc() if ascending else F.col("seq").desc()
    return df.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), order).mapInArrow(run, schema)


def _unit(state: int) -> tuple:
    return tuple(0 if s == state else inf for s in range(4))


def _table_of(conv, seq, codes):
    """The block's least costs from each state to each state, by columns."""
    return conv, seq, [float(x) for e in range(4) for x in backward(codes, _unit(e))]


def _compose_costs(v, row):
    """Hands on the costs before the block; the result keeps those behind it."""
    conv, seq, table = row
    before = tuple(min(table[4 * e + s] + v[e] for e in range(4)) for s in range(4))
    return before, (conv, seq, [int(x) for x in v])


def _exits(conv, seq, codes, end, last, head, tail):
    return conv, seq, [walk(codes, tuple(end), s, bool(last))[1] for s in range(4)], head, tail


def _compose_states(state, row):
    conv, seq, exits, head, tail = row
    entry, before = state
    across = int(before is not None and (before, head) not in LEGAL)
    return (exits[entry], tail), (conv, seq, entry, across)


_DONE = (
    "conv_id bigint, seq bigint, n bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
    "cost bigint, audit string, codes binary, turns array<bigint>, digests array<string>, entry int"
)


def _finished(conv, seq, n, codes, turns, digests, blank, duplicate, truncated, illegal, end, last, entry, across):
    audit, _ = walk(codes, tuple(end), entry, bool(last))
    standing = [c for c, e in zip(codes, audit.replace("I", "")) if e != "D"]
    cost = DELETE * audit.count("D") + REROLE * audit.count("R") + INSERT * audit.count("I")
    cost += sum(1 for c in standing if c & CUT)
    return conv, seq, n, blank, duplicate, truncated, illegal + across, cost, audit, codes, turns, digests, entry


BEFORE, EDIT, TEXT, AFTER = range(4)
_EDIT = "conv_id bigint, seq bigint, step bigint, edit string, role string, turn bigint, digest string, place int"


def _edits(conv, seq, audit, codes, turns, digests, entry):
    out = []
    for step, (at, edit, role) in enumerate(replay(codes, audit, entry)):
        # an insert stands before the turn it comes to; a turn that must go may equal the kept one before it
        end = at == len(codes)
        at = min(at, len(codes) - 1)
        place = EDIT if edit != "I" else AFTER if end or codes[at] & GONE else BEFORE
        out.append((conv, seq, step, edit, role, turns[at], digests[at], place))
    return out


class Repair:
    """One run over ``turns`` (conv_id, turn, role, text)."""

    def __init__(self, turns: DataFrame, block: int = BLOCK):
        self.turns = whole(turns)
        self.rows = _places(self.turns)
        firsts = self.rows.where("not blank").groupBy("conv_id", "digest").agg(F.min("seq").alias("seq"))
        flagged = self.rows.join(firsts.select("seq", F.lit(True).alias("first")), "seq", "left")
        flagged = flagged.select(
            "seq", "conv_id", "turn", "digest", "initial", "blank", "cut", F.coalesce("first", F.lit(False)).alias("first")
        )
        ordered = flagged.repartitionByRange("seq").sortWithinPartitions("seq")
        self.blocks = durable(ordered.mapInArrow(_blocks(block), _BLOCK), "blocks")
        self.done = durable(_mapped(self._placed(), _finished, _DONE), "walked")

    def _placed(self) -> DataFrame:
        """Blocks with the costs behind them, whether they are the last, their entry state, and illegal pairs across."""
        several = self.blocks.groupBy("conv_id").agg(F.count(F.lit(1)).alias("m"), F.min("seq").alias("first"))
        several = durable(several.where("m > 1"), "several")
        columns = [c.split()[0] for c in _BLOCK.split(", ")][:-2]
        alone = [F.array(*[F.lit(c).cast("long") for c in END]).alias("end"), F.lit(1).alias("last")]
        alone += [F.lit(START).alias("entry"), F.lit(0).cast("long").alias("across")]
        if several.isEmpty():
            return self.blocks.select(*columns, *alone)
        same = self.blocks["conv_id"].eqNullSafe(several["conv_id"])
        parts = durable(self.blocks.join(several, same, "left_semi"), "parts")
        tables = durable(
            _mapped(parts.select("conv_id", "seq", "codes"), _table_of, "conv_id bigint, seq bigint, costs array<double>"),
            "tables",
        )
        # the last block comes first: nothing but the end is behind it
        ends = _composed(tables, END, _compose_costs, "conv_id bigint, seq bigint, end array<bigint>", False)
        ends = durable(ends, "ends")
        final = parts.groupBy("conv_id").agg(F.max("seq").alias("seq")).select("seq", F.lit(1).alias("last"))
        known = parts.join(ends.select("seq", "end"), "seq").join(final, "seq", "left")
        known = durable(known.withColumn("last", F.coalesce("last", F.lit(0))), "known")
        exits = _mapped(
            known.select("conv_id", "seq", "codes", "end", "last", "head", "tail"),
            _exits,
            "conv_id bigint, seq bigint, exits array<int>, head string, tail string",
        )
        entries = _composed(
            durable(exits, "exits"), (START, None), _compose_states, "conv_id bigint, seq bigint, entry int, across bigint", True
        )
        full = known.join(entries.drop("conv_id"), "seq").select(*columns, "end", "last", "entry", "across")
        return self.blocks.join(several, same, "left_anti").select(*columns, *alone).unionByName(full)

    def edits(self) -> DataFrame:
        """Every edit in order (conv_id, seq, step): edit, role behind it (Insert, Rerole), and the turn it stands at."""
        return _mapped(self.done.select("conv_id", "seq", "audit", "codes", "turns", "digests", "entry"), _edits, _EDIT)

    def repaired(self) -> DataFrame:
        """The repaired turns: conv_id, place (0, 1, ...), role, text."""
        return self._lines().mapInArrow(_standing, "conv_id bigint, place bigint, role string, text string")

    def _lines(self) -> DataFrame:
        edits = self.edits().where("edit <> 'D'")
        texts = self.turns.select(
            "conv_id",
            "turn",
            digest().alias("digest"),
            F.lit(TEXT).alias("place"),
            F.lit(0).cast("long").alias("seq"),
            F.lit(0).cast("long").alias("step"),
            "role",
            "text",
        )
        mine = edits.select("conv_id", "turn", "digest", "place", "seq", "step", "role", F.lit(None).cast("string").alias("text"))
        order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "digest", "place", "seq", "step")]
        ordered = mine.unionByName(texts).repartition("conv_id").sortWithinPartitions(*order)
        return ordered.select("conv_id", "turn", "digest", "place", "role", "text")

    def digests(self) -> DataFrame:
        """(conv_id, repaired_sha256) of the conversations with a repaired turn: ``role:text`` joined by newlines."""
        return self._lines().mapInArrow(_hashed, "conv_id bigint, repaired_sha256 string")

    def summary(self) -> DataFrame:
        """Per conversation with a turn: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
        none = hashlib.sha256().hexdigest()
        span = (F.max("turn").cast("decimal(38,0)") - F.min("turn").cast("decimal(38,0)") + 1 - F.countDistinct("turn"))
        gaps = self.rows.groupBy("conv_id").agg(F.coalesce(span, F.lit(0)).try_cast("long").alias("gaps"))
        counts = ["blank", "duplicate", "truncated", "illegal", "cost"]
        steps = F.array_sort(F.collect_list(F.struct("seq", "audit")))
        found = self.done.groupBy("conv_id").agg(
            *[F.sum(c).alias(c) for c in counts],
            F.array_join(F.transform(steps, lambda s: s["audit"]), "").alias("audit"),
        )
        parts = gaps.unionByName(found, allowMissingColumns=True).unionByName(self.digests(), allowMissingColumns=True)
        return parts.groupBy("conv_id").agg(
            *[F.max(c).alias(c) for c in ("gaps", *counts, "audit")],
            F.coalesce(F.max("repaired_sha256"), F.lit(none)).alias("repaired_sha256"),
        )


def _standing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The repaired turns of each conversation from its sorted lines; a kept text follows its edit."""
    now, count, waiting = None, 0, None
    for batch in batches:
        out = []
        for conv, turn, mark, place, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            if conv != now:
                now, count, waiting = conv, 0, None
            if place == EDIT:
                waiting = (turn, mark, role)
                continue
            if place == TEXT:
                if waiting is None or waiting[:2] != (turn, mark):
                    continue
                role, waiting = waiting[2] or role, None
            out.append((conv, count, role, text or ""))
            count += 1
        yield _records(out, "conv_id bigint, place bigint, role string, text string")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One hash per conversation over its repaired turns; holds one batch."""
    schema = "conv_id bigint, repaired_sha256 string"
    now, sha = None, None
    for batch in _standing(batches):
        out = []
        for conv, place, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            if not place:
                if sha is not None:
                    out.append((now, sha.hexdigest()))
                now, sha = conv, hashlib.sha256()
            else:
                sha.update(b"\n")
            sha.update(f"{role}:{text}".encode())
        yield _records(out, schema)
    if sha is not None:
        yield _records([(now, sha.hexdigest())], schema)


def repair_conversations(conversations: DataFrame) -> DataFrame:
    """One row per conv_id of ``conversations``: the faults of its damaged turns and their cheapest repair."""
    found = Repair(damage(conversations)).summary()
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    none = hashlib.sha256().hexdigest()
    both = found.withColumn("had", F.lit(True)).unionByName(ids, allowMissingColumns=True)
    both = both.groupBy("conv_id").agg(
        *[F.max(c).alias(c) for c in (*counts, "audit", "repaired_sha256")], F.max("had").alias("had")
    )
    zero = lambda c: F.when(F.col("had"), F.col(c)).otherwise(F.lit(0)).cast("long").alias(c)
    return both.select(
        "conv_id",
        *[zero(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(none)).alias("repaired_sha256"),
    )
