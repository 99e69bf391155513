"""Personal data: candidate spans, boosted trees, calibrated redaction.

Method.  Fixed base rules find e-mail addresses, IPv4 addresses, card and
phone numbers; what they accept is always redacted.  High-recall generators
propose further, overlapping spans of the same kinds (spelled-out e-mail
addresses, IP addresses with bracketed, spelled or spaced dots, numbers with other separators or
without a plus sign) and of a fifth kind without base rule, secrets (long runs of letters and digits).  Every
candidate becomes a row of format features (lengths, digits, separators,
checksum, parts) and context features (neighbouring characters and hint words
before it).  Histogram gradient-boosted trees are fitted on at most
``FIT_ROWS`` candidates.  Positive are base finds, and what the generators
propose for the same finds rewritten in their own context (``rewritten``:
spelled out, without the plus, with other separators), and secrets given to a
named key (``token = ...``).  Negative are candidates that fail a check (checksum, part above 255, number of digits, end
of a domain), phone-like digit runs without a hint word and long runs that no key names; further candidates, and those that
overlap a base find, are not learned from.  A threshold per kind is calibrated
on a held-out fifth of the generators' candidates so that at least
``PRECISION`` of what reaches it is positive; candidates that reach it and
overlap nothing better are redacted too.

No shuffle: texts are searched where they lie, in Arrow batches.  All
patterns are linear in the text: none can start again inside a run that it has
read, and e-mail addresses are found from their @ outwards.

Defined results: null text is empty and has no spans; rows that repeat are
searched each; null ids are kept; without candidates to learn from nothing is
added to the base spans; further columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm.labelled import matrix
from rollcall.llm.rows import small_batches
from rollcall.llm.trees import Forest, fit

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
SECRET = 4
FIT_ROWS = 20_000
PRECISION = 0.99
CONTEXT = 24

# The base patterns.  A digit run is entered at its first digit
# only, which finds the same leftmost matches.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

# Candidate generators beyond the base patterns
_SPELLED = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+\s?[\[({<]\s?at\s?[\])}>]\s?[A-Za-z0-9-]+"
    r"(?:(?:\.|\s?[\[({<]\s?dot\s?[\])}>]\s?)[A-Za-z0-9-]+)+",
    re.IGNORECASE,
)
_DOTTED = re.compile(
    r"(?<![0-9.])[0-9]{1,3}(?:(?:\s?[\[({<]\s?(?:\.|dot)\s?[\])}>]\s?|\s\.\s?|\.\s|\sdot\s)[0-9]{1,3}){3}(?![0-9])", re.IGNORECASE
)
_RUN = re.compile(r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{16,}={0,2}")
_NAMED = re.compile(r"""[=:]\s?["']?\Z""")
_DIGITS = re.compile(r"(?<![0-9A-Za-z])\(?[0-9][0-9 ().\-/]{6,30}[0-9](?![0-9A-Za-z])")
_HINTS = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "host", "server", "addr"),
    "card": ("card", "visa", "credit", "pay"),
    "phone": ("tel", "phone", "call", "fax", "mobile"),
    "secret": ("token", "secret", "passw", "key", "auth", "credential"),
}


class Span(NamedTuple):
    kind: int
    start: int
    end: int


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, done
        else:
            done = at + 1  # no match can reach back over an @
        at = text.find("@", done)


def _octet(digits: str) -> bool:
    """Whether digits, of any length, are at most 255."""
    value = digits.lstrip("0")
    return len(value) <= 3 and int(value or "0") <= 255


def base_candidates(text: str) -> list[tuple[Span, bool]]:
    """Leftmost matches of the base patterns, and whether each passes its rule."""
    out = [(Span(0, a, b), True) for a, b in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        out.append((Span(1, *m.span()), all(_octet(p) for p in m.group().split("."))))
    for m in _CARD.finditer(text):
        number = digits_of(m.group())
        out.append((Span(2, *m.span()), 13 <= len(number) <= 19 and luhn(number)))
    if "+" in text:
        for m in _PHONE.finditer(text):
            out.append((Span(3, *m.span()), 9 <= len(digits_of(m.group())) <= 15))
    return out


def base_spans(text: str) -> list[Span]:
    return sorted(span for span, good in base_candidates(text) if good)


def generated(text: str) -> list[Span]:
    """Further candidates: high recall, may overlap each other and the base spans."""
    out = []
    if "at" in text or "AT" in text or "At" in text:
        out += [Span(0, *m.span()) for m in _SPELLED.finditer(text)]
    out += [Span(1, *m.span()) for m in _DOTTED.finditer(text)]
    for m in _RUN.finditer(text):
        run = m.group()
        if any("0" <= c <= "9" for c in run) and any(c.isalpha() for c in run):
            out.append(Span(SECRET, *m.span()))
    for m in _DIGITS.finditer(text):
        n = len(digits_of(m.group()))
        if 9 <= n <= 15:
            out.append(Span(3, *m.span()))
        if 13 <= n <= 19:
            out.append(Span(2, *m.span()))
    return out


def features(text: str, span: Span) -> list[float]:
    """Format and context of a candidate."""
    inside = text[span.start : span.end]
    number = digits_of(inside)
    before = text[max(0, span.start - CONTEXT) : span.start].lower()
    prev, nxt = text[span.start - 1 : span.start], text[span.end : span.end + 1]
    groups = re.findall("[0-9]+", inside)
    return [
        float(span.kind),
        len(inside),
        len(number),
        len(groups),
        max(map(len, groups), default=0),
        min(map(len, groups), default=0),
        float(bool(number) and luhn(number)),
        max((int(g[:6]) for g in groups), default=0),
        inside.count(" "),
        inside.count("-"),
        inside.count("."),
        inside.count("(") + inside.count("["),
        inside.count("@"),
        float(inside.startswith("+")),
        float(number[:1] in ("3", "4", "5", "6")),
        sum(c.isalpha() for c in inside),
        len(inside) - inside.rfind(".") - 1,
        float(prev.isalnum()),
        float(nxt.isalnum()),
        float(prev in ("=", '"', "'", "/")),
        float(prev in ("", " ", "\n")),
        float(bool(_NAMED.search(before))),
        sum(c.isupper() for c in inside),
        sum(c in "abcdefABCDEF" for c in inside),
        *(float(any(h in before for h in _HINTS[k])) for k in KINDS),
    ]


def rewritten(text: str, span: Span) -> list[str]:
    """A base find in the forms that only the generators find."""
    inside = text[span.start : span.end]
    if span.kind == 0:
        local, _, domain = inside.partition("@")
        spelled = domain.replace(".", " [dot] ")
        return [f"{local} [at] {spelled}", f"{local}(at){domain}", f"{local} (at) {domain.replace('.', ' (dot) ')}"]
    if span.kind == 1:
        return [inside.replace(".", dot) for dot in ("[.]", " [dot] ", " . ", "(dot)", " dot ")]
    if span.kind == 2:
        groups = re.findall("[0-9]+", inside)
        if len(groups) == 1:
            groups = re.findall("[0-9]{1,4}", inside)
        return [sep.join(groups) for sep in (".", "/")]
    if span.kind == 3:
        plain = inside[1:]
        return [plain, re.sub(r"[ ().-]+", ".", plain), re.sub(r"[ ().-]+", "/", plain)]
    return []


def _rewritten_spans(text: str, span: Span) -> Iterator[tuple[str, Span]]:
    """(text, candidate) for each rewritten form that the generators find in the find's own context."""
    before, after = text[max(0, span.start - 2 * CONTEXT) : span.start], text[span.end : span.end + CONTEXT]
    for form in rewritten(text, span):
        changed = before + form + after
        end = len(before) + len(form)
        for other in generated(changed):
            if other.kind == span.kind and other.start <= len(before) and other.end >= end:
                yield changed, other


def _names_secret(text: str, span: Span) -> bool:
    """Whether the text gives the run to a key that is called a secret."""
    before = text[max(0, span.start - CONTEXT) : span.start].lower()
    return bool(_NAMED.search(before)) and any(h in before for h in _HINTS["secret"])


def _fails(text: str, span: Span) -> bool:
    """Whether a generated candidate is surely none of its kind."""
    inside = text[span.start : span.end]
    if span.kind == 0:
        return re.search(r"[A-Za-z]{2,}\Z", inside) is None
    if span.kind == 1:
        return not all(_octet(g) for g in re.findall("[0-9]+", inside))
    if span.kind == 2:
        return not luhn(digits_of(inside))
    if span.kind == SECRET:
        return not _names_secret(text, span)
    before = text[max(0, span.start - CONTEXT) : span.start].lower()
    return not any(h in before for h in _HINTS[KINDS[span.kind]])


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, generated, x) of the candidates of each text whose label is known."""
    for batch in batches:
        labels, made, rows = [], [], []

        def add(text: str, span: Span, label: bool, by_generator: bool):
            labels.append(int(label))
            made.append(by_generator)
            rows.append(features(text, span))

        for value in batch.column(0):
            text = value.as_py() or ""
            found = base_candidates(text)
            taken = sorted((span.start, span.end) for span, good in found if good)
            reach = list(accumulate((end for _, end in taken), max))
            for span, good in found:
                if good or span.end - span.start >= 7:  # a lone short number is no look-alike
                    if good or not _overlaps(taken, reach, span):
                        add(text, span, good, False)
                if good:
                    for changed, other in _rewritten_spans(text, span):
                        add(changed, other, True, True)
            for span in generated(text):
                if _overlaps(taken, reach, span):
                    continue
                if _fails(text, span):
                    add(text, span, False, True)
                elif span.kind == SECRET:
                    add(text, span, True, True)
        if labels:
            yield pa.RecordBatch.from_arrays(
                [pa.array(labels, pa.int32()), pa.array(made, pa.bool_()), pa.array(rows, pa.list_(pa.float64()))],
                ["label", "made", "x"],
            )


def _overlaps(taken: list[tuple[int, int]], reach: list[int], span: Span) -> bool:
    """Whether one of ``taken`` (sorted; ``reach``: largest end so far) overlaps the span."""
    at = bisect_left(taken, (span.end,))
    return at > 0 and reach[at - 1] > span.start


class Model(NamedTuple):
    forest: Forest
    thresholds: tuple[float, ...]  # by kind; above 1: nothing is added


def fit_pii(docs: DataFrame, most: int = FIT_ROWS, precision: float = PRECISION) -> Model:
    """Trees and thresholds from at most ``most`` candidates, taken from documents in hash order."""
    small_batches(docs.sparkSession)
    # a document gives one candidate or more, so this many documents are enough and bound the work
    hinted = docs.where(F.col("text").rlike("[0-9]{3}|@|[0-9][.][0-9]")).select("doc_id", "text")
    ids = hinted.select("doc_id", F.xxhash64("text").alias("mark")).orderBy(F.xxhash64("doc_id", "mark"), "doc_id").limit(most)
    rows = hinted.withColumn("mark", F.xxhash64("text")).join(F.broadcast(ids.distinct()), ["doc_id", "mark"])
    got = rows.select("text").mapInArrow(_examples, "label int, made boolean, x array<double>")
    got = got.orderBy(F.xxhash64("x", "label", "made"), "label", "made").limit(most).toArrow()
    y = got.column("label").to_numpy().astype(float)
    x = matrix(got.column("x"))
    made = np.array(got.column("made").to_pylist(), bool)
    held = np.arange(len(y)) % 5 == 0
    forest = fit(x[~held], y[~held], trees=40, depth=4)
    limits = []
    for kind in range(len(KINDS)):
        own = held & made & (x[:, 0] == kind) if len(y) else held  # thresholds are for generated candidates
        limits.append(_limit(forest.probability(x[own]), y[own], precision))
    return Model(forest, tuple(limits))


def _limit(score: np.ndarray, y: np.ndarray, precision: float) -> float:
    """Half-way below the least score from which on at least ``precision`` are positive; 2.0 if there is none."""
    if not len(y):
        return 2.0
    order = np.argsort(-score, kind="stable")
    share = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    # equal scores stand or fall together
    ends = np.append(score[order][1:] != score[order][:-1], True)
    good = np.flatnonzero((share >= precision) & ends)
    if not len(good):
        return 2.0
    last = good[-1]
    below = score[order][last + 1] if last + 1 < len(y) else 0.0
    return max(0.5, float(score[order][last] + below) / 2)


def find(text: str, model: Model) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans) of a text, each sorted by kind and start."""
    base = base_spans(text)
    more = generated(text)
    if not more:
        return base, base
    score = model.forest.probability(np.array([features(text, s) for s in more], float))
    ranked = sorted((-p, s) for p, s in zip(score.tolist(), more) if p >= model.thresholds[s.kind])
    taken = sorted((s.start, s.end) for s in base)
    added = []
    for _, span in ranked:
        at = bisect_left(taken, (span.start, span.end))
        clear_left = at == 0 or taken[at - 1][1] <= span.start
        if clear_left and (at == len(taken) or taken[at][0] >= span.end):
            taken.insert(at, (span.start, span.end))
            added.append(span)
    return base, sorted(base + added)


def redact(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans merge."""
    out, at = [], 0
    for span in sorted(spans, key=lambda s: (s.start, -s.end)):
        if span.start >= at:
            out += [text[at : span.start], f"[{KINDS[span.kind]}]"]
        at = max(at, span.end)
    return "".join([*out, text[at:]])


FOUND = "doc_id bigint, base array<struct<kind:string,start:int,end:int>>, spans array<struct<kind:string,start:int,end:int>>, redacted string"


def find_pii(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: its base spans, all spans (code points, end exclusive) and the redacted text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        as_rows = lambda spans: [{"kind": KINDS[k], "start": a, "end": b} for k, a, b in spans]
        for batch in batches:
            base, spans, texts = [], [], []
            for value in batch.column(1):
                text = value.as_py()
                few, all_spans = find(text or "", model)
                base.append(as_rows(few))
                spans.append(as_rows(all_spans))
                texts.append(redact(text, all_spans) if text is not None and all_spans else text)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(base, kind), pa.array(spans, kind), pa.array(texts, pa.string())],
                ["doc_id", "base", "spans", "redacted"],
            )

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, FOUND)
