"""Benchmark decontamination: training documents that contain test passages.

Method.  Test items are normalised (A-Z folded, words of digits, a-z and
non-ASCII characters) and cut into windows of ten words; an item of fewer
words is one window.  The hashes of the distinct windows form a broadcast hash
set; every document's token windows are scanned against it in one pass without
a shuffle, the words of each hit are compared with the test window itself, and
the hit spans are reported per document, or the documents are removed.

The broadcast holds two numbers per window.  Its size is checked: beyond
``BROADCAST_WINDOWS`` the set is cut by hash into blocks of at most that many,
and the documents are scanned once per block.

Only DataFrame functions run here.  A document's hits are grouped on
(doc_id, text hash), at most one row per word of one document.

Defined results: null text or no words gives 0 words and no hits; null or
repeated doc_ids give each row the result of its own text; null item texts
have no windows, null item_ids are not counted as items; an empty benchmark
leaves every document clean; further columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.session import durable

WINDOW = 10
BROADCAST_WINDOWS = 1_000_000

# Fixed value: everything outside the word characters of the contract
CUT = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def normal_words(text: Column) -> Column:
    """Lower-cased (A-Z only) words of digits, a-z and non-ASCII characters."""
    folded = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(folded, CUT), "")


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def test_windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item_id, size, window, hash): every window of every item, distinct per item."""
    words = items.select("item_id", normal_words(F.col("text")).alias("w")).where("size(w) > 0")
    cut = words.select("item_id", "w", _hashes(F.col("w")).alias("h"), F.least(F.size("w"), F.lit(size)).alias("size"))
    at = cut.select("*", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("size") + 1)).alias("at"))
    return at.select(
        "item_id",
        "size",
        F.array_join(F.slice("w", F.col("at"), F.col("size")), " ").alias("window"),
        F.xxhash64(F.slice("h", F.col("at"), F.col("size"))).alias("hash"),
    ).distinct()


def _keyed(docs: DataFrame, *columns: Column) -> DataFrame:
    """Row key (a text hash tells rows that share an id apart) and the given columns."""
    return docs.select(
        F.coalesce(F.col("doc_id"), F.lit(-1)).alias("_id"), F.xxhash64("text").alias("_text"), *columns
    )


def window_hits(docs: DataFrame, windows: DataFrame, block: int = BROADCAST_WINDOWS) -> DataFrame:
    """(_id, _text, at, size, window): verified occurrences of test windows, ``at`` from 1."""
    hashes = durable(windows.select("hash", "size").distinct(), "windows")
    count = hashes.count()
    sizes = sorted(r["size"] for r in hashes.select("size").distinct().collect())  # at most WINDOW values
    blocks = max(1, -(-count // block))
    words = _keyed(docs, normal_words(F.col("text")).alias("w"))
    hashed = words.select("*", _hashes(F.col("w")).alias("h"))

    def probes(size: int) -> Column:
        starts = F.when(F.size("h") >= size, F.sequence(F.lit(1), F.size("h") - size + 1))
        return F.transform(
            F.coalesce(starts, F.array().cast("array<int>")),
            lambda i: F.struct(
                i.alias("at"), F.lit(size).alias("size"), F.xxhash64(F.slice("h", i, F.lit(size))).alias("hash")
            ),
        )

    found = None
    for part in range(blocks):
        known = F.broadcast(hashes.where(F.pmod("hash", F.lit(blocks)) == part))
        probe = F.flatten(F.array(*[probes(s) for s in sizes or [WINDOW]]))
        scan = hashed.select("_id", "_text", "w", F.explode(probe).alias("p"))
        scan = scan.select("_id", "_text", "w", "p.at", "p.size", "p.hash").join(known, ["hash", "size"])
        hits = scan.select(
            "_id", "_text", "at", "size", F.array_join(F.slice("w", F.col("at"), F.col("size")), " ").alias("window")
        )
        found = hits if found is None else found.unionByName(hits)
    # the words themselves decide, not their hash
    return found.join(windows.select("window").distinct(), "window", "left_semi")


def covered(spans: Column) -> Column:
    """Words inside the union of (at, size) spans."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to"))
    end = lambda s: s["at"] + s["size"]
    return F.aggregate(
        F.array_sort(spans),
        start,
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(F.lit(0), end(s) - F.greatest(s["at"], acc["to"]))).alias("n"),
            F.greatest(end(s), acc["to"]).alias("to"),
        ),
        lambda acc: acc["n"],
    )


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """One row per document: its id, word count, spans of hit words and the items found.

    Columns doc_id, n_words, spans (array of at, size; one per hit window),
    n_hit, items (sorted as strings), contaminated.
    """
    windows = durable(test_windows(items, size), "items")
    hits = durable(window_hits(docs, windows), "hits")
    spans = hits.groupBy("_id", "_text").agg(F.collect_set(F.struct("at", "size")).alias("spans"))
    owners = windows.select("window", F.col("item_id").cast("string").alias("item"))
    found = hits.select("_id", "_text", "window").distinct().join(owners, "window")
    named = found.groupBy("_id", "_text").agg(F.array_sort(F.collect_set("item")).alias("items"))
    marks = spans.join(named, ["_id", "_text"], "left")
    base = _keyed(docs, F.col("doc_id"), F.size(normal_words(F.col("text"))).cast("long").alias("n_words"))
    out = base.join(marks, ["_id", "_text"], "left")
    return out.select(
        "doc_id",
        "n_words",
        F.array_sort("spans").alias("spans"),
        F.coalesce(covered(F.col("spans")), F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.col("spans").isNotNull().alias("contaminated"),
    )


def remove_contaminated(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """``docs`` without the documents in which a test window occurs; all columns kept."""
    hits = window_hits(docs, durable(test_windows(items, size), "items"))
    bad = durable(hits.select("_id", "_text").distinct(), "contaminated")
    bad = bad.select(F.col("_id").alias("__llm_id"), F.col("_text").alias("__llm_text"))
    key = {"__llm_id": F.coalesce(F.col("doc_id"), F.lit(-1)), "__llm_text": F.xxhash64("text")}
    return docs.withColumns(key).join(bad, list(key), "left_anti").select(*docs.columns)
