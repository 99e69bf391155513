"""Substring search through a trigram index (O-07).

A match of ``%q%`` needs the whole scan; an index of the three-character runs
of all names needs only the names that share the runs of ``q``.  The index is a
posting table (trigram, id), sorted by both over all files, so that a look-up
reads the row groups of its trigrams, and a table of how many ids each
trigram has.  A very common trigram is spread over many files like any other.

A request looks up how common its trigrams are (as many rows as ``q`` has
characters), intersects the rarest ``RAREST`` posting lists, and verifies the
names found by the same ``ilike`` as the scan, so the answer is exact.  Without
a literal run of three characters, or if even the rarest trigram is in more
than one name in ``SHARE``, the directory is scanned.

Both sides are compared in lower case, as ``ilike`` does.  Runs end at wildcards
and at characters outside ASCII, whose case mapping is left to ``ilike``.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.functions.text import like_pattern
from rollcall.operators.search import SearchRequest, check_section, search_unsorted

GRAM = 3
RAREST = 3
SHARE = 10
FEW_IDS = 1_000  # ids that are pushed into the scan as a list


def literal_runs(q: str, literal: bool = False) -> list[str]:
    """Lower-case runs of ASCII characters that every match of ``%q%`` contains."""
    pattern, runs, run, i = like_pattern(q, literal), [], "", 0
    while i < len(pattern):
        ch = pattern[i]
        wild = ch in "%_"
        if ch == "\\" and i + 1 < len(pattern):
            i += 1
            ch = pattern[i]
        if wild or not ch.isascii():
            runs.append(run)
            run = ""
        else:
            run += ch.lower()
        i += 1
    return [r for r in [*runs, run] if r]


def trigrams_of(q: str, literal: bool = False) -> list[str]:
    return sorted({r[i : i + GRAM] for r in literal_runs(q, literal) for i in range(len(r) - GRAM + 1)})


def postings_of(users: DataFrame, column: str = "username") -> DataFrame:
    """(trigram, id): every distinct trigram of each lower-case name; names under three characters have none."""
    name = F.lower(F.col(column))
    named = users.select("id", name.alias("name")).where(F.char_length("name") >= GRAM)
    grams = F.transform(F.sequence(F.lit(1), F.char_length("name") - GRAM + 1), lambda i: F.substring(F.col("name"), i, F.lit(GRAM)))
    return named.select(F.explode(F.array_distinct(grams)).alias("trigram"), "id")


@dataclass
class TrigramIndex:
    postings: DataFrame  # trigram, id
    counts: DataFrame  # trigram, n; the empty trigram has the number of rows


def write_index(users: DataFrame, root: str, column: str = "username") -> None:
    """Index of a directory under ``root``; the counts are written last."""
    postings = postings_of(users, column)
    ordered = postings.repartitionByRange("trigram", "id").sortWithinPartitions("trigram", "id")
    ordered.write.parquet(os.path.join(root, "postings"))
    stored = users.sparkSession.read.schema(postings.schema).parquet(os.path.join(root, "postings"))
    total = users.agg(F.lit("").alias("trigram"), F.count(F.lit(1)).alias("n"))
    counts = stored.groupBy("trigram").agg(F.count(F.lit(1)).alias("n")).unionByName(total)
    counts.repartitionByRange("trigram").sortWithinPartitions("trigram").write.parquet(os.path.join(root, "counts"))


def read_index(spark: SparkSession, root: str) -> TrigramIndex:
    return TrigramIndex(
        spark.read.schema("trigram string, id string").parquet(os.path.join(root, "postings")),
        spark.read.schema("trigram string, n bigint").parquet(os.path.join(root, "counts")),
    )


def narrowed(users: DataFrame, index: TrigramIndex, req: SearchRequest) -> DataFrame:
    """The rows of ``users`` that can match ``req.q``: all of them if the index does not help."""
    grams = trigrams_of(req.q, req.literal) if req.q else []
    if not grams:
        return users
    found = index.counts.where(F.col("trigram").isin("", *grams)).collect()  # at most len(q) + 1 rows
    n = {r["trigram"]: r["n"] for r in found}
    if len(n) < len(grams) + 1:
        return users.where(F.lit(False))  # a run that no name has
    rarest = sorted(grams, key=lambda g: (n[g], g))[:RAREST]
    least = n[rarest[0]]
    if least * SHARE > n[""]:
        return users
    ids = index.postings.where(F.col("trigram").isin(*rarest))
    ids = ids.groupBy("id").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") == len(rarest)).select("id")
    if least <= FEW_IDS:
        few = [r["id"] for r in ids.collect()]
        return users.where(F.col("id").isin(few)) if few else users.where(F.lit(False))
    return users.join(ids, "id", "left_semi")


def search_indexed(users: DataFrame, index: TrigramIndex, req: SearchRequest) -> DataFrame:
    """``search.search_unsorted`` with the same rows, through the index."""
    check_section(req.section)
    return search_unsorted(narrowed(users, index, req), req)
