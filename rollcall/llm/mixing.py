"""Mixing sources to target weights, exact to the word.

Method.  Every document gets a hash-random key (md5 of seed, id and the
text's md5).  Rows are range-sorted by that key within their source; distributed
prefix sums of the word counts give each document's place; the source is cut
at its exact budget.  A target above the source's size repeats whole epochs
first and cuts only the last one.  The document at the cut is taken in part,
so that a very long document cannot miss the budget.

Weights go round the sources in code point order (null last).  A target stops
at ``cap`` times its source; the excess is shared again by weight until no
target is above.  That search works on one row per source and brings two sums
per step to the driver.

Only DataFrame functions run here.  A source holding a third of all rows is
sorted in slices of its key range (see ``prefix``), never in one task.

Defined results: null text has no words and takes 0; null source is a source
of its own; rows that repeat are mixed each for itself; rows that share an id
but not a text have keys of their own; no words at all, or an empty table,
gives targets of 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.llm.prefix import random_key, running_total
from rollcall.llm.rows import SPACE_RUN, WORD, split_words
from rollcall.plans.positions import with_position
from rollcall.session import durable

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0
SEED = 17


def source_group(source: Column) -> Column:
    """A source as a non-null grouping key; null differs from every text."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def targets(
    sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP
) -> DataFrame:
    """Per source (source, source_size) also its weight and target in words."""
    ranked = with_position(sources, [F.col("source").asc_nulls_last()], "_rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("_rank") - 1) % len(weights) + 1).cast("int"))
    # positive sizes only: an empty source has target 0 and would never leave the search
    ranked = durable(ranked.select("source", "source_size", weight.alias("weight")), "sources")
    room = F.col("source_size") * F.lit(cap)
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    budget, level = total * share, 0.0
    while total:
        free = room > F.col("weight") * F.lit(level)
        row = ranked.agg(
            F.coalesce(F.sum(F.when(~free, room)), F.lit(0.0)).alias("full"), F.sum(F.when(free, F.col("weight"))).alias("w")
        ).first()
        if not row["w"]:
            level = float("inf")
            break
        higher = (budget - row["full"]) / row["w"]
        if higher <= level:
            break
        level = higher
    target = F.least(room, F.col("weight") * F.lit(level)) if total else F.lit(0.0)
    return ranked.withColumn("target", target)


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    cap: float = CAP,
    seed: int = SEED,
) -> DataFrame:
    """One row per document: doc_id, _text (hash of its text), source, size, source_size, target, taken.

    ``taken`` counts the words the mix takes of the document, repeats
    included: ``taken div size`` whole copies and the first ``taken % size``
    words once more.
    """
    sized = durable(
        docs.select(
            "doc_id",
            F.xxhash64("text").alias("_text"),
            "source",
            F.size(split_words(F.col("text"))).cast("long").alias("size"),
            random_key(F.lit(seed), F.col("doc_id"), F.md5("text")).alias("key"),
        ),
        "sizes",
    )
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = durable(targets(sources, weights, share, cap), "targets")
    goal = goal.select(source_group(F.col("source")).alias("_source"), "source_size", "target")
    placed = running_total(
        sized, source_group(F.col("source")), "key", ["doc_id", "_text", "size"], F.col("size"), "before", sized.count()
    ).withColumn("_source", source_group(F.col("source")))
    out = placed.join(goal, "_source")
    budget = F.floor(F.col("target"))
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    rest = budget - epochs * F.col("source_size")
    partly = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before")))
    return out.select(
        "doc_id", "_text", "source", "size", "source_size", "target", (epochs * F.col("size") + partly).cast("long").alias("taken")
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: ``docs`` with each row as often as taken, the row at a cut shortened.

    Copies are whole texts; the shortened text keeps its first words and the
    white space between them.  Rows without words are in no mix.  Of rows equal in
    doc_id, text and source one stands for all; if their other columns differ, any of them does.
    """
    plan = mix(docs, **options).where("taken > 0").select(
        F.coalesce("doc_id", F.lit(-1)).alias("__llm_id"),
        F.col("_text").alias("__llm_text"),
        source_group(F.col("source")).alias("__llm_source"),
        F.col("size").alias("__llm_size"),
        F.col("taken").alias("__llm_taken"),
    )
    # rows that repeat have plans of their own, which differ at a cut: add them up for one of the rows
    key = ["__llm_id", "__llm_text", "__llm_source"]
    plan = plan.groupBy(*key).agg(F.first("__llm_size").alias("__llm_size"), F.sum("__llm_taken").alias("__llm_taken"))
    keyed = docs.withColumns(
        {
            "__llm_id": F.coalesce(F.col("doc_id"), F.lit(-1)),
            "__llm_text": F.xxhash64("text"),
            "__llm_source": source_group(F.col("source")),
        }
    )
    size, taken = F.col("__llm_size"), F.col("__llm_taken")
    whole = F.array_repeat(size, F.floor(taken / size).cast("int"))
    cut = F.when(taken % size > 0, F.array(taken % size)).otherwise(F.array().cast("array<bigint>"))
    copies = keyed.dropDuplicates(key).join(plan, key)
    copies = copies.select("*", F.explode(F.concat(whole, cut)).alias("__llm_words"))
    words = F.regexp_extract_all("text", F.lit(f"({SPACE_RUN})?{WORD}"), 0)
    text = F.when(F.col("__llm_words") == size, F.col("text")).otherwise(
        F.array_join(F.slice(words, F.lit(1), F.col("__llm_words").cast("int")), "")
    )
    return copies.withColumn("text", text).select(*docs.columns)
