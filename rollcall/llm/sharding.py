"""Sharding: longest-processing-time scheduling of groups that stay together.

Method.  A group is all documents of equal text; its weight is its bytes.
Groups sorted by falling weight go to the least-loaded shard, found through a
heap.  Groups of one weight are interchangeable, so the heap works on runs
(weight, number of groups): a run longer than ``shards`` is placed at once by
the level up to which it fills the shards, which is what the heap would come
to.  Every group is scheduled this way, whatever its size.

Runs come to the driver in order of falling weight, one partition of the sorted
runs at a time; it keeps the loads of the shards only, and writes how many
groups of a run each shard takes in blocks of ``BLOCK`` runs.  There are as many runs as distinct
weights: at most the square root of twice all bytes, as D distinct weights add up
to D * D / 2 bytes at least (and 4,604 for 10,000 documents of the test tables).

Weights are summed per group with partial aggregates, so a group that holds a
third of all rows is no hot key.  A group's rank within its run is a distributed
running count, and its shard follows from the rank.  Slots come from
distributed running counts.

Defined results: null text counts no bytes and is in the group of the empty
text (crc 0); rows that repeat are members of one group; null ids are kept; an
empty table has no rows; further columns are ignored.
"""

from __future__ import annotations

import heapq
import os
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm.prefix import random_key, running_total
from rollcall.llm.rows import sure_small
from rollcall.operators.joins import lookup_join
from rollcall.session import durable, scratch_path

SHARDS = 40
ROW_BYTES = 16
BLOCK = 100_000  # runs; at most SHARDS numbers each
BROADCAST_RUNS = 20_000  # runs of up to SHARDS parts, about 10 MB

_GROUP = ["text_hash", "text_crc32", "size"]
_PLAN = "weight bigint, ends array<bigint>, shards array<int>"


def _taken(loads: list[int], weight: int, level: int) -> list[int]:
    """Groups that each shard takes at loads of up to ``level``."""
    return [max(0, (level - load) // weight + 1) for load in loads]


def place_run(loads: list[int], weight: int, count: int) -> list[int]:
    """How many of ``count`` groups of one weight each shard takes: each to the least-loaded one, ties to the first.

    Adds them to ``loads``.
    """
    taken = [0] * len(loads)
    if count <= len(loads):
        heap = [(load, shard) for shard, load in enumerate(loads)]
        heapq.heapify(heap)
        for _ in range(count):
            load, shard = heap[0]
            taken[shard] += 1
            heapq.heapreplace(heap, (load + weight, shard))
    else:
        # the heap serves the ``count`` smallest of load + k * weight: find the level that holds them
        low, high = min(loads) - 1, min(loads) + weight * count
        while high - low > 1:
            level = (low + high) // 2
            low, high = (level, high) if sum(_taken(loads, weight, level)) < count else (low, level)
        taken = _taken(loads, weight, low)
        rest = count - sum(taken)
        for shard, load in enumerate(loads):
            if rest and (high - load) % weight == 0 and high >= load:
                taken[shard] += 1
                rest -= 1
    for shard, n in enumerate(taken):
        loads[shard] += n * weight
    return taken


def schedule(runs: Iterable[tuple[int, int]], shards: int) -> Iterator[tuple[int, list[int], list[int]]]:
    """For (weight, count) runs of falling weight: weight, running counts, and the shard of each count."""
    loads = [0] * shards
    for weight, count in runs:
        taken = place_run(loads, weight, count)
        of, ends, at = [s for s, n in enumerate(taken) if n], [], 0
        for s in of:
            at += taken[s]
            ends.append(at)
        yield weight, ends, of


def _plan(groups: DataFrame, shards: int) -> DataFrame:
    """The schedule as a table (``_PLAN``), one row per run, written in blocks."""
    spark = groups.sparkSession
    runs = durable(groups.groupBy("weight").agg(F.count(F.lit(1)).alias("n")), "runs")
    path = scratch_path(spark, "shard-plans", uuid.uuid4().hex)
    block, part = [], 0

    def write(rows):
        spark.createDataFrame(rows, _PLAN).write.parquet(os.path.join(path, f"part={part}"))

    in_order = runs.orderBy(F.desc("weight")).toLocalIterator()
    for row in schedule(((r["weight"], r["n"]) for r in in_order), shards):
        block.append(row)
        if len(block) == BLOCK:
            write(block)
            block, part = [], part + 1
    if block or not part:
        write(block)
    return spark.read.schema(_PLAN + ", part int").parquet(path).drop("part")


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, slot (gapless from 0 in each shard)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = durable(
        docs.select(
            "doc_id",
            (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.xxhash64(text).alias("text_hash"),
        ),
        "shard-rows",
    )
    groups = rows.groupBy(*_GROUP).agg(F.sum("size").alias("weight"))
    groups = durable(groups.withColumn("key", random_key(*[F.col(c) for c in _GROUP])), "shard-groups")
    plan = _plan(groups, shards)
    one = F.lit(1).cast("long")
    ranked = running_total(groups, F.col("weight"), "key", _GROUP, one, "rank", groups.count())
    # many groups may have one weight, but a weight has one row in the plan
    if sure_small(plan, BROADCAST_RUNS):
        found = ranked.join(F.broadcast(plan), "weight")
        ends, of = F.col("ends"), F.col("shards")
    else:
        found = lookup_join(durable(ranked, "ranked"), ["weight"], plan, "weight")
        ends, of = F.col("weight_row.ends"), F.col("weight_row.shards")
    place = F.size(F.filter(ends, lambda e: e <= F.col("rank")))
    name = F.concat_ws(":", *_GROUP).alias("name")
    placed = durable(found.select(name, of[place].alias("shard")), "placed")
    # copies of one text may be a third of all rows
    sent = lookup_join(rows.select("*", name), ["name"], placed, "name")
    sent = sent.withColumn("shard", F.col("name_row.shard"))
    sent = sent.withColumn("key", random_key(F.col("doc_id"), F.col("text_hash")))
    out = running_total(sent, F.col("shard"), "key", ["doc_id"], F.lit(1).cast("long"), "slot", rows.count())
    return out.select("doc_id", "size", "text_crc32", "shard", "slot")
