"""Connected components of a link table by alternating star contractions.

Large-star: every node links its larger neighbours to its smallest
neighbour.  Small-star: every node links its smaller neighbours to the
smallest of them.  Each round shortens all paths, so the number of rounds is
logarithmic in the longest chain.  A round is a partial ``min`` per node and
a join back on the node, so a node with very many links is pre-aggregated and
its rows can be split by the skew join; no neighbour list is ever collected.
Every round is written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.session import durable


def _state(links: DataFrame) -> tuple[int, int]:
    row = links.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")
    ).first()
    return row["n"], int(row["s"] or 0)


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b: bigint) to (node, root): each linked node and the smallest node it reaches.

    Loops and nulls are ignored; an empty table gives an empty table.
    """
    clean = links.where("a is not null and b is not null and a <> b")
    now = durable(clean.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = _state(now)
    while state[0]:
        # large-star: (node, other) both ways; larger others go to the node's smallest
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        # small-star: every link already points from the larger to the smaller node
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        nxt = durable(moved.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "links")
        after = _state(nxt)
        if after == state:
            break
        now, state = nxt, after
    roots = now.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    tops = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    # at the fixed point every link is (node, root), so no node is in both parts
    return roots.unionByName(tops)
