"""Connected components of an edge table by alternating star contraction.

Every round is two pairs of (aggregate, join): neighbours are re-linked to the
least node they see, first larger ones (large star), then smaller ones (small
star), until the edges no longer change and form one star for each component.
The per-node minimum is a map-side combined aggregate, so a hub's edges never
meet in one task.  The minimum is handed out by a broadcast where the edges were
counted and are few, else by an equi-join whose edge side adaptive execution can
split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.llm.common import Scratch


#: Edges up to which the nodes' minima (16 bytes each, at most two for an edge) are broadcast.
MAX_BROADCAST_EDGES = 500_000


def _star(links: DataFrame, keep, small: bool) -> DataFrame:
    """``links(u, v)``: give each kept ``v`` and ``u`` itself to u's least node."""
    least = links.groupBy("u").agg(F.min("v").alias("m")).select(
        F.col("u").alias("w"), F.least("u", "m").alias("m"))
    handed = links.join(F.broadcast(least) if small else least, links.u == least.w).where(keep)
    return handed.select(F.col("v").alias("a"), F.col("m").alias("b")).union(
        least.select(F.col("w").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()


def connected_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """``edges(a, b)`` -> ``(node, component)``, component = least node reachable.

    Nulls and self-loops are ignored; nodes without edges do not appear.
    Raises if the contraction has not settled after ``max_rounds``.
    """
    cur = scratch.save(edges.where("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).distinct())
    mark = None
    for _ in range(max_rounds):
        now = cur.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == mark or now[0] == 0:
            # a star fixpoint: each larger end points at its component's least node
            return cur.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                cur.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
        mark = now
        both = cur.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
            cur.select(F.col("b").alias("u"), F.col("a").alias("v")))
        small = now[0] <= MAX_BROADCAST_EDGES
        large = _star(both, F.col("v") > F.col("u"), small)
        large = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        nxt = scratch.save(_star(large, F.col("v") != F.col("m"), small))
        scratch.drop(cur)
        cur = nxt
    raise RuntimeError("components did not settle")
