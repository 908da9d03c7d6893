"""Distances between sketches by equi-joins on bits."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladeframe.functions.distance import ani_distance, jaccard, rounded
from cladeframe.operators.sketch import sizes


def with_distance(shared: DataFrame, k: int) -> DataFrame:
    return shared.withColumn("jaccard", jaccard(F.col("inter"), F.col("uni"))) \
        .withColumn("ani", ani_distance(F.col("jaccard"), k))


#: Holders of a bit up to which its pairs are made in one task.
HOLDERS = 512


def _classes(held: DataFrame, by: tuple = ()) -> DataFrame:
    """``<by>, bit, weight``: one bit for each set of holders, and how many bits have those holders.

    ``held(<by>, bit, side, holder)``.  Neighbouring k-mers of a shared passage have the same
    holders, so the joins below see a passage once and not once per k-mer.  Holder
    sets are told apart by two 64-bit digests.  Bits that are not held on both sides
    (or, with one side, only once) have no pair and are left out.
    """
    sets = held.groupBy(*by, "bit").agg(
        F.count_if(F.col("side") == 0).alias("left"), F.count_if(F.col("side") == 1).alias("right"),
        F.bit_xor(F.xxhash64("side", "holder")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "side", "holder")).alias("y"))
    return sets.groupBy(*by, "left", "right", "x", "y").agg(F.min("bit").alias("bit"), F.count(F.lit(1)).alias("weight"))


def overlaps(bits: DataFrame, by: tuple = ()) -> DataFrame:
    """``a, b, inter`` of all pairs ``a < b`` that share a bit, with ``by`` only those of one group (columns of ``bits``).

    A bit with many holders is dealt out: each holder goes to one slice as the lesser end
    and to all slices as the greater one.
    """
    held = bits.select(*by, "bit", F.lit(0).alias("side"), F.col("genome_id").alias("holder"))
    shared = _classes(held, by).where("left > 1").select(*by, "bit", "weight", F.ceil(F.col("left") / HOLDERS).cast("int").alias("slices"))
    kept = bits.join(shared, [*by, "bit"])
    left = kept.select(*by, "bit", "weight", F.col("genome_id").alias("a"), F.pmod(F.xxhash64("genome_id"), F.col("slices")).cast("int").alias("slice"))
    right = kept.select(*by, "bit", F.col("genome_id").alias("b"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    return left.join(right, [*by, "bit", "slice"]).where("a < b").groupBy("a", "b").agg(F.sum("weight").alias("inter"))


def shared_classes(q: DataFrame, t: DataFrame) -> DataFrame:
    """``bit, weight`` of the bits that ``q(query, bit)`` and ``t(target, bit)`` share, one for each set of holders."""
    held = q.select("bit", F.lit(0).alias("side"), F.col("query").cast("string").alias("holder")).union(
        t.select("bit", F.lit(1), F.col("target").cast("string")))
    return _classes(held).where("left > 0 and right > 0").select("bit", "weight")


def _common(q: DataFrame, t: DataFrame) -> DataFrame:
    """``query, target, common`` of all pairs that share a bit."""
    shared = shared_classes(q, t)
    return q.join(shared, "bit").join(t, "bit").groupBy("query", "target").agg(F.sum("weight").alias("common"))


def pairwise(bits: DataFrame, k: int, by: tuple = ()) -> DataFrame:
    """``a, b, inter, uni, jaccard, ani`` of all pairs that share a bit (and the columns ``by``); others are at distance 1."""
    n = sizes(bits)
    na, nb = n.select(F.col("genome_id").alias("a"), F.col("n").alias("na")), n.select(F.col("genome_id").alias("b"), F.col("n").alias("nb"))
    found = overlaps(bits, by).join(na, "a").join(nb, "b").select("a", "b", "inter", (F.col("na") + F.col("nb") - F.col("inter")).alias("uni"))
    return with_distance(found, k)


def within(bits: DataFrame, groups: DataFrame, by: str, k: int) -> DataFrame:
    """Pairs of :func:`pairwise` within the groups of ``groups(genome_id, <by>)``, whose names are part of the join key."""
    return pairwise(bits.join(groups.select("genome_id", by), "genome_id"), k, (by,))


def least_jaccard(distance: float, k: int) -> float:
    """The Jaccard index below which no pair is within a distance, with room for both roundings."""
    share = math.exp(-k * (distance + 1e-5))
    return max(share / (2 - share) - 1e-5, 0.0)


def close_pairs(bits: DataFrame, k: int, threshold: float, keep=lambda df: df) -> DataFrame:
    """``a, b, ani`` of all pairs ``a < b`` within a distance below 1, without the pairs that are further apart.

    Equal sketches are one.  In the order of their holders' number, rare bits first, two
    sets of a Jaccard index of at least j meet in the first n - ceil(j n) + 1 bits of both,
    and their sizes differ by no more than that share; only such pairs are counted in full.
    """
    j = least_jaccard(threshold, k)
    digest = keep(bits.groupBy("genome_id").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("bit")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "bit")).alias("y")))
    named = keep(digest.join(digest.groupBy("n", "x", "y").agg(F.min("genome_id").alias("rep")), ["n", "x", "y"]).select("genome_id", "rep", "n"))
    mine = keep(bits.join(named.where("genome_id = rep").select("genome_id", "n"), "genome_id"))
    often = mine.groupBy("bit").agg(F.count(F.lit(1)).alias("often"))
    order = Window.partitionBy("genome_id").orderBy("often", "bit")
    first = mine.join(often, "bit").withColumn("at", F.row_number().over(order)) \
        .where((F.col("at") <= F.col("n") - F.ceil(F.col("n") * F.lit(j) - F.lit(1e-9)) + 1) & (F.col("often") > 1))
    first = keep(first.select("genome_id", "n", "bit", F.ceil(F.col("often") / HOLDERS).cast("int").alias("slices")))
    left = first.select("bit", F.col("genome_id").alias("a"), F.col("n").alias("na"), F.pmod(F.xxhash64("genome_id"), F.col("slices")).cast("int").alias("slice"))
    right = first.select("bit", F.col("genome_id").alias("b"), F.col("n").alias("nb"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    near = left.join(right, ["bit", "slice"]).where((F.col("a") < F.col("b")) & (F.least("na", "nb") >= F.greatest("na", "nb") * F.lit(j) - F.lit(1e-6)))
    near = keep(near.select("a", "b", "na", "nb").distinct())
    both = near.join(mine.select(F.col("genome_id").alias("a"), "bit"), "a").join(mine.select(F.col("genome_id").alias("b"), "bit"), ["b", "bit"]) \
        .groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("inter")).withColumn("uni", F.col("na") + F.col("nb") - F.col("inter"))
    found = keep(with_distance(both, k).where(F.col("ani") <= threshold).select("a", "b", "ani"))
    # what has the same sketch has the same pairs
    x, y = named.select(F.col("rep").alias("a"), F.col("genome_id").alias("x")), named.select(F.col("rep").alias("b"), F.col("genome_id").alias("y"))
    spread = found.join(x, "a").join(y, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "ani")
    same = x.join(y, F.col("a") == F.col("b")).where("x < y").select(F.col("x").alias("a"), F.col("y").alias("b"), F.lit(0.0).alias("ani"))
    return spread.union(same)


def dense(found: DataFrame, groups: DataFrame, by: str) -> DataFrame:
    """All pairs ``a < b`` within each group, pairs without overlap at distance 1.

    ``groups(genome_id, <by>)``; only meant for groups whose full matrix is wanted.
    """
    left = groups.select(F.col("genome_id").alias("a"), by)
    right = groups.select(F.col("genome_id").alias("b"), by)
    return left.join(right, by).where("a < b").join(found.select("a", "b", "ani"), ["a", "b"], "left") \
        .select(by, "a", "b", F.coalesce("ani", F.lit(1.0)).alias("ani"))


def cross_distance(queries: DataFrame, targets: DataFrame, k: int) -> DataFrame:
    """``query, target, inter, uni, jaccard, ani`` of query and target sketches that overlap."""
    q = queries.select(F.col("genome_id").alias("query"), "bit")
    t = targets.select(F.col("genome_id").alias("target"), "bit")
    nq = q.groupBy("query").agg(F.count(F.lit(1)).alias("nq"))
    nt = t.groupBy("target").agg(F.count(F.lit(1)).alias("nt"))
    found = _common(q, t).withColumnRenamed("common", "inter")
    found = found.join(nq, "query").join(nt, "target").select(
        "query", "target", "inter", (F.col("nq") + F.col("nt") - F.col("inter")).alias("uni"))
    return with_distance(found, k)


def containment(queries: DataFrame, targets: DataFrame) -> DataFrame:
    """``query, target, common, total, score``: share of a query's bits that a target holds.

    Targets without a common bit do not appear (their score is 0).
    """
    q = queries.select(F.col("genome_id").alias("query"), "bit")
    t = targets.select(F.col("genome_id").alias("target"), "bit")
    total = q.groupBy("query").agg(F.count(F.lit(1)).alias("total"))
    return _common(q, t).join(total, "query") \
        .withColumn("score", rounded(F.col("common") / F.col("total")))


def replicas(found: DataFrame, threshold: float) -> DataFrame:
    """Pairs that replicate each other: distance at most ``threshold``."""
    return found.where(F.col("ani") <= threshold)
