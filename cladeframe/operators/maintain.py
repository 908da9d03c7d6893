"""Maintenance of a database: every operation makes a new snapshot of its tables.

Genomes are ``(genome_id, taxonomy, is_reference)``, clusters ``(cluster_id, name, level,
parent)``; names of clusters are label prefixes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladeframe.functions.taxonomy import LEVELS, cluster_number, is_cluster_id, is_defined, last_part
from cladeframe.operators.linkage import place
from cladeframe.operators.sketch import label_sizes
from cladeframe.operators.tree import nodes, paths
from cladeframe.storage import Scratch


def numbered(rows: DataFrame, order: list[str], after: int = 0, column: str = "number") -> DataFrame:
    """Adds numbers from ``after`` + 1 in a stated order, which must be unique.

    Rows are dealt by ranges of the order, written with the number of their range (which
    another run of the plan could draw differently) and counted by range; what goes
    through one task is one number for a range.
    """
    dealt = Scratch(rows.sparkSession).save(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    totals = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.join(F.broadcast(totals.withColumn("_before", before)), "_range").withColumn(
        column, own + F.col("_before") + F.lit(after)).drop("_range", "_n", "_before")


def allocate_ids(rows: DataFrame, order: list[str], after: int = 0, column: str = "cluster_id") -> DataFrame:
    """Adds ``MSBT<n>`` counted from ``after`` + 1 in a stated order (rows: new nodes only)."""
    return numbered(rows, order, after, "_number").withColumn(column, F.concat(F.lit("MSBT"), F.col("_number").cast("string"))).drop("_number")


def add(genomes: DataFrame, clusters: DataFrame) -> DataFrame:
    """Clusters with the missing nodes of the genomes' labels.

    New nodes get ids after the largest in use, from species to kingdom and by name; a
    name ``<level>__MSBT<n>`` that was made here keeps its own id.
    """
    missing = nodes(genomes).join(clusters.select(F.col("name").alias("node")), "node", "left_anti")
    named = F.substring(last_part(F.col("node")), 4, 1_000_000)
    reused = missing.where(is_cluster_id(named)).select(named.alias("cluster_id"), F.col("node").alias("name"), "level", "parent")
    fresh = missing.where(~is_cluster_id(named))
    used = clusters.select("cluster_id").union(reused.select("cluster_id"))
    top = used.agg(F.coalesce(F.max(cluster_number(F.col("cluster_id"))), F.lit(0))).first()[0]
    new = allocate_ids(fresh.withColumn("_up", -F.col("depth")), ["_up", "node"], top).select(
        "cluster_id", F.col("node").alias("name"), "level", "parent")
    columns = ["cluster_id", "name", "level", "parent"]
    return clusters.select(*columns).unionByName(reused.select(*columns)).unionByName(new.select(*columns))


def merge(genomes: DataFrame, species: list[str], into: str) -> DataFrame:
    """Genomes after the named species became one."""
    moved = F.col("taxonomy").isin([s for s in species if s != into])
    return genomes.withColumn("taxonomy", F.when(moved, F.lit(into)).otherwise(F.col("taxonomy")))


def oldest(clusters: DataFrame, by: str) -> DataFrame:
    """The cluster with the least number of each group."""
    return clusters.groupBy(by).agg(F.min_by("cluster_id", cluster_number(F.col("cluster_id"))).alias("cluster_id"))


def smallest_species(genomes: DataFrame, nodes_asked: DataFrame) -> DataFrame:
    """``node, species, n_genomes``: the species with the fewest genomes below each node of ``nodes_asked(node)``, ties to the least name."""
    below = paths(genomes).select("genome_id", "node", "depth")
    size = below.where(F.col("depth") == len(LEVELS)).groupBy(F.col("node").alias("species")).agg(F.count(F.lit(1)).alias("n_genomes"))
    above = size.select("species", "n_genomes", F.explode(F.sequence(F.lit(1), F.lit(len(LEVELS)))).alias("up")).select(
        F.expr("array_join(slice(split(species, '[|]'), 1, up), '|')").alias("node"), "species", "n_genomes")
    best = above.join(nodes_asked.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min(F.struct("n_genomes", "species")).alias("b"))
    return best.select("node", "b.species", "b.n_genomes")


def internal_labels(clusters: DataFrame) -> DataFrame:
    """``name, internal``: each cluster's path with the ids of its levels in place of the names."""
    steps = clusters.select("name", F.explode(F.sequence(F.lit(1), F.size(F.split("name", r"\|")))).alias("up")).select(
        "name", "up", F.expr("array_join(slice(split(name, '[|]'), 1, up), '|')").alias("step"))
    ids = clusters.select(F.col("name").alias("step"), F.concat(F.substring(last_part(F.col("name")), 1, 3), "cluster_id").alias("part"))
    parts = F.sort_array(F.collect_list(F.struct("up", "part")))
    return steps.join(ids, "step").groupBy("name").agg(parts.alias("p")).select("name", F.array_join(F.transform("p", lambda x: x["part"]), "|").alias("internal"))


def member_lists(genomes: DataFrame) -> DataFrame:
    """``node, level, references_list, mags_list``: genomes of a species; known and unknown children of other nodes (sorted)."""
    per = paths(genomes)
    kind = genomes.select("genome_id", "is_reference")
    own = per.where(F.col("depth") == len(LEVELS)).join(kind, "genome_id").select("node", "level", F.col("genome_id").cast("string").alias("member"), F.col("is_reference").alias("known"))
    known = per.join(kind, "genome_id").groupBy("node", "parent", "depth").agg(F.bool_or("is_reference").alias("known")).where("depth > 1")
    upper = known.select(F.col("parent").alias("node"), F.element_at(F.array(*map(F.lit, LEVELS)), F.col("depth") - 1).alias("level"), F.col("node").alias("member"), "known")
    listed = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("member"))))
    return own.union(upper).groupBy("node", "level").agg(listed(F.col("known")).alias("references_list"), listed(~F.col("known")).alias("mags_list"))


def from_report(lists: DataFrame) -> DataFrame:
    """``genome_id, taxonomy, is_reference`` of the species rows of :func:`member_lists`, to open a database from its report."""
    species = lists.where(F.col("level") == LEVELS[-1])
    arms = [species.select(F.explode(c).alias("genome_id"), F.col("node").alias("taxonomy"), F.lit(kind).alias("is_reference"))
            for c, kind in (("references_list", True), ("mags_list", False))]
    return arms[0].union(arms[1])


def remove(genomes: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Genomes without ``gone(genome_id)``, and the nodes that this empties from species upwards."""
    left = genomes.join(gone.select("genome_id").distinct(), "genome_id", "left_anti")
    emptied = nodes(genomes).join(nodes(left).select("node"), "node", "left_anti")
    return left, emptied


def changed(old: DataFrame, new: DataFrame, by: str) -> DataFrame:
    """``<by>, added, removed`` of the groups whose members (genome and kind) are not the same."""
    columns = [by, "genome_id", "is_reference"]
    a, b = old.select(*columns).distinct(), new.select(*columns).distinct()
    plus = b.exceptAll(a).groupBy(by).agg(F.count(F.lit(1)).alias("added"))
    minus = a.exceptAll(b).groupBy(by).agg(F.count(F.lit(1)).alias("removed"))
    return plus.join(minus, by, "full").select(by, F.coalesce("added", F.lit(0)).alias("added"), F.coalesce("removed", F.lit(0)).alias("removed"))


def report(genomes: DataFrame, bits: DataFrame, filter_size: int) -> DataFrame:
    """One row per node: level, counts, density and whether any reference is below it."""
    from cladeframe.operators.descent import node_bits

    return _report(genomes, node_bits(genomes, bits).groupBy("node").agg(F.count(F.lit(1)).alias("n_bits")), filter_size)


def text_report(genomes: DataFrame, k: int, filter_size: int) -> DataFrame:
    """:func:`report` from the texts of ``genomes(genome_id, seq, is_reference, taxonomy)``, whose bits are not kept."""
    labels = genomes.where(is_defined(F.col("taxonomy"))).select("genome_id", "taxonomy")
    return _report(genomes, label_sizes(genomes, labels, "taxonomy", k), filter_size)


def _report(genomes: DataFrame, dense: DataFrame, filter_size: int) -> DataFrame:
    from cladeframe.operators.tree import members

    return members(genomes).join(dense, "node", "left").select(
        "node", "level", F.round(F.coalesce("n_bits", F.lit(0)) / F.lit(filter_size), 8).alias("density"),
        F.col("n_references").alias("references_count"), (F.col("n_genomes") - F.col("n_references")).alias("mags_count"), "known")


def summarize(nodes_table: DataFrame) -> DataFrame:
    """``level, clusters, known, references, mags`` from ``members`` of the tree."""
    return nodes_table.groupBy("level").agg(
        F.count(F.lit(1)).alias("clusters"), F.count_if("known").alias("known"), F.sum("n_references").alias("references"),
        F.sum(F.col("n_genomes") - F.col("n_references")).alias("mags"))


def components(edges: DataFrame, keep, max_rounds: int = 100) -> DataFrame:
    """``node, component``: the least node that each end of ``edges(a, b)`` can reach."""
    links = keep(edges.union(edges.select("b", "a")).distinct())
    now = keep(links.groupBy("a").agg(F.least("a", F.min("b")).alias("c")).select(F.col("a").alias("node"), F.col("c").alias("component")))
    for _ in range(max_rounds):
        near = links.join(now.select(F.col("node").alias("b"), F.col("component").alias("c")), "b").groupBy("a").agg(F.min("c").alias("c"))
        met = now.join(near, F.col("node") == F.col("a")).select("node", F.least("component", "c").alias("low"), "component")
        # a node's component is a node too, whose own may be less by now
        new = keep(met.join(now.select(F.col("node").alias("low"), F.col("component").alias("lower")), "low")
                   .select("node", "lower", "component"))
        if new.where("lower <> component").isEmpty():
            return now
        now = new.select("node", F.col("lower").alias("component"))
    raise RuntimeError("components did not settle")


def characterize(unknown: DataFrame, profiles: DataFrame, to_center: DataFrame, bounds: DataFrame, children: DataFrame,
                 pairs: DataFrame, keep=lambda df: df) -> DataFrame:
    """``genome_id, level, node, taxonomy``: the deepest node that takes each unknown genome, and its label completed to species.

    ``profiles(genome_id, level, node)``: the best node per level; ``to_center(genome_id, node,
    ani)``; ``bounds(node, max_ani)``; ``children(node, below)`` (``medoid.child_boundaries``);
    ``pairs(a, b, ani)`` of the unknowns, others are at distance 1.  The unknowns share a
    dendrogram (``linkage.place``).  Those without a chain of pairs between them never meet
    below a cut of 1, so each such component is a group of its own, unless a boundary
    is 1.  Unknowns that fit nowhere have a null node.
    """
    levels = LEVELS[:-1]
    depth = F.array_position(F.array(*map(F.lit, levels)), F.col("level")).cast("int")
    fits = keep(profiles.select("genome_id", "level", "node").where(F.col("level").isin(*levels)).join(to_center.select("genome_id", "node", "ani"), ["genome_id", "node"])
                .join(bounds.select("node", "max_ani"), "node").where(F.col("ani") <= F.col("max_ani")).join(children, "node")
                .select("genome_id", depth.alias("depth"), "node", "max_ani", "below"))
    each = fits.groupBy("genome_id").agg(F.collect_list(F.struct("depth", "node", "max_ani", "below")).alias("fits"))
    pairs = keep(pairs.where("ani < 1").select("a", "b", "ani"))
    # digests may clash, which only joins two groups into one
    one = F.lit(0).cast("long")
    if fits.where("max_ani >= 1 or exists(below, x -> x >= 1)").isEmpty():
        parts = components(pairs.select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b")), keep)
        members = unknown.select("genome_id", F.xxhash64("genome_id").alias("node")).join(parts, "node", "left") \
            .select("genome_id", F.coalesce("component", "node").alias("g"))
    else:
        members = unknown.select("genome_id", one.alias("g"))
    members = keep(members.distinct().join(each, "genome_id", "left"))
    links = pairs.join(members.select(F.col("genome_id").alias("a"), F.col("g").alias("h")), "a").select("h", "a", "b", "ani")
    kind = unknown.schema["genome_id"].dataType.simpleString()

    def run(rows: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("genome_id", ignore_index=True)
        ids = rows["genome_id"]
        where = pd.Series(np.arange(len(ids)), index=ids)
        d = np.ones((len(ids), len(ids)))
        a, b = where[near["a"]].to_numpy(), where[near["b"]].to_numpy()
        d[a, b] = d[b, a] = near["ani"]
        own = [[(f["depth"], f["node"], f["max_ani"], [None if x is None or np.isnan(x) else float(x) for x in f["below"]]) for f in held]
               if held is not None else [] for held in rows["fits"]]
        got = place(d, own, ids.tolist())
        return pd.DataFrame({"genome_id": ids, "node": [x and x[0] for x in got], "taxonomy": [x and x[1] for x in got]})

    # pairs with others than the unknowns do not count
    links = links.join(unknown.select(F.col("genome_id").alias("b")).distinct(), "b", "left_semi")
    out = members.groupBy("g").cogroup(links.groupBy("h")).applyInPandas(run, f"genome_id {kind}, node string, taxonomy string")
    return out.select("genome_id", F.when(F.col("node").isNotNull(), F.element_at(F.array(*map(F.lit, levels)), F.size(F.split("node", r"\|")))).alias("level"), "node", "taxonomy")
