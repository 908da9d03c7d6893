"""The taxonomy as an adjacency table of label prefixes, and what is derived from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.functions.taxonomy import LEVELS, is_defined, parent_label, prefix_label

ROOT = "db"


def paths(genomes: DataFrame) -> DataFrame:
    """``genome_id, depth, level, node, parent`` for each of the seven levels of each label.

    ``genomes(genome_id, taxonomy)``; ill-formed labels have no rows.  Nodes are label
    prefixes, so equal names under different parents stay apart; the root is ``db``.
    """
    arms = F.array(*[F.struct(F.lit(i + 1).alias("depth"), F.lit(level).alias("level"),
                              prefix_label(F.col("taxonomy"), i + 1).alias("node")) for i, level in enumerate(LEVELS)])
    out = genomes.where(is_defined(F.col("taxonomy"))).select("genome_id", F.inline(arms))
    return out.withColumn("parent", F.coalesce(parent_label(F.col("node")), F.lit(ROOT)))


def nodes(genomes: DataFrame) -> DataFrame:
    """``depth, level, node, parent``, each node once."""
    return paths(genomes).select("depth", "level", "node", "parent").distinct()


def members(genomes: DataFrame) -> DataFrame:
    """``node, depth, level, n_genomes, n_references, known`` (``genomes`` has ``is_reference``)."""
    flags = genomes.select("genome_id", "is_reference")
    return paths(genomes).join(flags, "genome_id").groupBy("node", "depth", "level").agg(
        F.count(F.lit(1)).alias("n_genomes"), F.count_if("is_reference").alias("n_references"),
        F.bool_or("is_reference").alias("known"))


def full_path(edges: DataFrame, steps: int = 6, keep=lambda df: df) -> DataFrame:
    """``node, path`` from an adjacency table ``edges(node, parent)`` of bounded depth.

    ``path`` joins the names from the root down; a parent that is no node ends it.  Paths are
    made for the few nodes that are parents of parents first, and each node takes that
    of its parent, so no table of all nodes is dealt by its few distant ancestors.
    """
    wanted = [edges.select("node", "parent")]
    for _ in range(steps):
        parents = wanted[-1].select(F.col("parent").alias("node")).where("node is not null").distinct()
        wanted.append(keep(wanted[-1].join(parents, "node", "left_semi")))
    out = wanted[-1].select("node", F.col("node").alias("path"))
    for rows in wanted[-2::-1]:
        up = out.select(F.col("node").alias("_n"), F.col("path").alias("_above"))
        out = rows.join(up, F.col("parent") == F.col("_n"), "left").select(
            "node", F.when(F.col("_n").isNotNull(), F.concat("_above", F.lit("|"), "node")).otherwise(F.col("node")).alias("path"))
    return out


def descendants(edges: DataFrame, steps: int = 6) -> DataFrame:
    """``node, ancestor, distance`` for all ancestors within ``steps`` levels."""
    up = edges.select(F.col("node").alias("_n"), F.col("parent").alias("_p"))
    reach = edges.select("node", F.col("parent").alias("ancestor"), F.lit(1).alias("distance")).where("ancestor is not null")
    out = reach
    for k in range(2, steps + 1):
        reach = reach.join(up, F.col("ancestor") == F.col("_n")).where("_p is not null").select(
            "node", F.col("_p").alias("ancestor"), F.lit(k).alias("distance"))
        out = out.union(reach)
    return out


def violations(entries: DataFrame) -> DataFrame:
    """``entry_id, problem`` of entries that break the rules of the data model.

    ``entries(entry_id, name, level, known, taxonomy, n_children)``; an entry can have
    several problems.
    """
    valid = [*LEVELS, "genome", ROOT]
    genome = F.col("level") == "genome"
    checks = {
        "no id": F.coalesce(F.col("entry_id"), F.lit("")) == "",
        "no name": F.coalesce(F.col("name"), F.lit("")) == "",
        "unknown level": ~F.coalesce(F.col("level").isin(*valid), F.lit(False)),
        "genome with children": genome & (F.col("n_children") > 0),
        "genome id differs from its name": genome & (F.col("entry_id") != F.col("name")),
        "cluster without a cluster id": ~genome & ~F.col("entry_id").rlike("^MSBT[0-9]*$"),
        "known genome without a label": genome & F.col("known") & ~is_defined(F.col("taxonomy")),
    }
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(p)) for p, c in checks.items()]))
    return entries.select("entry_id", F.explode(found).alias("problem"))


def taxonomy_exists(labels: DataFrame, genomes: DataFrame) -> DataFrame:
    """``taxonomy, exists``: whether all seven levels of a label are named in the database.

    Levels are looked up by name alone, as names are unique within a level there.
    """
    names = paths(genomes).select("depth", F.substring_index("node", "|", -1).alias("name")).distinct()
    asked = labels.where(is_defined(F.col("taxonomy"))).select("taxonomy", F.posexplode(F.split("taxonomy", r"\|")).alias("pos", "name"))
    hits = asked.join(names.withColumn("pos", F.col("depth") - 1), ["pos", "name"], "left_semi").groupBy("taxonomy").agg(
        F.count_distinct("pos").alias("levels"))
    return labels.select("taxonomy").distinct().join(hits, "taxonomy", "left").select(
        "taxonomy", (F.coalesce("levels", F.lit(0)) == len(LEVELS)).alias("exists"))


def totals(genomes: DataFrame) -> DataFrame:
    """One row: genomes, references, MAGs, species and clusters of a database."""
    counts = genomes.agg(F.count(F.lit(1)).alias("genomes"), F.count_if("is_reference").alias("references"), F.count_if(~F.col("is_reference")).alias("mags"))
    clusters, species = nodes(genomes).agg(F.count(F.lit(1)), F.count_if(F.col("level") == LEVELS[-1])).first()
    return counts.withColumns({"clusters": F.lit(clusters).cast("long"), "species": F.lit(species).cast("long")})
