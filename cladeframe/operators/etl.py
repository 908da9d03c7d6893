"""Selection of genomes from assembly summaries, exports and quality reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeframe.functions import assembly
from cladeframe.functions.taxonomy import in_clade
from cladeframe.operators.maintain import numbered


def assembly_table(summary: DataFrame, full_only: bool = False) -> DataFrame:
    """Summary rows with ``id``, ``type`` and ``url``; partial genomes can be left out."""
    rows = summary.where(F.col("genome_rep") != "Partial") if full_only else summary
    return rows.withColumn("type", assembly.genome_type(F.col("excluded_from_refseq"))) \
        .withColumn("id", F.substring_index("ftp_path", "/", -1)).withColumn("url", assembly.genome_url(F.col("ftp_path")))


def select_genomes(table: DataFrame, lineages: DataFrame, exported: DataFrame | None = None, clade: str | None = None,
                   kind: str | None = None, categories: list[str] | None = None, max_per_species: int = 0) -> DataFrame:
    """Assemblies with their taxonomy, by clade, category or type, and the best few per species.

    ``lineages(species_taxid, taxonomy)``.  With ``categories`` the refseq category decides and
    makes the type ``reference``; else ``kind`` does, unclassified species are only for
    MAGs and what was ``exported(id)`` before is left out.  Of equal ids the greatest url counts.
    """
    rows = table.join(lineages, "species_taxid")
    if clade:
        rows = rows.where(in_clade(F.col("taxonomy"), clade))
    if categories:
        rows = rows.where(F.col("refseq_category").isin(*categories)).withColumn("type", F.lit("reference"))
    elif kind:
        rows = rows.where(F.col("type") == kind)
        if kind != "mag":
            rows = rows.where(~F.contains("taxonomy", F.lit("unclassified")))
        if exported is not None:
            rows = without_exported(rows, exported)
    w = Window.partitionBy("id").orderBy(F.desc("url"))
    rows = rows.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")
    return top_per_species(rows, max_per_species) if max_per_species else rows


def without_exported(rows: DataFrame, exported: DataFrame) -> DataFrame:
    """Rows whose id was not exported before."""
    return rows.join(exported.select("id").distinct(), "id", "left_anti")


def selected(given: DataFrame, lineage: DataFrame, key: str = "genome_id") -> DataFrame:
    """Genomes that were asked for and that the lineage holds, each once."""
    return given.select(key).intersect(lineage.select(key))


def by_superkingdom(parts: list[DataFrame], key: str = "id") -> DataFrame:
    """Genomes of several superkingdoms in one table; of equal ids that of the last part counts."""
    every = parts[0].withColumn("_part", F.lit(0))
    for k, part in enumerate(parts[1:], 1):
        every = every.unionByName(part.withColumn("_part", F.lit(k)))
    columns = [c for c in parts[0].columns if c != key]
    return every.groupBy(key).agg(F.max(F.struct("_part", *columns)).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in columns])


def top_per_species(rows: DataFrame, limit: int, by: str = "taxonomy", level: str = "assembly_level", key: str = "id") -> DataFrame:
    """At most ``limit`` rows per species: better assembly levels first, then by the MD5 of the id."""
    ranked = rows.withColumn("_prio", assembly.level_priority(F.col(level))).where("_prio is not null")
    w = Window.partitionBy(by).orderBy("_prio", F.md5(F.col(key).cast("string")), key)
    return ranked.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= limit).drop("_rank", "_prio")


def latest_versions(catalogue: DataFrame) -> DataFrame:
    """The row with the greatest version (a number in text) of each id."""
    w = Window.partitionBy("id").orderBy(F.col("version").cast("bigint").desc())
    return catalogue.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def lineages(edges: DataFrame, names: DataFrame, prefixes: dict[str, str], steps: int = 8) -> DataFrame:
    """``taxid, taxonomy`` from parent pointers: ranks in ``prefixes`` (rank -> prefix), in its order.

    Missing ranks become ``<prefix>__<parent's name>_unclassified``.
    """
    up = edges.select(F.col("taxid").alias("_t"), F.col("parent").alias("_p"), F.col("rank").alias("_r"))
    named = names.select(F.col("taxid").alias("_n"), F.col("name").alias("_name"))
    out = edges.select("taxid", F.col("taxid").alias("_at"), *[F.lit(None).cast("string").alias(r) for r in prefixes])
    for _ in range(steps):
        step = out.join(up, F.col("_at") == F.col("_t"), "left").join(named, F.col("_at") == F.col("_n"), "left")
        out = step.select("taxid", F.when(F.col("_p") != F.col("_t"), F.col("_p")).alias("_at"),
                          *[F.coalesce(r, F.when(F.col("_r") == r, F.col("_name"))).alias(r) for r in prefixes])
    parts, before = [], F.lit("root")
    for rank, prefix in prefixes.items():
        name = F.coalesce(F.col(rank), F.concat(before, F.lit("_unclassified")))
        parts.append(F.concat(F.lit(f"{prefix}__"), name))
        before = name
    return out.select("taxid", F.concat_ws("|", *parts).alias("taxonomy"))


def resolve_names(wanted: DataFrame, known: DataFrame, new: DataFrame) -> DataFrame:
    """``name, taxid`` with the known id before the new one; a name without any fails the query."""
    a = known.select("name", F.col("taxid").alias("_known"))
    b = new.select("name", F.col("taxid").alias("_new"))
    return wanted.select("name").join(a, "name", "left").join(b, "name", "left").select("name", F.coalesce(
        "_known", "_new", F.raise_error(F.concat(F.lit("no taxid for "), F.col("name"))).cast("bigint")).alias("taxid"))


def new_taxids(nodes: DataFrame, known: DataFrame, top: int) -> DataFrame:
    """``name, taxid`` for node names that ``known(name, taxid)`` lacks, counted from ``top`` by depth and name."""
    missing = nodes.join(known.select("name"), "name", "left_anti").select("name", "depth").groupBy("name").agg(F.min("depth").alias("depth"))
    return numbered(missing, ["depth", "name"], top, "taxid").select("name", "taxid")


def taxdump_rows(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """``names_row, nodes_row`` in the layout of a taxonomy dump, for ``nodes(name, parent, level)``."""
    own = ids.select("name", "taxid")
    parent = ids.select(F.col("name").alias("parent"), F.col("taxid").alias("parent_id"))
    sep = "\t|\t"
    return nodes.join(own, "name").join(parent, "parent", "left").select(
        "taxid", F.concat(F.concat_ws(sep, F.col("taxid").cast("string"), "name", F.lit(""), F.lit("scientific name")), F.lit("\t|")).alias("names_row"),
        F.concat(F.concat_ws(sep, F.col("taxid").cast("string"), F.coalesce("parent_id", F.lit(1)).cast("string"), "level"), F.lit("\t|")).alias("nodes_row"))


def kraken_header(genome: Column, taxid: Column) -> Column:
    return F.concat(genome, F.lit("|kraken:taxid|"), taxid.cast("string"), F.lit(" "), genome)


def checkv_average(contigs: DataFrame) -> DataFrame:
    """``genome_id, completeness, contamination`` from contig rows; ``NA`` is no value, none at all is 0."""
    def mean(c: str) -> Column:
        return F.round(F.coalesce(F.avg(F.expr(f"try_cast(nullif({c}, 'NA') AS DOUBLE)")), F.lit(0.0)), 5).alias(c)

    return contigs.groupBy("genome_id").agg(mean("completeness"), mean("contamination"))


def join_quality(genomes: DataFrame, quality: DataFrame) -> DataFrame:
    """Every genome with its completeness and contamination, 0 where the report lacks it."""
    return genomes.join(quality, "genome_id", "left").fillna(0.0, ["completeness", "contamination"])
