"""Command line: the verbs of the engine with their parameters and defaults.

A database is a folder ``<workdir>/<database>`` of snapshots; paths may be anywhere that
Spark reads and writes.  ``python -m cladeframe.cli VERB --help`` lists parameters.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.operators import descent, etl, maintain, sketch, tree
from cladeframe.plans import lifecycle
from cladeframe.session import ship
from cladeframe.sources import fasta, tables
from cladeframe.storage import Scratch

#: Tables of a snapshot.
TABLES = ["genomes", "bits", "clusters", "medoids", "metadata"]

#: Parameters of each verb, as name -> default; ... marks what must be given, a type what has no default.
VERBS = {
    "index": {"workdir": ..., "database": ..., "references": ..., "quality": str, "dereplicate": 0.0, "filter-size": int, "increase-filter-size": 50.0,
              "min-kmer-occurrences": 2, "kmer-size": int, "limit-kmer-size": 32, "completeness": 0.0, "contamination": 100.0},
    "update": {"workdir": ..., "database": ..., "genomes": ..., "quality": str, "dereplicate": 0.0, "completeness": 0.0, "contamination": 100.0,
               "uncertainty": 20.0, "pruning-threshold": 0.0},
    "profile": {"workdir": ..., "database": "cladeframe", "genomes": ..., "output": ..., "uncertainty": 20.0, "pruning-threshold": 0.0},
    "sketch": {"workdir": ..., "database": "cladeframe", "genomes": ..., "output": ...},
    "summarize": {"workdir": ..., "database": ...},
    "remove": {"workdir": ..., "database": ..., "genomes": ...},
    "merge": {"workdir": ..., "database": ..., "species": ..., "into": str},
    "kraken": {"workdir": ..., "database": ..., "genomes": ..., "names": ..., "nodes": ..., "output": ...},
    "pack": {"workdir": ..., "database": ..., "output": ...},
    "unpack": {"workdir": ..., "database": ..., "tarball": ...},
    "db": {"catalogue": ..., "version": str},
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="cladeframe")
    verbs = top.add_subparsers(dest="verb", required=True)
    for verb, parameters in VERBS.items():
        one = verbs.add_parser(verb)
        for name, default in parameters.items():
            if default is ...:
                one.add_argument(f"--{name}", required=True)
            elif isinstance(default, type):
                one.add_argument(f"--{name}", type=default)
            else:
                one.add_argument(f"--{name}", type=type(default), default=default)
        if verb in ("index", "update", "profile", "sketch"):
            one.add_argument("--alphabet")
            one.add_argument("--canonical", action="store_true")
    return top


def _genomes(spark: SparkSession, listed: str) -> DataFrame:
    """``genome_id, seq`` of the FASTA files that a list names; other endings are an error."""
    paths = tables.read_paths(spark, listed, distinct=True)
    wrong = paths.where("not supported").first()
    if wrong:
        raise ValueError(f"no FASTA file: {wrong['path']}")
    return fasta.collapse(fasta.read_fasta(spark, [r["path"] for r in paths.select("path").toLocalIterator()]))


def _quality(spark: SparkSession, path: str | None) -> DataFrame | None:
    """``genome_id, completeness, contamination`` of a headed TSV with these columns, or CheckM's names for them."""
    if not path:
        return None
    rows = spark.read.csv(path, sep="\t", header=True)
    named = {"Bin Id": "genome_id", "Completeness": "completeness", "Contamination": "contamination"}
    rows = rows.withColumnsRenamed({a: b for a, b in named.items() if a in rows.columns})
    return rows.select("genome_id", F.col("completeness").cast("double").alias("completeness"), F.col("contamination").cast("double").alias("contamination"))


def run(spark: SparkSession, arguments: list[str]) -> DataFrame | str | None:
    """Run a verb; gives the table that it shows, or the path that it wrote."""
    a = parser().parse_args(arguments)
    ship(spark)
    scratch, options = Scratch(spark), {}
    if getattr(a, "alphabet", None):
        options["alphabet"] = a.alphabet
    if getattr(a, "canonical", False):
        options["canonical"] = True
    path = f"{a.workdir}/{a.database}" if "database" in a else None
    if a.verb == "db":
        latest = etl.latest_versions(tables.read_catalogue(spark, a.catalogue))
        return latest.where(F.col("version") == a.version) if a.version else latest
    if a.verb == "unpack":
        return tables.unpack_snapshot(a.tarball, a.workdir, a.database)
    if a.verb == "pack":
        return tables.pack_snapshot(path, a.database, a.output)[0]
    if a.verb == "index":
        listed = tables.read_references(spark, a.references)
        seqs = fasta.collapse(fasta.read_fasta(spark, [r["path"] for r in listed.select("path").toLocalIterator()]))
        rows = scratch.save(seqs.join(listed.select("genome_id", "taxonomy"), "genome_id").withColumn("is_reference", F.lit(True)))
        found = lifecycle.set_configs(rows, list(range(5, a.limit_kmer_size + 1, 4)), scratch, a.min_kmer_occurrences, a.kmer_size, a.filter_size,
                                      a.increase_filter_size, **options)
        made = lifecycle.index(rows, _quality(spark, a.quality), scratch, found["kmer_size"], a.min_kmer_occurrences, a.increase_filter_size,
                               a.completeness, a.contamination, a.dereplicate, **options)
        tables.write_snapshot({n: made[n] for n in TABLES}, path, 0)
        return path
    held = tables.read_snapshot(spark, path, TABLES)
    meta = held["metadata"].first()
    k, least = meta["kmer_size"], meta["min_kmer_occurrence"]
    if a.verb == "summarize":
        return maintain.summarize(tree.members(held["genomes"]))
    number = spark.read.parquet(f"{path}/genomes").agg(F.max("snapshot_id")).first()[0] + 1
    if a.verb in ("remove", "merge"):
        changed = (lifecycle.remove(held, tables.read_paths(spark, a.genomes).select("genome_id"), scratch, k) if a.verb == "remove"
                   else lifecycle.merge(held, a.species.split(","), scratch, k, a.into))
    elif a.verb == "kraken":
        nodes = tree.nodes(held["genomes"]).withColumn("name", F.substring_index("node", "|", -1))
        nodes = scratch.save(nodes.select(F.substring("name", 4, 1_000_000).alias("name"), F.expr("substring(substring_index(parent, '|', -1), 4)").alias("parent"), "level", "depth", "node"))
        known = tables.read_names(spark, a.names).select("name", "taxid")
        top = max(known.agg(F.max("taxid")).first()[0] or 0, tables.read_nodes(spark, a.nodes).agg(F.max("taxid")).first()[0] or 0)
        new = etl.new_taxids(nodes.select("name", "depth"), known, top)
        ids = scratch.save(etl.resolve_names(nodes.select("name").distinct(), known, new))
        added = nodes.join(new.select("name"), "name", "left_semi").select("name", "parent", "level").distinct()
        etl.taxdump_rows(added, ids).write.mode("overwrite").json(f"{a.output}/taxonomy")
        own = held["genomes"].join(tables.read_paths(spark, a.genomes).select("genome_id"), "genome_id", "left_semi").select(
            "genome_id", F.expr("substring(substring_index(taxonomy, '|', -1), 4)").alias("name")).join(ids, "name").select("genome_id", "taxid")
        files = [r["path"] for r in tables.read_paths(spark, a.genomes, distinct=True).select("path").toLocalIterator()]
        fasta.write_fasta(fasta.with_taxids(fasta.read_fasta(spark, files), own), f"{a.output}/library")
        return a.output
    else:
        new = scratch.save(_genomes(spark, a.genomes))
        if a.verb == "update":
            quality = _quality(spark, a.quality)
            if quality is not None:
                new = lifecycle.passing(new, quality, a.completeness, a.contamination)
            changed = lifecycle.update(held, new, scratch, k, least, a.dereplicate, **options)
        else:
            bits = scratch.save(sketch.sketch(new, k, least, **options))
            if a.verb == "sketch":
                bits.write.mode("overwrite").parquet(a.output)
                return a.output
            placed = held["genomes"].where("taxonomy is not null")
            key = f"snapshot{number - 1}-u{a.uncertainty}-p{a.pruning_threshold}"
            return tables.cached_profiles(bits, a.output, key, lambda q: descent.profile(
                q, placed, held["bits"], held["medoids"], k, a.uncertainty, a.pruning_threshold, scratch.save))
    tables.write_snapshot({n: changed[n] for n in TABLES}, path, number)
    return path


def main() -> None:
    import sys

    spark = SparkSession.builder.appName("cladeframe").getOrCreate()
    shown = run(spark, sys.argv[1:])
    if isinstance(shown, str):
        print(shown)
    elif shown is not None:
        shown.show(1000, truncate=False)
    spark.stop()


if __name__ == "__main__":
    main()
