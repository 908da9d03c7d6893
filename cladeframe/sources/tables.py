"""Readers and writers of the tabular inputs, reports and database snapshots."""

from __future__ import annotations

import hashlib
import os
import tarfile
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cladeframe.functions.taxonomy import LEVELS, file_stem, is_supported, normalise_name

METADATA_KEYS = ("clusters_count", "filter_size", "kmer_size", "min_kmer_occurrence", "flat")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines in file order, without blank ones."""
    rows = spark.read.text(path).select(F.col("value"), F.monotonically_increasing_id().alias("line_no"))
    return rows.where(F.trim("value") != "")


def read_references(spark: SparkSession, path: str) -> DataFrame:
    """``path, taxonomy, genome_id`` from a TSV with ``#`` comments; of equal paths the last counts."""
    rows = _lines(spark, path).where(~F.startswith("value", F.lit("#"))).select(
        F.trim(F.split_part("value", F.lit("\t"), F.lit(1))).alias("path"), F.trim(F.split_part("value", F.lit("\t"), F.lit(2))).alias("taxonomy"), "line_no")
    last = rows.groupBy("path").agg(F.max_by("taxonomy", "line_no").alias("taxonomy"))
    return last.withColumn("genome_id", file_stem(F.col("path")))


def read_paths(spark: SparkSession, path: str, distinct: bool = False) -> DataFrame:
    """``path, genome_id, supported`` of a list with one path per line and ``#`` comments."""
    rows = _lines(spark, path).where(~F.startswith("value", F.lit("#"))).select(F.trim("value").alias("path"))
    rows = rows.distinct() if distinct else rows
    return rows.select("path", file_stem(F.col("path")).alias("genome_id"), is_supported(F.col("path")).alias("supported"))


def read_commented(spark: SparkSession, path: str, header_prefix: str = "#") -> DataFrame:
    """A TSV whose header is its last comment line; empty cells are null, columns are strings."""
    head = _lines(spark, path).where(F.startswith("value", F.lit(header_prefix))).agg(F.max_by("value", "line_no")).first()[0]
    names = [n.strip() for n in head.lstrip(header_prefix).strip().split("\t")]
    rows = spark.read.csv(path, sep="\t", comment=header_prefix[0], quote="", nullValue="", schema=", ".join(f"`{n}` string" for n in names))
    return rows


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """A cluster report with its lists as arrays and numbers as numbers."""
    rows = read_commented(spark, path)
    casts = {"density": "double", "references_count": "int", "mags_count": "int", "min_ani": "double", "max_ani": "double"}
    for name, kind in casts.items():
        if name in rows.columns:
            rows = rows.withColumn(name, F.col(name).cast(kind))
    for name in ("references_list", "mags_list"):
        if name in rows.columns:
            rows = rows.withColumn(name, F.when(F.col(name).isNull(), F.array().cast("array<string>")).otherwise(F.split(name, ",")))
    return rows.withColumn("known", F.lower("known") == "true") if "known" in rows.columns else rows


def write_report(rows: DataFrame, path: str, stamp: date | None = None) -> None:
    """One commented TSV ordered from species to kingdom; an older one is kept with a number."""
    order = F.array_position(F.array(*map(F.lit, LEVELS[::-1])), F.col("level")) if "level" in rows.columns else F.lit(0)
    flat = [F.array_join(c, ",").alias(c) if t.startswith("array") else F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c, t in rows.dtypes]
    lines = rows.orderBy(order, *[c for c in rows.columns[:1]]).select(F.concat_ws("\t", *flat).alias("line"))
    if os.path.exists(path):
        n = 1
        while os.path.exists(f"{path}.{n}"):
            n += 1
        os.rename(path, f"{path}.{n}")
    with open(path, "w", encoding="utf-8") as f:
        f.write(f"# {(stamp or date.today()):%Y%m%d}\n# " + "\t".join(rows.columns) + "\n")
        for row in lines.toLocalIterator():
            f.write(row["line"] + "\n")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """The one row of a database's metadata; missing keys are an error."""
    rows = spark.read.json(path, multiLine=True)
    missing = [k for k in METADATA_KEYS if k not in rows.columns]
    if missing:
        raise ValueError(f"metadata lacks {', '.join(missing)}")
    return rows.select(*METADATA_KEYS)


def read_names(spark: SparkSession, path: str, classes=("scientific name", "equivalent name", "synonym")) -> DataFrame:
    """``taxid, name, class`` of a names dump: kept classes, normalised, the last name of a taxid per name wins."""
    cells = F.transform(F.split("value", r"\|"), lambda c: F.trim(c))
    rows = _lines(spark, path).select(cells.alias("c"), "line_no").select(
        F.regexp_replace(F.col("c")[0], r"\s", "").cast("bigint").alias("taxid"), F.trim(F.regexp_replace(F.col("c")[1], "\t", "")).alias("raw"),
        F.trim(F.regexp_replace(F.col("c")[3], "\t", "")).alias("class"), "line_no").where(F.col("class").isin(*classes))
    named = rows.withColumn("name", normalise_name(F.col("raw")))
    w = Window.partitionBy("name").orderBy(F.desc("line_no"))
    return named.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").select("taxid", "name", "class")


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    """``taxid, parent, rank`` of a nodes dump."""
    cell = lambda k: F.trim(F.regexp_replace(F.col("c")[k], "\t", ""))
    return _lines(spark, path).select(F.split("value", r"\|").alias("c")).select(
        cell(0).cast("bigint").alias("taxid"), cell(1).cast("bigint").alias("parent"), cell(2).alias("rank"))


def read_assembly_summary(spark: SparkSession, path: str) -> DataFrame:
    """An assembly summary: a comment line, then a commented header, then rows."""
    return read_commented(spark, path)


def read_lineages(spark: SparkSession, path: str, superkingdom: str, kingdom: str | None = None) -> DataFrame:
    """``taxid, taxonomy`` of the lineages below a superkingdom (and kingdom), from a headed CSV."""
    rows = spark.read.csv(path, header=True)
    top = "superkingdom" if "superkingdom" in rows.columns else "domain"
    rows = rows.where(F.col(top) == superkingdom)
    if kingdom:
        rows = rows.where(F.col("kingdom") == kingdom)
    parts, before = [], F.lit(kingdom or superkingdom)
    for prefix, name in zip("kpcofgs", ("kingdom", "phylum", "class", "order", "family", "genus", "species")):
        raw = F.lit(kingdom or superkingdom) if name == "kingdom" else F.coalesce(F.col(name), F.lit(""))
        clean = normalise_name(raw, before)
        parts.append(F.concat(F.lit(f"{prefix}__"), clean))
        before = clean
    return rows.select(F.col(rows.columns[0]).cast("bigint").alias("taxid"), F.concat_ws("|", *parts).alias("taxonomy"))


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """The list of public databases and versions."""
    return read_commented(spark, path)


def catalogue_versions(catalogue: DataFrame) -> DataFrame:
    """``id, versions``: the rows of each database as structs, the latest first."""
    columns = [c for c in catalogue.columns if c not in ("id", "version")]
    entry = F.struct(F.col("version").cast("bigint").alias("n"), "version", *columns)
    return catalogue.groupBy("id").agg(F.sort_array(F.collect_list(entry), asc=False).alias("versions"))


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def append_table(rows: DataFrame, path: str, key: str = "id") -> None:
    """Append what is not there yet, by its key, to a Parquet table."""
    spark = rows.sparkSession
    new = rows.join(spark.read.parquet(path).select(key), key, "left_anti") if exists(spark, path) else rows
    new.write.mode("append").parquet(path)


def write_metadata(rows: DataFrame, path: str) -> None:
    """The one row of a database's metadata as JSON (a folder with one file)."""
    rows.select(*METADATA_KEYS).coalesce(1).write.mode("overwrite").json(path)


def write_lines(rows: DataFrame, order: list[str], path: str, comments: tuple[str, ...] = ()) -> None:
    """Tab-separated lines in a stated order below comment lines, as one file of a folder; arrays are joined by commas.

    Meant for reports and lists, which are one row for a cluster or genome.
    """
    flat = [F.array_join(c, ",").alias(c) if t.startswith("array") else F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c, t in rows.dtypes]
    body = rows.select(F.lit(1).alias("_part"), F.struct(*order).alias("_order"), F.concat_ws("\t", *flat).alias("value"))
    head = rows.sparkSession.createDataFrame([(0, k, f"# {c}") for k, c in enumerate(comments)], "_part int, _k int, value string")
    both = head.select("_part", "_k", F.lit(None).cast(body.schema["_order"].dataType).alias("_order"), "value").unionByName(body.withColumn("_k", F.lit(0)))
    both.repartition(1).sortWithinPartitions("_part", "_k", "_order").select("value").write.mode("overwrite").text(path)


def cached_profiles(queries: DataFrame, path: str, key: str, make) -> DataFrame:
    """Profiles of ``queries(genome_id, ...)`` kept below ``path``, of which only the missing ones are made.

    ``key`` must name the database's snapshot and all parameters, so a result never serves
    another database or other limits.  ``make(queries)`` gives ``query, ...`` rows; genomes that
    have none are remembered as well.
    """
    spark, table, done = queries.sparkSession, f"{path}/{key}/profiles", f"{path}/{key}/done"
    missing = queries.join(spark.read.parquet(done), "genome_id", "left_anti") if exists(spark, done) else queries
    ids = missing.select("genome_id").distinct()
    if not ids.isEmpty():
        make(missing).write.mode("append").parquet(table)
        ids.write.mode("append").parquet(done)
    return spark.read.parquet(table).join(queries.select(F.col("genome_id").alias("query")).distinct(), "query", "left_semi")


def write_snapshot(tables: dict[str, DataFrame], path: str, snapshot_id: int) -> None:
    """Write the tables of a database as one snapshot; others stay as they are."""
    for name, rows in tables.items():
        rows.withColumn("snapshot_id", F.lit(snapshot_id)).write.mode("overwrite") \
            .option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_id").parquet(f"{path}/{name}")


def read_snapshot(spark: SparkSession, path: str, names: list[str], snapshot_id: int | None = None) -> dict[str, DataFrame]:
    """The tables of a snapshot, by default the last one.

    Genomes without a sketch are an error, as a database can't be opened without them;
    one with a null taxonomy may be too short for any k-mer.
    """
    out = {n: spark.read.parquet(f"{path}/{n}") for n in names}
    if snapshot_id is None:
        snapshot_id = out[names[0]].agg(F.max("snapshot_id")).first()[0]
    out = {n: t.where(F.col("snapshot_id") == snapshot_id).drop("snapshot_id") for n, t in out.items()}
    if {"genomes", "bits"} <= out.keys():
        named = out["genomes"].where("taxonomy is not null") if "taxonomy" in out["genomes"].columns else out["genomes"]
        lost = named.select("genome_id").join(out["bits"].select("genome_id"), "genome_id", "left_anti").first()
        if lost:
            raise FileNotFoundError(f"no sketch of genome {lost[0]}")
    return out


def pack_snapshot(path: str, name: str, folder: str, stamp: date | None = None) -> tuple[str, str]:
    """A gzipped tar of a local database folder and its SHA-256 (driver side)."""
    base, n = f"{name}-{(stamp or date.today()):%Y%m%d}", 0
    target = os.path.join(folder, f"{base}.tar.gz")
    while os.path.exists(target):
        n += 1
        target = os.path.join(folder, f"{base}-{n}.tar.gz")
    with tarfile.open(target, "w:gz") as tar:
        tar.add(path, arcname=name)
    digest = hashlib.sha256()
    with open(target, "rb") as f:
        for block in iter(lambda: f.read(1 << 20), b""):
            digest.update(block)
    return target, digest.hexdigest()


def unpack_snapshot(archive: str, folder: str, name: str) -> str:
    """Unpack a database under a new name; paths are never stored in it, so none are rewritten."""
    target = os.path.join(folder, name)
    if os.path.exists(target):
        raise FileExistsError(target)
    with tarfile.open(archive) as tar:
        top = tar.getmembers()[0].name.split("/")[0]
        for member in tar.getmembers():
            member.name = os.path.relpath(member.name, top)
            tar.extract(member, target, filter="data")
    return target
