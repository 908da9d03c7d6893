"""FASTA files as contig tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.functions.taxonomy import file_stem


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``genome_id, contig_no, contig, header, seq``: one row per record.

    The reader splits at ``>``, so records of any length are read by whichever task
    holds their start.  A ``>`` inside a header line is not supported.
    ``contig_no`` numbers the records of a file from 0 in file order; line ends are
    removed from sequences, which are upper-cased (soft masking is no other base), compressed files are read as such.
    """
    raw = spark.read.text(path, lineSep=">").select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_order"), F.regexp_replace("value", "\r", "").alias("value"))
    raw = raw.where(F.trim(F.regexp_replace("value", "\n", "")) != "")
    header = F.trim(F.split_part("value", F.lit("\n"), F.lit(1)))
    lines = F.split("value", "\n")
    from pyspark.sql import Window

    numbered = F.row_number().over(Window.partitionBy("_file").orderBy("_block", "_order")) - 1
    stem = file_stem(F.regexp_replace(F.regexp_replace("_file", r"\.gz$", ""), "%20", " "))
    return raw.select(
        stem.alias("genome_id"), numbered.alias("contig_no"), F.split_part(header, F.lit(" "), F.lit(1)).alias("contig"), header.alias("header"),
        F.upper(F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), "")).alias("seq"))


def collapse(contigs: DataFrame, gap: str = "N") -> DataFrame:
    """``genome_id, seq``: a genome's contigs in order, joined by ``gap`` so that no k-mer spans two."""
    parts = F.sort_array(F.collect_list(F.struct("contig_no", "seq")))
    return contigs.groupBy("genome_id").agg(parts.alias("parts")).select(
        "genome_id", F.array_join(F.transform("parts", lambda p: p["seq"]), gap).alias("seq"))


def with_taxids(contigs: DataFrame, ids: DataFrame) -> DataFrame:
    """Records whose header names the genome's taxid: ``id|kraken:taxid|<taxid> id``."""
    from cladeframe.operators.etl import kraken_header

    return contigs.join(ids, "genome_id").withColumn("header", kraken_header(F.col("contig"), F.col("taxid")))


def write_fasta(contigs: DataFrame, path: str, width: int = 80) -> None:
    """Write records as text, one file per genome and task, lines of ``width`` characters."""
    body = F.regexp_replace("seq", f"(.{{{width}}})(?=.)", "$1\n")
    contigs.select(F.concat(F.lit(">"), "header", F.lit("\n"), body).alias("value"), "genome_id") \
        .write.partitionBy("genome_id").mode("overwrite").text(path)
