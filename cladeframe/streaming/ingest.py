"""A folder of arriving genomes as a stream that keeps a database up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cladeframe.functions.taxonomy import file_stem
from cladeframe.plans import lifecycle
from cladeframe.sources.tables import read_snapshot, write_snapshot
from cladeframe.storage import Scratch

TABLES = ["genomes", "bits", "clusters", "medoids", "metadata"]


def genome_stream(spark: SparkSession, folder: str) -> DataFrame:
    """``genome_id, seq`` of files that arrive in a folder, a record's line ends removed."""
    raw = spark.readStream.option("wholetext", True).text(folder)
    body = F.regexp_replace(F.regexp_replace("value", r"(?m)^>.*$", ">"), r"\s+", "")
    return raw.select(file_stem(F.col("_metadata.file_path")).alias("genome_id"),
                      F.upper(F.regexp_replace(F.regexp_replace(body, "^>+", ""), ">+", "N")).alias("seq"))


def maintain(stream: DataFrame, database: str, checkpoint: str, k: int, min_occurrence: int = 2, **options) -> StreamingQuery:
    """Update a database snapshot with every batch of arriving genomes.

    The snapshot's number is the batch's plus one, so a batch that is run again after
    a failure starts from the same snapshot and overwrites its own result.  ``options`` as in
    ``lifecycle.update``.
    """
    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        scratch = Scratch(spark)
        current = read_snapshot(spark, database, TABLES, number)
        updated = lifecycle.update(current, scratch.save(batch), scratch, k, min_occurrence, **options)
        write_snapshot({n: updated[n] for n in TABLES}, database, number + 1)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
