"""How the test tables stand for genomes, and SQL of the same derived tables.

A document is a genome with its text as sequence; every fifth (by id) is a
newly assembled genome (MAG), the others are references.  The label is fixed by language and id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.operators import sketch

#: K-mer length of distance queries, and of counting queries.
K, SHORT_K = 21, 9


class Book:
    """Queries of a module with their SQL."""

    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None):
        def enter(f):
            self.queries[f.__name__] = f
            if sql is not None:
                self.sql[f.__name__] = sql
            return f

        return enter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def genomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``genome_id, seq, is_reference, taxonomy``."""
    parts = [F.lit("k__Docs|p__"), F.coalesce("lang", F.lit("none"))]
    for prefix, name, n in (("c", "C", 2), ("o", "O", 4), ("f", "F", 8), ("g", "G", 16), ("s", "S", 32)):
        parts += [F.lit(f"|{prefix}__{name}"), (F.col("doc_id") % n).cast("string")]
    docs, cores = table(spark, sf_dir, "documents"), spark.sparkContext.defaultParallelism
    if docs.rdd.getNumPartitions() < cores:
        # a file of one row group is one task; k-mers are many times its size
        docs = docs.repartition(cores)
    return docs.select(
        F.col("doc_id").alias("genome_id"), F.col("text").alias("seq"), (F.col("doc_id") % 5 != 0).alias("is_reference"),
        F.concat(*parts).alias("taxonomy"))


def bits(rows: DataFrame, k: int = K) -> DataFrame:
    return sketch.sketch(rows, k)


GENOMES_SQL = """genomes AS (
  SELECT doc_id AS genome_id, text AS seq, doc_id % 5 <> 0 AS is_reference,
         'k__Docs|p__' || coalesce(lang, 'none') || '|c__C' || doc_id % 2 || '|o__O' || doc_id % 4 || '|f__F' || doc_id % 8
         || '|g__G' || doc_id % 16 || '|s__S' || doc_id % 32 AS taxonomy
  FROM documents)"""


def windows_sql(k: int, source: str = "genomes") -> str:
    return f"""windows AS (
  SELECT genome_id, substr(seq, CAST(i AS BIGINT), {k}) AS kmer
  FROM (SELECT genome_id, seq, unnest(range(1, length(seq) - {k} + 2)) AS i FROM {source}))"""


def bits_sql(k: int = K) -> str:
    """CTEs ``genomes, windows, bits``; bits hold a hash, of which only equality matters."""
    return f"{GENOMES_SQL}, {windows_sql(k)}, bits AS (SELECT DISTINCT genome_id, hash(kmer) AS bit FROM windows)"


def distance_sql(inter: str, uni: str, k: int) -> tuple[str, str]:
    """Jaccard index and distance, as in ``cladeframe.functions.distance``."""
    j = f"((200000 * {inter} + {uni}) // (2 * {uni})) / 100000.0"
    return j, f"CASE WHEN {j} <= 0 THEN 1.0 ELSE round(least(1.0, 1.0 - (1.0 + ln(2.0 * ({j}) / (1.0 + ({j}))) / {float(k)})), 5) END"


def mean_sql(ani: str) -> str:
    """Mean of five-decimal distances, as in ``cladeframe.functions.distance``."""
    total = f"sum(CAST(round({ani} * 100000) AS BIGINT))"
    return f"((2 * {total} + count(*)) // (2 * count(*))) / 100000.0"
