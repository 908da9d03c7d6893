"""Queries that write files to the shared folder, read them back and compare, and operators of the report."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.operators import etl, maintain, tree
from cladeframe.plans.derived import Book, genomes, table
from cladeframe.plans.trees import PATHS_SQL
from cladeframe.sources import fasta, tables
from cladeframe.storage import shared_dir

book = Book()
QUERIES, SQL = book.queries, book.sql


def _place(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"


def _written(rows: DataFrame, order: list[str]) -> str:
    """One text file of ``rows(value, <order>)``, in its folder."""
    path = _place(rows.sparkSession)
    rows.repartition(1).sortWithinPartitions(*order).select("value").write.text(path)
    return path


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


@book("""SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS contig_no, 'c' || c_custkey AS contig, 'c' || c_custkey || ' ' || c_mktsegment AS header, upper(c_name || c_mktsegment) AS seq FROM customer""")
def source_fasta(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    path = _written(c.select("c_custkey", _text(">c", F.col("c_custkey"), " ", F.col("c_mktsegment"), "\n", F.col("c_name"), "\n", F.lower("c_mktsegment")).alias("value")), ["c_custkey"])
    return fasta.read_fasta(spark, path).select(F.col("contig_no").cast("long").alias("contig_no"), "contig", "header", "seq")


@book("""SELECT '/data/n' || n_regionkey || '.fna' AS path, 'k__' || max_by(n_name, n_nationkey) AS taxonomy, 'n' || n_regionkey AS genome_id FROM nation GROUP BY n_regionkey""")
def source_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    rows = n.select("n_nationkey", _text("/data/n", F.col("n_regionkey"), ".fna\tk__", F.col("n_name")).alias("value"))
    extra = spark.createDataFrame([(-1, "# path and taxonomy"), (-1, "")], "n_nationkey int, value string")
    return tables.read_references(spark, _written(rows.unionByName(extra), ["n_nationkey"]))


@book("""SELECT DISTINCT '/m/' || n_regionkey || CASE WHEN n_regionkey = 2 THEN '.txt' ELSE '.fa' END AS path, n_regionkey::VARCHAR AS genome_id, n_regionkey <> 2 AS supported FROM nation""")
def source_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    rows = n.select("n_nationkey", _text("/m/", F.col("n_regionkey"), F.when(F.col("n_regionkey") == 2, ".txt").otherwise(".fa")).alias("value"))
    return tables.read_paths(spark, _written(rows, ["n_nationkey"]), distinct=True)


_LISTS_SQL = f"""{PATHS_SQL}, own AS (SELECT node, level, genome_id::VARCHAR AS member, is_reference AS known FROM paths WHERE depth = 7),
upper AS (SELECT parent AS node, ['kingdom','phylum','class','order','family','genus'][depth - 1] AS level, node AS member, bool_or(is_reference) AS known FROM paths WHERE depth > 1 GROUP BY node, parent, depth),
lists AS (SELECT node, level, list_sort(coalesce(list(member) FILTER (known), [])) AS refs, list_sort(coalesce(list(member) FILTER (NOT known), [])) AS mags FROM (SELECT * FROM own UNION ALL SELECT * FROM upper) GROUP BY ALL)"""


@book(f"WITH {_LISTS_SQL} SELECT node, level, array_to_string(refs, ',') AS refs, array_to_string(mags, ',') AS mags, len(refs) AS n_refs FROM lists")
def source_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The member lists as a commented report, ordered from species to kingdom, and read back."""
    lists = maintain.member_lists(genomes(spark, sf_dir)).withColumn("rank", F.size(F.split("node", r"\|")))
    path = _place(spark)
    rows = lists.select(F.col("node").alias("cluster_id"), "level", "references_list", "mags_list", (F.lit(7) - F.col("rank")).alias("references_count"))
    tables.write_lines(rows, ["references_count", "cluster_id"], path, ("20240101", "\t".join(rows.columns)))
    got = tables.read_report(spark, path)
    return got.select(F.col("cluster_id").alias("node"), "level", F.array_join("references_list", ",").alias("refs"), F.array_join("mags_list", ",").alias("mags"),
                      F.size("references_list").cast("long").alias("n_refs"))


@book("WITH RECURSIVE " + PATHS_SQL + " SELECT genome_id::VARCHAR AS genome_id, taxonomy, is_reference FROM genomes")
def database_from_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain.from_report(maintain.member_lists(genomes(spark, sf_dir)))


@book("SELECT count(*) AS clusters_count, sum(o_custkey)::BIGINT AS filter_size, 21::BIGINT AS kmer_size, 2::BIGINT AS min_kmer_occurrence, true AS flat FROM orders")
def source_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark)
    tables.write_metadata(table(spark, sf_dir, "orders").agg(F.count(F.lit(1)).alias("clusters_count"), F.sum("o_custkey").alias("filter_size")).withColumns(
        {"kmer_size": F.lit(21), "min_kmer_occurrence": F.lit(2), "flat": F.lit(True)}), path)
    return tables.read_metadata(spark, path)


@book("""SELECT max(c_custkey) AS taxid, 'C_' || c_mktsegment || '_' || c_nationkey AS name, 'synonym' AS class FROM customer WHERE c_custkey % 3 = 0 GROUP BY c_mktsegment, c_nationkey""")
def source_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    rows = c.select("c_custkey", _text(F.col("c_custkey"), "\t|\tC (", F.col("c_mktsegment"), ") ", F.col("c_nationkey"), "\t|\t\t|\t", F.when(F.col("c_custkey") % 3 == 0, "synonym").otherwise("authority"), "\t|").alias("value"))
    return tables.read_names(spark, _written(rows, ["c_custkey"]))


@book("SELECT c_custkey AS taxid, c_nationkey::BIGINT AS parent, c_mktsegment AS rank FROM customer")
def source_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    rows = c.select("c_custkey", _text(F.col("c_custkey"), "\t|\t", F.col("c_nationkey"), "\t|\t", F.col("c_mktsegment"), "\t|").alias("value"))
    return tables.read_nodes(spark, _written(rows, ["c_custkey"]))


@book("SELECT p_partkey::VARCHAR AS assembly_accession, p_name AS organism, nullif(CASE WHEN p_size > 20 THEN p_type ELSE '' END, '') AS excluded FROM part")
def source_assembly_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark)
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("assembly_accession"), F.col("p_name").alias("organism"), F.when(F.col("p_size") > 20, F.col("p_type")).alias("excluded"))
    tables.write_lines(rows, ["assembly_accession"], path, ("  See the manual", "assembly_accession\torganism\texcluded"))
    return tables.read_assembly_summary(spark, path)


@book("""SELECT p_brand AS id, string_agg(p_size::VARCHAR, ',' ORDER BY p_size DESC) AS versions FROM (SELECT DISTINCT p_brand, p_size FROM part) GROUP BY p_brand""")
def source_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark)
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("id"), F.col("p_size").cast("string").alias("version"), F.lit("x").alias("info")).distinct()
    tables.write_lines(rows, ["id", "version"], path, ("20240101", "id\tversion\tinfo"))
    got = tables.catalogue_versions(tables.read_catalogue(spark, path))
    return got.select("id", F.array_join(F.transform("versions", lambda v: v["version"]), ",").alias("versions"))


@book("SELECT o_orderkey AS id, CASE WHEN o_orderstatus <> 'O' THEN 'first' ELSE 'second' END AS run FROM orders WHERE o_orderstatus <> 'O' OR o_orderkey % 2 = 0")
def appended_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, o = _place(spark), table(spark, sf_dir, "orders")
    tables.append_table(o.where("o_orderstatus <> 'O'").select(F.col("o_orderkey").alias("id"), F.lit("first").alias("run")), path)
    tables.append_table(o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("id"), F.lit("second").alias("run")), path)
    return spark.read.parquet(path)


@book(f"WITH {PATHS_SQL} SELECT genome_id, taxonomy, is_reference FROM genomes WHERE genome_id % 3 = 0")
def snapshot_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, rows = _place(spark), genomes(spark, sf_dir).select("genome_id", "taxonomy", "is_reference")
    tables.write_snapshot({"genomes": rows}, path, 1)
    tables.write_snapshot({"genomes": rows.where("genome_id % 3 = 0")}, path, 2)
    return tables.read_snapshot(spark, path, ["genomes"])["genomes"]


@book("SELECT o_custkey AS query, count(*) AS n, CASE WHEN o_custkey % 2 = 0 THEN 1 ELSE 2 END AS run FROM orders GROUP BY o_custkey")
def profile_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results are made once for each genome; a second call makes those that the first was not asked for."""
    path, o = _place(spark), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("genome_id"), "o_orderkey")

    def make(run: int):
        return lambda q: q.groupBy(F.col("genome_id").alias("query")).agg(F.count(F.lit(1)).alias("n")).withColumn("run", F.lit(run))

    tables.cached_profiles(o.where("genome_id % 2 = 0"), path, "snapshot1-k21-u20", make(1))
    return tables.cached_profiles(o, path, "snapshot1-k21-u20", make(2))


@book(f"""WITH {PATHS_SQL}, size AS (SELECT node AS species, count(*) AS n FROM paths WHERE depth = 7 GROUP BY node),
above AS (SELECT array_to_string(string_split(species, '|')[1:up], '|') AS node, species, n FROM size, (SELECT unnest(range(1, 8)) AS up))
SELECT node, species, n AS n_genomes FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY n, species) AS r FROM above) WHERE r = 1""")
def smallest_species(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = genomes(spark, sf_dir)
    return maintain.smallest_species(rows, tree.nodes(rows))


@book(f"""WITH {PATHS_SQL}, ids AS (SELECT node, depth, row_number() OVER (ORDER BY depth DESC, node) AS n FROM (SELECT DISTINCT node, depth FROM paths)),
steps AS (SELECT node AS name, up, array_to_string(string_split(node, '|')[1:up], '|') AS step FROM ids, LATERAL (SELECT unnest(range(1, depth + 1)) AS up))
SELECT name, string_agg(['k','p','c','o','f','g','s'][up] || '__MSBT' || n, '|' ORDER BY up) AS internal FROM steps JOIN ids ON ids.node = step GROUP BY name""")
def internal_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = maintain.allocate_ids(tree.nodes(genomes(spark, sf_dir)).withColumn("down", -F.col("depth")), ["down", "node"])
    return maintain.internal_labels(named.select("cluster_id", F.col("node").alias("name")))


@book("""SELECT p_brand AS g, 'MSBT' || min(p_partkey) AS cluster_id FROM part GROUP BY p_brand""")
def oldest_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain.oldest(table(spark, sf_dir, "part").select(F.col("p_brand").alias("g"), _text("MSBT", F.col("p_partkey")).alias("cluster_id")), "g")


@book("""SELECT o_orderkey AS id, CASE WHEN o_custkey % 3 = 0 THEN 'b' ELSE 'a' END AS kingdom FROM orders""")
def superkingdom_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey")
    return etl.by_superkingdom([o.select("id", F.lit("a").alias("kingdom")), o.where("o_custkey % 3 = 0").select("id", F.lit("b").alias("kingdom"))])
