"""Queries of scalar functions, names, labels and assembly rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.functions import assembly
from cladeframe.functions import taxonomy as tx
from cladeframe.operators import etl, tree
from cladeframe.plans.derived import GENOMES_SQL, Book, genomes, table

book = Book()
QUERIES, SQL = book.queries, book.sql


def _flawed(column: str = "taxonomy"):
    """Labels with flaws of several kinds, by id."""
    t = F.col(column)
    return F.when(F.col("genome_id") % 7 == 1, F.regexp_replace(t, r"\|s__.*$", "")) \
        .when(F.col("genome_id") % 7 == 2, F.regexp_replace(t, "c__", "x__")) \
        .when(F.col("genome_id") % 7 == 3, F.regexp_replace(t, "s__.*$", "s__")).otherwise(t)


_FLAWED_SQL = """CASE genome_id % 7 WHEN 1 THEN regexp_replace(taxonomy, '\\|s__.*$', '') WHEN 2 THEN replace(taxonomy, 'c__', 'x__')
  WHEN 3 THEN regexp_replace(taxonomy, 's__.*$', 's__') ELSE taxonomy END"""


@book(f"""WITH {GENOMES_SQL}, t AS (SELECT genome_id, {_FLAWED_SQL} AS label FROM genomes)
SELECT genome_id, label, regexp_full_match(label, 'k__[^|]+\\|p__[^|]+\\|c__[^|]+\\|o__[^|]+\\|f__[^|]+\\|g__[^|]+\\|s__[^|]+') AS defined FROM t""")
def taxonomy_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = genomes(spark, sf_dir).select("genome_id", _flawed().alias("label"))
    return rows.withColumn("defined", tx.is_defined(F.col("label")))


@book(f"""WITH {GENOMES_SQL}, t AS (SELECT genome_id, {_FLAWED_SQL} AS label FROM genomes)
SELECT genome_id, ['kingdom','phylum','class','order','family','genus','species'][len(string_split(label, '|'))] AS level,
       string_split(label, '|')[-1] AS last_part, array_to_string(string_split(label, '|')[1:-2], '|') AS parent,
       array_to_string(string_split(label, '|')[1:3], '|') AS class_prefix FROM t""")
def taxonomy_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("label")
    return genomes(spark, sf_dir).select("genome_id", _flawed().alias("label")).select(
        "genome_id", tx.level_of(t).alias("level"), tx.last_part(t).alias("last_part"), tx.parent_label(t).alias("parent"),
        tx.prefix_label(t, 3).alias("class_prefix"))


@book("""WITH t AS (SELECT doc_id, split_part(text, ' ', 1) || ' - ' || split_part(text, ' ', 2) || '!' AS name, lang FROM documents),
n AS (SELECT doc_id, name, lang, regexp_replace(regexp_replace(regexp_replace(name, '[^\\p{L}\\p{N}\\p{M}_]+', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g') AS x FROM t)
SELECT doc_id, name, CASE WHEN x = '' THEN lang || '_unclassified' ELSE x END AS normalised FROM n""")
def name_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", F.concat(
        F.split_part("text", F.lit(" "), F.lit(1)), F.lit(" - "), F.split_part("text", F.lit(" "), F.lit(2)), F.lit("!")).alias("name"))
    return rows.select("doc_id", "name", tx.normalise_name(F.col("name"), F.col("lang")).alias("normalised"))


@book("""WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 3 THEN 'X' ELSE 'MSBT' END || o_orderkey AS cluster_id FROM orders)
SELECT cluster_id, starts_with(cluster_id, 'MSBT') AS is_cluster, CASE WHEN starts_with(cluster_id, 'MSBT') THEN lpad((o_orderkey // 1000)::VARCHAR, 6, '0') END AS batch FROM t""")
def cluster_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    ids = table(spark, sf_dir, "orders").select(F.concat(F.when(key % 10 == 3, "X").otherwise("MSBT"), key.cast("string")).alias("cluster_id"))
    return ids.select("cluster_id", tx.is_cluster_id(F.col("cluster_id")).alias("is_cluster"), tx.cluster_batch(F.col("cluster_id")).alias("batch"))


@book("""WITH t AS (SELECT page_id, split_part(split_part(url, '?', 1), '#', 1) || CASE page_id % 5 WHEN 0 THEN '.fa' WHEN 1 THEN '.fasta' WHEN 2 THEN '.fna' WHEN 3 THEN '.bf' ELSE '.txt' END AS path FROM pages),
b AS (SELECT page_id, path, string_split(path, '/')[-1] AS base FROM t)
SELECT page_id, path, regexp_replace(base, '(.)\\.[^.]*$', '\\1') AS stem, page_id % 5 < 4 AS supported FROM b""")
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    ending = F.element_at(F.array(*map(F.lit, (".fa", ".fasta", ".fna", ".bf", ".txt"))), (F.col("page_id") % 5 + 1).cast("int"))
    path = F.concat(F.split_part(F.split_part("url", F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1)), ending)
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path")).select(
        "page_id", "path", tx.file_stem(F.col("path")).alias("stem"), tx.is_supported(F.col("path")).alias("supported"))


def quality_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("genome_id"), (F.col("quality") * 100.0 - F.col("doc_id") % 10).alias("completeness"),
        (F.col("toxic") * 10.0 + F.col("doc_id") % 4).alias("contamination"))


QUALITY_SQL = "quality AS (SELECT doc_id AS genome_id, quality * 100.0 - doc_id % 10 AS completeness, toxic * 10.0 + doc_id % 4 AS contamination FROM labels)"


@book(f"""WITH {QUALITY_SQL} SELECT genome_id, completeness::DOUBLE AS completeness, contamination::DOUBLE AS contamination
FROM quality WHERE completeness >= 95 AND contamination <= 5""")
def qc_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_table(spark, sf_dir).where(assembly.passes_quality(F.col("completeness"), F.col("contamination"), 95.0, 5.0))


@book(f"""WITH {GENOMES_SQL}, {QUALITY_SQL} SELECT g.genome_id, coalesce(q.completeness, 0)::DOUBLE AS completeness, coalesce(q.contamination, 0)::DOUBLE AS contamination
FROM genomes g LEFT JOIN quality q ON q.genome_id = g.genome_id""")
def qc_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return etl.join_quality(genomes(spark, sf_dir).select("genome_id"), quality_table(spark, sf_dir))


@book("""SELECT o_custkey AS genome_id, round(coalesce(avg(CASE WHEN l.l_linenumber < 6 THEN l_quantity END), 0), 5) AS completeness,
       round(coalesce(avg(l_tax), 0), 5) AS contamination
FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey GROUP BY o_custkey""")
def checkv_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    contigs = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("genome_id"), F.when(F.col("l_linenumber") < 6, F.col("l_quantity").cast("string")).otherwise("NA").alias("completeness"),
        F.col("l_tax").cast("string").alias("contamination"))
    return etl.checkv_average(contigs)


@book("""WITH j AS (SELECT event_id, (props->>'$.k')::BIGINT AS k, event_id % 7 AS missing FROM events)
SELECT event_id, round(100.0 * (1.0 - missing / 100.0::DOUBLE), 6) AS completeness,
       round(CASE WHEN k = 0 THEN 0.0 ELSE 100.0 * missing / k::DOUBLE END, 6) AS contamination FROM j""")
def busco_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), (F.col("event_id") % 7).alias("missing"))
    return rows.select("event_id", F.round(assembly.busco_completeness(F.col("missing"), F.lit(100)), 6).alias("completeness"),
                       F.round(assembly.busco_contamination(F.col("missing"), F.col("k")), 6).alias("contamination"))


#: Exclusion tags of the test rows: none, single and several, in mixed case, with empty parts.
TAGS = ("", "na", "derived from single cell", "chimeric; derived from single cell", "partial", "contaminated; x", "Derived from Single Cell;",
        "Contaminated", "; genus undefined ;", "Partial;Chimeric", "from large multi-isolate project; Missing strain identifier")


def summary_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as an assembly summary."""
    o = F.col("o_orderkey")
    tag = F.element_at(F.array(*map(F.lit, TAGS)), (o % len(TAGS) + 1).cast("int"))
    level = F.element_at(F.array(*map(F.lit, ("Complete Genome", "Chromosome", "Scaffold", "Contig", "Other"))), (o % 5 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("species_taxid"), F.concat(F.lit("https://host/GCA_"), o.cast("string")).alias("ftp_path"),
        F.when(o % 9 == 0, "Partial").otherwise("Full").alias("genome_rep"), tag.alias("excluded_from_refseq"),
        F.when(o % 11 == 0, "reference genome").when(o % 11 == 1, "representative genome").otherwise("na").alias("refseq_category"), level.alias("assembly_level"))


def _listed(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


SUMMARY_SQL = f"""summary AS (SELECT o_custkey AS species_taxid, 'https://host/GCA_' || o_orderkey AS ftp_path,
  CASE WHEN o_orderkey % 9 = 0 THEN 'Partial' ELSE 'Full' END AS genome_rep,
  [{', '.join(f"'{t}'" for t in TAGS)}][o_orderkey % {len(TAGS)} + 1] AS excluded_from_refseq,
  CASE o_orderkey % 11 WHEN 0 THEN 'reference genome' WHEN 1 THEN 'representative genome' ELSE 'na' END AS refseq_category,
  ['Complete Genome', 'Chromosome', 'Scaffold', 'Contig', 'Other'][o_orderkey % 5 + 1] AS assembly_level FROM orders),
tagged AS (SELECT *, list_filter(list_transform(string_split(lower(excluded_from_refseq), ';'), lambda t: trim(t)), lambda t: t <> '') AS tags FROM summary),
assemblies AS (SELECT * EXCLUDE (tags), CASE WHEN len(tags) = 0 OR tags = ['na'] OR len(list_intersect(tags, [{_listed(assembly.REFERENCE_TAGS)}])) = len(list_distinct(tags)) THEN 'reference'
  WHEN len(list_intersect(tags, [{_listed(assembly.EXCLUDE_TAGS)}])) > 0 THEN 'na' ELSE 'mag' END AS type,
  string_split(ftp_path, '/')[-1] AS id, ftp_path || '/' || string_split(ftp_path, '/')[-1] || '_genomic.fna.gz' AS url FROM tagged WHERE genome_rep <> 'Partial'),
lineages AS (SELECT c_custkey AS species_taxid, 'k__Market|p__' || c_mktsegment || '|c__N' || c_nationkey || '|o__O|f__F|g__G|s__' || CASE WHEN c_custkey % 13 = 0 THEN 'unclassified' ELSE 'S' || c_custkey END AS taxonomy FROM customer)"""


def lineage_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(c.alias("species_taxid"), F.concat(
        F.lit("k__Market|p__"), "c_mktsegment", F.lit("|c__N"), F.col("c_nationkey").cast("string"), F.lit("|o__O|f__F|g__G|s__"),
        F.when(c % 13 == 0, "unclassified").otherwise(F.concat(F.lit("S"), c.cast("string")))).alias("taxonomy"))


@book(f"WITH {SUMMARY_SQL} SELECT id, type, excluded_from_refseq, url FROM assemblies")
def genome_type_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return etl.assembly_table(summary_table(spark, sf_dir), full_only=True).select("id", "type", "excluded_from_refseq", "url")


@book(f"""WITH {SUMMARY_SQL}, best AS (SELECT id, type, taxonomy, assembly_level, row_number() OVER (PARTITION BY taxonomy ORDER BY
  list_position(['Complete Genome', 'Chromosome', 'Scaffold', 'Contig'], assembly_level), md5(id), id) AS r
  FROM assemblies JOIN lineages USING (species_taxid) WHERE assembly_level <> 'Other')
SELECT id, type, taxonomy, assembly_level FROM best WHERE r <= 3""")
def top_n_per_species(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = etl.assembly_table(summary_table(spark, sf_dir), full_only=True).join(lineage_table(spark, sf_dir), "species_taxid")
    return etl.top_per_species(rows, 3).select("id", "type", "taxonomy", "assembly_level")


@book(f"""WITH {SUMMARY_SQL}, chosen AS (SELECT * FROM assemblies JOIN lineages USING (species_taxid)
  WHERE contains(taxonomy || '|', '|p__BUILDING|') AND type = 'reference' AND NOT contains(taxonomy, 'unclassified')
  AND id NOT IN (SELECT 'GCA_' || o_orderkey FROM orders WHERE o_orderstatus = 'P')),
best AS (SELECT id, type, taxonomy, excluded_from_refseq, assembly_level, url, row_number() OVER (PARTITION BY taxonomy ORDER BY
  list_position(['Complete Genome', 'Chromosome', 'Scaffold', 'Contig'], assembly_level), md5(id), id) AS r FROM chosen WHERE assembly_level <> 'Other')
SELECT id, type, taxonomy, excluded_from_refseq, assembly_level, url FROM best WHERE r <= 2""")
def assembly_etl(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.concat(F.lit("GCA_"), F.col("o_orderkey").cast("string")).alias("id"))
    rows = etl.select_genomes(etl.assembly_table(summary_table(spark, sf_dir), True), lineage_table(spark, sf_dir), done, "p__BUILDING", "reference", max_per_species=2)
    return rows.select("id", "type", "taxonomy", "excluded_from_refseq", "assembly_level", "url")


@book(f"""WITH {SUMMARY_SQL} SELECT id, 'reference' AS type, refseq_category, taxonomy FROM assemblies JOIN lineages USING (species_taxid)
WHERE refseq_category IN ('reference genome', 'representative genome')""")
def assembly_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = etl.select_genomes(etl.assembly_table(summary_table(spark, sf_dir), True), lineage_table(spark, sf_dir),
                              categories=["reference genome", "representative genome"])
    return rows.select("id", "type", "refseq_category", "taxonomy")


@book(f"""WITH {SUMMARY_SQL} SELECT id, type FROM assemblies WHERE id NOT IN (SELECT 'GCA_' || o_orderkey FROM orders WHERE o_orderstatus = 'F')""")
def anti_join_exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.concat(F.lit("GCA_"), F.col("o_orderkey").cast("string")).alias("id"))
    return etl.without_exported(etl.assembly_table(summary_table(spark, sf_dir), True), done).select("id", "type")


@book("""SELECT DISTINCT c_custkey::VARCHAR AS genome_id FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""")
def semi_join_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("genome_id"))
    lineage = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").cast("string").alias("genome_id"))
    return etl.selected(given, lineage)


@book("""SELECT id, version, size FROM (SELECT p_brand AS id, p_size::VARCHAR AS version, max(p_partkey) AS size,
  row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS r FROM part GROUP BY p_brand, p_size) WHERE r = 1""")
def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalogue = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("id"), F.col("p_size").cast("string").alias("version")).agg(F.max("p_partkey").alias("size"))
    return etl.latest_versions(catalogue)


@book(f"""WITH {GENOMES_SQL}, {QUALITY_SQL}, e AS (
  SELECT CASE genome_id % 9 WHEN 4 THEN '' ELSE genome_id::VARCHAR END AS entry_id, CASE genome_id % 8 WHEN 3 THEN 'other' ELSE genome_id::VARCHAR END AS name,
         CASE genome_id % 10 WHEN 7 THEN 'clade' ELSE 'genome' END AS level, is_reference AS known, {_FLAWED_SQL} AS taxonomy, genome_id % 6 // 5 AS n_children FROM genomes)
SELECT entry_id, problem FROM (
  SELECT entry_id, 'no id' AS problem FROM e WHERE entry_id = '' UNION ALL
  SELECT entry_id, 'unknown level' FROM e WHERE level = 'clade' UNION ALL
  SELECT entry_id, 'genome with children' FROM e WHERE level = 'genome' AND n_children > 0 UNION ALL
  SELECT entry_id, 'genome id differs from its name' FROM e WHERE level = 'genome' AND entry_id <> name UNION ALL
  SELECT entry_id, 'cluster without a cluster id' FROM e WHERE level <> 'genome' UNION ALL
  SELECT entry_id, 'known genome without a label' FROM e WHERE level = 'genome' AND known AND NOT regexp_full_match(taxonomy, 'k__[^|]+\\|p__[^|]+\\|c__[^|]+\\|o__[^|]+\\|f__[^|]+\\|g__[^|]+\\|s__[^|]+'))""")
def entry_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = F.col("genome_id")
    entries = genomes(spark, sf_dir).select(
        F.when(g % 9 == 4, "").otherwise(g.cast("string")).alias("entry_id"), F.when(g % 8 == 3, "other").otherwise(g.cast("string")).alias("name"),
        F.when(g % 10 == 7, "clade").otherwise("genome").alias("level"), F.col("is_reference").alias("known"), _flawed().alias("taxonomy"),
        F.floor(g % 6 / 5).alias("n_children"))
    return tree.violations(entries)
