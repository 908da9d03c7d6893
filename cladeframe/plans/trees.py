"""Queries of the taxonomy tree, its sums, sets and ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.operators import etl, linkage, maintain, medoid, tree
from cladeframe.plans.derived import GENOMES_SQL, Book, genomes, table
from cladeframe.storage import Scratch

book = Book()
QUERIES, SQL = book.queries, book.sql

TREE_SQL = """paths AS (SELECT genome_id, is_reference, depth,
  ['kingdom','phylum','class','order','family','genus','species'][depth] AS level, array_to_string(string_split(taxonomy, '|')[1:depth], '|') AS node,
  CASE WHEN depth = 1 THEN 'db' ELSE array_to_string(string_split(taxonomy, '|')[1:depth - 1], '|') END AS parent
  FROM genomes, (SELECT unnest(range(1, 8)) AS depth)),
members AS (SELECT node, depth, level, count(*) AS n_genomes, count(*) FILTER (is_reference) AS n_references, bool_or(is_reference) AS known FROM paths GROUP BY ALL)"""
PATHS_SQL = f"{GENOMES_SQL}, {TREE_SQL}"

_GEO_SQL = """edges AS (SELECT 'R' || r_regionkey AS node, NULL AS parent FROM region UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation
  UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey FROM customer UNION ALL SELECT 'O' || o_orderkey, 'C' || o_custkey FROM orders)"""


def _geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    def edge(name: str, own: str, prefix: str, up: str | None, up_prefix: str) -> DataFrame:
        parent = F.concat(F.lit(up_prefix), F.col(up).cast("string")) if up else F.lit(None).cast("string")
        return table(spark, sf_dir, name).select(F.concat(F.lit(prefix), F.col(own).cast("string")).alias("node"), parent.alias("parent"))

    return edge("region", "r_regionkey", "R", None, "").union(edge("nation", "n_nationkey", "N", "n_regionkey", "R")) \
        .union(edge("customer", "c_custkey", "C", "c_nationkey", "N")).union(edge("orders", "o_orderkey", "O", "o_custkey", "C"))


@book(f"""WITH RECURSIVE {_GEO_SQL}, up AS (SELECT node, node AS path, parent AS above FROM edges
  UNION ALL SELECT u.node, e.node || '|' || u.path, e.parent FROM up u JOIN edges e ON e.node = u.above)
SELECT node, path FROM up u WHERE above IS NULL OR above NOT IN (SELECT node FROM edges)""")
def full_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.full_path(_geography(spark, sf_dir), steps=4, keep=Scratch(spark).save)


@book(f"""WITH RECURSIVE {_GEO_SQL}, up AS (SELECT node, parent AS ancestor, 1 AS distance FROM edges WHERE parent IS NOT NULL
  UNION ALL SELECT u.node, e.parent, u.distance + 1 FROM up u JOIN edges e ON e.node = u.ancestor WHERE e.parent IS NOT NULL)
SELECT ancestor, distance, count(*) AS descendants FROM up GROUP BY ALL""")
def descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.descendants(_geography(spark, sf_dir), steps=4).groupBy("ancestor", "distance").agg(F.count(F.lit(1)).alias("descendants"))


@book(f"WITH {PATHS_SQL} SELECT node, depth, level, n_genomes, n_references, known FROM members")
def known_by_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.members(genomes(spark, sf_dir))


@book(f"WITH {PATHS_SQL} SELECT level, count(*) AS clusters FROM members GROUP BY level")
def level_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.nodes(genomes(spark, sf_dir)).groupBy("level").agg(F.count(F.lit(1)).alias("clusters"))


@book(f"""WITH {PATHS_SQL} SELECT level, count(*) AS clusters, count(*) FILTER (known) AS known, sum(n_references)::BIGINT AS references, sum(n_genomes - n_references)::BIGINT AS mags
FROM members GROUP BY level""")
def summary_by_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain.summarize(tree.members(genomes(spark, sf_dir)))


@book(f"""WITH {PATHS_SQL}, known AS (SELECT DISTINCT depth, string_split(node, '|')[-1] AS name FROM paths WHERE is_reference AND genome_id % 3 = 0),
asked AS (SELECT DISTINCT taxonomy FROM genomes),
hits AS (SELECT taxonomy, count(*) AS n FROM asked, (SELECT unnest(range(1, 8)) AS d) JOIN known ON depth = d AND name = string_split(taxonomy, '|')[d] GROUP BY taxonomy)
SELECT a.taxonomy, coalesce(n, 0) = 7 AS exists FROM asked a LEFT JOIN hits h ON h.taxonomy = a.taxonomy""")
def taxonomy_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = genomes(spark, sf_dir)
    return tree.taxonomy_exists(rows, rows.where("is_reference and genome_id % 3 = 0"))


@book(f"""WITH {PATHS_SQL} SELECT count(*) AS genomes, count(*) FILTER (is_reference) AS references, count(*) FILTER (NOT is_reference) AS mags,
  (SELECT count(*) FROM members) AS clusters, (SELECT count(*) FROM members WHERE level = 'species') AS species FROM genomes""")
def database_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.totals(genomes(spark, sf_dir))


@book("""SELECT lang, source, count(*) AS documents, count(*) FILTER (l.quality = 1) AS good, count(*) FILTER (l.toxic = 1) AS toxic, sum(n_chars)::BIGINT AS chars
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY ROLLUP (lang, source)""")
def rollup_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").rollup("lang", "source").agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("toxic") == 1).alias("toxic"),
        F.sum("n_chars").alias("chars"))


@book("""SELECT source, lang, votes FROM (SELECT source, lang, count(*) AS votes, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) AS r
FROM documents WHERE lang IS NOT NULL GROUP BY source, lang) WHERE r = 1""")
def majority_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.majority_label(table(spark, sf_dir, "documents"), "source", "lang").select("source", "lang", "votes")


@book("""WITH m AS (SELECT source, lang FROM (SELECT source, lang, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) AS r FROM documents
  WHERE lang IS NOT NULL GROUP BY source, lang) WHERE r = 1)
SELECT source, CASE WHEN count(*) OVER (PARTITION BY lang) > 1 THEN lang || '__clade_' || row_number() OVER (PARTITION BY lang ORDER BY source) ELSE lang END AS assigned FROM m""")
def clade_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = linkage.majority_label(table(spark, sf_dir, "documents"), "source", "lang")
    return linkage.clade_suffixes(top, "source", "lang").select("source", "assigned")


@book("""SELECT p_brand, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS members, count(*) AS n, (count(DISTINCT p_type) > 3) AS characterised FROM part GROUP BY p_brand""")
def grouped_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(
        F.array_join(F.array_sort(F.collect_set("p_type")), ",").alias("members"), F.count(F.lit(1)).alias("n"), (F.count_distinct("p_type") > 3).alias("characterised"))


@book(f"""WITH {PATHS_SQL} SELECT node, level, 'MSBT' || row_number() OVER (ORDER BY depth DESC, node) AS cluster_id FROM members""")
def id_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain.allocate_ids(tree.nodes(genomes(spark, sf_dir)).withColumn("down", -F.col("depth")), ["down", "node"]).select("node", "level", "cluster_id")


@book(f"""WITH {PATHS_SQL}, old AS (SELECT DISTINCT node, level, depth, parent FROM paths WHERE is_reference),
ids AS (SELECT node, level, parent, row_number() OVER (ORDER BY node) AS n FROM old),
fresh AS (SELECT DISTINCT node, level, depth, parent FROM paths WHERE node NOT IN (SELECT node FROM old))
SELECT 'MSBT' || n AS cluster_id, node AS name, level, parent FROM ids
UNION ALL SELECT 'MSBT' || (row_number() OVER (ORDER BY depth DESC, node) + (SELECT max(n) FROM ids)), node, level, parent FROM fresh""")
def add_genomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = genomes(spark, sf_dir)
    old = maintain.allocate_ids(tree.nodes(rows.where("is_reference")), ["node"]).select("cluster_id", F.col("node").alias("name"), "level", "parent")
    return maintain.add(rows, old)


@book(f"""WITH {GENOMES_SQL}, m AS (SELECT genome_id, is_reference, CASE WHEN taxonomy IN ('k__Docs|p__en|c__C0|o__O0|f__F0|g__G8|s__S24') THEN 'k__Docs|p__en|c__C0|o__O0|f__F0|g__G8|s__S8' ELSE taxonomy END AS taxonomy FROM genomes)
SELECT taxonomy, count(*) AS n_genomes, count(*) FILTER (is_reference) AS n_references FROM m GROUP BY taxonomy""")
def merge_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    into = "k__Docs|p__en|c__C0|o__O0|f__F0|g__G8|s__S8"
    merged = maintain.merge(genomes(spark, sf_dir), [into, "k__Docs|p__en|c__C0|o__O0|f__F0|g__G8|s__S24"], into)
    return merged.groupBy("taxonomy").agg(F.count(F.lit(1)).alias("n_genomes"), F.count_if("is_reference").alias("n_references"))


@book(f"""WITH {PATHS_SQL}, kept AS (SELECT DISTINCT node FROM paths WHERE genome_id % 16 NOT IN (3, 5))
SELECT DISTINCT depth, level, node, parent FROM paths WHERE node NOT IN (SELECT node FROM kept)""")
def remove_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = genomes(spark, sf_dir)
    return maintain.remove(rows, rows.where("genome_id % 16 in (3, 5)"))[1].select("depth", "level", "node", "parent")


@book(f"""WITH {GENOMES_SQL}, old AS (SELECT taxonomy, genome_id, is_reference FROM genomes WHERE genome_id % 50 <> 7),
new AS (SELECT taxonomy, genome_id, is_reference OR genome_id % 60 = 0 AS is_reference FROM genomes WHERE genome_id % 70 <> 9),
plus AS (SELECT taxonomy, count(*) AS added FROM (SELECT * FROM new EXCEPT SELECT * FROM old) GROUP BY taxonomy),
minus AS (SELECT taxonomy, count(*) AS removed FROM (SELECT * FROM old EXCEPT SELECT * FROM new) GROUP BY taxonomy)
SELECT taxonomy, coalesce(added, 0) AS added, coalesce(removed, 0) AS removed FROM plus FULL JOIN minus USING (taxonomy)""")
def changed_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = genomes(spark, sf_dir)
    new = rows.where("genome_id % 70 <> 9").withColumn("is_reference", F.col("is_reference") | (F.col("genome_id") % 60 == 0))
    return maintain.changed(rows.where("genome_id % 50 <> 7"), new, "taxonomy")


@book(f"""WITH {PATHS_SQL}, known AS (SELECT DISTINCT node AS name FROM paths WHERE is_reference),
missing AS (SELECT node AS name, min(depth) AS depth FROM paths WHERE node NOT IN (SELECT name FROM known) GROUP BY node)
SELECT name, row_number() OVER (ORDER BY depth, name) + 9000 AS taxid FROM missing""")
def new_taxids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = genomes(spark, sf_dir)
    known = tree.nodes(rows.where("is_reference")).select(F.col("node").alias("name"), F.lit(1).alias("taxid"))
    return etl.new_taxids(tree.nodes(rows).select(F.col("node").alias("name"), "depth"), known, 9000)


@book(f"""WITH {PATHS_SQL}, n AS (SELECT DISTINCT node, level, depth, parent FROM paths), ids AS (SELECT node, row_number() OVER (ORDER BY depth, node) + 9000 AS taxid FROM n)
SELECT i.taxid, i.taxid || chr(9) || '|' || chr(9) || n.node || chr(9) || '|' || chr(9) || '' || chr(9) || '|' || chr(9) || 'scientific name' || chr(9) || '|' AS names_row,
       i.taxid || chr(9) || '|' || chr(9) || coalesce(p.taxid, 1) || chr(9) || '|' || chr(9) || n.level || chr(9) || '|' AS nodes_row
FROM n JOIN ids i USING (node) LEFT JOIN ids p ON p.node = n.parent""")
def taxdump_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = tree.nodes(genomes(spark, sf_dir)).withColumnRenamed("node", "name")
    ids = etl.new_taxids(nodes, nodes.where("false").select("name", F.lit(1).alias("taxid")), 9000)
    return etl.taxdump_rows(nodes, ids)


@book(f"""WITH {GENOMES_SQL} SELECT genome_id || '|kraken:taxid|' || (genome_id + 100) || ' ' || genome_id AS header FROM genomes""")
def kraken_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = F.col("genome_id")
    return genomes(spark, sf_dir).select(etl.kraken_header(g.cast("string"), g + 100).alias("header"))


@book("""WITH wanted AS (SELECT 'N' || n_nationkey AS name, n_nationkey FROM nation)
SELECT name, CASE WHEN n_nationkey < 10 THEN n_nationkey + 1000 ELSE n_nationkey + 5000 END AS taxid FROM wanted""")
def resolved_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("name"), F.col("n_nationkey").cast("long").alias("k"))
    return etl.resolve_names(n, n.where("k < 10").select("name", (F.col("k") + 1000).alias("taxid")), n.select("name", (F.col("k") + 5000).alias("taxid")))


@book("""WITH RECURSIVE e AS (SELECT 1 AS taxid, 1 AS parent, 'root' AS rank, 'root' AS name UNION ALL SELECT 10 + r_regionkey, 1, 'kingdom', r_name FROM region
  UNION ALL SELECT 100 + n_nationkey, 10 + n_regionkey, 'phylum', n_name FROM nation UNION ALL SELECT 1000 + c_custkey, 100 + c_nationkey, CASE WHEN c_custkey % 2 = 0 THEN 'species' ELSE 'genus' END, c_name FROM customer),
c AS (SELECT e.taxid, e.rank, e.name, p.name AS phylum, k.name AS kingdom FROM e LEFT JOIN e p ON p.taxid = e.parent AND p.rank = 'phylum' LEFT JOIN e k ON k.taxid = p.parent AND k.rank = 'kingdom' WHERE e.taxid >= 1000)
SELECT taxid, 'k__' || kingdom || '|p__' || phylum || '|g__' || CASE WHEN rank = 'genus' THEN name ELSE phylum || '_unclassified' END
  || '|s__' || CASE WHEN rank = 'species' THEN name ELSE name || '_unclassified' END AS taxonomy FROM c""")
def lineage_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    def rows(name: str, base: int, own: str, up, rank, label: str) -> DataFrame:
        return table(spark, sf_dir, name).select((F.lit(base) + F.col(own)).cast("long").alias("taxid"), up.cast("long").alias("parent"), rank.alias("rank"), F.col(label).alias("name"))

    every = rows("region", 10, "r_regionkey", F.lit(1), F.lit("kingdom"), "r_name").union(
        rows("nation", 100, "n_nationkey", F.col("n_regionkey") + 10, F.lit("phylum"), "n_name")).union(
        rows("customer", 1000, "c_custkey", F.col("c_nationkey") + 100, F.when(F.col("c_custkey") % 2 == 0, "species").otherwise("genus"), "c_name"))
    every = every.union(spark.range(1).select(F.lit(1).cast("long"), F.lit(1).cast("long"), F.lit("root"), F.lit("root")))
    found = etl.lineages(every.select("taxid", "parent", "rank"), every.select("taxid", "name"),
                         {"kingdom": "k", "phylum": "p", "genus": "g", "species": "s"}, steps=4)
    return found.where("taxid >= 1000")


@book("""SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR), doc_id) AS r, ceil(count(*) OVER (PARTITION BY source) * 10.0 / 100.0) AS most FROM documents) WHERE r <= most""")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return medoid.seeded_sample(table(spark, sf_dir, "documents").select("source", "doc_id"), "source", "doc_id", percent=10.0)


@book("""SELECT p_brand, list_aggregate(list_sort(list_distinct(list(p_type) FILTER (p_size > 20))), 'string_agg', ',') AS refs FROM part GROUP BY p_brand""")
def set_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = F.array_sort(F.collect_set(F.when(F.col("p_size") > 20, F.col("p_type"))))
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(refs.alias("r")).select("p_brand", F.when(F.size("r") > 0, F.array_join("r", ",")).alias("refs"))


@book("""WITH a AS (SELECT c_mktsegment AS g, list_distinct(list(c_nationkey)) AS s FROM customer WHERE c_acctbal > 5000 GROUP BY ALL),
b AS (SELECT c_mktsegment AS g, list_distinct(list(c_nationkey)) AS s FROM customer WHERE c_acctbal <= 0 GROUP BY ALL)
SELECT g, len(list_distinct(list_concat(a.s, b.s))) AS both_sides, len(list_intersect(a.s, b.s)) AS shared, len(a.s) - len(list_intersect(a.s, b.s)) AS only_first FROM a JOIN b USING (g)""")
def set_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    a = c.where("c_acctbal > 5000").groupBy(F.col("c_mktsegment").alias("g")).agg(F.collect_set("c_nationkey").alias("x"))
    b = c.where("c_acctbal <= 0").groupBy(F.col("c_mktsegment").alias("g")).agg(F.collect_set("c_nationkey").alias("y"))
    return a.join(b, "g").select("g", F.size(F.array_union("x", "y")).cast("long").alias("both_sides"), F.size(F.array_intersect("x", "y")).cast("long").alias("shared"),
                                 F.size(F.array_except("x", "y")).cast("long").alias("only_first"))
