"""Queries of k-mers, sketches and distances."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.operators import linkage, pairwise, sketch
from cladeframe.plans.derived import GENOMES_SQL, K, SHORT_K, Book, bits, bits_sql, distance_sql, genomes, table, windows_sql
from cladeframe.storage import Scratch

book = Book()
QUERIES, SQL = book.queries, book.sql

#: Size of the portable sketches.
M = 1_000_003


@book(f"WITH {GENOMES_SQL}, {windows_sql(SHORT_K)} SELECT genome_id, count(*) AS f1, count(DISTINCT kmer) AS f0 FROM windows GROUP BY genome_id")
def kmer_distinct_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.genome_counts(genomes(spark, sf_dir), SHORT_K).select("genome_id", F.col("occurrences").alias("f1"), F.col("distinct").alias("f0"))


@book(f"""WITH {GENOMES_SQL}, {windows_sql(SHORT_K)}, c AS (SELECT genome_id, kmer, count(*) AS n FROM windows GROUP BY ALL)
SELECT genome_id, count(*) AS kept, sum(n)::BIGINT AS occurrences FROM c WHERE n >= 2 GROUP BY genome_id""")
def kmer_min_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.genome_counts(genomes(spark, sf_dir), SHORT_K, 2).select("genome_id", F.col("distinct").alias("kept"), "occurrences")


@book(f"""WITH {GENOMES_SQL}, {windows_sql(SHORT_K)}, c AS (SELECT kmer, count(*) AS occurrences FROM windows GROUP BY kmer)
SELECT occurrences, count(*) AS n_kmers FROM c GROUP BY occurrences""")
def kmer_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.kmer_histogram(genomes(spark, sf_dir), SHORT_K)


@book(f"""WITH {GENOMES_SQL}, {windows_sql(SHORT_K)}, c AS (SELECT kmer, count(*) AS n FROM windows GROUP BY kmer),
s AS (SELECT coalesce(sum(n), 0)::BIGINT AS f1, count(*) AS f0, count(*) FILTER (n < 2) AS rare FROM c),
z AS (SELECT *, CASE WHEN f0 = 0 THEN f1 ELSE f0 - rare END AS size FROM s)
SELECT f1, f0, rare, size + floor(size * 50.0 / 100.0)::BIGINT AS filter_size FROM z""")
def filter_size_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.filter_size(sketch.kmer_histogram(genomes(spark, sf_dir), SHORT_K))


_LENGTHS = (5, 9, 13, 17, 21)
_CURVE_SQL = f"""WITH {GENOMES_SQL}, curve AS (""" + " UNION ALL ".join(f"""
  SELECT {k} AS k, coalesce(sum(n), 0)::BIGINT AS total, count(*) AS n_distinct FROM (SELECT kmer, count(*) AS n FROM (
    SELECT substr(seq, CAST(i AS BIGINT), {k}) AS kmer FROM (SELECT seq, unnest(range(1, length(seq) - {k} + 2)) AS i FROM genomes)) GROUP BY kmer)"""
    for k in _LENGTHS) + "), shares AS (SELECT *, CASE WHEN total > 0 THEN round(n_distinct / total, 6) ELSE 0.0 END AS share FROM curve)"


@book(_CURVE_SQL + " SELECT k, total, n_distinct, share FROM shares")
def kmer_length_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.length_curve(genomes(spark, sf_dir), list(_LENGTHS))


@book(_CURVE_SQL + """ SELECT min(k) AS k FROM (SELECT k, coalesce(lead(share) OVER (ORDER BY k) - share, 0) AS gain FROM shares) WHERE gain < 0.05""")
def kmer_length_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.choose_length(sketch.length_curve(genomes(spark, sf_dir), list(_LENGTHS)))


_DNA_SQL = "dna AS (SELECT doc_id AS genome_id, translate(md5(doc_id::VARCHAR) || md5('x' || doc_id), '0123456789abcdef', 'ACGTACGTACGTACGN') AS seq FROM documents)"


@book(f"""WITH {_DNA_SQL}, {windows_sql(5, 'dna')}, c AS (SELECT genome_id, least(kmer, reverse(translate(kmer, 'ACGT', 'TGCA'))) AS kmer FROM windows WHERE NOT contains(kmer, 'N'))
SELECT genome_id, kmer, count(*) AS occurrences FROM c GROUP BY ALL""")
def canonical_kmer(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id").cast("string")
    dna = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("genome_id"), F.translate(
        F.concat(F.md5(i), F.md5(F.concat(F.lit("x"), i))), "0123456789abcdef", "ACGTACGTACGTACGN").alias("seq"))
    return sketch.kmer_counts(sketch.kmers(dna, 5, canonical=True, alphabet="ACGT"))


_PORTABLE_SQL = f"""{GENOMES_SQL}, {windows_sql(SHORT_K)},
pbits AS (SELECT DISTINCT genome_id, ('0x' || substr(md5(kmer), 1, 15))::BIGINT % {M} AS bit FROM windows)"""


@book(f"WITH {_PORTABLE_SQL} SELECT genome_id, count(*) AS n_bits, sum(bit)::BIGINT AS bit_sum, max(bit) AS last_bit FROM pbits GROUP BY genome_id")
def sketch_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.portable_sizes(genomes(spark, sf_dir), SHORT_K, M).select("genome_id", F.col("n").alias("n_bits"), "bit_sum", "last_bit")


@book(f"WITH {_PORTABLE_SQL} SELECT genome_id, count(*) AS n, round(count(*) / {M}.0::DOUBLE, 8) AS density FROM pbits GROUP BY genome_id")
def sketch_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.with_density(sketch.portable_sizes(genomes(spark, sf_dir), SHORT_K, M).select("genome_id", "n"), M)


@book(f"""WITH {_PORTABLE_SQL} SELECT lang AS genome_id, count(DISTINCT bit) AS n, round(count(DISTINCT bit) / {M}.0::DOUBLE, 8) AS density
FROM pbits JOIN documents ON doc_id = genome_id GROUP BY lang""")
def parent_union_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("genome_id"), "lang")
    packed = sketch.packed_unions(genomes(spark, sf_dir), groups, "lang", SHORT_K, M)
    return sketch.with_density(packed.groupBy(F.col("lang").alias("genome_id")).agg(F.sum(F.bitmap_count("bits")).alias("n")), M)


@book(f"""WITH {_PORTABLE_SQL} SELECT lang AS genome_id, bit // 32768 + 1 AS bucket, count(DISTINCT bit) AS set_bits
FROM pbits JOIN documents ON doc_id = genome_id WHERE bit > 0 GROUP BY ALL""")
def packed_union_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("genome_id"), "lang")
    packed = sketch.packed_unions(genomes(spark, sf_dir), groups, "lang", SHORT_K, M)
    # without bit 0, the lowest of the first byte of the first bucket
    zero = F.when((F.col("bucket") == 1) & (F.conv(F.hex(F.substring("bits", 1, 1)), 16, 10).cast("int") % 2 == 1), 1).otherwise(0)
    return packed.select(F.col("lang").alias("genome_id"), "bucket", (F.bitmap_count("bits") - zero).alias("set_bits")).where("set_bits > 0")


_J, _ANI = distance_sql("inter", "uni", K)
_PAIRS_SQL = f"""{bits_sql()}, n AS (SELECT genome_id, count(*) AS n FROM bits GROUP BY genome_id),
shared AS (SELECT a.genome_id AS a, b.genome_id AS b, count(*) AS inter FROM bits a JOIN bits b ON a.bit = b.bit AND a.genome_id < b.genome_id GROUP BY ALL),
counted AS (SELECT a, b, inter, x.n + y.n - inter AS uni FROM shared JOIN n x ON x.genome_id = a JOIN n y ON y.genome_id = b),
pairs AS (SELECT a, b, inter, uni, {_J} AS jaccard, {_ANI} AS ani FROM counted)"""


@book(f"WITH {_PAIRS_SQL} SELECT a, b, inter, uni, jaccard, ani FROM pairs")
def pairwise_ani(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairwise.pairwise(bits(genomes(spark, sf_dir)), K)


@book(f"WITH {_PAIRS_SQL} SELECT a, b, ani FROM pairs WHERE ani <= 0.01")
def near_duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    return pairwise.close_pairs(scratch.save(bits(genomes(spark, sf_dir))), K, 0.01, scratch.save)


@book(f"""WITH {_PAIRS_SQL} SELECT x.taxonomy, p.a, p.b, coalesce(q.ani, 1.0) AS ani
FROM (SELECT g.taxonomy, g.genome_id AS a, h.genome_id AS b FROM genomes g JOIN genomes h ON g.taxonomy = h.taxonomy AND g.genome_id < h.genome_id) p
JOIN genomes x ON x.genome_id = p.a LEFT JOIN pairs q ON q.a = p.a AND q.b = p.b""")
def dense_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = genomes(spark, sf_dir)
    groups = rows.select("genome_id", "taxonomy")
    found = pairwise.within(Scratch(spark).save(bits(rows)), groups, "taxonomy", K)
    return pairwise.dense(found, groups, "taxonomy")


@book(f"""WITH RECURSIVE {_PAIRS_SQL}, close AS MATERIALIZED (SELECT a, b FROM pairs WHERE ani <= 0.01),
ordered AS MATERIALIZED (SELECT b, row_number() OVER (ORDER BY b) AS i FROM (SELECT DISTINCT b FROM close)),
walk(i, dropped) AS (
  SELECT 0::BIGINT, []::BIGINT[]
  UNION ALL
  SELECT o.i, CASE WHEN EXISTS (SELECT 1 FROM close c WHERE c.b = o.b AND NOT list_contains(w.dropped, c.a)) THEN list_append(w.dropped, o.b) ELSE w.dropped END
  FROM walk w JOIN ordered o ON o.i = w.i + 1)
SELECT genome_id FROM genomes WHERE NOT list_contains((SELECT dropped FROM walk ORDER BY i DESC LIMIT 1), genome_id)""")
def dereplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    close = scratch.save(pairwise.close_pairs(scratch.save(bits(genomes(spark, sf_dir))), K, 0.01, scratch.save).select("a", "b"))
    return linkage.dereplicate(genomes(spark, sf_dir).select("genome_id"), close, scratch.save)


_CONTAIN_SQL = f"""{bits_sql()}, q AS (SELECT b.* FROM bits b JOIN genomes g USING (genome_id) WHERE NOT is_reference),
r AS (SELECT b.* FROM bits b JOIN genomes g USING (genome_id) WHERE is_reference), total AS (SELECT genome_id, count(*) AS total FROM q GROUP BY genome_id),
c AS (SELECT q.genome_id AS query, r.genome_id AS target, count(*) AS common FROM q JOIN r ON q.bit = r.bit GROUP BY ALL),
scores AS (SELECT query, target, common, total, round(common / total, 8) AS score FROM c JOIN total ON genome_id = query)"""


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = genomes(spark, sf_dir)
    return bits(rows.where("not is_reference")), bits(rows.where("is_reference"))


@book(f"WITH {_CONTAIN_SQL} SELECT query, target, common, total, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, target) AS r FROM scores) WHERE r = 1")
def containment_top_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cladeframe.operators.descent import best_match

    return best_match(pairwise.containment(*_sides(spark, sf_dir)), ["query"], "target").select("query", "target", "common", "total", "score")


@book(f"WITH {_CONTAIN_SQL} SELECT query, target, score FROM (SELECT *, max(score) OVER (PARTITION BY query) AS best FROM scores) WHERE score >= round(best * 0.8::DOUBLE, 8)")
def uncertainty_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cladeframe.operators.descent import band

    return band(pairwise.containment(*_sides(spark, sf_dir)), 20.0, ["query"]).select("query", "target", "score")


@book(f"WITH {_CONTAIN_SQL} SELECT query, target, score FROM (SELECT *, max(score) OVER (PARTITION BY query) AS best FROM scores WHERE score >= 0.05) WHERE score >= round(best * 0.5::DOUBLE, 8)")
def pruned_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cladeframe.operators.descent import band

    return band(pairwise.containment(*_sides(spark, sf_dir)).where("score >= 0.05"), 50.0, ["query"]).select("query", "target", "score")


_CROSS_SQL = f"""{_CONTAIN_SQL}, nr AS (SELECT genome_id, count(*) AS n FROM r GROUP BY genome_id),
counted AS (SELECT query, target, common AS inter, total + n - common AS uni FROM scores JOIN nr ON genome_id = target),
found AS (SELECT query, target, inter, uni, {_ANI} AS ani FROM counted)"""


@book(f"WITH {_CROSS_SQL} SELECT query, target, ani FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY ani, target) AS k FROM found) WHERE k = 1")
def closest_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cladeframe.operators.descent import closest

    return closest(pairwise.cross_distance(*_sides(spark, sf_dir), K), ["query"], "target").select("query", "target", "ani")
