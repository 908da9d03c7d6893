"""Hand-checked cases of the column functions."""

import pytest
from pyspark.sql import functions as F

from cladeframe.functions import assembly, distance
from cladeframe.functions import taxonomy as tx

FULL = "k__A|p__B|c__C|o__D|f__E|g__F|s__G"


def one(spark, value, kind="string"):
    return lambda f: spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("out")).first()["out"]


@pytest.mark.parametrize("label, defined", [
    (FULL, True), (FULL[:-6], False), (FULL.replace("c__", "x__"), False), ("k__A|p__B|c__C|o__D|f__E|g__F|s__", False), ("", False), (None, False), (FULL + "|t__x", False)])
def test_is_defined(spark, label, defined):
    assert one(spark, label)(tx.is_defined) is defined


def test_parts_of_labels(spark):
    assert one(spark, FULL)(tx.level_of) == "species" and one(spark, "k__A")(tx.level_of) == "kingdom"
    assert one(spark, FULL)(tx.last_part) == "s__G" and one(spark, "k__A")(tx.parent_label) is None
    assert one(spark, FULL)(tx.parent_label) == FULL[:-5] and one(spark, FULL)(lambda c: tx.prefix_label(c, 2)) == "k__A|p__B"
    assert one(spark, FULL)(lambda c: tx.in_clade(c, "p__B")) and not one(spark, FULL)(lambda c: tx.in_clade(c, "k__A"))


@pytest.mark.parametrize("name, clean", [("Escherichia coli (K-12)", "Escherichia_coli_K_12"), ("__a__b__", "a_b"), ("Ñandú é", "Ñandú_é"), ("..", None), ("", None)])
def test_normalise_name(spark, name, clean):
    assert one(spark, name)(tx.normalise_name) == clean
    assert one(spark, name)(lambda c: tx.normalise_name(c, F.lit("up"))) == (clean or "up_unclassified")


@pytest.mark.parametrize("key, batch", [("MSBT0", "000000"), ("MSBT999", "000000"), ("MSBT1000", "000001"), ("MSBT1234567", "001234"), ("MSBT", None), ("X1", None), (None, None)])
def test_cluster_batch(spark, key, batch):
    assert one(spark, key)(tx.cluster_batch) == batch


def test_file_names(spark):
    assert one(spark, "/a/b.c/genome.1.fna")(tx.file_stem) == "genome.1" and one(spark, "plain")(tx.file_stem) == "plain"
    assert [one(spark, p)(tx.is_supported) for p in ("a.fa", "a.fasta", "a.fna", "a.bf", "a.fa.gz", None)] == [True] * 4 + [False] * 2


@pytest.mark.parametrize("inter, uni, j, ani", [
    (10, 10, 1.0, 0.0), (0, 10, 0.0, 1.0), (0, 0, 0.0, 1.0), (1, 200_000, 0.00001, 1.0), (1, 2, 0.5, 0.04505), (1, 3, 0.33333, 0.07702)])
def test_distance(spark, inter, uni, j, ani):
    row = spark.createDataFrame([(inter, uni)], "i long, u long").select(distance.jaccard(F.col("i"), F.col("u")).alias("j")) \
        .select("j", distance.ani_distance(F.col("j"), 9).alias("ani")).first()
    assert row.j == j and row.ani == pytest.approx(ani, abs=1e-5) and str(row.ani) != "-0.0"


@pytest.mark.parametrize("tags, kind", [
    ("", "reference"), ("na", "reference"), (None, "reference"), ("derived from single cell", "reference"), ("contaminated", "na"),
    ("derived from single cell; contaminated", "na"), ("partial", "mag"), ("derived from single cell; partial", "mag"),
    ("Derived from single cell", "reference"), ("derived from single cell;", "reference"), ("Contaminated", "na"), (" ; ", "reference"), ("NA", "reference"),
    ("na; chimeric", "na"), ("na;", "reference"), ("DERIVED FROM SINGLE CELL ;; Partial", "mag")])
def test_genome_type(spark, tags, kind):
    assert one(spark, tags)(assembly.genome_type) == kind


def test_quality_and_sizes(spark):
    assert one(spark, 0, "int")(lambda c: assembly.busco_completeness(F.lit(5), F.lit(20))) == 75.0
    assert one(spark, 0, "int")(lambda c: assembly.busco_contamination(F.lit(1), F.lit(0))) == 0.0
    assert one(spark, 101, "long")(lambda c: assembly.expanded_size(c, 50.0)) == 151
    assert one(spark, None, "double")(lambda c: assembly.passes_quality(c, c)) is True
    assert one(spark, None, "double")(lambda c: assembly.passes_quality(c, c, 50.0)) is False
    assert one(spark, "ftp/x/GCA_1")(assembly.genome_url) == "ftp/x/GCA_1/GCA_1_genomic.fna.gz"
