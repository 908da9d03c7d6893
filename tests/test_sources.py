"""Files: FASTA, lists, reports, dumps, snapshots, archives and the stream."""

import gzip
import json
import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from cladeframe.plans import lifecycle
from cladeframe.sources import fasta, tables
from cladeframe.storage import Scratch
from cladeframe.streaming import ingest


def test_fasta(spark, tmp_path):
    (tmp_path / "one.fna").write_text(">c1 first\nACGT\nAC\n>c2\r\nGG\r\nTT\r\n")
    with gzip.open(tmp_path / "two.v1.fa.gz", "wt") as f:
        f.write(">x\nAAAA\n>empty\n")
    rows = fasta.read_fasta(spark, [str(tmp_path / "one.fna"), str(tmp_path / "two.v1.fa.gz")])
    assert sorted((r.genome_id, r.contig_no, r.contig, r.header, r.seq) for r in rows.collect()) == [
        ("one", 0, "c1", "c1 first", "ACGTAC"), ("one", 1, "c2", "c2", "GGTT"), ("two.v1", 0, "x", "x", "AAAA"), ("two.v1", 1, "empty", "empty", "")]
    assert {r.genome_id: r.seq for r in fasta.collapse(rows).collect()} == {"one": "ACGTACNGGTT", "two.v1": "AAAAN"}
    named = fasta.with_taxids(rows, spark.createDataFrame([("one", 7)], "genome_id string, taxid long"))
    assert {r.header for r in named.collect()} == {"c1|kraken:taxid|7 c1", "c2|kraken:taxid|7 c2"}
    fasta.write_fasta(rows.where("genome_id = 'one'"), str(tmp_path / "out"), width=4)
    text = "".join(p.read_text() for p in (tmp_path / "out").rglob("*.txt"))
    assert ">c1 first\nACGT\nAC\n" in text


def test_lists(spark, tmp_path):
    (tmp_path / "refs.tsv").write_text("# path\ttaxonomy\n/a/x.fna\tk__A\n\n/a/y.fa\tk__B\n/a/x.fna\tk__C\n")
    assert {(r.path, r.taxonomy, r.genome_id) for r in tables.read_references(spark, str(tmp_path / "refs.tsv")).collect()} == {("/a/x.fna", "k__C", "x"), ("/a/y.fa", "k__B", "y")}
    (tmp_path / "list.txt").write_text("# mags\n/m/a.fna\n\n/m/a.fna\n/m/b.txt\n")
    path = str(tmp_path / "list.txt")
    assert tables.read_paths(spark, path).count() == 3 and tables.read_paths(spark, path, distinct=True).count() == 2
    assert {r.genome_id: r.supported for r in tables.read_paths(spark, path).collect()} == {"a": True, "b": False}


def test_report_round_trip_keeps_older_ones(spark, tmp_path):
    rows = spark.createDataFrame([("MSBT2", "kingdom", 0.5, ["a", "b"], True, None), ("MSBT1", "species", 0.25, [], False, 0.05)],
                                 "cluster_id string, level string, density double, references_list array<string>, known boolean, max_ani double")
    path = str(tmp_path / "clusters.tsv")
    for _ in range(3):
        tables.write_report(rows, path, date(2024, 5, 6))
    assert (tmp_path / "clusters.tsv.1").exists() and (tmp_path / "clusters.tsv.2").exists()
    lines = open(path).read().splitlines()
    assert lines[0] == "# 20240506" and lines[2].startswith("MSBT1")
    got = {r.cluster_id: (r.density, list(r.references_list), r.known, r.max_ani) for r in tables.read_report(spark, path).collect()}
    assert got == {"MSBT2": (0.5, ["a", "b"], True, None), "MSBT1": (0.25, [], False, 0.05)}


def test_metadata(spark, tmp_path):
    values = {"clusters_count": 3, "filter_size": 100, "kmer_size": 9, "min_kmer_occurrence": 1, "flat": True}
    (tmp_path / "m.json").write_text(json.dumps(values))
    assert tables.read_metadata(spark, str(tmp_path / "m.json")).first().asDict() == values
    (tmp_path / "bad.json").write_text(json.dumps({"kmer_size": 9}))
    with pytest.raises(ValueError, match="filter_size"):
        tables.read_metadata(spark, str(tmp_path / "bad.json"))


def test_dumps(spark, tmp_path):
    (tmp_path / "names.dmp").write_text("1\t|\troot\t|\t\t|\tscientific name\t|\n2\t|\tBact (x)\t|\t\t|\tsynonym\t|\n3\t|\tBact (x)\t|\t\t|\tscientific name\t|\n4\t|\tz\t|\t\t|\tauthority\t|\n")
    assert {(r.taxid, r.name) for r in tables.read_names(spark, str(tmp_path / "names.dmp")).collect()} == {(1, "root"), (3, "Bact_x")}
    (tmp_path / "nodes.dmp").write_text("1\t|\t1\t|\tno rank\t|\n2\t|\t1\t|\tspecies\t|\n")
    assert {tuple(r) for r in tables.read_nodes(spark, str(tmp_path / "nodes.dmp")).collect()} == {(1, 1, "no rank"), (2, 1, "species")}
    (tmp_path / "summary.txt").write_text("#   See readme\n#assembly_accession\tftp_path\nGCA_1\thttps://x/GCA_1\n")
    assert tables.read_assembly_summary(spark, str(tmp_path / "summary.txt")).first().asDict() == {"assembly_accession": "GCA_1", "ftp_path": "https://x/GCA_1"}
    (tmp_path / "lineages.csv").write_text("tax_id,superkingdom,phylum,class,order,family,genus,species,kingdom\n5,Viruses,P-1,,O,F,G,S 1,K\n6,Bacteria,P,C,O,F,G,S,K\n")
    assert [tuple(r) for r in tables.read_lineages(spark, str(tmp_path / "lineages.csv"), "Viruses").collect()] == [
        (5, "k__Viruses|p__P_1|c__P_1_unclassified|o__O|f__F|g__G|s__S_1")]


def test_append_and_snapshots(spark, tmp_path):
    path = str(tmp_path / "etl")
    tables.append_table(spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string"), path)
    tables.append_table(spark.createDataFrame([(2, "c"), (3, "d")], "id long, v string"), path)
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "a"), (2, "b"), (3, "d")]
    db = str(tmp_path / "db")
    genomes, bits = spark.createDataFrame([(1,), (2,)], "genome_id long"), spark.createDataFrame([(1, 5), (2, 6)], "genome_id long, bit long")
    tables.write_snapshot({"genomes": genomes, "bits": bits}, db, 0)
    tables.write_snapshot({"genomes": genomes, "bits": bits.where("genome_id = 1")}, db, 1)
    assert tables.read_snapshot(spark, db, ["genomes", "bits"], 0)["bits"].count() == 2
    with pytest.raises(FileNotFoundError, match="no sketch of genome 2"):
        tables.read_snapshot(spark, db, ["genomes", "bits"])
    archive, digest = tables.pack_snapshot(db, "DB", str(tmp_path), date(2024, 1, 2))
    again, _ = tables.pack_snapshot(db, "DB", str(tmp_path), date(2024, 1, 2))
    assert archive.endswith("DB-20240102.tar.gz") and again.endswith("DB-20240102-1.tar.gz") and len(digest) == 64
    opened = tables.unpack_snapshot(archive, str(tmp_path), "renamed")
    assert tables.read_snapshot(spark, opened, ["genomes", "bits"], 0)["genomes"].count() == 2
    with pytest.raises(FileExistsError):
        tables.unpack_snapshot(archive, str(tmp_path), "renamed")


def test_stream_updates_the_database(spark, tmp_path):
    r = random.Random(3)
    base = "".join(r.choice("ACGT") for _ in range(400))
    label = "k__A|p__B|c__C|o__D|f__E|g__F|s__G"
    rows = spark.createDataFrame([(f"g{i}", base[:390 + i], True, label) for i in range(3)], "genome_id string, seq string, is_reference boolean, taxonomy string")
    made = lifecycle.index(rows, None, Scratch(spark), 11, 1)
    db, inbox = str(tmp_path / "db"), tmp_path / "inbox"
    tables.write_snapshot({n: made[n] for n in ingest.TABLES}, db, 0)
    inbox.mkdir()
    (inbox / "new.fna").write_text(f">c\n{base[:200]}\n{base[200:395]}\n")
    query = ingest.maintain(ingest.genome_stream(spark, str(inbox)), db, str(tmp_path / "cp"), 11, 1)
    assert query.awaitTermination(120) and query.exception() is None
    found = tables.read_snapshot(spark, db, ["genomes"])["genomes"]
    assert found.where(F.col("genome_id") == "new").first().taxonomy == label and found.count() == 4
