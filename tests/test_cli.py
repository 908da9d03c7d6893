"""The verbs from files to files."""

import random

from cladeframe import cli
from cladeframe.sources import tables


def test_defaults():
    a = cli.parser().parse_args(["index", "--workdir", "w", "--database", "d", "--references", "r"])
    assert (a.dereplicate, a.increase_filter_size, a.min_kmer_occurrences, a.limit_kmer_size, a.completeness, a.contamination) == (0.0, 50.0, 2, 32, 0.0, 100.0)
    assert a.kmer_size is None and a.filter_size is None
    b = cli.parser().parse_args(["profile", "--workdir", "w", "--genomes", "g", "--output", "o"])
    assert (b.uncertainty, b.pruning_threshold) == (20.0, 0.0)


def test_index_update_profile_remove(spark, tmp_path):
    r = random.Random(3)
    label = "k__A|p__B|c__C|o__D|f__E|g__F|s__"
    mutated = lambda s: "".join(r.choice("acgt") if r.random() < 0.004 else c for c in s)
    base = ["".join(r.choice("acgt") for _ in range(500)) for _ in range(2)]
    lines, news = [], []
    for i in range(6):
        f = tmp_path / f"GCF_{i}.fna"
        f.write_text(f">c1\n{mutated(base[i % 2])[:250]}\n>c2\n{mutated(base[i % 2])[250:]}\n")
        lines.append(f"{f}\t{label}S{i % 2}")
    for name, seq in (("new1", mutated(base[0])), ("new2", "".join(r.choice("ACGT") for _ in range(500)))):
        (tmp_path / f"{name}.fa").write_text(f">x\n{seq}\n")
        news.append(str(tmp_path / f"{name}.fa"))
    (tmp_path / "refs.tsv").write_text("# path\ttaxonomy\n" + "\n".join(lines) + "\n")
    (tmp_path / "news.txt").write_text("\n".join(news) + "\n")
    (tmp_path / "gone.txt").write_text("".join(f"{tmp_path}/GCF_{i}.fna\n" for i in (1, 3, 5)))
    where = ["--workdir", str(tmp_path), "--database", "db"]
    cli.run(spark, ["index", *where, "--references", str(tmp_path / "refs.tsv"), "--kmer-size", "11", "--min-kmer-occurrences", "1", "--alphabet", "ACGT"])
    found = cli.run(spark, ["profile", *where, "--genomes", str(tmp_path / "news.txt"), "--output", str(tmp_path / "profiles"), "--alphabet", "ACGT"])
    best = {(x.query, x.level): x.closest for x in found.collect()}
    assert best["new1", "species"] == label + "S0"
    cli.run(spark, ["update", *where, "--genomes", str(tmp_path / "news.txt"), "--alphabet", "ACGT"])
    held = tables.read_snapshot(spark, str(tmp_path / "db"), ["genomes"])["genomes"]
    assert {x.genome_id: x.taxonomy for x in held.collect() if x.genome_id.startswith("new")} == {"new1": label + "S0", "new2": None}
    cli.run(spark, ["remove", *where, "--genomes", str(tmp_path / "gone.txt")])
    after = tables.read_snapshot(spark, str(tmp_path / "db"), cli.TABLES)
    assert after["genomes"].count() == 5 and [x.node for x in after["medoids"].collect()] == [label + "S0"]
    assert after["clusters"].where("name like '%S1'").count() == 0
    assert {x.level: x.clusters for x in cli.run(spark, ["summarize", *where]).collect()}["species"] == 1
