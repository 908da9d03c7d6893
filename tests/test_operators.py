"""Small cases of operators that SQL does not cover, and edge cases."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladeframe.operators import etl, linkage, maintain, medoid, pairwise, sketch, tree
from cladeframe.plans import lifecycle
from cladeframe.sources import tables
from cladeframe.storage import Scratch

A = "k__A|p__B|c__C|o__D|f__E|g__F|s__"


def genomes(spark, rows):
    return spark.createDataFrame(rows, "genome_id long, seq string, is_reference boolean, taxonomy string")


def test_kmers_of_long_short_and_null_sequences(spark):
    r = random.Random(1)
    seqs = {1: "".join(r.choice("ACGTN") for _ in range(3 * sketch.CHUNK + 7)), 2: "ACG", 3: "", 4: None, 5: "ACGT", 6: "x" * sketch.CHUNK}
    rows = spark.createDataFrame(list(seqs.items()), "genome_id long, seq string")
    for options in ({}, {"alphabet": "ACGT"}, {"alphabet": "ACGT", "canonical": True}):
        expected = []
        for i, s in seqs.items():
            for k in range(len(s or "") - 3):
                w = s[k:k + 4]
                if options and set(w) - set("ACGT"):
                    continue
                expected.append((i, min(w, w.translate(str.maketrans("ACGT", "TGCA"))[::-1]) if "canonical" in options else w))
        got = [tuple(x) for x in sketch.kmers(rows, 4, **options).collect()]
        assert sorted(got) == sorted(expected)


def test_filter_size_without_kmers(spark):
    none = sketch.kmers(spark.createDataFrame([(1, "A")], "genome_id long, seq string"), 4)
    assert sketch.filter_size(sketch.histogram(none)).first().filter_size == 0


def test_pairwise_of_equal_and_disjoint_sets(spark):
    bits = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 2), (3, 9)], "genome_id long, bit long")
    assert [(r.a, r.b, r.inter, r.uni, r.ani) for r in pairwise.pairwise(bits, 9).collect()] == [(1, 2, 2, 2, 0.0)]
    groups = spark.createDataFrame([(1, "g"), (2, "g"), (3, "g")], "genome_id long, g string")
    dense = {(r.a, r.b): r.ani for r in pairwise.dense(pairwise.pairwise(bits, 9), groups, "g").collect()}
    assert dense == {(1, 2): 0.0, (1, 3): 1.0, (2, 3): 1.0}


def test_paths_are_taken_from_parents(spark):
    """Same rows as following each node upwards, with repeated nodes, a loop, a missing parent and too many levels; all nodes are joined once."""
    rows = [("r", None), ("a", "r"), ("b", "r"), ("b", "gone"), ("c", "b"), ("x", "y"), ("y", "x"), (None, "a"), ("d", None)] + [(f"n{i}", f"n{i + 1}") for i in range(9)]
    up: dict = {}
    for n, p in rows:
        up.setdefault(n, []).append(p)

    def path(n, p, left):
        if left == 0 or p is None or p not in up:
            return [n or ""]
        return [f"{above}|{n}" if n else "" for q in up[p] for above in path(p, q, left - 1)]

    found = tree.full_path(spark.createDataFrame(rows, "node string, parent string"), steps=4)
    assert sorted((x.node or "", x.path or "") for x in found.collect()) == sorted((n or "", one) for n, p in rows for one in path(n, p, 4))
    plan, joins = found._jdf.queryExecution().optimizedPlan(), 0
    while plan.children().size():
        joins += plan.nodeName() == "Join"
        plan = plan.children().head()
    assert joins == 1


def test_bands_end_where_their_sql_ends(spark, duck):
    """Half of a score with an odd last digit is a tie of decimals, but not of the binary numbers that SQL rounds."""
    from cladeframe.operators.descent import band

    duck.execute("""CREATE OR REPLACE TEMP TABLE s AS SELECT q, t, round(c / n, 8) AS score FROM (
      SELECT n * 10000 + c AS q, t, n, CASE WHEN t = 0 THEN 2 * c ELSE c END AS c FROM range(40, 400) x(n), range(1, 40, 3) y(c), range(0, 2) z(t) WHERE 2 * c < n)""")
    want = duck.execute("SELECT q, t FROM (SELECT *, max(score) OVER (PARTITION BY q) AS best FROM s) WHERE score >= round(best * 0.5::DOUBLE, 8)").fetchall()
    scores = spark.createDataFrame(duck.execute("SELECT * FROM s").fetchall(), "q long, t long, score double")
    assert sorted(tuple(x) for x in band(scores, 50.0, ["q"]).select("q", "t").collect()) == sorted(want)


def test_medoid_rules(spark):
    rows = [("a", 1, 2, 0.1), ("a", 1, 3, 0.2), ("a", 2, 3, 0.4), ("b", 4, 5, 0.3), ("c", 7, 8, 1.0), ("c", 7, 9, 1.0), ("c", 8, 9, 1.0)]
    matrix = spark.createDataFrame(rows, "g string, a long, b long, ani double")
    groups = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 4), ("b", 5), ("c", 7), ("c", 8), ("c", 9), ("d", 6)], "g string, genome_id long")
    got = {r.g: (r.centroid, r.min_ani, r.max_ani) for r in medoid.medoids(matrix, groups, "g").collect()}
    assert got == {"a": (1, 0.1, 0.2), "b": (4, None, None), "c": (7, None, None), "d": (6, None, None)}
    top = {r.g: r.max_ani for r in medoid.medoids(matrix, groups, "g", is_kingdom=True).collect()}
    assert top["c"] == 1.0


def test_average_linkage_against_recomputed_means():
    r = np.random.default_rng(2)
    x = r.random((9, 2))
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    merges = linkage.average_linkage(d)
    held = {i: [i] for i in range(9)}
    for step, (a, b, height, size) in enumerate(merges):
        mean = lambda p, q: d[np.ix_(held[p], held[q])].mean()
        assert height == pytest.approx(min(mean(p, q) for p, q in itertools.combinations(held, 2)))
        held[9 + step] = held.pop(int(a)) + held.pop(int(b))
        assert size == len(held[9 + step])
    assert (np.diff(merges[:, 2]) >= -1e-12).all()
    assert len(set(linkage.cut(merges, 9, -1))) == 9 and set(linkage.cut(merges, 9, 9)) == {0}
    assert linkage.average_linkage(np.zeros((1, 1))).shape == (0, 4) and list(linkage.cut(np.empty((0, 4)), 1, 1)) == [0]


def test_greedy_dereplication(spark):
    r = random.Random(4)
    pairs = {tuple(sorted((r.randrange(60), r.randrange(60)))) for _ in range(80)} | {(k, k + 1) for k in range(100, 130)}
    pairs = [p for p in pairs if p[0] != p[1]]
    kept = []
    for g in range(140):
        if not any((k, g) in pairs for k in kept):
            kept.append(g)
    found = linkage.dereplicate(spark.range(140).withColumnRenamed("id", "genome_id"), spark.createDataFrame(pairs, "a long, b long"), Scratch(spark).save)
    assert sorted(x.genome_id for x in found.collect()) == kept


def test_removal_cascades_and_additions_keep_ids(spark):
    rows = genomes(spark, [(1, "x", True, A + "G1"), (2, "x", True, A + "G2"), (3, "x", False, A.replace("g__F", "g__H") + "G3")])
    left, emptied = maintain.remove(rows, spark.createDataFrame([(3,), (99,)], "genome_id long"))
    assert left.count() == 2 and sorted(r.level for r in emptied.collect()) == ["genus", "species"]
    clusters = maintain.allocate_ids(tree.nodes(left), ["depth", "node"]).select("cluster_id", F.col("node").alias("name"), "level", "parent")
    more = rows.union(genomes(spark, [(4, "x", False, A + "MSBT40")]))
    added = {r.name: r.cluster_id for r in maintain.add(more, clusters).collect()}
    assert added[A + "MSBT40"] == "MSBT40" and len(added) == len(set(added.values())) == 11
    assert {added[n] for n in added if "g__H" in n} == {"MSBT41", "MSBT42"}
    named = spark.createDataFrame([("a", "MSBT10"), ("a", "MSBT9"), ("b", "MSBT2")], "g string, cluster_id string")
    assert {r.g: r.cluster_id for r in maintain.oldest(named, "g").collect()} == {"a": "MSBT9", "b": "MSBT2"}


def test_names_without_an_id_fail(spark):
    names = spark.createDataFrame([("a",), ("b",)], "name string")
    known = spark.createDataFrame([("a", 1)], "name string, taxid long")
    with pytest.raises(Exception, match="no taxid for b"):
        etl.resolve_names(names, known, known).collect()


def test_checkv_average(spark):
    rows = spark.createDataFrame([(1, "90", "1"), (1, "NA", "3"), (2, "NA", "NA")], "genome_id long, completeness string, contamination string")
    assert sorted(map(tuple, etl.checkv_average(rows).collect())) == [(1, 90.0, 2.0), (2, 0.0, 0.0)]


def mutated(r, seq, share):
    return "".join(r.choice("ACGT") if r.random() < share else c for c in seq)


def test_index_and_update(spark):
    """Two species; new genomes: a replica, a member, a stranger, and one that is there already."""
    r = random.Random(9)
    base = ["".join(r.choice("ACGT") for _ in range(600)) for _ in range(3)]
    rows = [(i, mutated(r, base[0], 0.005), True, A + "G1") for i in range(4)] + [(10 + i, mutated(r, base[1], 0.005), True, A.replace("g__F", "g__H") + "G2") for i in range(4)]
    scratch = Scratch(spark)
    quality = spark.createDataFrame([(i, 99.0, 0.0) for i, *_ in rows[1:]] + [(0, 10.0, 0.0)], "genome_id long, completeness double, contamination double")
    made = lifecycle.index(genomes(spark, rows), quality, scratch, 11, 1, completeness=50.0, contamination=5.0)
    assert made["genomes"].count() == 7 and made["clusters"].count() == 9 and made["report"].where("level = 'kingdom'").first().references_count == 7
    mixed = base[0][:300] + base[2][:300]
    new = spark.createDataFrame([(1, rows[1][1]), (20, rows[1][1]), (21, mutated(r, base[0], 0.01)), (22, mixed)], "genome_id long, seq string")
    after = lifecycle.update(made, new, scratch, 11, 1, dereplicate=0.001)
    labels = {x.genome_id: x.taxonomy for x in after["genomes"].collect()}
    assert set(labels) == {1, 2, 3, 10, 11, 12, 13, 21, 22}
    assert labels[21] == A + "G1" and labels[22] == A + "new22"
    assert after["clusters"].where(F.col("name") == A + "new22").first().cluster_id == "MSBT10"
    assert after["medoids"].count() == 3


def test_update_keeps_genomes_without_a_profile(spark, tmp_path):
    """A stranger without a common k-mer, one shorter than k, an empty and a null one stay, and harm no later update."""
    r = random.Random(12)
    base = ["".join(r.choice("ACGT") for _ in range(600)) for _ in range(2)]
    scratch = Scratch(spark)
    made = lifecycle.index(genomes(spark, [(i, mutated(r, base[0], 0.005), True, A + "G1") for i in range(4)]), None, scratch, 11, 1)
    new = spark.createDataFrame([(20, base[1].lower()), (21, "ACGT"), (22, ""), (23, None), (24, mutated(r, base[0], 0.005))], "genome_id long, seq string")
    after = lifecycle.update(made, new, scratch, 11, 1, dereplicate=0.001)
    assert {x.genome_id: x.taxonomy for x in after["genomes"].collect()} == {i: A + "G1" for i in (0, 1, 2, 3, 24)} | dict.fromkeys((20, 21, 22, 23))
    assert after["bits"].where("genome_id = 20").count() == 590 and after["medoids"].count() == 1 and after["clusters"].count() == 7
    names = ["genomes", "bits", "clusters", "medoids", "metadata"]
    tables.write_snapshot({n: after[n] for n in names}, str(tmp_path), 1)
    again = spark.createDataFrame([(30, base[1].lower()), (31, base[0])], "genome_id long, seq string")
    later = lifecycle.update(tables.read_snapshot(spark, str(tmp_path), names), again, scratch, 11, 1)
    labels = {x.genome_id: x.taxonomy for x in later["genomes"].collect()}
    assert len(labels) == 11 and labels[30] is None and labels[31] == A + "G1"


def test_unknowns_are_cut_at_the_boundary_of_each_level(spark):
    """1 fits the family and takes along 2 and 3, but not 4; 5 fits the phylum; 6 has no pair."""
    F5, P2 = "k__A|p__B|c__C|o__D|f__E", "k__A|p__B"
    unknown = spark.createDataFrame([(i,) for i in range(1, 7)], "genome_id long")
    profiles = spark.createDataFrame([(1, "family", F5, 0.2), (5, "phylum", P2, 0.3), (4, "family", F5, 0.9)], "genome_id long, level string, node string, ani double")
    bounds = spark.createDataFrame([(F5, 0.25), (P2, 0.4), (F5 + "|g__F", 0.1), (P2 + "|c__C", 0.35)], "node string, max_ani double")
    rows = genomes(spark, [(100, "x", True, A + "G1")])
    pairs = spark.createDataFrame([(1, 2, 0.04), (1, 3, 0.2), (2, 3, 0.2), (1, 4, 0.8), (2, 4, 0.8), (3, 4, 0.8), (4, 5, 0.5)], "a long, b long, ani double")
    scratch = Scratch(spark)
    children = medoid.child_boundaries(rows, bounds)
    assert {r.node: r.below for r in children.collect()}[P2] == [0.35, None, 0.25, 0.1]
    got = {r.genome_id: (r.level, r.node, r.taxonomy) for r in maintain.characterize(unknown, profiles, profiles, bounds, children, pairs, scratch.save).collect()}
    first = ("family", F5, F5 + "|g__new1|s__new1")
    assert got[1] == got[2] == first and got[3] == ("family", F5, F5 + "|g__new3|s__new3")
    assert got[5] == ("phylum", P2, P2 + "|c__new5|o__new5|f__new5|g__new5|s__new5")
    assert got[4] == got[6] == (None, None, None)


def test_genomes_of_one_genus_and_two_species():
    d = np.array([[0, 0.2, 0.09], [0.2, 0, 0.2], [0.09, 0.2, 0]])
    fits = [[(5, "f", 0.3, [0.1])], [], []]
    assert linkage.place(d, fits, [1, 2, 3]) == [("f", "f|g__new1|s__new1"), ("f", "f|g__new2|s__new2"), ("f", "f|g__new1|s__new3")]
    assert linkage.place(d, [[(5, "f", 0.1, [None])], [], []], ["a", "b", "c"]) == [("f", "f|g__newa|s__newa"), None, ("f", "f|g__newc|s__newc")]


def test_update_tests_the_boundaries(spark):
    """A genus of three species: an unknown within its boundary joins it, one that shares little stays in the pool."""
    r = random.Random(5)
    base = "".join(r.choice("ACGT") for _ in range(900))
    far = "".join(r.choice("ACGT") for _ in range(900))
    rows = [(i, mutated(r, base, 0.1), True, A + f"G{i}") for i in range(3)]
    scratch = Scratch(spark)
    made = lifecycle.index(genomes(spark, rows), None, scratch, 11, 1)
    new = spark.createDataFrame([(20, mutated(r, base, 0.1)), (21, base[:30] + far)], "genome_id long, seq string")
    after = lifecycle.update(made, new, scratch, 11, 1)
    labels = {x.genome_id: x.taxonomy for x in after["genomes"].collect()}
    assert len(labels) == 5 and labels[21] is None
    assert labels[20] == A + "new20"


def plain_clusters(ids, near, threshold):
    """Average linkage over all pairs, means recomputed at every step; clusters by their least member."""
    held, far = [[i] for i in sorted(ids)], lambda a, b: near.get((min(a, b), max(a, b)), 1.0)
    mean = lambda p, q: sum(far(a, b) for a in p for b in q) / len(p) / len(q)
    while len(held) > 1:
        height, i, j = min((mean(held[i], held[j]), i, j) for i, j in itertools.combinations(range(len(held)), 2))
        if height > threshold:
            break
        held[i] = held[i] + held.pop(j)
    return {g: min(c) for c in held for g in c}


def test_clusters_of_string_ids_and_of_the_query(spark):
    r = random.Random(7)
    ids = [f"GCA_{i:03d}" for i in range(40)]
    near = {(a, b): round(0.02 + r.random() * 0.3, 5) for a, b in itertools.combinations(ids, 2) if r.random() < 0.5 or ids.index(a) // 5 == ids.index(b) // 5}
    matrix = spark.createDataFrame([("g", a, b, d) for (a, b), d in near.items()] + [("g", "GCA_000", "other", 0.0)], "genus string, a string, b string, ani double")
    groups = spark.createDataFrame([(i, "g") for i in ids] + [("lone", "h")], "genome_id string, genus string")
    for threshold in (0.05, 0.2, 1.0):
        got = {x.genome_id: x.cluster for x in linkage.cluster(matrix, groups, "genus", threshold, Scratch(spark).save).collect()}
        assert got == plain_clusters(ids, near, threshold) | {"lone": "lone"}


def test_average_linkage_query_against_plain_clusters(spark):
    from cladeframe.plans import profiles
    from cladeframe.plans.derived import K, bits
    from cladeframe.plans.derived import genomes as table
    from tests.conftest import SMALL
    rows = table(spark, SMALL).where("not is_reference")
    near = {(x.a, x.b): x.ani for x in pairwise.pairwise(bits(rows), K).collect()}
    genus = {x.genome_id: x.taxonomy.rsplit("|", 1)[0] for x in rows.collect()}
    want = {}
    for g in set(genus.values()):
        want |= plain_clusters([i for i in genus if genus[i] == g], near, 0.05)
    got = {x.genome_id: x.cluster for x in profiles.average_linkage_cut(spark, SMALL).collect()}
    assert got == want and len(got) == 40


@pytest.mark.parametrize("holders", [512, 3])
def test_close_pairs_against_all_pairs(spark, monkeypatch, holders):
    monkeypatch.setattr(pairwise, "HOLDERS", holders)
    r = random.Random(2)
    sets = {}
    for c in range(12):
        base = [r.randrange(400) for _ in range(r.choice([1, 5, 60]))]
        for m in range(6):
            sets[f"g{c}_{m}"] = set(base) if m < 2 else set(r.sample(base, max(1, int(len(base) * r.uniform(0.7, 1))))) | {r.randrange(400) for _ in range(r.randrange(6))}
    bits = spark.createDataFrame([(g, b) for g, s in sets.items() for b in s], "genome_id string, bit long")
    for threshold in (0.0, 0.01, 0.05, 0.3):
        want = {(x.a, x.b): x.ani for x in pairwise.pairwise(bits, 11).collect() if x.ani <= threshold}
        got = {(x.a, x.b): x.ani for x in pairwise.close_pairs(bits, 11, threshold, Scratch(spark).save).collect()}
        assert got == want and len(want) >= 12


def test_update_with_string_names_and_two_contigs(spark):
    """Contigs are joined by N; with an alphabet no k-mer spans them, and one that fits nowhere stays in the pool."""
    r = random.Random(21)
    base, far = ("".join(r.choice("ACGT") for _ in range(800)) for _ in range(2))
    rows = [(f"GCF_{i}", mutated(r, base[:400], 0.004) + "N" + mutated(r, base[400:], 0.004), True, A + "G1") for i in range(4)]
    scratch, options = Scratch(spark), {"alphabet": "ACGT", "canonical": True}
    made = lifecycle.index(spark.createDataFrame(rows, "genome_id string, seq string, is_reference boolean, taxonomy string"), None, scratch, 11, 1, **options)
    assert made["bits"].where("genome_id = 'GCF_0'").count() <= 2 * 390
    swapped = base[400:].translate(str.maketrans("ACGT", "TGCA"))[::-1] + "N" + base[:400]
    new = spark.createDataFrame([("GCA_9", swapped), ("GCA_10", far), ("GCA_11", base[:200] + "N" + far)], "genome_id string, seq string")
    labels = {x.genome_id: x.taxonomy for x in lifecycle.update(made, new, scratch, 11, 1, **options)["genomes"].collect()}
    assert len(labels) == 7 and labels["GCA_9"] == A + "G1" and labels["GCA_10"] is None
