"""Numpy k-mers against strings and Spark's own functions."""

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cladeframe.operators import maintain, sketch, windows
from cladeframe.plans import sketches
from tests.conftest import SMALL

TEXTS = ["hello wörld hello wörld", "", "日本語テキスト日本語テキスト😀😀😀😀😀😀😀😀😀😀", None, "abc", "a" * 45 + "é", "x😀" * 20, "Straße, " * 9]


@pytest.mark.parametrize("k", [2, 5, 9, 21])
def test_numbers_and_digests_of_windows(spark, k):
    texts = windows.Texts(pa.array(TEXTS))
    kmers = [x[i:i + k] for x in TEXTS if x for i in range(max(len(x) - k + 1, 0))]
    keys, n = windows.local_keys(texts, k)
    assert n.tolist() == [max(len(x or "") - k + 1, 0) for x in TEXTS]
    assert len(set(zip(kmers, keys.tolist()))) == len(set(kmers)) == len(set(keys.tolist()))
    want = [int(hashlib.md5(x.encode()).hexdigest()[:15], 16) for x in kmers]
    assert windows.md5_head(texts, texts.windows(k)[0], k).tolist() == want
    bits = windows.PortableBits(k, 1_000_003, 4)
    for _ in range(2):  # the second time from those kept
        assert bits(texts)[0].tolist() == [x % 1_000_003 for x in want]
    hashed = spark.createDataFrame([(i, x) for i, x in enumerate(kmers)], "i int, x string").orderBy("i").select(F.xxhash64("x").alias("h")).toPandas()["h"]
    assert np.array_equal(windows.xxhash(texts, k)[0], hashed)


def test_a_genome_in_several_rows(spark):
    rows = spark.createDataFrame([(1, "abcab"), (1, "abc"), (None, "zzzz"), (2, None), (3, "ab")], "genome_id long, seq string")
    assert sorted(map(tuple, sketch.genome_counts(rows, 3).collect()), key=str) == [(1, 3, 4), (None, 1, 2)]
    assert sorted(map(tuple, sketch.genome_counts(rows, 3, 2).collect()), key=str) == [(1, 1, 2), (None, 1, 2)]


@pytest.mark.parametrize("k", [3, 9])
def test_counts_of_all_texts_in_many_parts(spark, k):
    texts = pa.array([*TEXTS, *TEXTS[:3], "hello hello \0 \x7f hello hello"])
    want = Counter(x[i:i + k] for x in texts.to_pylist() if x for i in range(max(len(x) - k + 1, 0)))
    batches = [pa.RecordBatch.from_arrays([texts.slice(i, 3)], names=["seq"]) for i in range(0, len(texts), 3)]
    for most in (20, 1 << 20):
        rows = sorted((r for b in windows.bucketed_counts(iter(batches), k, most) for r in b.to_pylist()), key=lambda r: r["bucket"])
        got = Counter()
        for part in windows.bucket_histograms(iter([pa.RecordBatch.from_pylist(rows)])):
            got.update(dict(zip(*(c.to_pylist() for c in part.columns))))
        assert got == Counter(want.values())


def test_unions_in_more_groups_than_a_task_holds(spark):
    rows = [(i, f"text number {i % 7} of group {i % 5}, äöü") for i in range(40)] + [(7, "a second row"), (99, "in no group")]
    groups = [(i, i % 5) for i in range(40)] + [(7, 3)]
    held = windows.Unions(9, 100_000, most=2)
    got: dict = {}
    for full in [*held.add(pa.array([t for i, t in rows[:40]]), [i % 5 for i in range(40)]), held.flush()]:
        for name, bucket, bits in full:
            seen = np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")) + (bucket - 1) * 32768
            got.setdefault(name, set()).update(seen.tolist())
    bits = sketch.sketch(spark.createDataFrame(rows[:40], "genome_id long, seq string"), 9, filter_size=100_000, portable=True)
    want: dict = {}
    for r in bits.collect():
        want.setdefault(r.genome_id % 5, set()).add(r.bit)
    assert got == want
    both = spark.createDataFrame(rows, "genome_id long, seq string"), spark.createDataFrame(groups, "genome_id long, g long")
    plain = sketch.sizes(sketch.union_by(sketch.sketch(both[0], 9, filter_size=100_000, portable=True), both[1], "g"))
    packed = sketch.packed_unions(*both, "g", 9, 100_000).groupBy("g").agg(F.sum(F.bitmap_count("bits")).alias("n"))
    assert sorted(map(tuple, packed.collect())) == sorted(map(tuple, plain.collect()))


def test_large_buckets_are_counted_in_parts(monkeypatch):
    texts = pa.array([*TEXTS, *TEXTS[:2], "hello world " * 5, "".join(map(chr, range(200, 600))), "plain text of some length " * 3])
    labels = [f"k__A|p__B{i % 2}|c__C{i % 4}" for i in range(len(texts))]
    batches = [pa.RecordBatch.from_arrays([texts.slice(i, 2), pa.array(labels[i:i + 2])], names=["seq", "label"]) for i in range(0, len(texts), 2)]
    got = []
    for sorted_, hashed in ((4 << 20, 1 << 20), (50, 60)):
        monkeypatch.setattr(windows, "SORTED", sorted_)
        monkeypatch.setattr(windows, "HASHED", hashed)
        rows = sorted((r for b in windows.bucketed_prefixes(iter(batches), 5, 9, 3, 100) for r in b.to_pylist()), key=lambda r: r["bucket"])
        found = next(windows.prefix_counts(iter([pa.RecordBatch.from_pylist(rows)]), [5, 7, 9])).to_pylist()
        rows = sorted((r for b in windows.bucketed_runs(iter(batches), 9, 3, 100) for r in b.to_pylist()), key=lambda r: r["bucket"])
        sizes = next(windows.node_sizes(iter([pa.RecordBatch.from_pylist(rows)]), 9)).to_pylist()
        got.append((found, sorted((r["node"], r["n"]) for r in sizes)))
    kmers = {k: {x[i:i + k] for x in texts.to_pylist() if x for i in range(len(x) - k + 1)} for k in (5, 7, 9)}
    assert got[0] == got[1] and [(r["k"], r["n"]) for r in got[0][0]] == [(k, len(x)) for k, x in kmers.items()]
    assert dict(got[0][1])["k__A"] == len(kmers[9])


def test_report_from_texts_with_repeated_ids(spark):
    rows = [(i, (t or "") + " " + "the same passage in all of them", i % 3 > 0, f"k__A|p__B{i % 2}|c__C|o__D|f__E|g__F|s__S{i % 4}") for i, t in enumerate([*TEXTS, *TEXTS])]
    rows += [(3, "another row of the third", True, "k__A|p__B0|c__C|o__D|f__E|g__F|s__S9"), (50, "no label " * 9, True, None)]
    df = spark.createDataFrame(rows, "genome_id long, seq string, is_reference boolean, taxonomy string")
    got = maintain.text_report(df, 21, 10_000)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, maintain.report(df, sketch.sketch(df, 21), 10_000).collect()))
    plan = sketch.label_sizes(df, df.select("genome_id", "taxonomy"), "taxonomy", 21)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan


def test_distinct_kmers_of_several_lengths(spark):
    strange = "".join(map(chr, range(200, 700)))
    for texts in ([*TEXTS, TEXTS[0] + TEXTS[-1], "the end is short", "the end is shorter by far"], [strange, strange[100:300], *TEXTS], ["a"], [None]):
        df = spark.createDataFrame([(x,) for x in texts], "seq string")
        df = df.selectExpr("monotonically_increasing_id() AS genome_id", "seq")
        lengths = [5, 9, 13, 17, 21]
        want = []
        for k in lengths:
            all_ = [x[i:i + k] for x in texts if x for i in range(len(x) - k + 1)]
            want.append((k, len(all_), len(set(all_))))
        assert sorted((r.k, r.total, r.n_distinct) for r in sketch.length_curve(df, lengths).collect()) == want


@pytest.mark.parametrize("name", ["kmer_distinct_count", "kmer_min_occurrence", "sketch_bits", "sketch_density", "kmer_histogram", "filter_size_estimate",
                                  "parent_union_sketch", "packed_union_sketch"])
def test_counts_of_a_genome_make_no_row_for_a_kmer(spark, name):
    plan = sketches.QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "explode" not in plan


@pytest.mark.parametrize("size", [None, 50])
def test_sketches_without_a_shuffle_of_kmers(spark, size):
    rows = spark.createDataFrame([*enumerate(TEXTS), (4, "abcdef"), (7, TEXTS[0])], "genome_id long, seq string")
    want = sketch.kmers(rows, 5).select("genome_id", sketch.kmer_bit(F.col("kmer"), size).alias("bit")).distinct()
    got = sketch.sketch(rows, 5, filter_size=size)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert "keys=[genome_id, bit" not in (plan := got._jdf.queryExecution().executedPlan().toString()) and "transform" not in plan
