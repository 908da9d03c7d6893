"""K-mers, sketches (sets of hashed k-mers) and what is counted from them.

Sketches are kept in long form, one ``(genome_id, bit)`` row per set bit, so that
unions, intersections and densities are hash aggregates and equi-joins on
``bit``.  ``pack`` gives the compact form of bitmap buckets for storage.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeframe.operators import windows as numeric

#: Characters of one chunk; a chunk is cut from its text once, k-mers from the chunk.
CHUNK = 256


def kmers(df: DataFrame, k: int, id_col: str = "genome_id", seq_col: str = "seq", canonical: bool = False,
          alphabet: str | None = None) -> DataFrame:
    """``genome_id, kmer``: one row for every window of ``k`` characters.

    Sequences shorter than ``k`` and nulls have none.  ``canonical`` takes the lesser of a
    window and its reverse complement; ``alphabet`` drops windows with any other
    character (so none spans contigs joined by ``N``).
    """
    chunk = df.where(F.length(seq_col) >= k).select(
        F.col(id_col).alias("genome_id"), F.col(seq_col).alias("_seq"),
        F.explode(F.sequence(F.lit(1), F.length(seq_col) - F.lit(k - 1), F.lit(CHUNK))).alias("_at")).select(
        "genome_id", F.col("_seq").substr(F.col("_at"), F.lit(CHUNK + k - 1)).alias("_part"))
    windows = F.transform(F.sequence(F.lit(1), F.length("_part") - F.lit(k - 1)), lambda i: F.col("_part").substr(i, F.lit(k)))
    out = chunk.select("genome_id", F.explode(windows).alias("kmer"))
    if alphabet:
        out = out.where(F.translate("kmer", alphabet, "") == "")
    return out.withColumn("kmer", canonical_kmer(F.col("kmer"))) if canonical else out


def canonical_kmer(kmer: Column) -> Column:
    return F.least(kmer, F.reverse(F.translate(kmer, "ACGT", "TGCA")))


def kmer_bit(kmer: Column, filter_size: int | None = None) -> Column:
    """Place of a k-mer: a 64-bit hash, folded into ``filter_size`` bits if that is given."""
    h = F.xxhash64(kmer)
    return h if filter_size is None else F.pmod(h, F.lit(filter_size))


def portable_bit(kmer: Column, filter_size: int) -> Column:
    """Like :func:`kmer_bit` with a hash that other engines have as well."""
    return F.pmod(F.conv(F.substring(F.md5(kmer), 1, 15), 16, 10).cast("bigint"), F.lit(filter_size))


def _per_genome(df: DataFrame, schema: str, count: Callable[[numeric.Texts, np.ndarray], tuple[np.ndarray, dict]], k: int) -> DataFrame:
    """``genome_id`` and the columns of ``schema``, from all texts of a genome in one row of a task.

    ``count(texts, genome)`` gets the number of windows of each genome's texts and returns which genomes
    have a row, and their columns.  Only texts are shuffled, and no k-mer is.
    """
    kind = df.schema["genome_id"].dataType.simpleString()
    rows = df.where(F.length("seq") >= k).groupBy("genome_id").agg(F.collect_list("seq").alias("seqs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in numeric.pieces(batches):
            texts, ends = numeric.gathered(batch)
            found, columns = count(texts, ends)
            yield pa.RecordBatch.from_pydict({"genome_id": batch.column("genome_id").take(pa.array(found))} | columns)

    return rows.mapInArrow(run, f"genome_id {kind}, {schema}")


def _by_genome(n: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Windows of each genome from those of its texts."""
    return numeric.sums(n, ends)


def genome_counts(df: DataFrame, k: int, min_occurrence: int = 1) -> DataFrame:
    """``genome_id, distinct, occurrences`` of the k-mers that occur at least ``min_occurrence`` times in a genome; genomes without one have no row."""
    def count(texts: numeric.Texts, ends: np.ndarray) -> tuple[np.ndarray, dict]:
        keys, n = numeric.local_keys(texts, k)
        _, often, last = numeric.per_genome(keys, _by_genome(n, ends))
        kept = often >= min_occurrence
        distinct, total = numeric.sums(kept, last), numeric.sums(often * kept, last)
        found = np.flatnonzero(distinct)
        return found, {"distinct": distinct[found], "occurrences": total[found]}

    return _per_genome(df, "distinct long, occurrences long", count, k)


def portable_sizes(df: DataFrame, k: int, filter_size: int) -> DataFrame:
    """``genome_id, n, bit_sum, last_bit`` of the portable sketches, without their bits."""
    def run_for(bits: list) -> Callable:
        def count(texts: numeric.Texts, ends: np.ndarray) -> tuple[np.ndarray, dict]:
            if not bits:
                bits.append(numeric.PortableBits(k, filter_size))
            keys, n = bits[0](texts)
            begin, _, last = numeric.per_genome(keys, _by_genome(n, ends))
            keys = keys[begin]
            size = np.diff(np.concatenate(([0], last)))
            found = np.flatnonzero(size)
            return found, {"n": size[found], "bit_sum": numeric.sums(keys, last)[found], "last_bit": keys[last[found] - 1]}
        return count

    return _per_genome(df, "n long, bit_sum long, last_bit long", run_for([]), k)


def kmer_histogram(df: DataFrame, k: int) -> DataFrame:
    """:func:`histogram` of the k-mers of texts: tasks count what they hold and pass on sorted k-mers by bucket, and no row per k-mer."""
    if k * numeric.WIDTH > 63:
        return histogram(kmers(df, k))
    counts = df.where(F.length("seq") >= k).select("seq").mapInArrow(lambda b: numeric.bucketed_counts(b, k), "bucket int, keys binary, counts binary")
    parts = counts.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(numeric.bucket_histograms, "occurrences long, n_kmers long")
    return parts.groupBy("occurrences").agg(F.sum("n_kmers").alias("n_kmers"))


def label_sizes(df: DataFrame, groups: DataFrame, by: str, k: int) -> DataFrame:
    """``node, n_bits``: how many bits the genomes below each node of the labels of ``groups(genome_id, <by>)`` have together.

    What is shuffled is texts and, by bucket, pieces of text that hold neighbouring k-mers;
    each bucket is counted for all levels at once.
    """
    rows = df.where(F.length("seq") >= k).select("genome_id", "seq").join(groups.select("genome_id", by).distinct(), "genome_id").select("seq", by)
    runs = rows.mapInArrow(lambda b: numeric.bucketed_runs(b, k), "bucket int, labels array<string>, owners binary, sizes binary, runs binary")
    counts = runs.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lambda b: numeric.node_sizes(b, k), "node string, n long")
    return counts.groupBy("node").agg(F.sum("n").alias("n_bits"))


def packed_unions(df: DataFrame, groups: DataFrame, by: str, k: int, filter_size: int) -> DataFrame:
    """``<by>, bucket, bits``: OR of the portable sketches of each group of ``groups(genome_id, <by>)``, packed as :func:`pack` does with bits counted from 1.

    Tasks fill the bitmaps of their groups, so what is shuffled is texts and bitmaps, whatever the number of k-mers.
    """
    rows = df.where(F.length("seq") >= k).select("genome_id", "seq").join(groups.select("genome_id", by).distinct(), "genome_id").select("seq", by)
    kind = rows.schema[by].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, type_ = numeric.Unions(k, filter_size), None

        def out(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(rows), 256):
                part = rows[at:at + 256]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], t) for i, t in enumerate((type_, pa.int64(), pa.binary()))], names=[by, "bucket", "bits"])

        for batch in numeric.pieces(batches):
            type_ = batch.column(1).type
            for full in held.add(batch.column(0), batch.column(1).to_pylist()):
                yield from out(full)
        yield from out(held.flush())

    packed = rows.mapInArrow(run, f"`{by}` {kind}, bucket long, bits binary")
    return packed.groupBy(by, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def kmer_counts(windows: DataFrame) -> DataFrame:
    return windows.groupBy("genome_id", "kmer").agg(F.count(F.lit(1)).alias("occurrences"))


def sketch(df: DataFrame, k: int, min_occurrence: int = 1, filter_size: int | None = None, portable: bool = False,
           **options) -> DataFrame:
    """``genome_id, bit`` of the k-mers that occur at least ``min_occurrence`` times in a genome."""
    if min_occurrence <= 1 and not portable and not options:
        return _hashed(df, k, filter_size)
    windows = kmers(df, k, **options)
    place = portable_bit(F.col("kmer"), filter_size) if portable else kmer_bit(F.col("kmer"), filter_size)
    if min_occurrence > 1:
        windows = kmer_counts(windows).where(F.col("occurrences") >= min_occurrence)
    return windows.select("genome_id", place.alias("bit")).distinct()


def _hashed(df: DataFrame, k: int, filter_size: int | None) -> DataFrame:
    """:func:`sketch` by :func:`kmer_bit`: a genome's bits are made distinct in its own task and not by a shuffle of k-mers."""
    def count(texts: numeric.Texts, ends: np.ndarray) -> tuple[np.ndarray, dict]:
        bits, n = numeric.xxhash(texts, k)
        if filter_size is not None:
            bits %= filter_size
        begin, _, last = numeric.per_genome(bits, _by_genome(n, ends))
        size = np.diff(np.concatenate(([0], last)))
        found = np.flatnonzero(size)
        return found, {"bits": pa.LargeListArray.from_arrays(np.concatenate(([0], last[found])), pa.array(bits[begin])).cast(pa.list_(pa.int64()))}

    return _per_genome(df, "bits array<long>", count, k).select("genome_id", F.explode("bits").alias("bit"))


def subsample(bits: DataFrame, scale: int) -> DataFrame:
    """Every ``scale``-th part of the hash space: an approximate sketch for very large collections."""
    return bits.where(F.pmod(F.col("bit"), F.lit(scale)) == 0)


def sizes(bits: DataFrame) -> DataFrame:
    return bits.groupBy("genome_id").agg(F.count(F.lit(1)).alias("n"))


def density(bits: DataFrame, filter_size: int) -> DataFrame:
    return with_density(sizes(bits), filter_size)


def with_density(sized: DataFrame, filter_size: int) -> DataFrame:
    return sized.withColumn("density", F.round(F.col("n") / F.lit(filter_size), 8))


def union_by(bits: DataFrame, groups: DataFrame, by: str) -> DataFrame:
    """OR of the sketches of each group; ``groups(genome_id, <by>)``."""
    return bits.join(groups, "genome_id").select(F.col(by).alias("genome_id"), "bit").distinct()


def histogram(windows: DataFrame) -> DataFrame:
    """``occurrences, n_kmers`` over the whole collection."""
    return windows.groupBy("kmer").agg(F.count(F.lit(1)).alias("occurrences")).groupBy("occurrences").agg(
        F.count(F.lit(1)).alias("n_kmers"))


def filter_size(counts: DataFrame, min_occurrence: int = 2, expand_by: float = 50.0) -> DataFrame:
    """``f1, f0, rare, filter_size`` from a histogram.

    ``f1`` counts all, ``f0`` the distinct k-mers, ``rare`` those below ``min_occurrence``; the size is
    ``f0 - rare`` (``f1`` if there are no distinct ones) and ``expand_by`` percent more.
    """
    sums = counts.agg(
        F.coalesce(F.sum(F.col("occurrences") * F.col("n_kmers")), F.lit(0)).alias("f1"),
        F.coalesce(F.sum("n_kmers"), F.lit(0)).alias("f0"),
        F.coalesce(F.sum(F.when(F.col("occurrences") < min_occurrence, F.col("n_kmers"))), F.lit(0)).alias("rare"))
    size = F.when(F.col("f0") == 0, F.col("f1")).otherwise(F.col("f0") - F.col("rare"))
    return sums.withColumn("filter_size", size + F.floor(size * F.lit(expand_by) / F.lit(100.0)).cast("bigint"))


def pack(bits: DataFrame) -> DataFrame:
    """``genome_id, bucket, bits``: bitmaps of 32768 bits each, for storage."""
    return bits.groupBy("genome_id", F.bitmap_bucket_number("bit").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))


def packed_union(packed: DataFrame, groups: DataFrame, by: str) -> DataFrame:
    """OR of packed sketches, bucket by bucket."""
    return packed.join(groups, "genome_id").groupBy(F.col(by).alias("genome_id"), "bucket").agg(
        F.bitmap_or_agg("bits").alias("bits"))


def _long_counts(df: DataFrame, lengths: list[int]) -> DataFrame:
    """``k, total, n_distinct`` of lengths in order, from pieces of text that are dealt by their first ``lengths[0]`` characters; no hash stands for a k-mer."""
    size = F.length("seq")
    totals = df.agg(*[F.coalesce(F.sum(F.greatest(size - F.lit(k - 1), F.lit(0)).cast("long")), F.lit(0)).alias(str(k)) for k in lengths])
    totals = totals.select(F.inline(F.array(*[F.struct(F.lit(k).alias("k"), F.col(str(k)).alias("total")) for k in lengths])))
    runs = df.where(size >= lengths[0]).select("seq").mapInArrow(lambda b: numeric.bucketed_prefixes(b, lengths[0], lengths[-1]), "bucket int, sizes binary, starts binary, runs binary")
    found = runs.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lambda b: numeric.prefix_counts(b, lengths), "k int, n long")
    return totals.join(found.groupBy("k").agg(F.sum("n").alias("n")), "k", "left").select("k", "total", F.coalesce("n", F.lit(0)).alias("n_distinct"))


def length_curve(df: DataFrame, lengths: list[int], **options) -> DataFrame:
    """``k, total, n_distinct, share``: how specific k-mers of each length are to their place."""
    if options:
        counts = {k: kmers(df, k, **options).groupBy("kmer").agg(F.count(F.lit(1)).alias("n")).agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("n_distinct")) for k in lengths}
        rows = [row.select(F.lit(k).alias("k"), "total", "n_distinct") for k, row in counts.items()]
    else:
        short, long = ([k for k in sorted(set(lengths)) if (k * numeric.WIDTH <= 63) == fits] for fits in (True, False))
        rows = [kmer_histogram(df, k).agg(F.coalesce(F.sum(F.col("occurrences") * F.col("n_kmers")), F.lit(0)).alias("total"),
                                          F.coalesce(F.sum("n_kmers"), F.lit(0)).alias("n_distinct")).select(F.lit(k).alias("k"), "total", "n_distinct") for k in short]
        if long:
            rows.append(_long_counts(df, long))
    out = reduce(DataFrame.union, rows)
    return out.withColumn("share", F.when(F.col("total") > 0, F.round(F.col("n_distinct") / F.col("total"), 6)).otherwise(F.lit(0.0)))


def choose_length(curve: DataFrame, least_gain: float = 0.05) -> DataFrame:
    """``k``: the shortest length after which the share of distinct k-mers grows by less than ``least_gain``."""
    step = F.lead("share").over(Window.orderBy("k")) - F.col("share")
    flat = curve.withColumn("gain", F.coalesce(step, F.lit(0.0))).where(F.col("gain") < least_gain)
    return flat.agg(F.min("k").alias("k"))
