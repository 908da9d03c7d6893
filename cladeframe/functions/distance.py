"""Set similarity and the nucleotide distance derived from it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def jaccard(inter: Column, uni: Column) -> Column:
    """Intersection over union, half-up to five decimals, from integers only."""
    scaled = F.floor((F.lit(200000) * inter + uni) / (F.lit(2) * uni))
    return F.when(uni > 0, scaled / F.lit(100000.0)).otherwise(F.lit(0.0))


def ani_distance(j: Column, k: int) -> Column:
    """1 for disjoint sets, else the Mash distance of a Jaccard index, at most 1, to five decimals."""
    raw = F.lit(1.0) - (F.lit(1.0) + F.log(F.lit(2.0) * j / (F.lit(1.0) + j)) / F.lit(float(k)))
    # the distance counts down from 1 - (1 + x), so equal sets have 0.0 and not -0.0
    return F.when(j <= 0, F.lit(1.0)).otherwise(F.round(F.least(F.lit(1.0), raw), 5))


def rounded(x: Column, digits: int = 8) -> Column:
    """``x`` half-up to some decimals by its binary value, as SQL engines do; ``F.round`` goes by the decimals it is printed with."""
    scale = F.lit(10.0 ** digits)
    return F.round(x * scale) / scale


def mean_distance(ani: Column) -> Column:
    """Mean of distances of five decimals, half-up to five decimals; exact, so independent of the order of rows."""
    total, n = F.sum(F.round(ani * F.lit(100000)).cast("bigint")), F.count(ani)
    return F.floor((F.lit(2) * total + n) / (F.lit(2) * n)) / F.lit(100000.0)
