"""Column functions over seven-level labels ``k__a|p__b|c__c|o__d|f__e|g__f|s__g``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Level names and their prefixes, from the root down.
LEVELS = ("kingdom", "phylum", "class", "order", "family", "genus", "species")
PREFIXES = ("k", "p", "c", "o", "f", "g", "s")

_VALID = "^" + r"\|".join(rf"{p}__[^|]+" for p in PREFIXES) + "$"


def is_defined(label: Column) -> Column:
    """Seven levels in order, each with its prefix and a name; null and empty labels are not."""
    return F.coalesce(label.rlike(_VALID), F.lit(False))


def level_of(label: Column) -> Column:
    """Name of the deepest level of a (partial) label."""
    return F.element_at(F.array(*map(F.lit, LEVELS)), F.size(F.split(label, r"\|")))


def last_part(label: Column) -> Column:
    return F.substring_index(label, "|", -1)


def parent_label(label: Column) -> Column:
    """The label without its last part; null for a kingdom."""
    return F.when(F.instr(label, "|") > 0, F.regexp_replace(label, r"\|[^|]*$", ""))


def prefix_label(label: Column, depth: int) -> Column:
    """The first ``depth`` levels."""
    return F.substring_index(label, "|", depth)


def normalise_name(name: Column, previous: Column | None = None) -> Column:
    """Runs of characters other than letters, digits and ``_`` become one ``_``, none at the ends.

    What has nothing left is ``<previous>_unclassified`` (null without ``previous``).
    """
    out = F.regexp_replace(F.regexp_replace(name, r"(?U)\W+", "_"), "_+", "_")
    out = F.regexp_replace(out, "^_|_$", "")
    fallback = F.concat(previous, F.lit("_unclassified")) if previous is not None else F.lit(None).cast("string")
    return F.when(out == "", fallback).otherwise(out)


def is_cluster_id(identifier: Column) -> Column:
    return F.coalesce(identifier.rlike("^MSBT[0-9]+$"), F.lit(False))


def cluster_batch(identifier: Column) -> Column:
    """Six-digit folder of 1000 clusters; null for anything but a cluster id."""
    number = F.substring(identifier, 5, 18).cast("bigint")
    return F.when(is_cluster_id(identifier), F.lpad(F.floor(number / 1000).cast("string"), 6, "0"))


def cluster_number(identifier: Column) -> Column:
    return F.when(is_cluster_id(identifier), F.substring(identifier, 5, 18).cast("bigint"))


def in_clade(label: Column, clade: str) -> Column:
    """Whether a level below the kingdom is exactly ``clade``."""
    return F.contains(F.concat(label, F.lit("|")), F.lit(f"|{clade}|"))


def file_stem(path: Column) -> Column:
    """Base name without the last extension."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"(?<=.)\.[^.]*$", "")


def is_supported(path: Column) -> Column:
    """Sequence or sketch files by their extension."""
    return F.coalesce(path.rlike(r"\.(fa|fasta|fna|bf)$"), F.lit(False))
