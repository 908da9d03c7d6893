"""Bounded samples of labelled rows, for the two classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a fit may use; doc ids and labels of so many rows are broadcast.
MAX_TRAINING_ROWS = 50_000


def training_rows(docs: DataFrame, labels: DataFrame, label: str, fold: Column | None = None,
                  bound: int = MAX_TRAINING_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``label, text`` of at most ``bound`` labelled documents outside the held-out fold.

    ``fold`` selects label rows (true: may be learned from).  Where more qualify, the
    ``bound`` ids with the least 64-bit hashes are used, so the choice depends on the
    ids alone.  Null ids or labels are left out, of repeated ids the largest label
    counts.  The sample is small by its bound, so it is broadcast and no text moves.
    """
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
    if fold is not None:
        chosen = chosen.where(fold)
    chosen = chosen.groupBy(F.col("doc_id").cast("long").alias("labelled_id")).agg(F.max(label).cast("int").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("labelled_id"), "labelled_id").limit(bound)
    texts = docs.select(F.col(id_col).cast("long").alias("labelled_id"), F.col(text_col).alias("text"))
    return texts.join(F.broadcast(chosen), "labelled_id").select("label", "text")
