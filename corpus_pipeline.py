"""Corpus pipeline: filter, deduplicate and pack the documents.

``STAGES`` lists ``(name, function)``; each function takes ``(spark, docs, sf_dir)`` and
returns a DataFrame that is written and read again as the next stage's ``docs``.
All but the last return the columns of ``documents``.

Every stage takes any further columns along as they are, whatever their names, and an
empty table gives an empty one.  Null and empty texts go through as empty ones;
each docstring says what holds for null ids and repeated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.llm.common import Scratch, keep_rows, read_table
from cladeframe.llm.minhash import MAX_BROADCAST_IDS, near_duplicates
from cladeframe.llm.packing import pack
from cladeframe.llm.quality import fit_quality, score_quality
from cladeframe.llm.substrings import clean_texts
from cladeframe.llm.toxicity import fit_grammar, score_toxicity
from cladeframe.session import ship


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the classifier, fitted on the labelled ones, accepts.

    Each row is judged by its text alone; texts without words share one score, and
    without labels of both kinds nothing tells documents apart.
    """
    ship(spark)
    model = fit_quality(docs, read_table(spark, sf_dir, "labels"))
    return keep_rows(docs, lambda rows: score_quality(rows, model), "quality_predicted = 1")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the grammar, fitted on the labelled ones, doesn't find toxic.

    Each row is judged by its text alone; one that matches no clause stays.
    """
    ship(spark)
    grammar = fit_grammar(docs, read_table(spark, sf_dir, "labels"), Scratch(spark))
    return keep_rows(docs, lambda rows: score_toxicity(rows, grammar), "toxicity_predicted = 0")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document (the least id) of each group of near-duplicates.

    Rows with a null id, without words or without a partner stay; rows that repeat an
    id are one document, so they stay or go together.
    """
    ship(spark)
    scratch = Scratch(spark)
    gone = scratch.save(near_duplicates(docs, scratch).where("not kept").select("doc_id").distinct())
    small = gone.count() <= MAX_BROADCAST_IDS
    return docs.join(F.broadcast(gone) if small else gone, "doc_id", "left_anti").select(*docs.columns)


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove repeated passages; ``n_chars`` follows the text.

    Every row stays; a null text becomes empty, rows with a null id keep their text, and
    rows that repeat an id and a text are cut alike.
    """
    ship(spark)
    clean = clean_texts(docs, Scratch(spark))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 1024 tokens; one row per piece, with its ids.

    A null or empty text is its end token; repeated rows are packed as often as they occur,
    null ids stay null.  Other columns end here.
    """
    ship(spark)
    return pack(docs, Scratch(spark))


STAGES = [("quality", quality), ("toxicity", toxicity), ("near_dedup", near_dedup),
          ("substring_dedup", substring), ("packing", packing)]

#: The classifiers and tokenisation are beyond SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what is between them is written to the shared folder."""
    scratch = Scratch(spark)
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.save(docs)
    return docs
