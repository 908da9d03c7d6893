"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.storage import Scratch  # noqa: F401


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc32_mod(column: str, modulus: int):
    """CRC-32 of the column's decimal text, modulo ``modulus``."""
    return F.crc32(F.col(column).cast("string")) % F.lit(modulus)


def chunks(batch: pa.RecordBatch, text: str, max_rows: int = 2048, max_bytes: int = 1 << 20):
    """Slices of an Arrow batch that hold a bounded amount of text each."""
    sizes = np.asarray(pc.binary_length(batch.column(text)).fill_null(0))
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and (i - start >= max_rows or held + n > max_bytes):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if start < len(sizes):
        yield batch.slice(start)


def give_back() -> None:
    """Return freed memory to the system: Python workers live on between tasks, beside a full heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def map_texts(df: DataFrame, fn, schema: str, text: str = "text") -> DataFrame:
    """``mapInArrow`` over bounded slices; ``fn(slice) -> pa.RecordBatch | None``."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch, text):
                out = fn(part)
                if out is not None:
                    yield out
        give_back()

    return df.mapInArrow(run, schema)


def keep_rows(docs: DataFrame, score, condition: str, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose scored text meets a condition, with all columns as they were.

    ``score(df)`` adds columns to a table; it sees the text beside one struct of the rest,
    so that none of the caller's columns can clash with what it adds.
    """
    rest = F.struct(*([F.col(f"`{c}`") for c in docs.columns if c != text] or [F.lit(True)]))
    found = score(docs.select(rest.alias("rest"), F.col(text))).where(condition)
    return found.select(*[F.col(text) if c == text else F.col(f"rest.`{c}`").alias(c) for c in docs.columns])


def ragged(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row number and position of every element of rows with these lengths."""
    lengths = np.asarray(lengths, dtype=np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    start = np.cumsum(lengths) - lengths
    return row, np.arange(len(row)) - start[row]
