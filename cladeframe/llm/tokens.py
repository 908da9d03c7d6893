"""Token counts and SentencePiece round trips of whole texts."""

from __future__ import annotations

import hashlib
import os

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.llm import bytebpe, piecebpe
from cladeframe.llm.common import map_texts


def vocabulary(name: str) -> str:
    """A vocabulary file's path; a bare name is one of the public tokenizers."""
    if os.path.exists(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def token_counts(df: DataFrame, model: str = "byte_bpe_50k.json", limit: int = 1024,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every text by the model's own rules, without added special tokens.

    Returns ``doc_id, n_bytes, n_tokens, over_limit``, one row for each input row
    (repeated rows stay).  A null or empty text has no bytes and no tokens; a
    null id stays null.  Other columns of the input are ignored.
    """

    def count(batch):
        texts = batch.column(1).to_pylist()
        path = vocabulary(model)
        n = piecebpe.load(path).count(texts) if path.endswith(".model") else bytebpe.load(path).count(texts)
        size = pc.binary_length(batch.column(1)).fill_null(0)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), size.cast("int64"), pa.array(n, "int64")], ["doc_id", "n_bytes", "n_tokens"])

    got = map_texts(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")),
                    count, "doc_id long, n_bytes long, n_tokens long")
    return got.withColumn("over_limit", F.col("n_tokens") > limit)


def piece_round_trip(df: DataFrame, model: str = "piece_bpe_32k.model",
                     id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """SentencePiece ids of every text and the text that they decode to.

    Returns ``doc_id, ids (decimal, joined by commas), n_tokens, decoded``.  A null
    text counts as empty: no ids, decoded to the empty text.  One row per input row
    (repeated rows and null ids stay); an empty table gives an empty result; other
    columns are ignored.
    """
    return _pieces(df, model, id_col, text_col, False)


def piece_digests(df: DataFrame, model: str = "piece_bpe_32k.model",
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Like :func:`piece_round_trip`, with SHA-256 digests instead of ids and texts."""
    return _pieces(df, model, id_col, text_col, True)


def _pieces(df: DataFrame, model: str, id_col: str, text_col: str, digests: bool) -> DataFrame:
    def sha(s: str) -> str:
        return hashlib.sha256(s.encode()).hexdigest()

    names = ["doc_id", "n_tokens", *(["ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"])]

    def encode(batch):
        coder = piecebpe.load(vocabulary(model))
        rows = [coder.encode_and_decode(t) for t in batch.column(1).to_pylist()]
        show = sha if digests else str
        return pa.RecordBatch.from_arrays([
            batch.column(0), pa.array([r[1] for r in rows], "int64"),
            pa.array([show(r[0]) for r in rows], "string"), pa.array([show(r[2]) for r in rows], "string")], names)

    return map_texts(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")),
                     encode, f"doc_id long, n_tokens long, {names[2]} string, {names[3]} string")
