"""Packing by concatenation and cutting.

All documents form one global stream of tokens.  Pass one tokenises and writes
each partition's ids together with the tokens before each document in its
partition.  A prefix sum over the partitions' totals (one small row each) gives
every partition's offset in the stream.  Pass two cuts the stream into fixed
windows where it stands: no document moves, only the last window is not full,
and windows that lie across partitions consist of marked boundary records.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladeframe.llm import bytebpe
from cladeframe.llm.common import chunks, give_back, ragged, Scratch
from cladeframe.llm.tokens import vocabulary

#: Partitions whose totals may be broadcast (a row of 24 bytes each).
MAX_BROADCAST_PARTS = 1_000_000


def tokenize(df: DataFrame, scratch: Scratch, model: str = "byte_bpe_50k.json", end_id: int = 0,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pass one: ``part, before, doc_id, n, wide, ids`` as a table in the shared folder.

    ``ids`` are the document's ids and ``end_id``, as unsigned 16-bit numbers
    where all fit and as 32-bit numbers where ``wide`` says so.  Null texts are empty.
    """

    def run(batches):
        part, before = TaskContext.get().partitionId(), 0
        coder = bytebpe.load(vocabulary(model))
        for batch in batches:
            for piece in chunks(batch, "text"):
                ids, counts = coder.encode_flat(piece.column(1).to_pylist())
                n = counts + 1
                end = np.cumsum(n)
                flat = np.empty(end[-1], dtype="<u4")
                last = np.zeros(len(flat), dtype=bool)
                last[end - 1] = True
                flat[last], flat[~last] = end_id, ids
                wide = bool(flat.max() > 0xFFFF)
                width = 4 if wide else 2
                data = flat.astype(f"<u{width}")
                offsets = np.r_[0, end * width]
                blobs = pa.Array.from_buffers(pa.binary(), len(n), [
                    None, pa.py_buffer(offsets.astype("<i4")), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(n), part), "int32"), pa.array(before + end - n, "int64"), piece.column(0),
                    pa.array(n, "int64"), pa.array(np.full(len(n), wide)), blobs],
                    ["part", "before", "doc_id", "n", "wide", "ids"])
                before += int(end[-1])
        give_back()

    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return scratch.save(docs.mapInArrow(run, "part int, before long, doc_id long, n long, wide boolean, ids binary"))


def offsets(tokens: DataFrame) -> DataFrame:
    """``part, base, total``: each partition's first position in the global stream."""
    totals = tokens.groupBy("part").agg(F.sum("n").alias("total"))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("total").over(upto), F.lit(0)).alias("base"), "total")


def pack(df: DataFrame, scratch: Scratch, model: str = "byte_bpe_50k.json", length: int = 1024,
         end_id: int = 0, keep_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents in windows of ``length`` tokens.

    Returns one row per piece: ``doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, boundary`` and, with ``keep_ids``, ``ids`` (unsigned 32-bit,
    little endian).  Every document, also an empty or null one, has at least the
    end token, so at least one piece; repeated rows are packed as often as they
    occur; an empty table gives no pieces.  ``boundary`` marks pieces of windows
    that other partitions share.
    """
    tokens = tokenize(df, scratch, model, end_id, id_col, text_col)
    base = scratch.save(offsets(tokens))
    if base.count() <= MAX_BROADCAST_PARTS:
        base = F.broadcast(base)
    placed = tokens.join(base, "part").select(
        "doc_id", "n", "wide", "ids", (F.col("base") + F.col("before")).alias("at"), "base",
        (F.col("base") + F.col("total")).alias("stop"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "boundary"]

    def cut(batches):
        for batch in (part for whole in batches for part in chunks(whole, "ids")):
            n, at, base_, stop = (np.asarray(batch.column(k)) for k in ("n", "at", "base", "stop"))
            first = at // length
            row, k = ragged((at + n - 1) // length - first + 1)
            seq = first[row] + k
            lo = np.maximum(seq * length, at[row])
            hi = np.minimum((seq + 1) * length, (at + n)[row])
            start, size = lo - at[row], hi - lo
            wide = batch.column("wide").to_pylist()
            blobs = [np.frombuffer(b, dtype="<u4" if w else "<u2").astype("<u4")
                     for b, w in zip(batch.column("ids").to_pylist(), wide)]
            pieces = [blobs[r][a:a + s] for r, a, s in zip(row.tolist(), start.tolist(), size.tolist())]
            crc = [zlib.crc32(p) for p in pieces]
            shared = (seq * length < base_[row]) | ((seq + 1) * length > stop[row])
            arrays = [batch.column("doc_id").take(pa.array(row)), start, size, crc, n[row], seq, lo % length, shared]
            if keep_ids:
                arrays.append(pa.array([p.tobytes() for p in pieces], "binary"))
            yield pa.RecordBatch.from_arrays(
                [a if isinstance(a, pa.Array) else pa.array(a) for a in arrays], names + ["ids"] * keep_ids)
        give_back()

    schema = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
              "offset long, boundary boolean" + ", ids binary" * keep_ids)
    return placed.mapInArrow(cut, schema)


def sequences(pieces: DataFrame) -> DataFrame:
    """Whole windows of :func:`pack`'s pieces: ``sequence_id, n_tokens, ids``.

    A group holds at most one window's tokens, whatever the input's size.
    """
    rows = F.sort_array(F.collect_list(F.struct("offset", "length", "ids")))
    return pieces.groupBy("sequence_id").agg(rows.alias("rows")).select(
        "sequence_id", F.aggregate("rows", F.lit(0).cast("long"), lambda a, r: a + r["length"]).alias("n_tokens"),
        F.aggregate("rows", F.lit(b""), lambda a, r: F.concat(a, r["ids"])).alias("ids"))
