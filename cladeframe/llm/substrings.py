"""Substring deduplication by hashing the lines of a text and runs of their parts.

A unit is a line, or the part of one up to a punctuation mark or up to a word whose
length and last byte sum up to a multiple of ``CUT``.  Cuts depend on nothing but the words
beside them, so a passage has the same inner units wherever it stands, with or
without marks.  Units are normalised (A-Z lower-cased, blanks as one) and hashed.

Units that stand for themselves must be long enough to be a passage: a window is the
shortest run of neighbouring units with at least ``min_words`` words, counted on from
each unit and back from each unit; a line that long is one by itself.  Digests of
windows are grouped over all documents, the occurrence with the least (doc_id,
position) is kept, and the units of all others are removed.  So what goes stood
in one piece in a text before; every unit stays where it occurs first, and short
common lines stay.  Removed spans keep the offsets that they had in the original
text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeframe.llm.common import Scratch, chunks, give_back

#: A unit ends after a word whose length in bytes and last byte (A-Z lower-cased) sum up to a multiple of this.
CUT = 10
#: Bytes of text that are hashed at once.
SLICE_BYTES = 1 << 19
#: Windows that a task holds to tell repeats among them from what the others must see (about 100 bytes each).
HELD_WINDOWS = 500_000
#: Removed spans (24 bytes each, and 40 a document) that may be broadcast; beyond that they are joined by a shuffle.
MAX_BROADCAST_SPANS = 200_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KIND = np.zeros(256, dtype=np.uint8)  # 1: blank, 2: mark, 3: line end
_KIND[[9, 13, 32]] = 1
_KIND[[ord(c) for c in ".,;:!?"]] = 2
_KIND[10] = 3
_RNG = np.random.default_rng(20240229)
_BYTES = _RNG.integers(1, 2**63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = [int(x) for x in _RNG.integers(1, 2**63, 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)]
_BACK = [pow(x, -1, 2**64) for x in _STEP]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_TABLES: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers modulo 2**64, kept for the next call unless they are many."""
    if base not in _TABLES or len(_TABLES[base]) < n:
        out = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        out[0] = 1
        out = np.multiply.accumulate(out)
        if n > 2 * SLICE_BYTES:
            return out[:n]
        _TABLES[base] = out
    return _TABLES[base][:n]


def _rolled(values: np.ndarray, at: np.ndarray, until: np.ndarray, k: int) -> np.ndarray:
    """Order-dependent digest of ``values[at:until]`` for many ranges, from one running sum."""
    running = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(_STEP[k], len(values)), out=running[1:])
    return _mix((running[until] - running[at]) * _powers(_BACK[k], len(values) + 1)[at] + (until - at).astype(np.uint64))


def units(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, first byte in the joined texts, words and two digests of every unit; and the bytes that start a character."""
    raws = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raws), dtype=np.uint8)
    size = np.fromiter(map(len, raws), dtype=np.int64, count=len(raws))
    row_start = np.cumsum(size) - size
    n = len(data)
    kind = _KIND[data]
    word = (kind == 0) | (kind == 2)
    first = np.zeros(n, dtype=bool)
    first[row_start[size > 0]] = True
    # after marks or line ends (with what blanks follow) a unit begins
    stop = kind >= 2
    filler = kind > 0  # marks and blanks, which belong to the unit before them
    run = np.flatnonzero(np.concatenate([[True], filler[1:] != filler[:-1]]) | first) if n else np.empty(0, np.int64)
    stopped = np.bitwise_or.reduceat(stop.astype(np.uint8), run) > 0 if n else np.empty(0, bool)
    begin = first.copy()
    after = run[1:][filler[run[:-1]] & stopped[:-1]]
    begin[after] = True
    # words, cut where units begin; a text may begin with fillers, which make a unit of their own
    prev_word = np.concatenate([[False], word[:-1]]) if n else word
    opens = word & (~prev_word | begin)
    at = np.flatnonzero(opens)
    closes = word & ~np.concatenate([(word & ~opens)[1:], [False]]) if n else word
    end = np.flatnonzero(closes) + 1
    # such a word ends its unit together with the blanks after it
    lower = _LOWER[data]
    ends = ((end - at + lower[end - 1]) % CUT == 0) & np.concatenate([kind[at[1:]] == 0, [False]]) if len(at) else np.empty(0, bool)
    last = np.searchsorted(at, row_start + size, side="left") - 1
    ends[last[last >= 0]] = False  # the next word is another text's
    begin[at[np.flatnonzero(ends) + 1]] = True
    start = np.flatnonzero(begin)
    of_word = np.searchsorted(at, start, side="left")
    until = np.concatenate([of_word[1:], [len(at)]]) if len(start) else of_word
    digests = [_rolled(_rolled(_BYTES[k][lower], at, end, k), of_word, until, k) for k in range(2)]
    row = np.searchsorted(row_start + size, start, side="right")
    return row, start, until - of_word, np.stack(digests), (data & 0xC0) != 0x80


def windows(texts: list[str], min_words: int) -> tuple[np.ndarray, ...]:
    """Row, first character, end and digests of every window."""
    row, start, words, digest, leads = units(texts)
    n = len(row)
    if not n:
        return tuple(np.empty(0, np.int64) for _ in range(3)) + (np.empty((2, 0), np.uint64),)
    upto = np.concatenate([[0], np.cumsum(words)])
    bounds = np.concatenate([[0], np.flatnonzero(row[1:] != row[:-1]) + 1, [n]])
    low = np.repeat(bounds[:-1], np.diff(bounds))
    high = np.repeat(bounds[1:], np.diff(bounds))
    each = np.arange(n)
    # counted on from each unit: the first end with enough words; counted back: the last start
    on = np.searchsorted(upto, upto[:-1] + min_words, side="left")
    back = np.searchsorted(upto, upto[1:] - min_words, side="right") - 1
    forward, backward = on <= high, back >= low
    a = np.concatenate([each[forward], back[backward]])
    b = np.concatenate([on[forward], each[backward] + 1])
    a, b = np.divmod(np.unique(a * (n + 1) + b), n + 1)
    chars = np.cumsum(leads)  # characters up to and with a byte
    begins = np.concatenate([chars[start] - 1, [int(chars[-1])]])
    text_begin = begins[low]
    digests = np.stack([_rolled(digest[k], a, b, k) for k in range(2)])
    return row[a], begins[a] - text_begin[a], begins[b] - text_begin[a], digests


def window_table(docs: DataFrame, min_words: int) -> DataFrame:
    """``h1, h2, doc_id, version, start, length, later`` of the windows of ``docs(doc_id, version, text)``.

    A digest has 96 bits.  ``later`` marks windows that the same task met with a lesser
    rank: they are decided, and their digest is one of their own, so a window that a
    third of all documents hold goes on as one row for ``HELD_WINDOWS`` of a task.
    """
    names = ["h1", "h2", "doc_id", "version", "start", "length", "later"]
    kinds = ["int64", "int32", "int64", "int32", "int32", "int32", "bool"]

    def flush(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        columns = [np.concatenate(c) for c in zip(*held)]
        held.clear()
        later = np.zeros(len(columns[0]), dtype=bool)
        # most windows are alone with their first digest
        order = np.argsort(columns[0])
        h = columns[0][order]
        equal = h[1:] == h[:-1]
        order = order[np.concatenate([[False], equal]) | np.concatenate([equal, [False]])]
        order = order[np.lexsort([columns[k][order] for k in (4, 3, 2, 1, 0)])]
        if len(order):
            met = [c[order] for c in columns[:5]]
            fresh = lambda upto: np.concatenate([[True], ~np.logical_and.reduce([c[1:] == c[:-1] for c in met[:upto]])])
            # of equal ranks (a row that occurs twice) all are first
            rank, heads = np.cumsum(fresh(5)), np.flatnonzero(fresh(2))
            later[order] = rank > rank[heads][np.cumsum(fresh(2)) - 1]
            own = _mix((columns[2][later] * 1_000_003 + columns[4][later]).view(np.uint64))
            columns[0][later] = own.view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip([*columns, later], kinds)], names)

    def run(batches):
        held, count = [], 0
        for batch in batches:
            for part in chunks(batch, "text", max_bytes=SLICE_BYTES):
                row, start, stop, digest = windows(part.column("text").to_pylist(), min_words)
                if not len(row):
                    continue
                ids, version = np.asarray(part.column("doc_id")), np.asarray(part.column("version"))
                held.append([digest[0].view(np.int64), (digest[1] >> np.uint64(32)).astype(np.uint32).view(np.int32).astype(np.int64),
                             ids[row], version[row].astype(np.int64), start, stop - start])
                count += len(row)
                if count >= HELD_WINDOWS:
                    yield flush(held)
                    held, count = [], 0
        if held:
            yield flush(held)
        _TABLES.clear()  # the worker lives on, beside later stages
        give_back()

    return docs.select("doc_id", "version", "text").mapInArrow(
        run, "h1 long, h2 int, doc_id long, version int, start int, length int, later boolean")


def repeated_spans(docs: DataFrame, scratch: Scratch, min_words: int = 20) -> DataFrame:
    """``doc_id, version, spans``: what to remove of each document, as ``(start, stop)`` in characters.

    ``version`` is null unless ids repeat with different texts, which it tells apart.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    hashes = texts.groupBy("doc_id").agg(F.min(_version(F.col("text"))).alias("a"), F.max(_version(F.col("text"))).alias("b"))
    unique = hashes.where("a <> b").isEmpty()
    found = window_table(texts.withColumn("version", F.lit(0) if unique else _version(F.col("text"))), min_words)
    rank = F.struct("doc_id", "version", "start")
    least = F.min(F.when(~F.col("later"), rank)).over(Window.partitionBy("h1", "h2"))
    # what is first in its task and everywhere ends here, most of all rows
    later = found.withColumn("least", least).where(F.col("later") | (rank != F.col("least"))) \
        .select("doc_id", "version", "start", (F.col("start") + F.col("length")).alias("stop"))
    by_doc = Window.partitionBy("doc_id", "version").orderBy("start", "stop")
    # windows that touch or overlap are one span
    before = F.max("stop").over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    islands = later.withColumn("opens", F.when(F.col("start") <= before, 0).otherwise(1)).withColumn(
        "island", F.sum("opens").over(by_doc.rowsBetween(Window.unboundedPreceding, 0)))
    spans = islands.groupBy("doc_id", "version", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    return scratch.save(spans.groupBy("doc_id", "version").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans"))
                        .withColumn("version", F.lit(None).cast("int") if unique else F.col("version")))


def _version(text: Column) -> Column:
    """Tells apart the texts of rows that repeat an id."""
    return F.hash(text)


def remove_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """All columns of ``docs`` with ``text`` cleaned, and ``n_removed, removed_chars, spans``.

    ``n_removed`` counts the removed spans; ``spans``: ``start+length`` in characters of the
    original text, joined by ``;``.  Columns of ``docs`` that have these names are replaced.
    """
    small = (spans.agg(F.sum(F.size("spans"))).first()[0] or 0) <= MAX_BROADCAST_SPANS
    made = ("n_removed", "removed_chars", "spans")
    # all columns of the input travel in one struct, so none can clash with the ones made here
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    text, spans = F.col("row.text"), spans.select(F.col("doc_id").alias("span_doc"), F.col("version").alias("span_version"), F.col("spans").alias("cut"))
    wide = rows.join(F.broadcast(spans) if small else spans, (F.col("row.doc_id").cast("long") == F.col("span_doc"))
                     & F.coalesce(_version(text) == F.col("span_version"), F.lit(True)), "left")
    # what stays lies between the end of a span and the start of the next
    froms = F.concat(F.array(F.lit(0)), F.transform("cut", lambda s: s["stop"]))
    tos = F.concat(F.transform("cut", lambda s: s["start"]), F.array(F.length(text)))
    kept = F.array_join(F.zip_with(froms, tos, lambda a, b: F.substring(text, a + 1, b - a)), "")
    clean = F.when(F.col("cut").isNull(), F.coalesce(text, F.lit(""))).otherwise(kept)

    def total(value) -> Column:
        return F.coalesce(F.aggregate("cut", F.lit(0), lambda a, s: a + value(s)), F.lit(0)).cast("long")

    return wide.select(
        *[clean.alias(c) if c.lower() == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns if c.lower() not in made],
        F.when(F.col("cut").isNull(), 0).otherwise(F.size("cut")).cast("long").alias("n_removed"), total(lambda s: s["stop"] - s["start"]).alias("removed_chars"),
        F.coalesce(F.array_join(F.transform("cut", lambda s: F.concat(
            s["start"].cast("string"), F.lit("+"), (s["stop"] - s["start"]).cast("string"))), ";"), F.lit("")).alias("spans"))


def clean_texts(docs: DataFrame, scratch: Scratch, min_words: int = 20) -> DataFrame:
    """``docs`` with its own columns only, repeated passages removed from ``text`` (cases as in :func:`substring_dedup`)."""
    slim = docs.select("doc_id", "text")
    spans = repeated_spans(slim, scratch, min_words)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("kept"), "doc_id", "text")
    done = remove_spans(rows, spans)
    return done.select(*[F.col("text") if c == "text" else F.col(f"kept.`{c}`").alias(c) for c in docs.columns])


def substring_dedup(docs: DataFrame, scratch: Scratch, min_words: int = 20) -> DataFrame:
    """Every document with repeated passages removed (see the module's text).

    One row per input row, with all of its columns; ``n_removed`` (spans), ``removed_chars`` and
    ``spans`` replace columns of these names.  Null texts become empty.  Rows without an
    id keep their text and take no part.  Rows that repeat an id with the same text are one
    document and cut alike; with other texts they are documents of their own, ranked by
    a hash of the text.  Of equal passages the one with the least (doc_id, position)
    stays, also within one document.  Texts of any length are read whole; an empty table
    gives an empty result.
    """
    return remove_spans(docs, repeated_spans(docs, scratch, min_words))
