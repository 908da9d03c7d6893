"""What a Python worker holds at once: two of them stand beside an executor's full heap."""

import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa

from cladeframe.llm import bytebpe, substrings
from cladeframe.llm.common import chunks
from cladeframe.session import ship


def peak_mb(run) -> float:
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 2**20
    finally:
        tracemalloc.stop()


def texts(mb: int) -> pa.RecordBatch:
    r = np.random.default_rng(1)
    words = ["".join(map(chr, r.integers(97, 123, n))) for n in r.integers(2, 10, 5000)]
    rows = [" ".join(words[i] for i in r.integers(0, 5000, 600)) for _ in range(mb * 2**20 // 3900)]
    return pa.RecordBatch.from_arrays([pa.array(rows)], ["text"])


def test_the_class_table_is_made_in_blocks():
    assert peak_mb(bytebpe.character_classes) < 16


def test_encoding_holds_one_small_slice():
    coder, batch = bytebpe.load(public_tokenizers.path("byte_bpe_50k.json")), texts(4)
    assert peak_mb(lambda: [len(coder.encode_flat(p.column(0).to_pylist())) for p in chunks(batch, "text")]) < 48


def test_windows_hold_one_small_slice():
    batch = texts(2)
    parts = lambda: chunks(batch, "text", max_bytes=substrings.SLICE_BYTES)
    substrings._TABLES.clear()
    assert peak_mb(lambda: [len(substrings.windows(p.column(0).to_pylist(), 20)) for p in parts()]) < 56


def test_workers_get_small_batches(spark):
    def held(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    rows = ship(spark).range(0, 3000, 1, 1).selectExpr("repeat(cast(id % 10 as string), 4096) AS text")
    sizes = [r.n for r in rows.mapInArrow(held, "n long").collect()]
    assert sum(sizes) > 12_000_000 and max(sizes) < 5 << 20
