"""Tokenisers against their libraries, counts, packing and round trips."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from cladeframe.llm import bytebpe, piecebpe
from cladeframe.llm.common import Scratch, read_table
from cladeframe.llm.packing import pack, sequences
from cladeframe.llm.tokens import piece_digests, piece_round_trip, token_counts
from tests.conftest import SMALL

BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  ", "a  b", "  a", "a ", "\n\n a \n b", "x<|endoftext|> y<|endoftext|>", "<|endoftext|>", "don't I'LL we've 's's !'s",
       "日本 語  の 漢字", "a\x1cb \x1d c\x85d\x00", "aaaa" * 300, " " * 100 + "x" + " " * 33, "1234 5678,90 ½²", "▁x ▁ y", "<s>hi</s><0x41>",
       "é́   x　y", "'" * 7 + "s", "a'sb'tc're"]


def noise(seed: int, n: int) -> list[str]:
    r = random.Random(seed)
    pick = lambda: r.choice([r.randrange(32, 127), r.randrange(1, 0x500), r.randrange(0x2000, 0x3100), r.randrange(0x10000, 0x1F9FF), 32, 10, 39])
    return ["".join(chr(pick()) for _ in range(r.randrange(1, 120))) for _ in range(n)]


def test_byte_bpe_equals_its_library():
    own, library = bytebpe.ByteBPE(BYTE), Tokenizer.from_file(BYTE)
    texts = ODD + noise(1, 300) + ["x" * 20_000]
    expected = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(b, "<u4").tolist() for b in own.encode(texts)] == expected
    assert own.encode([None]) == [b""] and own.encode([]) == []


def test_piece_bpe_equals_its_library():
    own, library = piecebpe.PieceBPE(PIECE, max_cached=100), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    letters = random.Random(2)
    texts = ODD + noise(3, 300) + ["".join(letters.choice("abcdeinorst ") for _ in range(500)) for _ in range(100)]
    for text in texts:
        ids, n, said = own.encode_and_decode(text)
        expected = library.encode(text)
        assert ids == ",".join(map(str, expected)) and n == len(expected) and said == library.decode(expected)
        assert own.decode(expected) == library.decode(expected)


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens long")


EDGES = [(1, "one two", "x", 1), (1, "one two", "x", 1), (2, None, None, None), (3, "", "y", 2), (None, "no id", "z", 3), (4, "long " * 9000, "w", 4)]


def test_counts_of_edge_cases(spark):
    got = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(documents(spark, EDGES)).collect()}
    library = Tokenizer.from_file(BYTE)
    assert got == {(i, len((t or "").encode()), n := len(library.encode(t or "").ids), n > 1024) for i, t, _, _ in EDGES}
    assert token_counts(documents(spark, EDGES)).count() == len(EDGES)
    assert token_counts(documents(spark, [])).count() == 0


def test_counts_of_documents(spark):
    library = Tokenizer.from_file(BYTE)
    texts = {r.doc_id: r.text for r in read_table(spark, SMALL, "documents").collect()}
    for r in token_counts(read_table(spark, SMALL, "documents")).collect():
        assert r.n_tokens == len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert r.n_bytes == len(texts[r.doc_id].encode())


def test_counts_with_a_piece_model(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    got = token_counts(documents(spark, EDGES), model=PIECE).collect()
    assert sorted(r.n_tokens for r in got) == sorted(len(library.encode(t or "")) for _, t, _, _ in EDGES)


def test_piece_digests(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    got = sorted(piece_digests(documents(spark, EDGES)).collect(), key=repr)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    expected = [(i, len(e := library.encode(t or "")), sha(",".join(map(str, e))), sha(library.decode(e))) for i, t, _, _ in EDGES]
    assert sorted(map(tuple, got), key=repr) == sorted(expected, key=repr)
    assert {r.decoded for r in piece_round_trip(documents(spark, EDGES)).collect()} == {t or "" for _, t, _, _ in EDGES}


@pytest.mark.parametrize("length", [1024, 7])
def test_packing_is_an_exact_round_trip(spark, length):
    docs = read_table(spark, SMALL, "documents").repartition(5)
    pieces = pack(docs, Scratch(spark), length=length).toPandas()
    library = Tokenizer.from_file(BYTE)
    texts = {r.doc_id: r.text for r in docs.collect()}
    total = 0
    for key, own in pieces.groupby("doc_id"):
        own = own.sort_values("start")
        expected = np.array(library.encode(texts[key], add_special_tokens=False).ids + [0], dtype="<u4")
        assert (own["start"].to_numpy() == np.r_[0, own["length"].cumsum().to_numpy()[:-1]]).all()
        assert b"".join(own["ids"]) == expected.tobytes() and (own["doc_tokens"] == len(expected)).all()
        for r in own.itertuples():
            assert zlib.crc32(expected[r.start:r.start + r.length].tobytes()) == r.ids_crc32
        total += len(expected)
    assert len(pieces["doc_id"].unique()) == len(texts)
    for key, own in pieces.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert (own["offset"].to_numpy() == np.r_[0, own["length"].cumsum().to_numpy()[:-1]]).all()
        assert own["length"].sum() == min(length, total - key * length)


def test_packing_edge_cases(spark):
    pieces = pack(documents(spark, EDGES), Scratch(spark), length=64)
    assert sorted((r.doc_id or -1) for r in pieces.where("start = 0").collect()) == sorted((i or -1) for i, *_ in EDGES)
    whole = sequences(pieces).orderBy("sequence_id").collect()
    assert [r.n_tokens for r in whole[:-1]] == [64] * (len(whole) - 1) and all(len(r.ids) == 4 * r.n_tokens for r in whole)
    assert pack(documents(spark, []), Scratch(spark)).count() == 0
