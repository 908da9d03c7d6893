"""Lossless storage, other lacings and unknown sizes, malformed buffers."""

import hashlib
import os
import random
import struct
import zlib

import pytest

from cladeframe.llm import matroska as mk
from cladeframe.llm.common import read_table
from tests.conftest import SMALL


@pytest.mark.parametrize("frames", [1, 2, 64, 65, 64 * 16, 64 * 16 * 3 + 5])
def test_round_trip(frames):
    payload = os.urandom(192 * frames)
    media = mk.write(payload)
    parsed = mk.parse(media)
    assert mk.samples(media, parsed) == payload and len(parsed["packets"]) == frames
    times = [p[1] for p in parsed["packets"]]
    assert times == [24_000_000 * k for k in range(frames)]
    assert [c[2] for c in parsed["cues"]] == parsed["clusters"]
    assert parsed["tracks"][1]["codec"] == "A_PCM/INT/LIT" and parsed["tracks"][1]["bits"] == 8


def test_only_whole_frames():
    for payload in (b"", b"x" * 191):
        with pytest.raises(ValueError):
            mk.write(payload)


def block(lacing: int, head: bytes, data: bytes) -> bytes:
    return mk.element(mk.SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", 5, 0x80 | lacing << 1) + head + data)


def container(body: bytes, unknown: bool = False) -> bytes:
    cluster = mk.element(mk.TIMESTAMP, b"\x0a") + body
    if unknown:
        wrap = lambda kind, data: kind.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + data
        return mk._HEAD + wrap(mk.SEGMENT, mk._TRACKS + wrap(mk.CLUSTER, cluster) + wrap(mk.CLUSTER, cluster))
    return mk._HEAD + mk.element(mk.SEGMENT, mk._TRACKS + mk.element(mk.CLUSTER, cluster))


def test_lacings():
    a, b, c = b"a" * 300, b"b" * 20, b"c" * 7
    cases = {1: b"\x02\xff\x2d\x14"}
    value = 20 - 300 + (1 << 13) - 1
    cases[3] = b"\x02\x41\x2c" + (value | 1 << 14).to_bytes(2, "big")
    for lacing, head in cases.items():
        media = container(block(lacing, head, a + b + c))
        packets = mk.parse(media)["packets"]
        assert [media[o:o + s] for _, _, _, o, s, _, _ in packets] == [a, b, c]
        assert [t for _, t, *_ in packets] == [15_000_000, 39_000_000, 63_000_000]
    group = mk.element(mk.BLOCK_GROUP, mk.element(mk.BLOCK, b"\x81" + struct.pack(">hB", 0, 0) + a))
    media = container(group)
    assert mk.samples(media) == a


def test_unknown_sizes():
    media = container(block(0, b"", b"payload"), unknown=True)
    parsed = mk.parse(media)
    assert mk.samples(media, parsed) == b"payload" * 2 and len(parsed["clusters"]) == 2


def test_texts_and_packet_table(spark):
    rows = [(1, "one"), (1, "one"), (2, None), (3, ""), (None, "x" * 192), (4, "ä" * 5000)]
    got = mk.media_from_texts(spark.createDataFrame(rows, "doc_id long, text string"))
    seen = {}
    for r in got.collect():
        raw = next((t or "") for i, t in rows if i == r.doc_id).encode()
        payload = raw + b" " * (192 - len(raw) % 192 if len(raw) % 192 or not raw else 0)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-16:]) and mk.samples(bytes(r.media)) == payload
        assert r.media_sha256 == hashlib.sha256(r.media).hexdigest() and r.media_bytes == len(r.media)
        assert seen.setdefault(raw, r.feature) == r.feature
    table = mk.packets(got).toPandas()
    assert len(table) == sum(r.payload_bytes // 192 for r in got.collect()) and table["error"].isna().all()
    bad = spark.createDataFrame([(1, b"\x1a\x45\xdf"), (2, None), (3, b"")], "doc_id long, media binary")
    assert mk.packets(bad).where("error is not null").count() == 3
    assert mk.media_from_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_malformed_media_is_reported_and_never_fails(spark):
    """Integers that are too long, endless nesting, laces over their block, and random damage."""
    good = mk.write(b"x" * 192 * 80)
    nested = mk._HEAD + b"\x18\x53\x80\x67\x01" + b"\xff" * 7 + b"\x1f\x43\xb6\x75\x01" + b"\xff" * 7 + (b"\xa0" + b"\x01" + b"\xff" * 7) * 3000
    cluster = lambda body: mk._HEAD + mk.element(mk.SEGMENT, mk.element(mk.CLUSTER, body))
    long_time = cluster(mk.element(mk.TIMESTAMP, b"\x01" * 12))
    late = cluster(mk.element(mk.TIMESTAMP, b"\xff" * 8) + mk.element(mk.SIMPLE_BLOCK, b"\x81\0\0\x80abc"))
    xiph = cluster(mk.element(mk.SIMPLE_BLOCK, b"\x81\0\0\x82\x02\xff\xff") + mk.element(mk.SIMPLE_BLOCK, b"\x81\0\0\x80abc"))
    bare = cluster(mk.element(mk.SIMPLE_BLOCK, b"\x81\0\0\x82"))
    r = random.Random(6)
    damaged = []
    for _ in range(150):
        data = bytearray(good[:r.randrange(1, len(good))] if r.random() < 0.3 else good)
        for _ in range(r.randrange(1, 6)):
            data[r.randrange(min(len(data), 400))] = r.randrange(256)
        damaged.append(bytes(data))
    media = [good, None, b"", nested, long_time, late, xiph, bare, *damaged]
    rows = spark.createDataFrame([(i, bytearray(m) if m is not None else None) for i, m in enumerate(media)], "doc_id long, media binary")
    got = mk.packets(rows).collect()
    errors = {x.doc_id: x.error for x in got if x.error is not None}
    assert {1, 2, 4, 5, 6, 7} <= errors.keys() and 0 not in errors and sum(x.doc_id == 0 for x in got) == 80
    assert "12 bytes" in errors[4] and "out of range" in errors[5] and "lacing" in errors[6] and "lacing" in errors[7]
    for x in got:  # what is listed lies inside the buffer
        assert x.error is not None or x.offset + x.size <= len(media[x.doc_id])


def test_figures_of_the_query_against_the_text(spark):
    """Stored bytes and figures, from the texts alone and a reader that looks for nothing but the frames' pattern."""
    docs = read_table(spark, SMALL, "documents")
    got = {x.doc_id: x for x in mk.media_from_texts(docs).collect()}
    for row in docs.collect():
        raw = (row.text or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        x = got[row.doc_id]
        assert (x.n_bytes, x.payload_bytes, x.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert x.tail_crc32 == zlib.crc32(payload[-16:]) and x.media_bytes == len(x.media) and x.media_sha256 == hashlib.sha256(x.media).hexdigest()
        media, at, blocks = bytes(x.media), 0, 0
        for lo in range(0, len(payload), 192 * 64):  # blocks lie in the file in order, with their bytes in one piece
            at = media.index(payload[lo:lo + 192 * 64], at) + len(payload[lo:lo + 192 * 64])
            blocks += 1
        figures = dict(f.split("=") for f in x.feature.split(";"))
        n = list(payload)
        want = {"packets": len(payload) // 192, "blocks": blocks, "clusters": -(-blocks // 16), "cues": -(-blocks // 16), "ms": len(payload) // 192 * 24,
                "sum": sum(n), "energy": sum(v * v for v in n), "peak": max(n), "crossings": sum((a >= 128) != (b >= 128) for a, b in zip(n, n[1:])),
                "steps": sum(abs(a - b) for a, b in zip(n, n[1:]))}
        assert {k: int(v) for k, v in figures.items()} == want
