"""Matroska media columns: EBML elements, clusters, laced blocks and cues.

``write`` stores bytes losslessly as 8-bit PCM samples; ``parse`` walks the
variable-length elements of any Matroska buffer (known or unknown sizes) and
lists every frame with its track, timestamp and byte range; ``packets`` turns a
media column into a packet table.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.llm.common import map_texts

# Element ids of the Matroska and EBML specifications (RFC 8794, RFC 9559).
EBML, EBML_VERSION, EBML_READ_VERSION = 0x1A45DFA3, 0x4286, 0x42F7
EBML_MAX_ID, EBML_MAX_SIZE = 0x42F2, 0x42F3
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, MUXING_APP, WRITING_APP, DURATION = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4D80, 0x5741, 0x4489
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83
FLAG_LACING, CODEC_ID, DEFAULT_DURATION = 0x9C, 0x86, 0x23E383
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
SEEK_HEAD, TAGS, CHAPTERS, ATTACHMENTS = 0x114D9B74, 0x1254C367, 0x1043A770, 0x1941A469

_TOP = {SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES, TAGS, CHAPTERS, ATTACHMENTS, SEGMENT, EBML}
FRAME_BYTES, RATE, LACE, BLOCKS_PER_CLUSTER = 192, 8000, 64, 16


class MatroskaError(ValueError):
    """The buffer is not well-formed Matroska."""


# -- writing -----------------------------------------------------------------


def _size(n: int) -> bytes:
    """Shortest size field; all-ones values are reserved for unknown sizes."""
    width = 1
    while n >= (1 << 7 * width) - 1:
        width += 1
    return (n | 1 << 7 * width).to_bytes(width, "big")


def _uint(n: int) -> bytes:
    return n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big")


def element(kind: int, data: bytes) -> bytes:
    return _uint(kind) + _size(len(data)) + data


def _header() -> bytes:
    return element(EBML, b"".join([
        element(EBML_VERSION, b"\x01"), element(EBML_READ_VERSION, b"\x01"), element(EBML_MAX_ID, b"\x04"),
        element(EBML_MAX_SIZE, b"\x08"), element(DOC_TYPE, b"matroska"), element(DOC_TYPE_VERSION, b"\x04"),
        element(DOC_TYPE_READ_VERSION, b"\x02")]))


def _tracks() -> bytes:
    audio = element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">f", RATE)) + element(CHANNELS, b"\x01")
                    + element(BIT_DEPTH, b"\x08"))
    return element(TRACKS, element(TRACK_ENTRY, b"".join([
        element(TRACK_NUMBER, b"\x01"), element(TRACK_UID, b"\x01"), element(TRACK_TYPE, b"\x02"),
        element(FLAG_LACING, b"\x01"), element(DEFAULT_DURATION, _uint(FRAME_BYTES * 10**9 // RATE)),
        element(CODEC_ID, b"A_PCM/INT/LIT"), audio])))


_HEAD, _TRACKS = _header(), _tracks()


def write(payload: bytes) -> bytes:
    """A Matroska file whose single track holds ``payload`` as 8-bit samples.

    The payload must be a positive multiple of the frame size; frames are laced
    with fixed sizes, a cue point names every cluster.
    """
    if not payload or len(payload) % FRAME_BYTES:
        raise ValueError(f"payload must be a positive multiple of {FRAME_BYTES} bytes")
    frame_ms = FRAME_BYTES * 1000 // RATE
    info = element(INFO, b"".join([
        element(TIMESTAMP_SCALE, _uint(10**6)), element(MUXING_APP, b"cladeframe"), element(WRITING_APP, b"cladeframe"),
        element(DURATION, struct.pack(">d", len(payload) // FRAME_BYTES * frame_ms))]))
    parts, at, cues = [info, _TRACKS], len(info) + len(_TRACKS), []
    step = FRAME_BYTES * LACE
    for lo in range(0, len(payload), step * BLOCKS_PER_CLUSTER):
        time = lo // FRAME_BYTES * frame_ms
        body = [element(TIMESTAMP, _uint(time))]
        for b in range(lo, min(lo + step * BLOCKS_PER_CLUSTER, len(payload)), step):
            data = payload[b:b + step]
            frames = len(data) // FRAME_BYTES
            lacing = bytes([0x84, frames - 1]) if frames > 1 else b"\x80"
            body.append(element(SIMPLE_BLOCK, b"\x81" + struct.pack(">h", b // FRAME_BYTES * frame_ms - time)
                                + lacing + data))
        cues.append(element(CUE_POINT, element(CUE_TIME, _uint(time)) + element(
            CUE_TRACK_POSITIONS, element(CUE_TRACK, b"\x01") + element(CUE_CLUSTER_POSITION, _uint(at)))))
        cluster = element(CLUSTER, b"".join(body))
        parts.append(cluster)
        at += len(cluster)
    parts.append(element(CUES, b"".join(cues)))
    return _HEAD + element(SEGMENT, b"".join(parts))


# -- reading -----------------------------------------------------------------


def _vint(data: bytes, at: int, end: int, keep_marker: bool) -> tuple[int, int, bool]:
    """Value of a variable-length integer, the place after it, whether it is all ones."""
    if at >= end or not data[at]:
        raise MatroskaError(f"no variable-length integer at byte {at}")
    width = 9 - data[at].bit_length()
    if at + width > end:
        raise MatroskaError(f"truncated integer at byte {at}")
    value = int.from_bytes(data[at:at + width], "big")
    plain = value & (1 << 7 * width) - 1
    return (value if keep_marker else plain), at + width, plain == (1 << 7 * width) - 1


def _elements(data: bytes, at: int, end: int, stop: frozenset | set = frozenset()):
    """``(id, first, last, place)`` of the elements between two places.

    An element of unknown size ends where one of ``_TOP`` begins on its level.
    """
    while at < end:
        kind, body, _ = _vint(data, at, end, True)
        if kind in stop:
            return
        size, body, unknown = _vint(data, body, end, False)
        last = body + size
        if unknown:
            last = end if kind in (SEGMENT, EBML) else _end_of_unknown(data, body, end)
        if last > end:
            raise MatroskaError(f"element {kind:#x} at byte {at} runs over its parent")
        yield kind, body, last, at
        at = last


def _end_of_unknown(data: bytes, at: int, end: int) -> int:
    """Where an element of unknown size ends; those inside of it that are unknown as well end there too."""
    while at < end:
        kind, body, _ = _vint(data, at, end, True)
        if kind in _TOP:
            return at
        size, body, unknown = _vint(data, body, end, False)
        at = body if unknown else body + size
    if at > end:
        raise MatroskaError(f"an element runs over its parent at byte {end}")
    return at


def _number(data: bytes, lo: int, hi: int) -> int:
    if hi - lo > 8:
        raise MatroskaError(f"integer of {hi - lo} bytes at byte {lo}")
    return int.from_bytes(data[lo:hi], "big")


def _frames(data: bytes, lo: int, hi: int) -> tuple[int, int, int, list[tuple[int, int]]]:
    """Track, relative time, flags and the byte ranges of a block's frames."""
    track, at, _ = _vint(data, lo, hi, False)
    if at + 3 > hi:
        raise MatroskaError(f"truncated block at byte {lo}")
    time, flags = struct.unpack_from(">hB", data, at)
    at += 3
    lacing = flags >> 1 & 3
    if not lacing:
        return track, time, flags, [(at, hi - at)]
    if at >= hi:
        raise MatroskaError(f"truncated lacing at byte {lo}")
    n = data[at] + 1
    at += 1
    if lacing == 2:  # fixed sizes
        each, rest = divmod(hi - at, n)
        if rest:
            raise MatroskaError(f"fixed lacing doesn't divide the block at byte {lo}")
        return track, time, flags, [(at + k * each, each) for k in range(n)]
    sizes = []
    if lacing == 1:  # sums of bytes up to one below 255
        for _ in range(n - 1):
            size = 0
            while at < hi and data[at] == 255:
                size, at = size + 255, at + 1
            if at >= hi:
                raise MatroskaError(f"truncated lacing at byte {lo}")
            sizes.append(size + data[at])
            at += 1
    else:  # a first size, then signed differences
        for k in range(n - 1):
            value, after, _ = _vint(data, at, hi, False)
            if k:
                value += sizes[-1] - (1 << 7 * (after - at) - 1) + 1
            sizes.append(value)
            at = after
    sizes.append(hi - at - sum(sizes))
    if min(sizes) < 0:
        raise MatroskaError(f"laces run over the block at byte {lo}")
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return track, time, flags, out


def parse(data: bytes) -> dict:
    """Tracks, packets and cues of a Matroska buffer.

    ``packets``: ``(track, timestamp_ns, keyframe, offset, size, cluster, block)``
    in file order; ``tracks``: number -> codec, kind, default duration, sampling rate,
    channels, bit depth; ``cues``: ``(timestamp_ns, track, cluster place)``.
    """
    scale, tracks, packets, cues, clusters, blocks = 10**6, {}, [], [], [], 0
    found = False
    for kind, lo, hi, _ in _elements(data, 0, len(data)):
        if kind != SEGMENT:
            continue
        found = True
        for top, a, b, place in _elements(data, lo, hi):
            if top == INFO:
                for k, x, y, _ in _elements(data, a, b):
                    if k == TIMESTAMP_SCALE:
                        scale = _number(data, x, y)
            elif top == TRACKS:
                for k, x, y, _ in _elements(data, a, b):
                    if k == TRACK_ENTRY:
                        track = _track(data, x, y)
                        tracks[track["number"]] = track
            elif top == CUES:
                for k, x, y, _ in _elements(data, a, b):
                    if k == CUE_POINT:
                        cues += _cue(data, x, y, scale, lo)
            elif top == CLUSTER:
                clusters.append(place)
                base = 0
                for k, x, y, _ in _elements(data, a, b, _TOP):
                    if k == TIMESTAMP:
                        base = _number(data, x, y)
                    elif k in (SIMPLE_BLOCK, BLOCK_GROUP):
                        spans = [(x, y)] if k == SIMPLE_BLOCK else [
                            (p, q) for g, p, q, _ in _elements(data, x, y) if g == BLOCK]
                        for p, q in spans:
                            number, time, flags, frames = _frames(data, p, q)
                            step = tracks.get(number, {}).get("default_duration", 0)
                            at = (base + time) * scale
                            if at + len(frames) * step >= 1 << 63 or place >= 1 << 63:
                                raise MatroskaError(f"timestamp out of range at byte {p}")
                            key = k == BLOCK_GROUP or bool(flags & 0x80)
                            packets += [(number, at + i * step, key, o, s, len(clusters) - 1, blocks)
                                        for i, (o, s) in enumerate(frames)]
                            blocks += 1
    if not found:
        raise MatroskaError("no segment")
    return {"tracks": tracks, "packets": packets, "cues": cues, "clusters": clusters, "blocks": blocks}


def _track(data: bytes, lo: int, hi: int) -> dict:
    out = {"number": 0, "codec": "", "kind": 0, "default_duration": 0, "rate": 8000.0, "channels": 1, "bits": 0}
    for k, x, y, _ in _elements(data, lo, hi):
        if k == TRACK_NUMBER:
            out["number"] = _number(data, x, y)
        elif k == TRACK_TYPE:
            out["kind"] = _number(data, x, y)
        elif k == CODEC_ID:
            out["codec"] = data[x:y].decode("ascii", "replace")
        elif k == DEFAULT_DURATION:
            out["default_duration"] = _number(data, x, y)
        elif k == AUDIO:
            for j, p, q, _ in _elements(data, x, y):
                if j == SAMPLING_FREQUENCY and q > p:
                    out["rate"] = struct.unpack(">f" if q - p == 4 else ">d", data[p:q])[0]
                elif j == CHANNELS:
                    out["channels"] = _number(data, p, q)
                elif j == BIT_DEPTH:
                    out["bits"] = _number(data, p, q)
    return out


def _cue(data: bytes, lo: int, hi: int, scale: int, base: int) -> list[tuple[int, int, int]]:
    time, at = 0, []
    for k, x, y, _ in _elements(data, lo, hi):
        if k == CUE_TIME:
            time = _number(data, x, y) * scale
        elif k == CUE_TRACK_POSITIONS:
            values = {j: _number(data, p, q) for j, p, q, _ in _elements(data, x, y)}
            at.append((values.get(CUE_TRACK, 0), base + values.get(CUE_CLUSTER_POSITION, 0)))
    return [(time, track, place) for track, place in at]


def samples(data: bytes, parsed: dict | None = None) -> bytes:
    """The stored bytes, read back through the packets' byte ranges."""
    parsed = parsed or parse(data)
    return b"".join([data[o:o + s] for _, _, _, o, s, _, _ in parsed["packets"]])


def feature(payload: bytes, parsed: dict) -> str:
    """Packet and signal figures, all from integers, in one string."""
    x = np.frombuffer(payload, dtype=np.uint8).astype(np.int64)
    signs = x >= 128
    return (f"packets={len(parsed['packets'])};blocks={parsed['blocks']};clusters={len(parsed['clusters'])};"
            f"cues={len(parsed['cues'])};ms={parsed['packets'][-1][1] // 10**6 + FRAME_BYTES * 1000 // RATE};"
            f"sum={x.sum()};energy={(x * x).sum()};peak={x.max()};crossings={int((signs[1:] != signs[:-1]).sum())};"
            f"steps={int(np.abs(np.diff(x)).sum())}")


# -- tables ------------------------------------------------------------------


def media_from_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = True) -> DataFrame:
    """Store every text as media, read it back and describe it.

    The payload is the text in UTF-8 and blanks up to a positive multiple of the
    frame size (null: empty, so one frame of blanks).  Returns ``doc_id, n_bytes,
    payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature``
    and, with ``keep_media``, ``media``; one row per input row (repeated rows and null ids
    stay, an empty table gives an empty result, other columns are ignored).  What is
    hashed is read back from the stored bytes.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def store(batch):
        rows = []
        for text in batch.column(1).to_pylist():
            raw = (text or "").encode()
            media = write(raw + b" " * (FRAME_BYTES - len(raw) % FRAME_BYTES if len(raw) % FRAME_BYTES or not raw else 0))
            parsed = parse(media)
            back = samples(media, parsed)
            rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media),
                         hashlib.sha256(media).hexdigest(), feature(back, parsed), media if keep_media else None))
        cols = list(zip(*rows))
        kinds = ["int64", "int64", "string", "int64", "int64", "string", "string", "binary"]
        arrays = [pa.array(c, k) for c, k in zip(cols, kinds)][:7 + keep_media]
        return pa.RecordBatch.from_arrays([batch.column(0), *arrays], names + ["media"] * keep_media)

    schema = ("doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
              "media_bytes long, media_sha256 string, feature string" + ", media binary" * keep_media)
    return map_texts(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), store, schema)


def packets(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Packet table of a media column, without touching the payload bytes.

    Returns ``doc_id, packet, track, codec, timestamp_ns, keyframe, offset, size,
    cluster, block``.  A null or malformed buffer gives one row whose ``error`` says
    why and whose other columns but ``doc_id`` are null; a file without frames gives no
    row, as does an empty table; repeated rows have their packets each.  Other columns of
    the input are ignored.
    """
    names = ["doc_id", "packet", "track", "codec", "timestamp_ns", "keyframe", "offset", "size", "cluster", "block", "error"]

    def table(batch):
        rows = []
        for key, media in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            try:
                if media is None:
                    raise MatroskaError("null")
                parsed = parse(media)
            except (MatroskaError, IndexError, OverflowError, struct.error) as e:
                rows.append((key, *[None] * 9, str(e)))
                continue
            for i, (t, at, key_frame, o, s, c, b) in enumerate(parsed["packets"]):
                codec = parsed["tracks"].get(t, {}).get("codec")
                rows.append((key, i, t, codec, at, key_frame, o, s, c, b, None))
        if not rows:
            return None
        kinds = ["int64", "int64", "int64", "string", "int64", "bool", "int64", "int64", "int64", "int64", "string"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    schema = ("doc_id long, packet long, track long, codec string, timestamp_ns long, keyframe boolean, "
              "offset long, size long, cluster long, block long, error string")
    media = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(media_col).alias("media"))
    return map_texts(media, table, schema, "media")
