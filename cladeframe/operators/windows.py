"""K-mers of whole genomes in numpy: what a task can count or hash by itself needs no row per k-mer.

Texts come as Arrow arrays and stay UTF-8.  A window is named by the place of its first
character among all characters of a batch; windows never span two texts.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Characters that the shared keys of k-mers know; windows with others are told apart as strings.
ALPHABET = "".join(map(chr, range(32, 127))) + "\n\tàáâäçèéêëíîïñóôöùúûüßÄÖÜÉÈÑÇÓ"
#: Bits of a character of the alphabet; 0 is any other character.
WIDTH = 7
assert len(ALPHABET) < 1 << WIDTH

_U = np.uint64


class Texts:
    """Bytes and characters of an Arrow array of strings; nulls are empty."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_string())
        _, at, data = texts.buffers()
        at = np.frombuffer(at, np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        self.data = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None else np.zeros(0, np.uint8)
        self._placed(at - at[0])

    @classmethod
    def of(cls, data: np.ndarray, at: np.ndarray) -> Texts:
        """Texts that are given by their bytes and where each begins, with the end."""
        new = cls.__new__(cls)
        new.data = data
        new._placed(at)
        return new

    def _placed(self, at: np.ndarray) -> None:
        #: byte of each character and of the end; character of each text and of the end
        self.byte = np.append(np.flatnonzero((self.data & 0xC0) != 0x80), len(self.data))
        self.first = np.searchsorted(self.byte, at)

    def points(self) -> np.ndarray:
        """Code points."""
        at, data = self.byte[:-1], self.data
        out = data[at].astype(np.uint32)
        for least, most, mask in ((0xC0, 0xDF, 0x1F), (0xE0, 0xEF, 0x0F), (0xF0, 0xFF, 0x07)):
            i = np.flatnonzero((out >= least) & (out <= most) & (at + 1 < len(data))) if len(data) > len(at) else ()
            if len(i):
                value = out[i] & mask
                for step in range(1, 2 + (least >= 0xE0) + (least >= 0xF0)):
                    value = (value << 6) | (data[at[i] + step] & 0x3F)
                out[i] = value | 0x80000000  # so that a code point is not taken for a leading byte
        return out & 0x7FFFFFFF

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of all windows of ``k`` characters, and how many each text has."""
        n = np.maximum(np.diff(self.first) - k + 1, 0)
        return np.arange(n.sum()) + np.repeat(self.first[:-1] - (np.cumsum(n) - n), n), n

    def kmer(self, at: int, k: int) -> str:
        return self.data[self.byte[at]:self.byte[at + k]].tobytes().decode()


def _packed(codes: np.ndarray, width: int, k: int) -> np.ndarray:
    """One number for each ``k`` codes in a row, equal only for equal ones; where they do not fit 64 bits, ranks within the batch."""
    def joined(a, wa, b, wb, by):
        n = len(b) - by
        if wa + wb > 64:
            (ua, a), (ub, b) = np.unique(a, return_inverse=True), np.unique(b, return_inverse=True)
            wa, wb = max(len(ua) - 1, 1).bit_length(), max(len(ub) - 1, 1).bit_length()
            a, b = a.astype(_U), b.astype(_U)
        return a[:n] | (b[by:] << _U(wa)), wa + wb

    part, w, p = codes.astype(_U), width, 1
    out, wo, have = None, 0, 0
    while True:
        if k & p:
            out, wo = (part, w) if out is None else joined(out, wo, part, w, have)
            have += p
        p *= 2
        if p > k:
            return out
        part, w = joined(part, w, part, w, p // 2)


def local_keys(texts: Texts, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all windows, equal within the batch for equal k-mers only, and how many each text has."""
    at, n = texts.windows(k)
    if not len(at):
        return np.zeros(0, _U), n
    points = texts.points()
    seen = np.zeros(int(points.max()) + 1, bool)
    seen[points] = True
    code = np.cumsum(seen) - 1
    return _packed(code[points], max(int(code[-1]), 1).bit_length(), k)[at], n


_CODES = np.zeros(512, np.uint8)
_CODES[[ord(c) for c in ALPHABET]] = np.arange(1, len(ALPHABET) + 1)


def shared_keys(texts: Texts, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of all windows that are the same in every task, which of the windows have one, and their places."""
    if k * WIDTH > 63:
        raise ValueError(f"keys of {k} characters do not fit")
    at, _ = texts.windows(k)
    if not len(at):
        return np.zeros(0, _U), np.zeros(0, bool), at
    codes = _CODES[np.minimum(texts.points(), len(_CODES) - 1)]
    keys = _packed(codes, WIDTH, k)[at]
    strange = np.concatenate(([0], np.cumsum(codes == 0)))
    return keys, strange[at + k] == strange[at], at


def per_genome(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorts keys within each genome (``n`` of them each): where each distinct key begins, how often it occurs, and ends of the genomes among these."""
    keys, ends = keys, np.cumsum(n)
    for a, b in zip(ends - n, ends):
        keys[a:b].sort()
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    starts = (ends - n)[n > 0]
    new[starts] = True
    begin = np.flatnonzero(new)
    return begin, np.diff(np.append(begin, len(keys))), np.searchsorted(begin, ends)


def sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of each stretch of ``values`` up to the next of ``ends``."""
    total = np.concatenate(([0], np.cumsum(values)))
    return np.diff(np.concatenate(([0], total[ends])))


def gathered(batch: pa.RecordBatch, column: str = "seqs") -> tuple[Texts, np.ndarray]:
    """Texts of all genomes of a batch in a row, and at which text each genome ends."""
    lists = batch.column(column)
    lists = lists.cast(pa.large_list(pa.large_string()))
    ends = np.cumsum([0 if x is None else x for x in lists.value_lengths().to_pylist()]) if len(lists) else np.zeros(0, int)
    return Texts(lists.flatten()), ends.astype(np.int64)


def pieces(batches: Iterator[pa.RecordBatch], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each has about ``most`` bytes of text."""
    for batch in batches:
        rows = max(1, int(batch.num_rows * most / max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


_SHIFTS = np.array([7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4)
_SINES = (np.abs(np.sin(np.arange(1, 65, dtype=np.float64))) * 2 ** 32).astype(np.uint64).astype(np.uint32)


def _md5_head(words: np.ndarray) -> np.ndarray:
    """The first 60 bits of the MD5 of messages of one block, ``words[16, n]``."""
    start = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    n = words.shape[1]
    a, b, c, d = (np.full(n, x, np.uint32) for x in start)
    f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
            g = i
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
            g = (5 * i + 1) % 16
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
            g = (3 * i + 5) % 16
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
            g = 7 * i % 16
        a += f
        a += _SINES[i]
        a += words[g]
        s = int(_SHIFTS[i])
        np.left_shift(a, np.uint32(s), out=t)
        a >>= np.uint32(32 - s)
        a |= t
        a += b
        a, d, c, b = d, c, b, a
    high, low = (a + start[0]).byteswap().astype(_U), (b + start[1]).byteswap().astype(_U)
    return (high << _U(28)) | (low >> _U(4))


#: By the bytes of a message from a word on: those kept of it, and the mark after the last one (-1: it is over).
_KEPT = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)
_ENDS = np.array([0x80, 0x8000, 0x800000, 0x80000000, 0, 0], np.uint32)


def md5_head(texts: Texts, at: np.ndarray, k: int) -> np.ndarray:
    """The first 15 hexadecimal digits of the MD5 of the k-mers at some places."""
    begin, end = texts.byte[at], texts.byte[at + k]
    size, out = end - begin, np.empty(len(at), _U)
    padded = np.concatenate((texts.data, np.zeros(64, np.uint8)))
    for i in np.flatnonzero(size > 55):
        out[i] = int(hashlib.md5(padded[begin[i]:end[i]].tobytes()).hexdigest()[:15], 16)
    short = np.flatnonzero(size <= 55)
    four = np.ndarray(len(padded) - 3, "<u4", padded, strides=(1,))
    for low in range(0, len(short), 32768):
        part = short[low:low + 32768]
        words, place = np.zeros((16, len(part)), np.uint32), begin[part]
        for j in range(int(size[part].max()) // 4 + 1):
            left = size[part] - 4 * j
            words[j] = (four[np.minimum(place + 4 * j, len(four) - 1)] & _KEPT[np.clip(left, 0, 4)]) | _ENDS[np.clip(left, -1, 4)]
        words[14] = size[part] * 8
        out[part] = _md5_head(words)
    return out


class PortableBits:
    """Bits of k-mers by MD5; those met lately are looked up, so a frequent k-mer is hashed seldom."""

    def __init__(self, k: int, filter_size: int, slots: int = 22):
        self.k, self.size, self.shift = k, filter_size, _U(64 - slots)
        self.known, self.value = np.zeros(1 << slots, _U), np.zeros(1 << slots, np.int64)
        self.turn = np.zeros(1 << slots, np.int32)

    def __call__(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Bits of all windows, and how many windows each text has."""
        at, n = texts.windows(self.k)
        out = np.empty(len(at), np.int64)
        if self.k * WIDTH > 63:
            return (md5_head(texts, at, self.k) % _U(self.size)).astype(np.int64), n
        # no key is 0, as every character of the alphabet has a code above it
        keys, plain, _ = shared_keys(texts, self.k)
        slot = ((keys * _U(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)
        met = plain & (self.known[slot] == keys)
        out[met] = self.value[slot[met]]
        rest = np.flatnonzero(plain & ~met)
        if len(rest):
            # one of those of a slot is hashed for all of the same key
            place, i = slot[rest], np.arange(len(rest), dtype=np.int32)
            self.turn[place] = i
            one = self.turn[place]
            same = keys[rest[one]] == keys[rest]
            hashed, value = np.flatnonzero((one == i) | ~same), np.zeros(len(rest), np.int64)
            value[hashed] = md5_head(texts, at[rest[hashed]], self.k) % _U(self.size)
            out[rest] = np.where(same, value[one], value)
            held = np.flatnonzero(one == i)
            self.known[place[held]], self.value[place[held]] = keys[rest[held]], value[held]
        rest = np.flatnonzero(~plain)
        out[rest] = (md5_head(texts, at[rest], self.k) % _U(self.size)).astype(np.int64)
        return out, n


_P1, _P2, _P3, _P4, _P5 = map(_U, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return (x << _U(by)) | (x >> _U(64 - by))


def _lane(x: np.ndarray) -> np.ndarray:
    return _rotated(x * _P2, 31) * _P1


def _xx(padded: np.ndarray, begin: np.ndarray, size: int, seed: int = 42) -> np.ndarray:
    """Spark's ``xxhash64`` of the ``size`` bytes from each place."""
    eight = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
    at = begin
    with np.errstate(over="ignore"):
        if size >= 32:
            v = [np.full(len(begin), x, _U) for x in (_U(seed) + _P1 + _P2, _U(seed) + _P2, _U(seed), _U(seed) - _P1)]
            for _ in range(size // 32):
                for i in range(4):
                    v[i] = _rotated(v[i] + eight[at + 8 * i] * _P2, 31) * _P1
                at = at + 32
            h = _rotated(v[0], 1) + _rotated(v[1], 7) + _rotated(v[2], 12) + _rotated(v[3], 18)
            for x in v:
                h = (h ^ _lane(x)) * _P1 + _P4
        else:
            h = np.full(len(begin), _U(seed) + _P5, _U)
        h = h + _U(size)
        left = size % 32
        while left >= 8:
            h = _rotated(h ^ _lane(eight[at]), 27) * _P1 + _P4
            at, left = at + 8, left - 8
        if left >= 4:
            h = _rotated(h ^ ((eight[at] & _U(0xFFFFFFFF)) * _P1), 23) * _P2 + _P3
            at, left = at + 4, left - 4
        for i in range(left):
            h = _rotated(h ^ (padded[at + i].astype(_U) * _P5), 11) * _P1
        h = (h ^ (h >> _U(33))) * _P2
        h = (h ^ (h >> _U(29))) * _P3
        return h ^ (h >> _U(32))


def xxhash(texts: Texts, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Spark's ``xxhash64`` of all windows, and how many each text has."""
    at, n = texts.windows(k)
    begin = texts.byte[at]
    size = texts.byte[at + k] - begin
    padded = np.concatenate((texts.data, np.zeros(16, np.uint8)))
    out = np.empty(len(at), np.int64)
    for low in range(0, len(at), 1 << 15):
        s, b = size[low:low + (1 << 15)], begin[low:low + (1 << 15)]
        part = out[low:low + (1 << 15)]
        for each in np.flatnonzero(np.bincount(s)):
            i = np.flatnonzero(s == each)
            part[i] = _xx(padded, b[i], int(each)).view(np.int64)
    return out, n


#: Parts into which counted k-mers are dealt.
BUCKETS = 2048


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and how often each occurs; sorts ``keys``."""
    keys.sort()
    begin = np.flatnonzero(np.concatenate((np.ones(min(len(keys), 1), bool), keys[1:] != keys[:-1])))
    return keys[begin], np.diff(np.append(begin, len(keys)))


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and sums of the counts of several such tables, which a stable sort joins run by run."""
    keys, counts = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    begin = np.flatnonzero(np.concatenate((np.ones(min(len(keys), 1), bool), keys[1:] != keys[:-1])))
    return keys[begin], np.add.reduceat(counts, begin) if len(begin) else counts


def _planes(x: np.ndarray) -> bytes:
    """Whole numbers, byte by byte of their places, compressed."""
    most = max(int(x.max()).bit_length() + 7 >> 3, 1) if len(x) else 1
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :most].T)
    return len(x).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True) + bytes([most])


def _from_planes(blob: bytes) -> np.ndarray:
    n, most = int.from_bytes(blob[:8], "little"), blob[-1]
    out = np.zeros((n, 8), np.uint8)
    out[:, :most] = np.frombuffer(pa.decompress(blob[8:-1], n * most, "zstd", asbytes=True), np.uint8).reshape(most, n).T
    return out.reshape(-1).view("<u8")


def _dealt(keys: np.ndarray, counts: np.ndarray, k: int) -> Iterator[tuple[int, bytes, bytes]]:
    """Counted keys by bucket; the last four characters make it, so that neighbours in order stay together and differ by little."""
    bucket = (((keys >> _U(WIDTH * max(k - 4, 0))) * _U(0x9E3779B97F4A7C15)) >> _U(64 - BUCKETS.bit_length() + 1)).astype(np.uint16)
    order = np.argsort(bucket, kind="stable")
    ends = np.searchsorted(bucket[order], np.arange(BUCKETS + 1))
    for i in np.flatnonzero(np.diff(ends)):
        own = order[ends[i]:ends[i + 1]]
        yield int(i), _planes(np.diff(keys[own], prepend=_U(0))), _planes(counts[own])


def bucketed_counts(batches: Iterator[pa.RecordBatch], k: int, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """``bucket, keys, counts`` of the texts in the first column of ``batches``.

    A task holds up to about ``most`` distinct k-mers before it passes them on.  Windows with
    characters outside of the alphabet are counted as strings: ``counts`` is null there.
    """
    held, waiting, n, strange = [], [], 0, Counter()

    def out(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], names=["bucket", "keys", "counts"])

    def flushed() -> Iterator[pa.RecordBatch]:
        rows = []
        for keys, counts in held:
            rows += _dealt(keys, counts, k)
        parts: dict[int, dict] = {}
        for kmer, c in strange.items():
            parts.setdefault(zlib.crc32(kmer.encode()) % BUCKETS, {})[kmer] = c
        rows += [(i, json.dumps(part).encode(), None) for i, part in parts.items()]
        held.clear()
        strange.clear()
        for at in range(0, len(rows), 256):
            yield out(rows[at:at + 256])

    def settle() -> None:
        if waiting:
            fresh = counted(np.concatenate(waiting))
            held[:] = [merged([*held, fresh]) if held else fresh]
            waiting.clear()

    for batch in pieces(batches):
        texts = Texts(batch.column(0))
        keys, plain, at = shared_keys(texts, k)
        waiting.append(keys[plain])
        n += len(waiting[-1])
        strange.update(texts.kmer(a, k) for a in at[~plain].tolist())
        if n >= most:
            settle()
            n = 0
        if (held and len(held[0][0]) >= most) or len(strange) > most >> 4:
            yield from flushed()
    settle()
    yield from flushed()


def bucket_histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``occurrences, n_kmers`` of whole buckets, whose rows come one after another."""
    total: Counter = Counter()

    def settle(parts: list, strings: Counter) -> None:
        if parts:
            total.update(dict(zip(*(x.tolist() for x in np.unique(merged(parts)[1], return_counts=True)))))
        total.update(Counter(strings.values()))

    at, parts, strings = None, [], Counter()
    for batch in batches:
        for bucket, keys, counts in zip(*(c.to_pylist() for c in batch.columns)):
            if bucket != at:
                settle(parts, strings)
                at, parts, strings = bucket, [], Counter()
            if counts is None:
                strings.update(json.loads(keys))
            else:
                parts.append((np.cumsum(_from_planes(keys), dtype=_U), _from_planes(counts).astype(np.int64)))
    settle(parts, strings)
    yield pa.RecordBatch.from_pydict({"occurrences": pa.array(list(total), pa.int64()), "n_kmers": pa.array(list(total.values()), pa.int64())})


class Unions:
    """Bitmaps of the portable sketches of groups, in buckets of 32768 bits as Spark packs them."""

    def __init__(self, k: int, filter_size: int, most: int = 64):
        self.bits, self.size, self.most = PortableBits(k, filter_size), -(-filter_size // 32768) * 32768, most
        self.held: dict = {}

    def flush(self) -> list[tuple]:
        rows = []
        for name, seen in self.held.items():
            parts = np.packbits(seen.reshape(-1, 32768), axis=1, bitorder="little")
            rows += [(name, i + 1, parts[i].tobytes()) for i in np.flatnonzero(parts.any(axis=1)).tolist()]
        self.held.clear()
        return rows

    def add(self, texts: pa.Array, names: list) -> Iterator[list[tuple]]:
        bits, n = self.bits(Texts(texts))
        ends = np.cumsum(n)
        for name, a, b in zip(names, (ends - n).tolist(), ends.tolist()):
            if a < b:
                if name not in self.held:
                    if len(self.held) >= self.most:
                        yield self.flush()
                    self.held[name] = np.zeros(self.size, bool)
                self.held[name][bits[a:b]] = True


#: Characters of the parts of a k-mer of which the least, by a digest, says to which bucket it goes.
PART = 5


def runs(texts: Texts, k: int, tail: int = 0) -> tuple[np.ndarray, ...]:
    """``text, begin, end, digest, n`` of stretches of ``n`` neighbouring k-mers with the same least part: their text, bytes and that part's digest.

    The bytes hold up to ``tail`` more characters, as far as the text goes.

    Equal k-mers have equal digests wherever they stand, so those of a stretch can travel as
    one piece of text, which is a fraction of their number in bytes.
    """
    at, n = texts.windows(k)
    if not len(at):
        return (*(np.zeros(0, np.int64),) * 3, np.zeros(0, _U), np.zeros(0, np.int64))
    least = texts.points().astype(_U)
    size = min(PART, k)
    code = np.zeros(len(least) - size + 1, _U)
    for i in range(size):
        code = (code ^ least[i:i + len(code)]) * _U(0x9E3779B97F4A7C15)
        code ^= code >> _U(29)
    have, span = 1, k - size + 1
    while have < span:
        step = min(have, span - have)
        code = np.minimum(code[:-step], code[step:])
        have += step
    digest = code[at]
    new = np.ones(len(at), bool)
    new[1:] = digest[1:] != digest[:-1]
    text = np.repeat(np.arange(len(n)), n)
    new[1:] |= text[1:] != text[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    end = np.minimum(at[last] + k + tail, texts.first[text[first] + 1])
    return text[first], texts.byte[at[first]], texts.byte[end], digest[first], last - first + 1


def _compressed(text: np.ndarray) -> bytes:
    return len(text).to_bytes(8, "little") + pa.Codec("zstd", compression_level=3).compress(text.tobytes(), asbytes=True)


def _decompressed(blob: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True), np.uint8)


def _run_order(data: np.ndarray, begin: np.ndarray, digest: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Stretches by bucket, there like ones together so that they compress, and where each bucket ends."""
    bucket = (digest * _U(0xD6E8FEB86659FD93) >> _U(40)) % _U(buckets)
    head = np.ndarray(len(data), ">u8", np.concatenate((data, np.zeros(7, np.uint8))), strides=(1,))[begin].astype(_U)
    order = np.lexsort((head, digest, bucket))
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


#: Windows of a bucket that are sorted at once, and bytes of text that are hashed at once.
SORTED, HASHED = 4 << 20, 1 << 20


def _by_part(columns: list[tuple[np.ndarray, ...]], digest: Callable[[tuple], np.ndarray]) -> Iterator[tuple[np.ndarray, ...]]:
    """The columns of several tables joined, in parts by a digest of about ``SORTED`` rows; releases the tables."""
    parts = -(-sum(len(c[0]) for c in columns) // SORTED)
    if parts > 1:
        split = [[] for _ in range(parts)]
        while columns:
            table = columns.pop()
            own = ((digest(table) * _U(0x9E3779B97F4A7C15)) >> _U(32)) % _U(parts)
            for i in range(parts):
                split[i].append(tuple(c[own == i] for c in table))
    else:
        split = [columns]
    for tables in split:
        yield tuple(np.concatenate(c) for c in zip(*tables))
        tables.clear()


def _joined(rows: list[tuple], size: Callable[[tuple], int]) -> Iterator[list[tuple]]:
    """Rows in groups of about ``HASHED`` bytes of text."""
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += size(row)
        if n >= HASHED:
            yield held
            held, n = [], 0
    if held:
        yield held


def _of_runs(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    size = end - begin
    return data[np.arange(size.sum()) + np.repeat(begin - (np.cumsum(size) - size), size)]


def bucketed_runs(batches: Iterator[pa.RecordBatch], k: int, buckets: int = 1024, most: int = 48 << 20) -> Iterator[pa.RecordBatch]:
    """``bucket, labels, owners, sizes, runs``: stretches of the k-mers of ``seq, label`` (the columns of ``batches``), by bucket."""
    held, n, names = [], 0, {}

    def flushed() -> Iterator[pa.RecordBatch]:
        if not held:
            return
        owner, size, digest = (np.concatenate(x) for x in list(zip(*held))[:3])
        data = np.concatenate([h[3] for h in held])
        begin = np.cumsum(size) - size
        order, ends = _run_order(data, begin, digest, buckets)
        label, rows = np.array(list(names), object), []
        for i in np.flatnonzero(np.diff(ends)).tolist():
            own = order[ends[i]:ends[i + 1]]
            used, code = np.unique(owner[own], return_inverse=True)
            text = _of_runs(data, begin[own], begin[own] + size[own])
            rows.append((i, label[used].tolist(), _planes(code), _planes(size[own]), _compressed(text)))
            if len(rows) == 64:
                yield packed(rows)
                rows = []
        held.clear()
        names.clear()
        if rows:
            yield packed(rows)

    def packed(rows: list) -> pa.RecordBatch:
        types = (pa.int32(), pa.list_(pa.string()), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["bucket", "labels", "owners", "sizes", "runs"])

    for batch in pieces(batches):
        texts = Texts(batch.column(0))
        text, begin, end, digest, _ = runs(texts, k)
        if len(text):
            codes = np.array([names.setdefault(x, len(names)) for x in batch.column(1).to_pylist()])
            held.append((codes[text], end - begin, digest, _of_runs(texts.data, begin, end)))
            n += len(held[-1][3])
        if n >= most:
            yield from flushed()
            n = 0
    yield from flushed()


def node_sizes(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """``node, n``: distinct bits of each node of the labels, over the whole buckets of a task."""
    total: Counter = Counter()

    def settle(rows: list[tuple]) -> None:
        names = sorted({x for labels, *_ in rows for x in labels})
        place, hashed = {x: i for i, x in enumerate(names)}, []
        for group in _joined(rows, lambda row: int.from_bytes(row[3][:8], "little")):
            size = np.concatenate([_from_planes(sizes) for _, _, sizes, _ in group]).astype(np.int64)
            data = np.concatenate([_decompressed(text) for *_, text in group])
            owner = np.concatenate([np.array([place[x] for x in labels], np.int32)[_from_planes(owners).astype(np.int64)] for labels, owners, *_ in group])
            bits, n = xxhash(Texts.of(data, np.concatenate(([0], np.cumsum(size)))), k)
            hashed.append((bits, np.repeat(owner, n)))
        rows.clear()
        parts = [x.split("|") for x in names]
        for bits, owner in _by_part(hashed, lambda table: table[0].view(_U)):
            order = np.lexsort((owner, bits)) if len(names) > 1 else np.argsort(bits)
            bits, owner = bits[order], owner[order]
            fresh = np.ones(len(bits), bool)
            fresh[1:] = bits[1:] != bits[:-1]
            for depth in range(1, max(map(len, parts)) + 1):
                # labels are in order, so those below a node are next to each other
                nodes: dict = {}
                code = np.array([nodes.setdefault("|".join(p[:depth]), len(nodes)) for p in parts])[owner]
                new = fresh.copy()
                new[1:] |= code[1:] != code[:-1]
                for node, count in zip(nodes, np.bincount(code[new], minlength=len(nodes)).tolist()):
                    total[node] += count

    at, rows = None, []
    for batch in batches:
        for bucket, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if bucket != at and rows:
                settle(rows)
                rows = []
            at = bucket
            rows.append(row)
    if rows:
        settle(rows)
    yield pa.RecordBatch.from_pydict({"node": pa.array(list(total), pa.string()), "n": pa.array(list(total.values()), pa.int64())})


def bucketed_prefixes(batches: Iterator[pa.RecordBatch], least: int, longest: int, buckets: int = 1024, most: int = 48 << 20) -> Iterator[pa.RecordBatch]:
    """``bucket, sizes, starts, runs``: stretches of text by the bucket of the ``least`` characters from each place, with what is needed for ``longest``."""
    held, n = [], 0

    def flushed() -> Iterator[pa.RecordBatch]:
        if not held:
            return
        size, digest, starts, data = (np.concatenate(x) for x in zip(*held))
        held.clear()
        begin, rows = np.cumsum(size) - size, []
        order, ends = _run_order(data, begin, digest, buckets)
        for i in np.flatnonzero(np.diff(ends)).tolist():
            own = order[ends[i]:ends[i + 1]]
            text = _of_runs(data, begin[own], begin[own] + size[own])
            rows.append((i, _planes(size[own]), _planes(starts[own]), _compressed(text)))
        for at in range(0, len(rows), 64):
            part = rows[at:at + 64]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.binary(), pa.binary()))],
                                             names=["bucket", "sizes", "starts", "runs"])

    for batch in pieces(batches):
        texts = Texts(batch.column(0))
        _, begin, end, digest, starts = runs(texts, least, longest - least)
        if len(begin):
            held.append((end - begin, digest, starts, _of_runs(texts.data, begin, end)))
            n += len(held[-1][3])
        if n >= most:
            yield from flushed()
            n = 0
    yield from flushed()


def _words(data: np.ndarray, size: np.ndarray, starts: np.ndarray, most: int, width: int, table: np.ndarray, known: list[int]) -> tuple[np.ndarray, ...] | None:
    """The first ``most`` characters from each place of stretches as words of codes, and how many there are; None if codes of ``width`` bits run out.

    ``table`` has the codes of characters and grows by those that are new; ``known`` counts them.  Code 0 is no character.
    """
    texts = Texts.of(data, np.concatenate(([0], np.cumsum(size))))
    points = texts.points()
    codes = table[points]
    if not codes.all():
        new = np.unique(points[codes == 0])
        if known[0] + len(new) >= 1 << width:
            return None
        table[new] = np.arange(known[0] + 1, known[0] + len(new) + 1)
        known[0] += len(new)
        codes = table[points]
    at = np.arange(starts.sum()) + np.repeat(texts.first[:-1] - (np.cumsum(starts) - starts), starts)
    left = np.minimum(np.repeat(texts.first[1:], starts) - at, most).astype(np.uint16)
    codes, per, words = np.concatenate((codes, np.zeros(most, codes.dtype))), 64 // width, []
    masks = np.array([((1 << width * i) - 1) << width * (per - i) for i in range(per + 1)], _U)
    for low in range(0, most, per):
        word = np.zeros(len(points), _U)
        for i in range(low, min(low + per, most)):
            word |= codes[i:i + len(points)].astype(_U) << _U(width * (per - 1 - i + low))
        # what is beyond the end of a stretch belongs to the next
        words.append(word[at] & masks[np.clip(left.astype(np.int64) - low, 0, per)])
    return (*words, left)


def _prefixes(rows: list[tuple], lengths: list[int]) -> list[int]:
    """How many strings of each length begin at the places of stretches ``(sizes, starts, runs)``, all of which hold the first of ``lengths``; exact."""
    for width in (8, 16, 21):
        table, known, tables = np.zeros(0x110000, np.uint32), [0], []
        for group in _joined(rows, lambda row: int.from_bytes(row[2][:8], "little")):
            size, starts = (np.concatenate([_from_planes(row[i]) for row in group]).astype(np.int64) for i in (0, 1))
            tables.append(_words(np.concatenate([_decompressed(row[2]) for row in group]), size, starts, lengths[-1], width, table, known))
            if tables[-1] is None:
                break
        else:
            break
    per, found = 64 // width, [0] * len(lengths)

    def prefix(words: tuple, k: int) -> Iterator[np.ndarray]:
        for j, low in enumerate(range(0, k, per)):
            yield words[j] >> _U(width * max(low + per - k, 0))

    def digest(words: tuple) -> np.ndarray:
        out = np.zeros(len(words[0]), _U)
        for part in prefix(words, lengths[0]):
            out = (out ^ part) * _U(0xBF58476D1CE4E5B9)
            out ^= out >> _U(31)
        return out

    for *words, left in _by_part(tables, digest):
        order = np.lexsort(words[::-1])
        words, left = [x[order] for x in words], left[order]
        for i, k in enumerate(lengths):
            # places without so many characters have no string of this length; those with the same prefix of it are next to each other
            new = np.zeros(len(left), bool)
            for part in prefix(words, k):
                new[1:] |= part[1:] != part[:-1]
            found[i] += int(np.count_nonzero(np.bincount(np.cumsum(new)[left >= k], minlength=1)))
    return found


def prefix_counts(batches: Iterator[pa.RecordBatch], lengths: list[int]) -> Iterator[pa.RecordBatch]:
    """``k, n``: distinct k-mers of each length over the whole buckets of a task."""
    total, at, held = dict.fromkeys(lengths, 0), None, []

    def settle() -> None:
        if held:
            for k, n in zip(lengths, _prefixes(held, lengths)):
                total[k] += n
            held.clear()

    for batch in batches:
        for bucket, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if bucket != at:
                settle()
            at = bucket
            held.append(row)
    settle()
    yield pa.RecordBatch.from_pydict({"k": pa.array(list(total), pa.int32()), "n": pa.array(list(total.values()), pa.int64())})
