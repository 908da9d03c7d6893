"""Byte-level BPE by rank-synchronous merging of ragged numpy arrays.

Pre-tokens are cut out of a whole batch of texts with array operations and their
repeats within the batch are set aside.  The distinct ones are one flat symbol
array plus row numbers: each round looks up the rank of every adjacent pair,
takes each row's least rank and applies all occurrences of that pair in all rows
at once; a row is finished when no pair of it has a rank.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pandas as pd
import regex

# The endings that follow an apostrophe as a pre-token of their own.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
# The white space characters (Unicode property White_Space).
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

_LETTER, _DIGIT, _OTHER, _SPACE = range(4)
_DTYPE = np.dtype("<u4")
_NO_RANK = np.iinfo(np.int64).max


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in the vocabulary."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in keep else chr(next(rest)) for b in range(256)]


def character_classes() -> np.ndarray:
    """Letter, digit, white space or other, for every code point."""
    kind = np.full(0x110000, _OTHER, dtype=np.uint8)
    patterns = [(regex.compile(r"\p{L}+"), _LETTER), (regex.compile(r"\p{N}+"), _DIGIT)]
    # in blocks: a string for each of all code points at once takes 100 MB in every worker
    for lo in range(0, 0x110000, 0x800):
        if 0xD800 <= lo < 0xE000:
            continue
        block = "".join(map(chr, range(lo, lo + 0x800)))
        for pattern, value in patterns:
            for run in pattern.finditer(block):
                kind[lo + run.start():lo + run.end()] = value
    kind[[ord(c) for c in SPACES]] = _SPACE
    return kind


def _powers(n: int) -> np.ndarray:
    """Powers of an odd multiplier modulo 2**64."""
    out = np.full(n, 0xD6E8FEB86659FD93, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class ByteBPE:
    """Encoder for a byte-level BPE ``tokenizer.json`` (ids as its library gives them)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if (model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"]
                or not pre.get("use_regex", True) or spec["normalizer"]
                or model.get("dropout") or model.get("ignore_merges")):
            raise NotImplementedError("only plain byte-level BPE models are supported")
        special = spec["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in special):
            raise NotImplementedError("added tokens that strip or normalise are not supported")
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in special}
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") \
            if self.special else None
        self.byte_id = np.array([vocab[c] for c in byte_alphabet()], dtype=np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        key = left << 32 | right
        order = np.argsort(key, kind="stable")
        self.key, self.rank, self.made = key[order], order, made[order]
        self._hash = self._table()
        self._class = character_classes()

    # -- ranks ---------------------------------------------------------------

    def _table(self) -> np.ndarray:
        """Open-addressing hash table over the pair keys (index into ``key`` or -1)."""
        size = 1 << int(len(self.key) * 4).bit_length()
        self.mask, table = size - 1, np.full(size, -1, dtype=np.int64)
        todo, slot = np.arange(len(self.key)), self._slot(self.key)
        while len(todo):
            at = slot[todo]
            free = table[at] < 0
            table[at[free]] = todo[free]
            todo = todo[table[slot[todo]] != todo]
            slot[todo] = (slot[todo] + 1) & self.mask
        return table

    def _slot(self, key: np.ndarray) -> np.ndarray:
        h = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((h ^ (h >> np.uint64(29))) >> np.uint64(17)).astype(np.int64) & self.mask

    def _lookup(self, key: np.ndarray) -> np.ndarray:
        """Index of each pair key in the merge table, -1 where it has no rank."""
        slot = self._slot(key)
        at = self._hash[slot]
        open_ = np.flatnonzero((at >= 0) & (self.key[at] != key))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            at[open_] = self._hash[slot[open_]]
            open_ = open_[(at[open_] >= 0) & (self.key[at[open_]] != key[open_])]
        return at

    # -- merging -------------------------------------------------------------

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Surviving symbols of all words, flat, and each word's count of them."""
        n = len(words)
        size = np.fromiter(map(len, words), dtype=np.int64, count=n)
        sym = self.byte_id[np.frombuffer(b"".join(words), dtype=np.uint8)]
        row = np.repeat(np.arange(n), size)
        done_sym, done_row = [], []
        while len(sym):
            same = row[1:] == row[:-1]
            at = np.full(len(sym), -1, dtype=np.int64)
            first = np.flatnonzero(same)
            at[first] = self._lookup(sym[first] << 32 | sym[first + 1])
            rank = np.where(at >= 0, self.rank[at], _NO_RANK)
            start = np.flatnonzero(np.r_[True, ~same])
            least = np.minimum.reduceat(rank, start)
            live = least != _NO_RANK
            length = np.diff(np.r_[start, len(sym)])
            alive = np.repeat(live, length)
            if not live.all():
                done_sym.append(sym[~alive])
                done_row.append(row[~alive])
                sym, row, rank, at = sym[alive], row[alive], rank[alive], at[alive]
                if not len(sym):
                    break
                least, length = least[live], length[live]
            hit = rank == np.repeat(least, length)
            # of overlapping occurrences (a run of one symbol) every second one merges
            place = np.flatnonzero(hit)
            brk = np.r_[True, np.diff(place) != 1]
            run = np.maximum.accumulate(np.where(brk, np.arange(len(place)), 0))
            place = place[(np.arange(len(place)) - run) % 2 == 0]
            sym[place] = self.made[at[place]]
            stay = np.ones(len(sym), dtype=bool)
            stay[place + 1] = False
            sym, row = sym[stay], row[stay]
        if not done_sym:
            return np.empty(0, dtype=_DTYPE), np.zeros(n, dtype=np.int64)
        sym, row = np.concatenate(done_sym), np.concatenate(done_row)
        order = np.argsort(row, kind="stable")
        return sym[order].astype(_DTYPE), np.bincount(row, minlength=n)

    # -- texts ---------------------------------------------------------------

    def _starts(self, code: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where pre-tokens begin; ``first``: where the (non-empty) texts begin."""
        n = len(code)
        kind = self._class[code]
        start = np.empty(n, dtype=bool)
        start[0] = True
        np.not_equal(kind[1:], kind[:-1], out=start[1:])
        start[first] = True
        # the last of white space before other text is a token, or a blank joins what follows
        end = np.flatnonzero(start[1:] & (kind[:-1] == _SPACE)) + 1
        is_first = np.zeros(n, dtype=bool)
        is_first[first] = True
        end = end[~is_first[end]]
        start[end - 1] = True
        blank = code[end - 1] == 32
        start[end[blank]] = False
        # an apostrophe that begins a token takes an ending from the letters after it
        quote = np.flatnonzero((code == 39) & start)
        for ending in ENDINGS:
            at = quote[quote + len(ending) < n]
            for k, c in enumerate(ending, 1):
                at = at[(code[at + k] == ord(c)) & ~is_first[at + k]]
            start[at + 1] = False
            after = at + len(ending) + 1
            start[after[after < n]] = True
            quote = np.setdiff1d(quote, at, assume_unique=True)
        return start

    def _encode_plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts without special tokens, flat, and each text's count."""
        size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        counts = np.zeros(len(texts), dtype=np.int64)
        joined = "".join(texts)
        if not joined:
            return np.empty(0, dtype=_DTYPE), counts
        full = np.flatnonzero(size)
        first = (np.cumsum(size) - size)[full]
        start = np.flatnonzero(self._starts(np.frombuffer(joined.encode("utf-32-le"), dtype="<u4"), first))
        owner = np.searchsorted(first, start, side="right") - 1
        raw = joined.encode()
        data = np.frombuffer(raw, dtype=np.uint8)
        if len(raw) != len(joined):  # from characters to bytes
            start = np.flatnonzero((data & 0xC0) != 0x80)[start]
        start = start.astype(np.int32 if len(raw) < 2**31 else np.int64)
        length = np.diff(np.append(start, start.dtype.type(len(raw))))
        code, rep = self._distinct(data, start, length)
        edge = start[rep].tolist(), (start[rep] + length[rep]).tolist()
        sym, got = self.merge([raw[a:b] for a, b in zip(*edge)])
        per = got[code]
        base = np.cumsum(got) - got
        out_at = np.cumsum(per) - per
        ids = sym[np.arange(per.sum()) + np.repeat(base[code] - out_at, per)]
        counts[full] = np.bincount(owner, weights=per, minlength=len(full)).astype(np.int64)
        return ids, counts

    @staticmethod
    def _distinct(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of each token among the distinct ones, and one place of each of those."""
        local = np.arange(len(data), dtype=start.dtype) - np.repeat(start, length)
        powers = _powers(int(length.max()))
        seed = 0
        while True:
            table = np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64)
            term = table[data]
            term *= powers[local]
            key = np.add.reduceat(term, start)
            del term
            key ^= key >> np.uint64(31)
            code, uniques = pd.factorize(key)
            rep = np.empty(len(uniques), dtype=np.int64)
            rep[code[::-1]] = np.arange(len(code) - 1, -1, -1)
            twin = start[rep][code]
            if (length[rep][code] == length).all() and (data[local + np.repeat(twin, length)] == data).all():
                return code, rep
            seed += 1  # two tokens met in one hash value

    def encode_flat(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: empty), flat, and each text's count of ids."""
        texts = [t or "" for t in texts]
        if not self._cut or not any(s in t for s in self.special for t in texts):
            return self._encode_plain(texts)
        owner, parts, marks = [], [], []
        for i, text in enumerate(texts):
            for piece in self._cut.split(text):
                owner.append(i)
                marks.append(self.special.get(piece, -1))
                parts.append("" if piece in self.special else piece)
        ids, got = self._encode_plain(parts)
        flat = np.split(ids, np.cumsum(got)[:-1])
        flat = [np.array([m], dtype=_DTYPE) if m >= 0 else x for x, m in zip(flat, marks)]
        counts = np.bincount(owner, weights=[len(x) for x in flat], minlength=len(texts)).astype(np.int64)
        return np.concatenate(flat), counts

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        ids, counts = self.encode_flat(texts)
        flat, end = ids.tobytes(), (np.cumsum(counts) * 4).tolist()
        return [flat[a:b] for a, b in zip([0, *end], end)]

    def count(self, texts: list[str | None]) -> np.ndarray:
        return self.encode_flat(texts)[1]


@lru_cache(maxsize=2)
def load(path: str) -> ByteBPE:
    return ByteBPE(path)
