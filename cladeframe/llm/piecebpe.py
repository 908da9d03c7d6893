"""SentencePiece BPE through a table of each prefix's unique last token.

Of all tokens that match at the end of a prefix exactly one can end the prefix's
encoding: the one that is compatible with the last token of the prefix before
it.  Two tokens are compatible when undoing their merges step by step never
meets a merge across the boundary that would have come first.  An automaton over
all pieces lists the matches; following the table backwards recovers the ids.

The engine works on words: no piece holds a blank mark after another character,
so a text falls apart in front of its blanks, and words repeat.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick

MARK = "▁"  # stands for a blank in pieces


class _Words(dict):
    """Encoded words in two bounded generations; a missing word is encoded on demand."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, word: str):
        value = self.old.get(word)
        if value is None:
            value = self.make(word)
            if len(word) > 64 or "\n" in word:
                return value
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[word] = value
        return value


def _merge_run(n: int, sizes) -> list[int]:
    """Piece lengths of n blanks whose merges all rank alike: leftmost first."""
    run = [1] * n
    while True:
        at = next((i for i in range(len(run) - 1) if run[i] + run[i + 1] in sizes), None)
        if at is None:
            return run
        run[at:at + 2] = [run[at] + run[at + 1]]


class PieceBPE:
    """Encoder and decoder for a SentencePiece BPE model with byte fallback."""

    def __init__(self, path: str, max_cached: int = 300_000):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, train = model.normalizer_spec, model.trainer_spec
        if (train.model_type != 2 or not train.byte_fallback or train.treat_whitespace_as_suffix
                or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix):
            raise NotImplementedError("only BPE models with byte fallback and identity normalisation")
        self.piece = [p.piece for p in model.pieces]
        self.byte_of = {i: int(p.piece[1:-1], 16) for i, p in enumerate(model.pieces) if p.type == 6}
        self.byte_id = {b: i for i, b in self.byte_of.items()}
        self.silent = {i for i, p in enumerate(model.pieces) if p.type == 3}
        self.unknown = {i for i, p in enumerate(model.pieces) if p.type == 2}
        normal = [(p.piece, i, p.score) for i, p in enumerate(model.pieces) if p.type == 1]
        if any(p.type not in (1, 2, 3, 6) for p in model.pieces):
            raise NotImplementedError("user-defined pieces are not supported")
        runs = {len(p): i for p, i, _ in normal if p == MARK * len(p)}
        others = [x for x in normal if x[0] != MARK * len(x[0])] + [(MARK, runs[1], 0.0)]
        if any(MARK in p[1:] for p, _, _ in others):
            raise NotImplementedError("pieces must hold blanks in front or be runs of them")
        self.runs, self.longest_run = runs, max(runs)
        self.short_runs = [_merge_run(n, runs) for n in range(self.longest_run)]
        if any(_merge_run(self.longest_run + n, runs)[0] != self.longest_run for n in range(self.longest_run)):
            raise NotImplementedError("runs of blanks must fill their longest piece first")

        # ranks: single characters first, then pieces in the order of merging
        others.sort(key=lambda x: (len(x[0]) > 1, -x[2], x[1]))
        self.id = [i for _, i, _ in others]
        self.digits = [str(i) for i in self.id]
        self.shown = [p.replace(MARK, " ") for p, _, _ in others]
        rank = {p: r for r, (p, _, _) in enumerate(others)}
        self.known = {p for p in rank if len(p) == 1}
        if not {c for p in rank for c in p} <= self.known:
            raise NotImplementedError("pieces of characters that are not pieces")
        self.size = [len(p) for p, _, _ in others]
        self.parts: list[tuple[int, int]] = []
        self.pair: dict[tuple[int, int], int] = {}
        self.fits: dict[int, bool] = {}
        self.auto = ahocorasick.Automaton()
        for p, _, _ in others:
            r = rank[p]
            found = (r, r)
            for cut in range(1, len(p)):
                a, b = rank.get(p[:cut], r), rank.get(p[cut:], r)
                if a < r and b < r and self._compatible(a, b):
                    found = (a, b)
                    self.pair[found] = r
                    break
            self.parts.append(found)
            if found != (r, r) or len(p) == 1:  # else no merges lead to it
                self.auto.add_word(p, (r, len(p)))
        self.auto.make_automaton()
        self.foreign = re.compile("([^" + "".join(map(re.escape, sorted(self.known))) + "])")
        self.words = _Words(self._word, max_cached)
        self.tails = _Words(self._any, max_cached // 4)

    def _compatible(self, a: int, b: int) -> bool:
        """Whether merging a's and b's characters never joins them (ranks)."""
        limit = len(self.id) + 1
        pair, parts = self.pair.get, self.parts
        while True:
            made = pair((a, b))
            if made is not None and made < limit:
                return False
            if a > b:
                limit = a
                a = parts[a][1]
                if a == limit:
                    limit = b + 1
                    b = parts[b][0]
                    if b + 1 == limit:
                        return True
            else:
                limit = b + 1
                b = parts[b][0]
                if b + 1 == limit:
                    limit = a
                    a = parts[a][1]
                    if a == limit:
                        return True

    def _tokens(self, text: str) -> list[int]:
        """Ranks of the tokens of known characters without inner blank marks."""
        last = [-1] * (len(text) + 1)
        fits = self.fits
        for end, (token, size) in self.auto.iter(text):
            end += 1
            if last[end] >= 0:
                continue
            begin = end - size
            if not begin:
                last[end] = token
                continue
            before = last[begin]
            if before >= 0:
                key = before << 24 | token
                if key not in fits:
                    if len(fits) >= 1_000_000:
                        fits.clear()
                    fits[key] = self._compatible(before, token)
                if fits[key]:
                    last[end] = token
        out, at, size = [], len(text), self.size
        while at:
            token = last[at]
            out.append(token)
            at -= size[token]
        out.reverse()
        return out

    def _entry(self, ids: list[int]) -> tuple[str, int, str]:
        return ",".join(map(str, ids)), len(ids), self._text(ids)

    def _any(self, text: str) -> tuple[str, int, str]:
        if not self.foreign.search(text):
            tokens = self._tokens(text)
            return ",".join([self.digits[t] for t in tokens]), len(tokens), "".join([self.shown[t] for t in tokens])
        ids: list[int] = []
        for k, part in enumerate(self.foreign.split(text)):
            if k % 2:
                ids += [self.byte_id[b] for b in part.encode()]
            elif part:
                ids += [self.id[t] for t in self._tokens(part)]
        return self._entry(ids)

    def _word(self, word: str) -> tuple[str, int, str]:
        if "\n" in word:
            head, *rest = word.split("\n")
            got, newline = [self.words[head]], (str(self.byte_id[10]), 1, "\n")
            for part in rest:
                got.append(newline)
                if part:
                    got.append(self.tails[part])
            ids, sizes, texts = zip(*got)
            return ",".join(ids), sum(sizes), "".join(texts)
        return self._any(MARK + word)

    def _run(self, n: int) -> list[int]:
        full, rest = divmod(n, self.longest_run)
        return [self.runs[self.longest_run]] * full + [self.runs[k] for k in self.short_runs[rest]]

    def _entries(self, text: str) -> list[tuple[str, int, str]]:
        words = text.replace(" ", MARK).split(MARK)
        if "" not in words:
            return list(map(self.words.__getitem__, words))
        out, blanks, alone = [], 0, str(self.runs[1])
        for w in words:
            blanks += 1
            if not w:
                continue
            ids, n, said = self.words[w]
            if blanks > 1:
                if ids == alone or ids.startswith(alone + ","):
                    # the blank in front of the word stays with the blanks before it
                    out.append(self._entry(self._run(blanks)))
                    ids, n, said = ids[len(alone) + 1:], n - 1, said[1:]
                else:
                    out.append(self._entry(self._run(blanks - 1)))
            if n:
                out.append((ids, n, said))
            blanks = 0
        if blanks:
            out.append(self._entry(self._run(blanks)))
        return out

    def encode_and_decode(self, text: str | None) -> tuple[str, int, str]:
        """Decimal ids joined by commas, their number, and the decoded text."""
        if not text:
            return "", 0, ""
        ids, sizes, texts = zip(*self._entries(text))
        said = "".join(texts)
        return ",".join(ids), sum(sizes), said[1:] if said.startswith(" ") else said

    def encode(self, text: str | None) -> list[int]:
        ids = self.encode_and_decode(text)[0]
        return list(map(int, ids.split(","))) if ids else []

    def count(self, texts: list[str | None]) -> list[int]:
        return [sum(e[1] for e in self._entries(t)) if t else 0 for t in texts]

    def _text(self, ids: list[int]) -> str:
        out, held = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            if i in self.unknown:
                out.append(" ⁇ ")
            elif i not in self.silent:
                out.append(self.piece[i].replace(MARK, " "))
        if held:
            out.append(held.decode("utf-8", "replace"))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        said = self._text(ids)
        return said[1:] if said.startswith(" ") else said


@lru_cache(maxsize=2)
def load(path: str) -> PieceBPE:
    return PieceBPE(path)
