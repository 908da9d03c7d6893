"""Toxicity by a weighted finite-state pattern grammar over clauses.

A text is read as words (runs of letters wherever they stand; a letter of a script
without blanks is a word) and clause ends.  Every word is an input symbol: the classes
that single words belong to (insult, threat, target, negation, reported speech), a
weight, and its number in the patterns of several words.  A clause that may hold an
insult or a threat goes through a composition of transducers, each of which writes
one symbol for each that it reads:

- patterns: an automaton over the words of multi-word patterns, which adds the class
  of a pattern at its last word;
- negation: marks insults and threats within reach of a negation;
- report: marks those after a word of reported speech;
- target: guesses whether the clause names a target and accepts if the guess is right;
- arcs: turns a marked insult or threat into the kind of arc that it leaves on.

A document's figures are the weights on the accepted paths, summed by kind of arc; a
logistic fit turns them into a score.  A word outside the grammar never counts, and
a matched word counts by its clause, not alone.  Insults are seed words and stems
learned from labelled rows.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from cladeframe.llm.common import chunks, give_back, Scratch
from cladeframe.llm.labelled import MAX_TRAINING_ROWS, training_rows

# Seed words and patterns of the transducers (English, German, French, Spanish).
INSULTS = "idiot moron stupid scum dumb loser fool trottel arschloch dummkopf connard imbécile idiota estúpido imbécil".split()
THREATS = "kill hurt destroy shoot stab töten umbringen verletzen zerstören tuer frapper détruire matar golpear destruir".split()
TARGETS = ("you your he him she her they them du dich dir ihr euch sie er tu toi te vous il elle lui leur "
           "tú usted ustedes vosotros ella ellos ellas él").split()
NEGATIONS = "not no never isn't aren't don't won't nicht kein keine nie niemals ne pas jamais aucun nunca jamás ningún".split()
REPORTS = ("said says wrote claims quoted reported called sagte sagt schrieb behauptet dit écrit affirme "
           "dijo dice escribió afirma").split()
PATTERNS = {
    "insult": ("piece of trash", "waste of space", "good for nothing", "shut up", "halt die klappe", "ferme ta bouche", "cierra la boca"),
    "threat": ("beat you up", "hope you die", "watch your back", "bring dich um", "te faire mal", "hacerte daño"),
    "negation": ("no longer", "by no means", "far from", "auf keinen fall", "en aucun cas", "de ninguna manera"),
    "report": ("according to", "in the words of", "laut einem", "selon lui", "según él"),
}

NEGATION_REACH = 3  # words after a negation that it still turns
STEM_LENGTHS = (4, 5, 6)
#: A stem is learned if this share of the toxic sample holds it, clean documents hardly do,
#: and chance would put it on the toxic side so often in at most this many cases.
MIN_SUPPORT, MAX_CLEAN, MAX_CHANCE = 0.004, 0.05, 1e-7

INSULT, THREAT, TARGET, NEGATION, REPORT, MAYBE = 1, 2, 4, 8, 16, 32
NEGATED, REPORTED, AIMED = 64, 128, 256
_BITS = {"insult": INSULT, "threat": THREAT, "negation": NEGATION, "report": REPORT}
ARCS = ("plain", "targeted", "negated", "reported", "threat")

_WORD = r"[^\W\d_]+(?:'[^\W\d_]+)?"
_words = re.compile(_WORD).findall
#: The same where each letter of a script without blanks is a word.
_IDEOGRAM = "[\u3040-\u30ff\u3400-\u9fff]"
_SINGLE = rf"{_IDEOGRAM}|(?:(?!{_IDEOGRAM})[^\W\d_])+(?:'(?:(?!{_IDEOGRAM})[^\W\d_])+)?"
_single_words = re.compile(_SINGLE).findall
#: A word, or the end of a clause (which a mark before a digit is not).
_pieces = re.compile(rf"({_SINGLE})|[.!?;:]+(?!\d)").finditer


def words_of(text: str) -> list[str]:
    """Runs of letters; letters of scripts without blanks one by one."""
    return _words(text) if text.isascii() or max(text) < "\u3040" else _single_words(text)


# -- transducers -------------------------------------------------------------


class Transducer:
    """States with arcs; ``step(state, symbol)`` lists ``(next state, written symbol, weight)``."""

    start: object = 0

    def step(self, state, symbol) -> list[tuple]:
        raise NotImplementedError

    def final(self, state) -> bool:
        return True


class Composed(Transducer):
    """Reads with the first machine, feeds what it writes to the second; weights add up."""

    def __init__(self, first: Transducer, second: Transducer):
        self.first, self.second = first, second
        self.start = (first.start, second.start)

    def step(self, state, symbol):
        return [((p, q), z, v + w) for p, y, v in self.first.step(state[0], symbol) for q, z, w in self.second.step(state[1], y)]

    def final(self, state):
        return self.first.final(state[0]) and self.second.final(state[1])


def compose(*machines: Transducer) -> Transducer:
    out = machines[-1]
    for m in machines[-2::-1]:
        out = Composed(m, out)
    return out


class Table(Transducer):
    """The same machine with all arcs that its states have on ``symbols`` written out."""

    def __init__(self, machine: Transducer, symbols):
        number, queue = {machine.start: 0}, [machine.start]
        self.arcs, self.ends = {}, []
        for state in queue:
            self.ends.append(machine.final(state))
            for x in symbols:
                arcs = machine.step(state, x)
                for to, *_ in arcs:
                    if to not in number:
                        number[to] = len(queue)
                        queue.append(to)
                self.arcs[number[state], x] = [(number[to], y, w) for to, y, w in arcs]
        self.start = 0

    def step(self, state, symbol):
        return self.arcs[state, symbol]

    def final(self, state):
        return self.ends[state]


class Patterns(Transducer):
    """Reads ``(classes, weight, number)`` of words, writes classes with those of patterns that end here."""

    def __init__(self, patterns: dict[str, tuple[str, ...]] = PATTERNS):
        self.numbers: dict[str, int] = {}
        nodes, self.adds = {(): 0}, {0: 0}
        self.longest: set[int] = set()
        for name, listed in patterns.items():
            for text in listed:
                path = tuple(self.numbers.setdefault(w, len(self.numbers) + 1) for w in text.split())
                for n in range(1, len(path) + 1):
                    self.adds.setdefault(nodes.setdefault(path[:n], len(nodes)), 0)
                self.adds[nodes[path]] |= _BITS[name]
                if name in ("insult", "threat"):
                    self.longest.add(self.numbers[max(text.split(), key=len)])
        # from each prefix: the longest prefix that what was read ends with
        self.arcs, self.prefixes = {}, nodes
        for path, at in nodes.items():
            for number in range(1, len(self.numbers) + 1):
                read = (*path, number)
                while read not in nodes:
                    read = read[1:]
                self.arcs[at, number] = nodes[read]
        # a pattern that ends inside of another counts as well
        for path, at in sorted(nodes.items(), key=lambda kv: len(kv[0])):
            for n in range(1, len(path)):
                self.adds[at] |= self.adds[nodes[path[n:]]] if path[n:] in nodes else 0

    def step(self, state, symbol):
        bits, weight, number = symbol
        to = self.arcs[state, number] if number else 0
        added = self.adds[to]
        return [(to, (bits | added) & ~MAYBE, max(weight, 1.0) if added & (INSULT | THREAT) else weight)]


class Negation(Transducer):
    def step(self, state, symbol):
        if symbol & NEGATION:
            return [(NEGATION_REACH, symbol | NEGATED, 0.0)]
        return [(max(state - 1, 0), symbol | NEGATED if state else symbol, 0.0)]


class Report(Transducer):
    def step(self, state, symbol):
        seen = state or bool(symbol & REPORT)
        return [(int(seen), symbol | REPORTED if seen else symbol, 0.0)]


class Target(Transducer):
    """Two branches from the start: with a target, which must come, and without any."""

    start = "open"

    def step(self, state, symbol):
        here, out = bool(symbol & TARGET), []
        if state in ("open", "wanted", "named"):
            out.append(("named" if here or state == "named" else "wanted", symbol | AIMED, 0.0))
        if state in ("open", "none") and not here:
            out.append(("none", symbol, 0.0))
        return out

    def final(self, state):
        return state != "wanted"


class Arcs(Transducer):
    def step(self, state, symbol):
        kind = None
        if symbol & (INSULT | THREAT):
            kind = ("reported" if symbol & REPORTED else "negated" if symbol & NEGATED else
                    "threat" if symbol & THREAT and symbol & AIMED else "targeted" if symbol & AIMED else "plain")
        return [(0, kind, 0.0)]


#: What follows the patterns, over all sets of classes.
CONTEXT = Table(compose(Negation(), Report(), Target(), Arcs()), range(32))


def accepted(machine: Transducer, symbols) -> list[tuple[list, list[float]]]:
    """What each accepted path writes, with the weights of its arcs."""
    alive = [(machine.start, [], [])]
    for x in symbols:
        alive = [(to, [*out, y], [*weights, w]) for state, out, weights in alive for to, y, w in machine.step(state, x)]
    return [(out, weights) for state, out, weights in alive if machine.final(state)]


# -- the grammar -------------------------------------------------------------


def tokens_of(text: str | None) -> list[str]:
    """Lower-case tokens; line ends are tokens that end a clause."""
    return (text or "").lower().replace("\n", " . ").split()


def stems(word: str) -> list[str]:
    """A word as such (marked by its end) and its prefixes."""
    return [word + "$"] + [word[:n] for n in STEM_LENGTHS if len(word) > n]


class _Symbols(dict):
    """Token -> its symbols, a clause end being None; in two bounded generations."""

    def __init__(self, grammar: Grammar, limit: int = 300_000):
        super().__init__()
        self.grammar, self.limit, self.old, self.hot = grammar, limit, {}, set()

    def __missing__(self, token: str):
        value = self.old.get(token)
        if value is None:
            word = token.rstrip(".,")
            if word.isalpha() and max(word) < "\u3040":
                symbol = self.grammar.symbol(word)
                value = (symbol, None) if "." in token else (symbol,)
                if symbol is _PLAIN:
                    value = _PLAIN_STOP if "." in token else _PLAIN_ONE
            else:
                value = tuple(self.grammar.symbol(m[1]) if m[1] else None for m in _pieces(token))
            if any(x is not None and x[0] & (INSULT | THREAT | MAYBE) for x in value):
                self.hot.add(token)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[token] = value
        return value


_PLAIN = (0, 0.0, 0)
_PLAIN_ONE, _PLAIN_STOP = (_PLAIN,), (_PLAIN, None)


@dataclass
class Grammar:
    """The transducers' weights and the logistic layer on the arcs."""

    insults: dict[str, float] = field(default_factory=dict)  # stem -> weight
    weights: np.ndarray = field(default_factory=lambda: np.array([-2.0, 3.0, 3.5, 0.5, 0.5, 2.0, 1.0]))
    offset: np.ndarray = field(default_factory=lambda: np.zeros(6))
    scale: np.ndarray = field(default_factory=lambda: np.ones(6))

    def __post_init__(self):
        self.words: dict[str, int] = {}
        for bit, listed in ((INSULT, INSULTS), (THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)):
            for w in listed:
                self.words[w] = self.words.get(w, 0) | bit
        self.patterns = Patterns()
        self.machine = compose(self.patterns, CONTEXT)

    def symbol(self, word: str) -> tuple[int, float, int]:
        """Classes, weight and number of a word; ``MAYBE``: it is the longest of an insult or threat of several words."""
        bits = self.words.get(word, 0)
        weight = 1.0 if bits & (INSULT | THREAT) else 0.0
        for s in stems(word):
            learned = self.insults.get(s)
            if learned is not None and learned > 0:
                bits |= INSULT
                weight = max(weight, learned)
        number = self.patterns.numbers.get(word, 0)
        if number in self.patterns.longest:
            bits |= MAYBE
        return (bits, weight, number) if bits or number else _PLAIN

    def arcs(self, tokens: list[str], symbols: _Symbols) -> list[float]:
        """Summed weight of each kind of arc, and of the heaviest clause."""
        read = list(map(symbols.__getitem__, tokens))
        out = dict.fromkeys(ARCS, 0.0)
        heaviest, done = 0.0, -1
        if symbols.hot.isdisjoint(tokens):  # no clause can leave on an arc
            return [0.0] * (len(ARCS) + 1)
        read = list(chain.from_iterable(read))
        for i in [i for i, x in enumerate(read) if x is not None and x[0] & (INSULT | THREAT | MAYBE)]:
            if i <= done:
                continue
            lo = hi = i
            while lo > done + 1 and read[lo - 1] is not None:
                lo -= 1
            while hi < len(read) - 1 and read[hi + 1] is not None:
                hi += 1
            done, total = hi, 0.0
            for kinds, weights in self.paths(read[lo:hi + 1]):
                for kind, weight in zip(kinds, weights):
                    out[kind] += weight
                    total += weight if kind in ("plain", "targeted", "threat") else 0.0
            heaviest = max(heaviest, total)
        return [float(np.log1p(v)) for v in (*out.values(), heaviest)]

    def paths(self, clause: list[tuple]) -> list[tuple[list[str], list[float]]]:
        """Like :func:`accepted`, with no more than the arcs that a kind is written on."""
        machine, alive = self.machine, [(self.machine.start, [], [])]
        for x in clause:
            follow = []
            for state, kinds, weights in alive:
                for to, kind, weight in machine.step(state, x):
                    follow.append((to, kinds, weights) if kind is None else (to, [*kinds, kind], [*weights, weight]))
            alive = follow
        return [(kinds, weights) for state, kinds, weights in alive if machine.final(state)]

    def score(self, figures: np.ndarray) -> np.ndarray:
        z = self.weights[0] + ((figures - self.offset) / self.scale) @ self.weights[1:]
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))

    def fit_weights(self, figures: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 50) -> None:
        """Penalised logistic regression by Newton's method."""
        if not len(y) or y.min() == y.max():
            return
        self.offset = figures.mean(axis=0)
        self.scale = np.where(figures.std(axis=0) > 1e-9, figures.std(axis=0), 1.0)
        x = np.c_[np.ones(len(y)), (figures - self.offset) / self.scale]
        w, ridge = np.zeros(x.shape[1]), penalty * np.eye(x.shape[1])
        ridge[0, 0] = 1e-6
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
            w += step
            if np.abs(step).max() < 1e-8:
                break
        self.weights = w


def _chance(toxic: int, clean: int, share: float) -> float:
    """Chernoff bound of the log probability that so many of the holders are toxic."""
    n = toxic + clean
    p = toxic / n
    if p <= share:
        return 0.0
    return -n * (p * np.log(p / share) + ((1 - p) * np.log((1 - p) / (1 - share)) if clean else 0.0))


def _stem_counts(rows: DataFrame, label: int, only: set[str] | None) -> DataFrame:
    """``stem, n``: documents of one class that hold it (``only``: among these stems)."""

    def run(batches):
        held: Counter = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                found = {s for w in set(words_of((text or "").lower())) for s in stems(w)}
                held.update(found & only if only is not None else found)
                if len(held) > 500_000:
                    yield _counts(held)
                    held.clear()
        if held:
            yield _counts(held)

    return rows.where(F.col("label") == label).select("text").mapInArrow(run, "stem string, n long") \
        .groupBy("stem").agg(F.sum("n").alias("n"))


def _counts(held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), "string"), pa.array(list(held.values()), "int64")], ["stem", "n"])


def fit_grammar(docs: DataFrame, labels: DataFrame, scratch: Scratch, fold: Column | None = None,
                bound: int = MAX_TRAINING_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Grammar:
    """Learn insult stems and arc weights from at most ``bound`` labelled documents.

    Stems that at least ``MIN_SUPPORT`` of the toxic documents hold are candidates (so
    their number is bounded by the words of a document over that share); those that
    clean documents hardly hold become insults with their log odds as weight.
    """
    rows = scratch.save(training_rows(docs, labels, "toxic", fold, bound, id_col, text_col))
    n = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}
    grammar = Grammar()
    if n.get(1) and n.get(0):
        least = max(3, round(MIN_SUPPORT * n[1]))
        toxic = {r[0]: r[1] for r in _stem_counts(rows, 1, None).where(F.col("n") >= least).collect()}
        clean = {r[0]: r[1] for r in _stem_counts(rows, 0, set(toxic)).collect()}
        for stem, hits in toxic.items():
            p, q = hits / n[1], (clean.get(stem, 0) + 0.5) / (n[0] + 1)
            if q <= MAX_CLEAN * p and _chance(hits, clean.get(stem, 0), n[1] / (n[0] + n[1])) <= np.log(MAX_CHANCE):
                grammar.insults[stem] = float(np.log(p / q)) / 4
        for stem in list(grammar.insults):
            # what begins with a shorter insult says no more than that
            if any(stem[:k] in grammar.insults for k in STEM_LENGTHS if k < len(stem.rstrip("$"))):
                del grammar.insults[stem]
        figures, y = _figures(rows, grammar)
        grammar.fit_weights(figures, y)
    scratch.drop(rows)
    return grammar


def _figures(rows: DataFrame, grammar: Grammar) -> tuple[np.ndarray, np.ndarray]:
    def run(batches):
        symbols = _Symbols(grammar)
        for batch in batches:
            for part in chunks(batch, "text"):
                x = [grammar.arcs(tokens_of(t), symbols) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("label"), pa.array(x, pa.list_(pa.float64()))], ["label", "x"])

    got = rows.select("label", "text").mapInArrow(run, "label int, x array<double>").toArrow()
    return np.array(got["x"].to_pylist()).reshape(-1, 6), np.asarray(got["label"], dtype=int)


def score_toxicity(docs: DataFrame, grammar: Grammar, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """All columns of ``docs``, ``toxicity_score`` (0 to 1) and ``toxicity_predicted`` (0 or 1).

    Null and empty texts match no clause and get the score of such texts.  One row per
    input row, so repeated rows score alike and an empty table gives none.  Columns of
    ``docs`` with these two names, in any case, are replaced; ``keep_rows`` goes around that.
    """
    docs = docs.drop("toxicity_score", "toxicity_predicted")

    def run(batches):
        symbols = _Symbols(grammar)
        for batch in batches:
            for part in chunks(batch, text_col):
                x = np.array([grammar.arcs(tokens_of(t), symbols) for t in part.column(text_col).to_pylist()])
                s = grammar.score(x.reshape(-1, 6))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(s), pa.array((s >= threshold).astype("int32"))],
                    [*part.schema.names, "toxicity_score", "toxicity_predicted"])
        give_back()

    schema = StructType([*docs.schema.fields, StructField("toxicity_score", DoubleType()),
                         StructField("toxicity_predicted", IntegerType())])
    return docs.mapInArrow(run, schema)


def toxicity_scores(docs: DataFrame, labels: DataFrame, scratch: Scratch, fold: Column | None = None,
                    bound: int = MAX_TRAINING_ROWS) -> DataFrame:
    """``doc_id, score, predicted`` of every document, one row per input row."""
    grammar = fit_grammar(docs, labels, scratch, fold, bound)
    return score_toxicity(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), grammar).select(
        "doc_id", F.col("toxicity_score").alias("score"), F.col("toxicity_predicted").alias("predicted"))
