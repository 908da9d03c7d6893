"""Held-out accuracy, the grammar's arcs and edge cases of the two classifiers and URL rules."""

import itertools
import re

import numpy as np
import pytest

from cladeframe.llm import queries, toxicity
from cladeframe.llm.common import Scratch, read_table
from cladeframe.llm.linkgraph import host_edges, judge_urls, propagate
from cladeframe.llm.quality import STATISTICS, Quadratic, fit_quality, score_quality, statistics
from cladeframe.llm.toxicity import Grammar, fit_grammar, score_toxicity, tokens_of
from tests.conftest import SMALL

MIDDLE = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name, label, least", [("op10_quality_classifier", "quality", 0.97), ("op4_toxicity", "toxic", 0.95)])
def test_held_out_accuracy(spark, name, label, least):
    got = queries.QUERIES[name](spark, MIDDLE).join(read_table(spark, MIDDLE, "labels"), "doc_id").toPandas()
    assert got["score"].between(0, 1).all() and (got["predicted"] == (got["score"] >= 0.5)).all()
    held = got[got["held_out"]]
    assert len(held) > 50 and (held["predicted"] == held[label]).mean() >= least


def test_discriminant_equals_the_densities():
    r = np.random.default_rng(1)
    x = np.r_[r.normal(size=(200, 3)), r.normal(size=(300, 3)) * [1, 2, 0.5] + 1]
    y = np.r_[np.zeros(200, int), np.ones(300, int)]
    model = Quadratic.fit(x, y, to_pooled=0.0, to_round=0.0)
    log = []
    for k in (0, 1):
        mean, cov = x[y == k].mean(axis=0), np.cov(x[y == k].T, bias=True)
        log.append(np.log(((y == k).sum() + 1) / 502) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean))
    assert np.allclose(model.difference(x), log[1] - log[0], atol=1e-3)


def test_few_or_no_labels():
    x = np.random.default_rng(0).normal(size=(5, len(STATISTICS)))
    for rows, y in ((x, np.array([1, 1, 1, 1, 1])), (x[:0], np.array([], dtype=int)), (x, np.array([0, 1, 1, 0, 1]))):
        score = Quadratic.fit(rows, y).score(x)
        assert np.isfinite(score).all() and ((score >= 0) & (score <= 1)).all()
    assert statistics(None) == statistics("") == [0.0] * len(STATISTICS)


CLASHING = [(1, "a good text", 0.1, 1), (1, "a good text", 0.1, 1), (2, None, None, None), (3, "", 0.2, 2), (None, "you idiot", 0.3, 3), (4, "word " * 30_000, 0.4, 4)]
SCHEMA = "doc_id long, text string, quality_score double, toxicity_predicted int"


def test_clashing_columns_and_empty_tables(spark):
    docs, labels = spark.createDataFrame(CLASHING, SCHEMA), spark.createDataFrame([(1, None, 1), (3, 0, 0), (None, 1, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    for d in (docs, docs.where("false")):
        for rows in (labels, labels.where("false")):
            q = score_quality(d, fit_quality(d, rows)).collect()
            t = score_toxicity(d, fit_grammar(d, rows, Scratch(spark))).collect()
            assert len(q) == len(t) == d.count()
            assert all(0 <= r.quality_score <= 1 for r in q) and all(0 <= r.toxicity_score <= 1 for r in t)


@pytest.mark.parametrize("text, arc", [
    ("What an idiot.", "plain"), ("You are an idiot.", "targeted"), ("He is not an idiot.", "negated"), ("She said that he is an idiot.", "reported"),
    ("I will kill you.", "threat"), ("Kill the lights.", "plain"), ("A fine day.", None), ("Not now.\nidiot", "plain"), ("Not a word and then so much idiot", "plain"),
    ("STUPID*** thing", "plain"), ("", None), (None, None), ("You idiot-behaviour", "targeted"), ("You idiot.Wonderful day", "targeted"),
    ("you-are-an-absolute-idiot", "targeted"), ("so shut up now", "plain"), ("you are no longer an idiot", "negated"),
    ("an idiot, according to none", "plain"), ("according to none an idiot", "reported"), ("I hope you die", "threat"), ("Hope and die", None),
    ("3.5 idiot 4.5 you", "targeted"), ("你idiot你", "plain")])
def test_arcs(text, arc):
    grammar = Grammar()
    figures = grammar.arcs(tokens_of(text), toxicity._Symbols(grammar))
    assert [a for a, v in zip(toxicity.ARCS, figures) if v > 0] == ([arc] if arc else [])
    assert (figures[5] > 0) == (arc in ("plain", "targeted", "threat"))


def test_composition_against_the_machines_one_by_one():
    """Every path of the composed machine on short clauses is a cascade of paths of its parts, and the other way round."""
    grammar = Grammar()
    symbol = lambda w: grammar.symbol(w)
    words = ["idiot", "kill", "you", "not", "said", "no", "longer", "shut", "up", "tree"]
    parts = [grammar.patterns, toxicity.Negation(), toxicity.Report(), toxicity.Target(), toxicity.Arcs()]

    def cascade(machines, symbols):
        if not machines:
            return [(symbols, [0.0] * len(symbols))]
        out = []
        for written, weights in toxicity.accepted(machines[0], symbols):
            out += [(x, [v + w for v, w in zip(weights, more)]) for x, more in cascade(machines[1:], written)]
        return out

    for n in (1, 2, 3):
        for clause in itertools.product(words, repeat=n):
            read = [symbol(w) for w in clause]
            whole, plain = toxicity.accepted(grammar.machine, read), cascade(parts, read)
            assert whole == plain and len(whole) == 1
            kinds, weights = whole[0]
            assert grammar.paths(read) == [([k for k in kinds if k], [w for k, w in zip(kinds, weights) if k])]
    for clause in (["she", "said", "you", "no", "longer", "shut", "up", "idiot"], ["kill", "tree", "not", "tree", "tree", "idiot", "idiot"]):
        read = [symbol(w) for w in clause]
        assert toxicity.accepted(grammar.machine, read) == cascade(parts, read)


def plain_figures(grammar, text):
    """The figures of a text by rules written out for each clause, without machines (single words only)."""
    out = dict.fromkeys(toxicity.ARCS, 0.0)
    heaviest = 0.0
    for clause in re.split(r"[.!?;:]+(?!\d)|\n", (text or "").lower()):
        words = re.findall(r"[^\W\d_]+(?:'[^\W\d_]+)?", clause)
        listed = lambda w, names: w in names
        total = 0.0
        for i, w in enumerate(words):
            learned = max([grammar.insults.get(s, 0.0) for s in [w + "$", *(w[:n] for n in toxicity.STEM_LENGTHS if len(w) > n)]])
            insult, threat = listed(w, toxicity.INSULTS) or learned > 0, listed(w, toxicity.THREATS)
            if not insult and not threat:
                continue
            weight = max(learned, 1.0 if listed(w, toxicity.INSULTS) or threat else 0.0)
            aimed = any(listed(x, toxicity.TARGETS) for x in words)
            if any(listed(x, toxicity.REPORTS) for x in words[:i + 1]):
                kind = "reported"
            elif any(listed(x, toxicity.NEGATIONS) for x in words[max(0, i - 3):i + 1]):
                kind = "negated"
            else:
                kind = "threat" if threat and aimed else "targeted" if aimed else "plain"
                total += weight
            out[kind] += weight
        heaviest = max(heaviest, total)
    return [float(np.log1p(v)) for v in (*out.values(), heaviest)]


def test_scores_against_plain_rules(spark):
    """op4's scores of all documents, from figures computed without the machines."""
    docs, labels, scratch = read_table(spark, SMALL, "documents"), read_table(spark, SMALL, "labels"), Scratch(spark)
    grammar = fit_grammar(docs, labels, scratch, ~(toxicity.F.crc32(toxicity.F.col("doc_id").cast("string")) % 5 == 0))
    listed = {w for p in toxicity.PATTERNS.values() for x in p for w in [x]}
    rows = [r for r in docs.collect() if not any(x in " ".join(re.findall(r"\w+", (r.text or "").lower())) for x in listed)]
    want = {r.doc_id: float(grammar.score(np.array([plain_figures(grammar, r.text)]))[0]) for r in rows}
    got = {r.doc_id: r.score for r in queries.op4_toxicity(spark, SMALL).collect()}
    assert len(want) > 150 and all(abs(got[i] - s) < 1e-9 for i, s in want.items())


def test_unlearned_grammar_ranks_clauses():
    grammar = Grammar()
    score = {t: float(grammar.score(np.array([grammar.arcs(tokens_of(t), toxicity._Symbols(grammar))]))[0])
             for t in ("You are an idiot.", "He is not an idiot.", "A fine day.")}
    assert score["You are an idiot."] > 0.5 > score["He is not an idiot."] > score["A fine day."]


def test_rules_and_edge_cases_of_urls(spark):
    cases = {
        "https://Shop.Example.COM/en/x?q#f": ("shop.example.com", "/en/x", "example.com/en/", "block"),
        "http://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        "https://a.www.example.com/en/1": ("a.www.example.com", "/en/1", "www.example.com/en/", "allow"),
        "https://x.com/": ("x.com", "/", "com/", "allow"), "https://x.com": ("x.com", "", None, "allow"),
        "https://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"), "https://a.net/es/1": ("a.net", "/es/1", "net/es/", "block"),
        "https://a.net/es": ("a.net", "/es", None, "block"), "https://a.net?x=/fr/": ("a.net", "", None, "block"), "https://b.org/fr/": ("b.org", "/fr/", None, "allow"),
        "no scheme": ("", "", None, "allow"), None: ("", "", None, "allow"), "": ("", "", None, "allow"), "://": ("", "", None, "allow"), "x://Ä.net/fr/#/": ("Ä.net", "/fr/", "net/fr/", "block")}
    rows = [(i, u, None if i % 2 else "<p>" * 10, "x") for i, u in enumerate(cases)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(pages, Scratch(spark)).collect()}
    assert got == dict(enumerate(cases.values()))
    assert judge_urls(pages.where("false"), Scratch(spark)).count() == 0


def test_trust_and_distrust_against_dense_iteration(spark):
    html = '<a href="https://good.com/">x</a><a href="//spam.net/es/1">y</a><a href=\'/own\'>z</a>'
    rows = [(1, "https://hub.org/", html), (2, "https://good.com/", '<a href="http://friend.org/">f</a>'), (3, "https://spam.net/es/", '<a href="https://hub.org/">h</a>'),
            (4, "https://friend.org/", ""), (5, "https://lone.org/", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in judge_urls(pages, Scratch(spark)).collect()}
    assert got == {1: "block", 2: "allow", 3: "block", 4: "allow", 5: "allow"}
    from pyspark.sql import functions as F

    from cladeframe.llm.linkgraph import host_of
    edges = host_edges(pages.withColumn("host", host_of(F.col("url"))))
    seeds = spark.createDataFrame([("good.com", 1, 0), ("spam.net", 0, 2)], "host string, good long, bad long")
    found = {r.host: (r.trust, r.distrust) for r in propagate(edges, seeds, Scratch(spark), rounds=20).collect()}
    links = {(r.src, r.dst): r.n for r in edges.collect()}
    assert links == {("hub.org", "good.com"): 1, ("hub.org", "spam.net"): 1, ("good.com", "friend.org"): 1, ("spam.net", "hub.org"): 1}
    names = sorted({x for e in links for x in e})
    m = np.zeros((len(names), len(names)))
    for (a, b), n in links.items():
        m[names.index(a), names.index(b)] = n
    for k, (seed, w) in enumerate((("good.com", m), ("spam.net", m.T))):
        p = np.divide(w, w.sum(axis=1, keepdims=True), out=np.zeros_like(w), where=w.sum(axis=1, keepdims=True) > 0)
        start = np.array([float(n == seed) for n in names])
        rank = start
        for _ in range(20):
            rank = 0.85 * rank @ p + 0.15 * start
        assert np.allclose([found.get(n, (0, 0))[k] for n in names], rank)
