"""The pipeline against a plain version of each stage on the small tables."""

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from cladeframe.llm.common import Scratch, read_table
from cladeframe.llm.quality import fit_quality, statistics
from cladeframe.llm.toxicity import _Symbols, fit_grammar, tokens_of
from tests.conftest import SMALL
from tests.llm.test_dedup import brute_near, plain_passages


def test_pipeline(spark):
    docs, labels = read_table(spark, SMALL, "documents"), read_table(spark, SMALL, "labels")
    rows = {r.doc_id: r.text for r in docs.collect()}
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    scratch = Scratch(spark)

    model = fit_quality(docs, labels)
    good = scratch.save(stages["quality"](spark, docs, SMALL))
    assert good.columns == columns
    rows = {i: t for i, t in rows.items() if model.score(np.array([statistics(t)]))[0] >= 0.5}
    assert {r.doc_id: r.text for r in good.collect()} == rows

    grammar = fit_grammar(good, labels, Scratch(spark))
    clean = scratch.save(stages["toxicity"](spark, good, SMALL))
    rows = {i: t for i, t in rows.items() if grammar.score(np.array([grammar.arcs(tokens_of(t), _Symbols(grammar))]))[0] < 0.5}
    assert clean.columns == columns and {r.doc_id: r.text for r in clean.collect()} == rows

    single = scratch.save(stages["near_dedup"](spark, clean, SMALL))
    _, component = brute_near(rows.items(), 5)
    rows = {i: t for i, t in rows.items() if component[i] == i}
    assert single.columns == columns and {r.doc_id: r.text for r in single.collect()} == rows

    cut = scratch.save(stages["substring_dedup"](spark, single, SMALL))
    rows = {i: t for i, (t, _) in plain_passages(rows.items()).items()}
    assert cut.columns == columns and {r.doc_id: r.text for r in cut.collect()} == rows
    assert all(r.n_chars == len(r.text) for r in cut.collect())

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = sum(len(library.encode(t, add_special_tokens=False).ids) + 1 for t in rows.values())
    packed = stages["packing"](spark, cut, SMALL).toPandas()
    assert packed["length"].sum() == expected and packed["sequence_id"].max() == (expected - 1) // 1024
    assert set(packed["doc_id"]) == rows.keys()

    whole = corpus_pipeline.run(spark, SMALL).toPandas()
    key = ["doc_id", "start"]
    assert whole[key + ["doc_tokens"]].groupby("doc_id")["doc_tokens"].first().to_dict() == packed.groupby("doc_id")["doc_tokens"].first().to_dict()


EDGE = [(1, "A good text of some words.", 0.1, 9, None), (1, "A good text of some words.", 0.1, 9, None), (2, None, None, None, "x"), (3, "", 0.2, 1, ""),
        (None, "a row without an id, in some words", 0.3, 2, "y"), (4, "word " * 30_000, 0.4, 3, "z"), (5, "A good text of some words.", 0.5, 4, "k")]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_with_odd_rows_and_clashing_columns(spark, name):
    """Null ids and texts, empty and long ones, repeated rows, an empty table, and columns named like the stages' own."""
    stage = dict(corpus_pipeline.STAGES)[name]
    own = {"quality": ("quality_score", "Quality_Predicted", "rest"), "toxicity": ("toxicity_score", "Toxicity_Predicted", "rest"),
           "near_dedup": ("n_shingles", "kept", "sig"), "substring_dedup": ("spans", "n_removed", "cut"), "packing": ("start", "length", "ids")}
    columns = own[name]
    docs = spark.createDataFrame(EDGE, f"doc_id long, text string, {columns[0]} double, {columns[1]} int, {columns[2]} string")
    got = stage(spark, docs, SMALL)
    rows = got.collect()
    assert stage(spark, docs.where("false"), SMALL).count() == 0
    if name == "packing":
        assert len({r.doc_id for r in rows}) == 6 and sum(r.start == 0 for r in rows) == len(EDGE)
        return
    assert got.columns == docs.columns
    given = {(i, x, y, z) for i, _, x, y, z in EDGE}
    assert {(r[0], r[2], r[3], r[4]) for r in rows} <= given
    if name == "near_dedup":
        assert sorted((r[0] is None, r[0] or 0) for r in rows) == [(False, 1), (False, 1), (False, 2), (False, 3), (False, 4), (True, 0)]
    if name == "substring_dedup":
        assert len(rows) == len(EDGE) and {r[1] for r in rows if r[0] in (2, 3)} == {""}
