"""Near-duplicates, repeated passages and components against brute force."""

import itertools
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from cladeframe.llm import epsilongrid, minhash, queries, substrings
from cladeframe.llm.common import Scratch, read_table
from cladeframe.llm.components import connected_components
from cladeframe.llm.epsilongrid import near_vectors
from cladeframe.llm.minhash import near_duplicates, shingle_sets
from cladeframe.llm.substrings import substring_dedup
from tests.conftest import SMALL


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(name, same):
    same(queries.QUERIES[name], queries.ORACLE_SQL[name])


def union_find(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def words(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def shingles(text, width):
    w = words(text)
    return set(zip(*[w[k:] for k in range(width)])) if len(w) >= width else ({tuple(w)} if w else set())


def brute_near(rows, width):
    sets, holders, shared = {i: shingles(t, width) for i, t in rows}, defaultdict(list), defaultdict(int)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    for ids in holders.values():
        for a, b in itertools.combinations(sorted(ids), 2):
            shared[a, b] += 1
    links = [(a, b) for (a, b), n in shared.items() if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n)]
    return sets, union_find(sets, links)


def test_components(spark):
    r = random.Random(5)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1060)] + [(7, None), (None, 7), (9, 9)]
    edges += [(2000, k) for k in range(2001, 2100)]
    real = [(a, b) for a, b in edges if a is not None and b is not None and a != b]
    expected = union_find({x for e in real for x in e}, real)
    got = connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect()
    assert {r.node: r.component for r in got} == expected and len(got) == len(expected)
    assert connected_components(spark.createDataFrame([], "a long, b long"), Scratch(spark)).count() == 0


def test_shingle_sets():
    texts = ["A b  c\td e", "a B c d", "a b c", None, "", " \n", "É b c d e", "é b c d e", "x\x00y z w v"]
    for width in (4, 5):
        sets = shingle_sets(texts, width)
        assert [len(s) for s in sets] == [len(shingles(t, width)) for t in texts]
        for i, j in itertools.combinations(range(len(texts)), 2):
            assert len(np.intersect1d(sets[i], sets[j])) == len(shingles(texts[i], width) & shingles(texts[j], width))


def variants(r, base, n, share):
    out = []
    for _ in range(n):
        w = list(base)
        for k in r.sample(range(len(w)), int(share * len(w))):
            w[k] = f"w{r.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("slice_size, shingles_held", [(4096, 3_000_000), (8, 3_000_000), (64, 1500)])
def test_near_duplicates_against_brute_force(spark, monkeypatch, slice_size, shingles_held):
    monkeypatch.setattr(minhash, "SLICE", slice_size)
    monkeypatch.setattr(minhash, "STAR", slice_size)
    monkeypatch.setattr(minhash, "TILE", slice_size)
    monkeypatch.setattr(minhash, "STAR_SHINGLES", shingles_held)
    r = random.Random(11)
    base = [f"w{r.randrange(10**6)}" for _ in range(120)]
    other = [f"w{r.randrange(10**6)}" for _ in range(200)]
    texts = variants(r, base, 40, 0.02) + variants(r, base, 30, 0.06) + variants(r, other, 10, 0.03) + [" ".join(base)] * 12
    passage = " ".join(f"p{k}" for k in range(60))
    texts += [passage + " " + " ".join(f"w{r.randrange(10**6)}" for _ in range(r.randrange(5, 90))) for _ in range(40)]
    texts += ["", None, "one", "One", "one two three", " ", "a b c d e f g"] * 2
    r.shuffle(texts)
    rows = list(enumerate(texts))
    for width in (4, 5):
        sets, component = brute_near(rows, width)
        got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark), width).collect()
        assert len(got) == len(rows)
        assert {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in got} == {
            i: (len(sets[i]), component[i], component[i] == i) for i in sets}


def test_each_two_partners_of_a_hub_meet(spark, monkeypatch):
    monkeypatch.setattr(minhash, "TILE", 8)
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(50)], "doc_id long, text string")
    pairs = [(0, k, 10) for k in range(1, 42)] + [(1, 43, 10), (1, 44, 10)]
    rows = minhash._hub_rows(docs, spark.createDataFrame(pairs, "a long, b long, n long"), Scratch(spark), tiled=True).collect()
    tasks = {}
    for x in rows:
        tasks.setdefault((x.a, x.slice), []).append(x)
    met = set()
    for (a, _), task in tasks.items():
        assert [x.b for x in task if x.role == 0] == [a] and len(task) <= 2 * 8 + 1
        met |= {(a, *sorted(c)) for c in itertools.combinations([x.b for x in task if x.role == 1], 2)}
    assert met == {(0, *c) for c in itertools.combinations(range(1, 42), 2)} | {(1, 43, 44)}


def test_near_duplicates_edge_cases(spark):
    rows = [(1, "a b c d e", "k"), (1, "a b c d e", "k"), (2, "A b c d e", None), (None, "a b c d e", "k"), (3, None, "k"), (4, "word " * 30_000, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sig string")
    got = sorted(map(tuple, near_duplicates(docs, Scratch(spark)).collect()), key=repr)
    assert got == sorted([(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (None, 1, None, True), (3, 0, 3, True), (4, 1, 4, True)], key=repr)
    assert near_duplicates(docs.where("false"), Scratch(spark)).count() == 0
    with pytest.raises(ValueError):
        near_duplicates(docs, Scratch(spark), percent=70)


def plain_units(text):
    """Units by reading characters: after marks or line ends (and what blanks follow), or after a word of such a length and end."""
    out, i, n = [], 0, len(text)
    while i < n:
        j = i
        while j < n and text[j] not in " \t\r\n.,;:!?":
            j += 1
        k = j
        while k < n and text[k] in " \t\r\n.,;:!?":
            k += 1
        piece, core = text[i:k], text[i:j]
        ends = any(c in "\n.,;:!?" for c in text[j:k]) or (core and (len(core.encode()) + re.sub("[A-Z]$", lambda m: m[0].lower(), core).encode()[-1]) % substrings.CUT == 0)
        if out and not out[-1][1]:
            out[-1] = (out[-1][0] + piece, ends)
        else:
            out.append((piece, ends))
        i = k
    return [u for u, _ in out]


def plain_passages(rows, least=20):
    """``id -> (clean text, removed spans)``: windows of enough words of which an earlier one is equal."""
    seen, out = set(), {}
    for i, text in sorted((i, t) for i, t in rows if i is not None and t is not None):
        parts = plain_units(text)
        norm = [" ".join(re.findall(r"[^ \t\r\n]+", re.sub("[A-Z]", lambda m: m[0].lower(), u))) for u in parts]
        count = [len(u.split(" ")) if u else 0 for u in norm]
        spans = set()
        for p in range(len(parts)):
            for step in (1, -1):
                q, total = p, 0
                while 0 <= q < len(parts):
                    total += count[q]
                    if total >= least:
                        spans.add((min(p, q), max(p, q)))
                        break
                    q += step
        gone = set()
        for a, b in sorted(spans):
            key = tuple(norm[a:b + 1])
            if key in seen:
                gone |= set(range(a, b + 1))
            seen.add(key)
        starts = np.cumsum([0, *map(len, parts)]).tolist()
        runs = []
        for k in sorted(gone):
            if runs and runs[-1][1] == starts[k]:
                runs[-1] = (runs[-1][0], starts[k + 1])
            else:
                runs.append((starts[k], starts[k + 1]))
        out[i] = "".join(u for k, u in enumerate(parts) if k not in gone), ";".join(f"{a}+{b - a}" for a, b in runs)
    return out


def test_passages_against_brute_force(spark, monkeypatch):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdéxyz") for _ in range(r.randrange(1, 9))) + r.choice(["", "", "", ",", ". ", "!", "\n", "?."])
    shared = [" ".join(word() for _ in range(n)) for n in (12, 19, 25, 60, 200)] + [" ".join(f"plain{k}" for k in range(70))]
    rows = []
    for i in range(150):
        text = " ".join(" ".join(word() for _ in range(r.randrange(30))) + " " + r.choice(["", *shared]) for _ in range(r.randrange(1, 4)))
        rows.append((i, r.choice([text, text.upper(), " ..  " + text, text + "  \n"])))
    rows += [(200, "ha ha! " * 60), (201, "same line again.\n" * 30), (202, "   "), (203, "."), (204, rows[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for held in (500_000, 50):
        monkeypatch.setattr(substrings, "HELD_WINDOWS", held)
        got = {x.doc_id: (x.text, x.spans) for x in substring_dedup(docs, Scratch(spark)).collect()}
        assert got == plain_passages(rows)
    assert got[204][0] == "" and got[202] == ("   ", "") and len(got[200][0]) < 200


def test_patchwork_stays(spark):
    """Clauses that stand apart in other documents make no passage; a passage without marks inside a line is found."""
    clauses = [" ".join(f"c{k}w{i}" for i in range(8)) + "." for k in range(4)]
    passage = " ".join(f"word{i % 7}x{i}" for i in range(55))
    rows = [*enumerate(clauses), (10, " ".join(clauses)), (11, f"one two three {passage} four five"), (12, f"something else {passage} at last")]
    got = {x.doc_id: x for x in substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark)).collect()}
    assert got[10].n_removed == 0 and got[11].n_removed == 0
    assert got[12].removed_chars > 0.6 * len(passage) and got[12].text.startswith("something else")


def test_passages_go_and_short_lines_stay(spark):
    passage = " ".join(f"Word{k}" + ("." if k % 9 == 8 else "") for k in range(60))
    rows = [(1, f"Intro one.\n{passage}\nAll rights reserved.", 5), (2, f"Other start. {passage} Other end.\nAll rights reserved.", 6),
            (3, f"{passage.upper()}\n{passage}", 7), (4, "Clean text. All rights reserved.", 8), (5, None, 9), (6, "", 10), (None, passage, 11),
            (7, "x" * 200_000, 12), (7, "x" * 200_000, 12), (8, f"one {passage}", 1), (8, f"two {passage} two", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_removed int")
    got = {(r.doc_id, r.text, r.n_removed > 0, r.spans) for r in substring_dedup(docs, Scratch(spark)).collect()}
    texts = {i: (t, s) for i, t, _, s in got}
    assert texts[1] == (rows[0][1], "") and texts[4] == (rows[3][1], "") and texts[None] == (passage, "")
    assert "Word30" not in texts[2][0] and texts[2][0].startswith("Other start.") and texts[2][0].endswith("All rights reserved.")
    assert "WORD30" not in texts[3][0] and "Word30" not in texts[3][0]
    assert texts[5] == ("", "") and texts[6] == ("", "") and len(texts[7][0]) == 200_000
    assert [len(t) < len(passage) / 2 for i, t, _, _ in got if i == 8] == [True, True]
    for key in (2, 3):  # spans are offsets of the original
        original, out, at = dict((i, t) for i, t, _ in rows)[key], [], 0
        for start, length in (map(int, s.split("+")) for s in texts[key][1].split(";")):
            out.append(original[at:start])
            at = start + length
        assert "".join(out) + original[at:] == texts[key][0]
    assert substring_dedup(docs.where("false"), Scratch(spark)).count() == 0
    kept = substrings.clean_texts(docs, Scratch(spark)).collect()
    assert len(kept) == len(rows) and {x.n_removed for x in kept if x.doc_id == 2} == {6}


def test_vectors_against_brute_force(spark):
    r = np.random.default_rng(3)
    centers = r.normal(size=(20, 12))
    x = np.repeat(centers, 15, axis=0) + r.normal(size=(300, 12)) * 0.25
    rows = [(i, [float(v) for v in np.float32(x[i])], int(i % 3)) for i in range(300)]
    rows += [(300 + k, rows[0][1], 0) for k in range(5)] + [(400, None, 1), (401, [0.0] * 12, 1), (402, [float("nan")] + [1.0] * 11, 1),
             (403, [None] + [1.0] * 11, 1), (404, rows[1][1], None), (405, [], 2), (406, [1.0, 2.0], 2), (407, [2.0, 4.0], 2), (408, [float("inf")] * 12, 2)]
    sound = {i: (np.array(e, dtype=float), l) for i, e, l in rows if e and l is not None and None not in e and np.isfinite(e).all() and any(e)}
    links = [(a, b) for a, b in itertools.combinations(sound, 2) if sound[a][1] == sound[b][1] and len(sound[a][0]) == len(sound[b][0])
             and sound[a][0] @ sound[b][0] / np.linalg.norm(sound[a][0]) / np.linalg.norm(sound[b][0]) >= 0.93]
    component = union_find([i for i, *_ in rows], links)
    degree = defaultdict(int)
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = near_vectors(vectors, Scratch(spark)).collect()
    assert {v.vec_id: (v.n_links, v.component_id, v.kept) for v in got} == {i: (degree[i], component[i], component[i] == i) for i, *_ in rows}
    assert len(links) > 100 and len(got) == len(rows)
    assert near_vectors(vectors.where("false"), Scratch(spark)).count() == 0


def test_vectors_of_extreme_size_and_many_blocks(spark, monkeypatch):
    """Squares beyond what a double holds, and tiles of several blocks."""
    rows = [(1, [1.0, 2.0], 0), (2, [2.0, 4.0], 0), (3, [1e-200, 0.0], 0), (4, [2e-200, 1e-210], 0), (5, [1e200, 2e200], 0), (6, [5e-324, 0.0], 0)]
    got = {v.vec_id: (v.n_links, v.component_id) for v in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), Scratch(spark)).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 5: (2, 1), 3: (2, 3), 4: (2, 3), 6: (2, 3)}
    monkeypatch.setattr(epsilongrid, "BLOCK", 16)
    monkeypatch.setattr(epsilongrid, "TILE", 3)
    r = np.random.default_rng(4)
    x = np.float32(np.repeat(r.normal(size=(40, 8)), 12, axis=0) + r.normal(size=(480, 8)) * 0.2)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    links = [(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(unit @ unit.T >= 0.93, 1)))]
    component, degree = union_find(range(480), links), np.bincount(np.array(links).ravel(), minlength=480)
    vectors = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = {v.vec_id: (v.n_links, v.component_id) for v in near_vectors(vectors, Scratch(spark)).collect()}
    assert got == {i: (int(degree[i]), component[i]) for i in range(480)}


def test_one_text_stands_for_a_repeated_id(spark):
    base = [f"w{k}" for k in range(60)]
    rows = [(1, " ".join(base)), (2, "some other short text of seven words"), (2, " ".join(base[:-1])), (3, "some other short text of seven words")]
    got = sorted(map(tuple, near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark)).collect()))
    assert got == [(1, 56, 1, True), (2, 3, 1, False), (2, 55, 1, False), (3, 3, 3, True)]


def test_queries_cover_whole_tables(spark):
    n = read_table(spark, SMALL, "documents").count()
    for name in ("op1_substring_dedup", "op2_minhash_near_dedup", "op4_toxicity", "op5_sentencepiece", "op6_token_counts", "op8_media_columns", "op10_quality_classifier"):
        assert queries.QUERIES[name](spark, SMALL).count() == n
