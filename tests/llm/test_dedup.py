"""Near-duplicate documents, components of links, and the pipeline."""

import random
import re
from collections import Counter

import numpy as np
import pytest


import corpus_pipeline
from occulta.llm import common, graph, near_dedup, queries, tokenise


def bags(text):
    w = re.findall(r"\w+", (text or "").lower())
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def jaccard(a, b):
    joint = sum((a & b).values())
    total = sum(a.values()) + sum(b.values()) - joint
    return joint / total if total else 0.0


def classes(rows, least=0.8):
    """Least id of each row's class: equal lower-cased texts, or similar ones, directly or by others."""
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    b = [bags(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] or "").lower() == (rows[j][1] or "").lower() or jaccard(b[i], b[j]) >= least:
                parent[max(top(i), top(j))] = min(top(i), top(j))
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(top(i), []).append(d)
    return [(d, min([x for x in groups[top(i)] if x is not None], default=None), len(groups[top(i)])) for i, (d, _) in enumerate(rows)]


def some_rows():
    rng = random.Random(4)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for g in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([3, 6, 40, 120]))]
        for _ in range(rng.choice([1, 2, 6])):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append(" ".join(t))
    hot = [rng.choice(words) for _ in range(100)]
    for _ in range(60):  # near copies, some too far from most
        t = list(hot)
        for _ in range(rng.choice([0, 1, 2, 3, 4])):
            t[rng.randrange(len(t))] = rng.choice(words)
        rows.append(" ".join(t).capitalize())
    rows += [None, "", "", "!!!", "?", "one two", "ONE two", "same line here again now\n" * 50, "same line here again now\n" * 49, " ".join(words) * 20]
    return [(100 - k if k % 2 else 200 + k, t) for k, t in enumerate(rows)] + [(-500, rows[0]), (-500, rows[0]), (None, "nobody has this text at all today")]


@pytest.mark.parametrize("block", [150, 400_000])
def test_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK_WORDS", block)
    rows = some_rows()
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, class_id string").repartition(5)
    got = sorted(((r.doc_id, r.class_id, r.class_size) for r in near_dedup.near_duplicates(df).collect()), key=str)
    assert got == sorted(classes(rows), key=str)


def test_one_of_each(spark):
    rows = some_rows() + [(None, "a second text that has no id either here"), (None, "a second text that has no id either here")]
    df = spark.createDataFrame([(d, t, k) for k, (d, t) in enumerate(rows)], "doc_id long, text string, kept int").repartition(3)
    got = near_dedup.one_of_each(df).collect()
    groups = {(c, n if c is None else 0, (t or "").lower() if c is None else "") for (d, c, n), (_, t) in zip(classes(rows), rows)}
    assert len(got) == len(groups) and sorted(str(r.doc_id) for r in got) == sorted(str(c) for c, _, _ in groups)


def test_rows_without_ids_are_linked(spark):
    rng = random.Random(9)
    rows = []
    for g, ids in enumerate([(None, 5), (None, None, 7), (8, 9), (None, None)]):
        base = [f"g{g}w{rng.randrange(300)}" for _ in range(80)]
        for k, i in enumerate(ids):  # near copies, some without an id
            rows.append((i, " ".join([*base[:-1], f"end{k}"])))
    rows += [(None, rows[5][1]), (None, rows[1][1])]  # exact copies, without an id, of linked texts
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = near_dedup.near_duplicates(df).select("doc_id", "class_id", "class_size").collect()
    assert sorted(map(tuple, got), key=str) == sorted(classes(rows), key=str)
    assert sorted(str(r.doc_id) for r in near_dedup.one_of_each(df).collect()) == ["5", "7", "8", "None"]


def test_near_duplicates_empty(spark):
    assert near_dedup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = near_dedup.near_duplicates(spark.createDataFrame([(None, None)], "doc_id long, text string")).first()
    assert tuple(one)[:4] == (None, None, 1, True)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    for share in (0.3, 0.8):
        both, one = rng.integers(1, 1 << 62, int(600 * share)).astype(np.uint64), rng.integers(1, 1 << 62, int(600 * (1 - share))).astype(np.uint64)
        wb, wo = rng.integers(1, 5, len(both)).astype(float), rng.integers(1, 5, len(one)).astype(float)
        doc = np.repeat([0, 1], [len(both) + len(one), len(both)])
        s = near_dedup.signatures(doc, np.concatenate([both, one, both]), np.concatenate([wb, wo, wb]), 2, 1040)
        assert abs((s[0] == s[1]).mean() - wb.sum() / (wb.sum() + wo.sum())) < 0.06
    # fractions of a weight count too
    s = near_dedup.signatures(np.array([0, 1]), np.array([5, 5], np.uint64), np.array([1.0, 0.5]), 2, 1040)
    assert abs((s[0] == s[1]).mean() - 0.5) < 0.06


def test_exact_similarities():
    rng = random.Random(2)
    texts = [" ".join(rng.choice("a b c d é".split()) for _ in range(rng.randint(0, 40))) for _ in range(60)]
    left, right = texts[:30], texts[30:]
    got = near_dedup.similarities(left, right)
    assert np.allclose(got, [jaccard(bags(a), bags(b)) for a, b in zip(left, right)])


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 460)] + [(500, k) for k in range(501, 560)] + [(1, 1), (None, 3)]
    parent = {}

    def top(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in edges:
        if a is not None and a != b:
            parent[max(top(a), top(b))] = min(top(a), top(b))
    want = {i: top(i) for i in list(parent)}
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == want
    assert graph.components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_registered_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in common.table(spark, sf, "documents").collect()]
    got = sorted((r.doc_id, r.class_id, r.class_size) for r in queries.op10_minhash(spark, sf).collect())
    assert got == sorted(classes(rows))


def test_pipeline(spark, sf, monkeypatch):
    seen = {}
    docs = common.table(spark, sf, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, sf), name)
        assert docs.columns == corpus_pipeline.COLUMNS
        seen[name] = {r.doc_id: r.text for r in docs.collect()}
    given = {r.doc_id: r.text for r in common.table(spark, sf, "documents").collect()}
    assert set(seen["language"]) >= {d for d, t in given.items() if re.search(r"[^\W\d_]{3}", t)}
    want = {c for _, c, _ in classes(sorted(seen["language"].items()))}
    assert set(seen["near_duplicates"]) == want and set(seen["personal_data"]) == want
    assert not any(re.search(r"[\w.]@mail\d\.example\.com|\+1 \(\d{3}\) \d{3}-\d{4}", t) for t in seen["personal_data"].values())
    library = tokenise.encoder(tokenise.default_path()).tokenizer
    pieces = corpus_pipeline.run(spark, sf).collect()
    total = {}
    for p in pieces:
        total[p.doc_id] = total.get(p.doc_id, 0) + p.length
    assert total == {d: len(library.encode(t, add_special_tokens=False).ids) + 1 for d, t in seen["personal_data"].items()}


def test_pipeline_edges(spark, sf):
    rows = [(1, None, "en", "s", 0), (2, "", None, None, None), (3, "The cat and the dog live at a@b.fr here", "en", "s", 3), (3, "The cat and the dog live at a@b.fr here", "en", "s", 3), (4, "123 456", "en", "s", 1), (None, "Der Hund und die Katze sind da", "de", "s", 2), (5, "the cat " * 3000, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.language(spark, docs, sf)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["3", "3", "5", "None"]
    one = corpus_pipeline.near_duplicates(spark, kept, sf)
    assert sorted(str(r.doc_id) for r in one.collect()) == ["3", "5", "None"]
    clean = {r.doc_id: r.text for r in corpus_pipeline.personal_data(spark, one, sf).collect()}
    assert clean[3] == "The cat and the dog live at [EMAIL] here"
    assert {r.doc_id for r in corpus_pipeline.pack(spark, corpus_pipeline.personal_data(spark, one, sf), sf).collect()} == {3, 5, None}
    none = docs.filter("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf).count() == 0

