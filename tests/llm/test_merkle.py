"""Merkle manifests against a plain tree."""

import zlib
from hashlib import sha256

import numpy as np
import pytest

from occulta.llm import common, merkle, queries


def h(text):
    return sha256(text.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes, fanout=8):
    """(top, for each leaf its siblings level by level: (those before, those behind))."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = i - i % fanout
            paths[k].append(("".join(nodes[run:i]), "".join(nodes[i + 1 : run + fanout])))
            at[k] = i // fanout
        nodes = [h("".join(nodes[k : k + fanout])) for k in range(0, len(nodes), fanout)]
    return nodes[0], paths


def expected(rows, tampered):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    made = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        made[g] = tree([leaf(r) for r in groups[g]])
    root, upper = tree([made[g][0] for g in order])
    out = []
    for g, above in zip(order, upper):
        for r, path in zip(groups[g], made[g][1]):
            path, fold = path + above, leaf(tampered(r))
            for x, y in path:
                fold = h(x + fold + y)
            out.append((r[0], leaf(r), made[g][0], root, h("".join(x + y for x, y in path)), fold, fold == root))
    return sorted(out, key=str)


def tampered(r):
    bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None
    return (*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])) if bad else r


@pytest.mark.parametrize("levels", [1, 4])
def test_manifest(spark, levels):
    rng = np.random.default_rng(levels)
    rows = [(int(k), None if k % 11 == 0 else f"s{k % 3}", [None, "en", "é", "zz", "only"][4 if k == 5 else int(rng.choice(4, p=[0.02, 0.5, 0.06, 0.42]))], None if k % 13 == 0 else int(k), [None, "", "Abc É", "x" * 500][k % 4]) for k in rng.permutation(700)]
    rows += [rows[0], rows[0], (None, "s", "en", 1, "No Id"), (None, "s", "en", 1, "no id")]
    frame = spark.createDataFrame([(*r, "g", 1, b"x") for r in rows], "doc_id long, source string, lang string, n_chars int, text string, g string, pos int, digest binary").repartition(5)
    altered = merkle.F.when(merkle.F.crc32(merkle.F.col("doc_id").cast("string").cast("binary")) % 3 == 0, merkle.leaf(text=merkle.lowered()))
    got = sorted((tuple(r) for r in merkle.verify(frame, altered=altered, levels=levels).collect()), key=str)
    assert got == expected(rows, tampered)


def test_few_rows(spark):
    frame = spark.createDataFrame([(1, "s", "en", 2, "Ab")], "doc_id long, source string, lang string, n_chars int, text string")
    assert merkle.verify(frame.filter("false")).count() == 0
    (one,) = merkle.verify(frame).collect()
    assert one.leaf == one.subroot == one.root == one.folded_root == leaf((1, "s", "en", 2, "Ab")) and one.verified and one.proof_sha256 == h("")


def test_siblings_by_index():
    leaves = np.frombuffer(b"".join(h(str(k)).encode() for k in range(21)), np.uint8).reshape(-1, 64)
    levels = merkle.levels_of(leaves, 21)
    assert [len(x) for x in levels] == [21, 3, 1]
    for level, (text, there, before) in zip(range(2), merkle.siblings(levels)):
        for i in range(21):
            node = i // 8**level
            run = [levels[level][k].tobytes() for k in range(node - node % 8, min(node - node % 8 + 8, len(levels[level])))]
            assert there[i] == len(run) - 1 and before[i] == node % 8 and text[i, : 64 * there[i]].tobytes() == b"".join(run[: node % 8] + run[node % 8 + 1 :])


def test_whole_table(spark, sf):
    got = sorted((tuple(r) for r in queries.op12_merkle(spark, sf).collect()), key=str)
    rows = [tuple(r) for r in common.table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert got == expected(rows, tampered)
    assert 0 < sum(not r[6] for r in got) < len(got)
