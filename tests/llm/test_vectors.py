"""Top-k search and vector near-dedup against brute force."""

import numpy as np
import pytest

from occulta.llm import common, queries, topk, vector_dedup

ODD = [(9000, None), (9001, [float("nan")] * 8), (9002, [float("inf")] + [0.0] * 7), (9003, [0.0] * 8), (9004, []), (9005, [1.0, 2.0]), (9005, [1.0, 2.0]), (9006, [None] + [1.0] * 7), (None, [1.0] * 8)]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int").repartition(3)


def best(ids, z, asked, k):
    out = []
    for q in asked:
        s = z @ z[q]
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != ids[q]][:k]
        out += [(int(ids[q]), r + 1, int(ids[i]), int(s[i])) for r, i in enumerate(order)]
    return sorted(out)


@pytest.mark.parametrize("block", [7, 64, 8192])
def test_top_k(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "ROW_BLOCK", block)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 5)
    rng = np.random.default_rng(block)
    x = np.round(rng.normal(size=(150, 8)), 1).astype(np.float32)  # many ties
    x[20:40] = x[3]
    rows = frame(spark, [*((int(k), [float(v) for v in r]) for k, r in enumerate(x)), *ODD])
    got = topk.top_k(rows, rows.filter("vec_id % 10 = 0"), 5).filter("query_id < 9000").collect()
    z = np.floor(256 * np.array(x, np.float64)).astype(np.int64)
    want = best(np.append(np.arange(150), [9003]), np.vstack([z, np.zeros((1, 8), np.int64)]), range(0, 150, 10), 5)
    assert sorted(map(tuple, got)) == want


def test_top_k_edges(spark):
    rows = frame(spark, ODD)
    got = sorted(map(tuple, topk.top_k(rows, rows.filter("vec_id IN (9000, 9004, 9005)"), 5).collect()))
    assert got == []  # no partner of the same length but the query's own id
    assert topk.top_k(rows.filter("false"), rows.filter("false"), 5).count() == 0
    big = frame(spark, [(0, [1e30, 1.0]), (1, [1.0, 1.0]), (2, [-1e30, 1.0])])
    assert [(r.vec_id, r.rank) for r in topk.top_k(big, big.filter("vec_id = 0"), 2).orderBy("rank").collect()] == [(1, 1), (2, 2)]


def test_reading_stops_early():
    rng = np.random.default_rng(1)
    rows = np.floor(256 * rng.normal(size=(4000, 4)))
    lists = topk.Lists(rows)
    left = topk.candidates(lists, rows[:3] * 3, [np.array([k]) for k in range(3)], 5)
    assert lists.depth < 4000
    skewed = topk.Lists(rows)
    topk.candidates(skewed, np.array([[1000.0, 1.0, 0.0, 1.0]]), [np.zeros(0, int)], 5)
    assert skewed.depth <= 128
    for q, some in left.items():
        scores = rows @ rows[q] * 3
        scores[q] = -np.inf
        assert len(some) <= topk.SPARE * 5 and set(np.argsort(-scores)[:5]) <= set(some.tolist()) and q not in some


def test_only_what_is_read_is_known():
    rng = np.random.default_rng(2)
    rows = np.floor(256 * rng.normal(size=(500, 6)))
    lists = topk.Lists(rows)
    seen = lists.read(20)
    rank = rows.argsort(axis=0, kind="stable").argsort(axis=0)
    assert (lists.high == (rank >= 480)).all() and (lists.low == (rank < 20)).all()
    assert (seen == np.flatnonzero(((rank >= 480) | (rank < 20)).any(axis=1))).all()
    assert (lists.got[lists.high | lists.low] == rows[lists.high | lists.low]).all() and not lists.got[~(lists.high | lists.low)].any()
    query = rng.normal(size=6)
    signed = np.concatenate([np.maximum(query, 0), np.minimum(query, 0)])
    assert (lists.filled(seen, lists.ends()) @ signed <= rows[seen] @ query + 1e-9).all() and (lists.filled(seen, lists.last()) @ signed >= rows[seen] @ query - 1e-9).all()
    assert (rows[np.setdiff1d(np.arange(500), seen)] @ query <= lists.last() @ signed + 1e-9).all()


def components(ids, x, least):
    u = vector_dedup.unit(x)
    link = u @ u.T >= least
    np.fill_diagonal(link, False)
    label = ids.copy()
    while True:
        new = np.array([min([label[i], *label[link[i]]]) for i in range(len(ids))])
        if (new == label).all():
            return link.sum(axis=1), label
        label = new


@pytest.mark.parametrize("block", [16, 4096])
def test_vector_dedup(spark, monkeypatch, block):
    monkeypatch.setattr(vector_dedup, "BLOCK", block)
    monkeypatch.setattr(vector_dedup, "TILE", 5)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 8))
    x = np.repeat(centres, 8, axis=0) + rng.normal(scale=0.12, size=(320, 8))
    x[100:160] = x[100] + rng.normal(scale=0.01, size=(60, 8))  # a hot group
    x[200:220] = x[200]  # copies
    x = x.astype(np.float32)
    ids = rng.permutation(320)
    rows = frame(spark, [*((int(i), [float(v) for v in r]) for i, r in zip(ids, x)), *ODD])
    got = {r.vec_id: r for r in vector_dedup.near_duplicate_vectors(rows).collect() if r.vec_id is not None and r.vec_id < 9000}
    n_links, label = components(ids, np.array(x, np.float64), 0.9)
    assert sum(got[i].n_links for i in ids) >= 0.9995 * n_links.sum()
    assert all(got[i].n_links <= n for i, n in zip(ids, n_links))
    assert sum(got[i].component_id == c for i, c in zip(ids, label)) >= 0.9995 * len(ids)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    odd = [tuple(r) for r in vector_dedup.near_duplicate_vectors(rows).filter("vec_id >= 9000").orderBy("vec_id").collect()]
    assert odd == [*((k, 0, k, True) for k in range(9000, 9005)), (9005, 1, 9005, True), (9005, 1, 9005, True), (9006, 0, 9006, True)]


def test_vector_dedup_empty(spark):
    assert vector_dedup.near_duplicate_vectors(frame(spark, ODD).filter("false")).count() == 0
    assert [tuple(r) for r in vector_dedup.near_duplicate_vectors(frame(spark, ODD[:1])).collect()] == [(9000, 0, 9000, True)]


def test_codes_are_balanced():
    rng = np.random.default_rng(0)
    x = vector_dedup.unit(rng.normal(size=(3000, 16)) * np.linspace(1, 3, 16))
    c = vector_dedup.Codes(x, 100_000)
    signs = ((x - c.mean) @ c.planes >= 0).mean(axis=0)
    assert abs(signs - 0.5).max() < 0.1 and c.of(x).max() < 1 << c.w


@pytest.mark.parametrize("rows", [8_000, 51_000, 1_000_000])
@pytest.mark.parametrize("offset", [0.3, 1.0, 2.0, 2.9])
def test_codes_of_vectors_with_a_common_mean(rows, offset):
    rng = np.random.default_rng(1)
    x = vector_dedup.unit(rng.normal(size=(2000, 64)))
    x = np.vstack([x, vector_dedup.unit(x + rng.normal(scale=0.05, size=x.shape))])
    x[:, 0] += offset
    x = vector_dedup.unit(x)
    made = vector_dedup.Codes(x, rows)
    codes, bits = made.of(x), made.bits(x)
    r, c = np.nonzero(np.triu(x @ x.T >= 0.9, 1))
    some = rng.permutation(len(r))[:20_000]
    meet = (codes[r[some]] == codes[c[some]]).any(axis=1) & ((bits[r[some]] != bits[c[some]]).sum(axis=1) <= made.radius)
    assert meet.mean() >= 0.9995


def test_distances_and_tables():
    rng = np.random.default_rng(4)
    made = vector_dedup.Codes(vector_dedup.unit(rng.normal(size=(2000, 32))), 50_000)
    bits = made.bits(vector_dedup.unit(rng.normal(size=(300, 32)))) if made.plan != "whole" else None
    assert made.plan != "whole"
    assert (made.unpacked(made.packed(bits)) == bits).all()
    bits[150:] = bits[:150] ^ (rng.random((150, bits.shape[1])) < 0.1)
    x = {"words": vector_dedup.words_of(made.packed(bits)), "codes": made.substrings(bits)}
    far = (bits[:, None] != bits[None]).sum(axis=2)
    meet = (x["codes"][:, None] == x["codes"][None]).any(axis=2)
    want = {(int(r), int(c)) for r, c in zip(*np.nonzero(np.triu((far <= made.radius) & meet, 1)))}
    got = [(int(r), int(c)) for t in range(made.tables) for rs, cs in vector_dedup.close_codes(x, x, True, t, made.radius) for r, c in zip(rs, cs)]
    assert sorted(got) == sorted(want) and len(want) > 100
    # fewer different bits than tables: one substring at least is the same
    assert meet[far < made.tables].all()


def test_vector_dedup_with_a_common_mean(spark):
    x = vector_dedup.unit(np.random.default_rng(2).normal(size=(400, 64)))
    x[:, 0] += 2.6
    x = x.astype(np.float32)
    got = {r.vec_id: r for r in vector_dedup.near_duplicate_vectors(frame(spark, [(k, [float(v) for v in r]) for k, r in enumerate(x)])).collect()}
    n_links, label = components(np.arange(400), np.array(x, np.float64), 0.9)
    assert [(got[i].n_links, got[i].component_id) for i in range(400)] == list(zip(n_links.tolist(), label.tolist()))


def test_registered_queries(spark, sf):
    t = common.table(spark, sf, "embeddings").toArrow()
    ids, x = np.array(t["vec_id"]), np.array(t["embedding"].to_pylist(), np.float64)
    got = sorted(map(tuple, queries.op5_top_k(spark, sf).collect()))
    assert got == best(ids, np.floor(256 * x).astype(np.int64), np.flatnonzero(ids % 50 == 0), 5)
    links, label = components(ids, x, 0.9)
    rows = {r.vec_id: r for r in queries.op7_vector_dedup(spark, sf).collect()}
    assert [(rows[i].n_links, rows[i].component_id) for i in ids] == list(zip(links.tolist(), label.tolist()))


@pytest.mark.parametrize("rows,offset", [(2, 0.0), (500, 0.0), (500, 1.5), (2000, 0.3), (50_000, 0.0)])
def test_rotations_are_learned_at_every_size(rows, offset):
    """Recall through the learned codes, of pairs about the threshold, against all pairs."""
    rng = np.random.default_rng(rows)
    x = rng.normal(size=(min(rows, 2000) // 2, 64))
    x[:, 0] += offset * 8
    x = vector_dedup.unit(np.vstack([x, x + rng.normal(scale=0.05, size=x.shape) * np.abs(x).mean(axis=1, keepdims=True) * rng.uniform(0, 12, size=(len(x), 1))]))
    made = vector_dedup.Codes(x, rows)
    assert made.plan == "learned" and made.w >= 4 and made.planes.shape == (64, made.w * made.tables)
    codes, bits = made.of(x), made.bits(x)
    r, c = np.nonzero(np.triu(x @ x.T >= 0.9, 1))
    meet = [(codes[a] == codes[b]).any() and (bits[a] != bits[b]).sum() <= made.radius for a, b in zip(r[:20_000], c[:20_000])]
    assert np.mean(meet) >= 0.999


def test_query_takes_its_method(spark, sf, monkeypatch):
    """The registered query's codes are learned; its links are those of all pairs."""
    made = []
    real = vector_dedup.fit
    monkeypatch.setattr(vector_dedup, "fit", lambda *a, **k: made.append(real(*a, **k)) or made[-1])
    table = common.table(spark, sf, "embeddings")
    got = sorted(tuple(r) for r in queries.op7_vector_dedup(spark, sf).collect())
    assert [(c.plan, c.tables > 1, c.planes.shape[0]) for c in made] == [("learned", True, 64)]
    exact = sorted(tuple(r) for r in vector_dedup.near_duplicate_vectors(table, plan="whole").collect())
    assert made[-1].plan == "whole" and got == exact


@pytest.mark.parametrize("plan", ["learned", "plain", "whole"])
def test_ties_at_the_threshold(spark, plan):
    """A cosine of exactly 0.9 is a link, one a little below isn't."""
    rows = [(0, [10.0, 0.0, 0.0, 0.0, 0.0]), (1, [9.0, 4.0, 1.0, 1.0, 1.0]), (2, [0.0, 0.0, 0.0, 0.0, -10.0]), (3, [4.0, 1.0, 1.0, 1.0, -9.0 + 2**-30])]
    frame_ = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in vector_dedup.near_duplicate_vectors(frame_, plan=plan).collect()}
    assert got == {0: 1, 1: 1, 2: 0, 3: 0}
