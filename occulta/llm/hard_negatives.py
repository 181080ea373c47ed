"""Hard negatives by ball trees: for each anchor and positive the nearest rows of other labels within a score window.

Rows are dealt to blocks of fixed size, and each block has a tree of balls:
nodes are halves of their parents, split by the direction between two far rows,
with a centre and the distance of the farthest row from it. A query's inner
product with any row of a ball lies within |query| x radius of that with the
centre, on either side. Nodes whose bounds miss the window are pruned from the
root down; leaves are then read, each query's most promising first, and one
whose upper bound is strictly beneath the query's current k-th score is pruned
too. Ties with the k-th are kept apart by id, so nothing that ties is lost.

Positives come from trees over rows of one label, negatives from trees over all
rows; both are exact whole numbers. The queries are a stated set, dealt to blocks
of their own; the best of each pair of blocks meet in a last ranking.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common, vectors

SCALE = 256
ROW_BLOCK, QUERY_BLOCK, LEAF = 8192, 2048, 64
#: Products and packed keys stay exact in 64 bits up to this score; beyond it whole numbers of any size are used.
_EXACT = 1 << 46
SCHEMA = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


class BallTree:
    """Balls over the rows of a block. Level ``l`` has ``2 ** l`` nodes; node ``j`` holds ``order[n * j >> l : n * (j + 1) >> l]``."""

    def __init__(self, rows: np.ndarray, leaf: int = LEAF):
        n = len(rows)
        self.depth = max(0, int(np.ceil(np.log2(max(1, n / leaf)))))
        order = np.arange(n)
        with np.errstate(all="ignore"):
            self._split(rows, order)
        self.order, self.n = order, n
        self.centres, self.radii = [], []
        for level in range(self.depth + 1):
            balls = [rows[order[slice(*self.ends(n, level, j))]] for j in range(1 << level)]
            with np.errstate(all="ignore"):
                centres = np.array([x.mean(axis=0) for x in balls])
                self.centres.append(centres)
                self.radii.append(np.array([np.sqrt(((x - c) ** 2).sum(axis=1).max()) for x, c in zip(balls, centres)]))

    def _split(self, rows: np.ndarray, order: np.ndarray) -> None:
        """Order rows so that a node's are next to each other: each node is cut in the middle along the line between two far rows."""
        n = len(rows)
        for level in range(self.depth):
            for j in range(1 << level):
                a, b = self.ends(n, level, j)
                some = rows[order[a:b]]
                far = some[((some - some[:1]) ** 2).sum(axis=1).argmax()]
                other = some[((some - far) ** 2).sum(axis=1).argmax()]
                middle = self.ends(n, level + 1, 2 * j)[1] - a
                order[a:b] = order[a:b][np.argpartition(some @ (other - far), middle) if 0 < middle < b - a else slice(None)]

    @staticmethod
    def ends(n: int, level: int, j: int) -> tuple[int, int]:
        return n * j >> level, n * (j + 1) >> level

    def bounds(self, queries: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest inner product of each query with any row of each node of a level, rounding allowed for."""
        with np.errstate(all="ignore"):
            middle, length = queries @ self.centres[level].T, np.sqrt((queries * queries).sum(axis=1))[:, None]
            reach = length * self.radii[level]
            reach = reach + 1e-9 * (reach + length * np.sqrt((self.centres[level] ** 2).sum(axis=1)))
            low, high = middle - reach, middle + reach
        # beyond what doubles hold nothing is known, and nothing pruned
        return np.where(np.isnan(low), -np.inf, low), np.where(np.isnan(high), np.inf, high)


def search(rows: np.ndarray, labels: np.ndarray, queries: np.ndarray, asks: dict[str, np.ndarray], k: int, differ: bool, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ask, row, score) of the ``k`` best rows of one block for each ask, ties by place.

    Rows are in the order of their ids. An ask has ``query`` (its row among
    ``queries``), ``own`` (rows [from, to) that take no part), ``label`` and a
    window ``low`` to ``high`` of scores; only rows of another label count if
    ``differ``, of its own otherwise.
    """
    n, shift = len(rows), len(rows).bit_length()
    exact = rows.shape[1] * float(np.abs(rows).max(initial=0)) * float(np.abs(queries).max(initial=0)) < _EXACT
    tree = BallTree(rows, leaf)
    query, low, high = asks["query"], asks["low"], asks["high"]
    near, far = low.astype(float), high.astype(float)
    alive = np.ones((len(query), 1), bool)
    for level in range(tree.depth + 1):
        if level:
            alive = alive.repeat(2, axis=1)
        least, most = (x[query] for x in tree.bounds(queries, level))
        alive &= (most >= near[:, None]) & (least <= far[:, None])
    # keys of the best so far: score and place as one number, the smaller place ahead
    kind = np.int64 if exact else object
    void = -(1 << 62) if exact else -(1 << 200)
    best = np.full((len(query), k), void, kind)
    whole = (lambda x: x.astype(np.int64)) if exact else (lambda x: np.array([[int(v) for v in r] for r in x.tolist()], object).reshape(x.shape))
    rows_, queries_ = (rows, queries) if exact else (whole(rows), whole(queries))
    bottom, top = (np.clip(x.astype(float), -(1 << 61), 1 << 61).astype(np.int64) for x in (low, high)) if exact else (low, high)

    def read(node: int, some: np.ndarray) -> None:
        a, b = tree.ends(n, tree.depth, node)
        at = tree.order[a:b]
        asked, place = np.unique(query[some], return_inverse=True)
        scores = (queries_[asked] @ rows_[at].T)[place]
        if exact:
            scores = scores.astype(np.int64)
        good = (scores >= bottom[some, None]) & (scores <= top[some, None]) & ((labels[at] != asks["label"][some, None]) == differ)
        good &= ~((at >= asks["from"][some, None]) & (at < asks["to"][some, None]))
        keys = np.where(good, scores * (1 << shift) + (n - 1 - at), void)
        both = np.concatenate([best[some], keys], axis=1)
        best[some] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:] if exact else np.sort(both, axis=1)[:, -k:]

    if n and len(query):
        first = np.where(alive, most, -np.inf).argmax(axis=1)
        for node in np.unique(first[alive.any(axis=1)]):
            read(int(node), np.flatnonzero((first == node) & alive[:, node]))
        alive[np.arange(len(query)), first] = False
        for node in np.argsort(-np.where(alive, most, 0).sum(axis=0) / np.maximum(1, alive.sum(axis=0))):
            kth = best.min(axis=1) >> shift if exact else np.array([x >> shift for x in best.min(axis=1)], object)
            some = np.flatnonzero(alive[:, node] & (most[:, node] >= kth.astype(float)))
            if len(some):
                read(int(node), some)
    ask, column = np.nonzero(best > void)
    keys = best[ask, column]
    return ask, n - 1 - (keys & ((1 << shift) - 1)).astype(np.int64), keys >> shift


def _block(rows: pa.Table, asked: pa.Table, k: int, differ: bool, leaf: int) -> pa.Table:
    """The best of one block of rows for one block of asks."""
    empty = pa.table({"anchor_id": pa.array([], pa.int64()), "positive_id": pa.array([], pa.int64()), "positive_score": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
    if not rows.num_rows or not asked.num_rows:
        return empty
    rows = rows.sort_by("vec_id")
    ids, codes = rows["vec_id"].to_numpy(), {v: i for i, v in enumerate(sorted({*rows["label"].to_pylist(), *asked["label"].to_pylist()}))}
    label = np.array([codes[v] for v in rows["label"].to_pylist()])
    anchors = asked["anchor_id"].to_numpy()
    wanted = asked["asks"].to_pylist()
    query = np.repeat(np.arange(len(wanted)), [len(w) for w in wanted])
    flat = [w for x in wanted for w in x]
    score = [w["score"] for w in flat]
    window = [(-(-30 * s // 100), 90 * s // 100) if s is not None else (-np.inf, np.inf) for s in score]
    low, high = (np.array([w[i] for w in window], object) for i in (0, 1))
    asks = {"query": query, "low": low, "high": high, "label": np.array([codes[v] for v in asked["label"].to_pylist()])[query], "from": np.searchsorted(ids, anchors, "left")[query], "to": np.searchsorted(ids, anchors, "right")[query]}
    given, sought = (np.floor(SCALE * vectors.matrix(x["v"])) for x in (rows, asked))
    ask, at, found = search(given, label, sought, asks, k, differ, leaf)
    positive = pa.array([flat[a]["id"] for a in ask], pa.int64())
    return pa.table({"anchor_id": pa.array(anchors[query[ask]], pa.int64()), "positive_id": positive, "positive_score": pa.array([score[a] for a in ask], pa.int64()), "vec_id": pa.array(ids[at], pa.int64()), "score": pa.array([max(_LEAST, min(_MOST, int(x))) for x in found], pa.int64())})


def _met(rows: DataFrame, asked: DataFrame, k: int, differ: bool) -> DataFrame:
    """The best of blocks of ``rows(d, r, q, ...)`` for blocks of ``asked(d, r, q, ...)``, ranked."""

    leaf = LEAF

    def block(a: pa.Table, b: pa.Table) -> pa.Table:
        return _block(a, b, k, differ, leaf)

    found = rows.groupBy("d", "r", "q").cogroup(asked.groupBy("d", "r", "q")).applyInArrow(block, "anchor_id long, positive_id long, positive_score long, vec_id long, score long")
    best = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", best).filter(F.col("rank") <= k)


def mine(embeddings: DataFrame, anchors: Column, label: Column | None = None, positives: int = 5, negatives: int = 10) -> DataFrame:
    """The ``negatives`` best rows of other labels for each anchor and each of its ``positives`` best rows of its own label.

    ``embeddings(vec_id, label, embedding)``; ``anchors`` says which rows are
    anchors, ``label`` what a row's label is. Scores are inner products of
    floor(256 * x); a negative's lies within 30 and 90 hundredths of the
    positive's. Higher scores come first, ties by smaller vec_id; beyond 64 bits they
    are cut to those. Rows with a
    null label or vec_id, a null vector, or any null or non-finite component
    take no part; vectors of different lengths aren't compared. Rows that repeat
    a vec_id rank each, but are no partners of it, and of several anchors with
    one vec_id the first by label and vector is taken. Anchors without a
    positive, or positives without a negative, give no row, nor does an empty
    table; extra columns are left alone.
    """
    spark = embeddings.sparkSession
    common.ship(spark)
    label = F.col("label") if label is None else label
    usable = vectors.usable("embedding") & F.col("vec_id").isNotNull() & label.isNotNull()
    kind = "array<float>" if dict(embeddings.dtypes)["embedding"] == "array<float>" else "array<double>"
    rows = embeddings.filter(usable).select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("string").alias("label"), F.col("embedding").cast(kind).alias("v"), F.size("embedding").alias("d"), anchors.alias("anchor"))
    chosen = rows.filter("anchor").groupBy("vec_id").agg(F.min(F.struct("label", "v", "d")).alias("x")).select(F.col("vec_id").alias("anchor_id"), "x.*")
    chosen = common.materialise(chosen, "anchors")
    rows = rows.drop("anchor")
    number = F.xxhash64(F.monotonically_increasing_id())

    def part(of, parts):
        return F.pmod(of, parts).cast("int")

    # positives: blocks of one label each, as many as its rows and its anchors need; a label without an anchor drops out
    sizes = rows.groupBy("d", "label").agg(F.ceil(F.count("*") / ROW_BLOCK).alias("n_rows"))
    parts = common.materialise(sizes.join(chosen.groupBy("d", "label").agg(F.ceil(F.count("*") / QUERY_BLOCK).alias("n_asked")), ["d", "label"]), "parts")
    one = F.array(F.struct(F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("score"))).alias("asks")

    def all_of(n: str):
        return F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))

    def named(x: str):
        return F.concat_ws("\x01", F.col(x).cast("string"), "label")

    of_label = rows.join(parts, ["d", "label"]).withColumn("x", part(number, F.col("n_rows"))).withColumn("q", all_of("n_asked"))
    asked = chosen.join(parts, ["d", "label"]).withColumn("q", part(F.xxhash64("anchor_id"), F.col("n_asked"))).withColumn("x", all_of("n_rows"))
    of_label, asked = of_label.select("d", "vec_id", "label", "v", named("x").alias("r"), "q"), asked.select("d", "anchor_id", "label", "v", one, named("x").alias("r"), "q")
    best = common.materialise(_met(of_label, asked, positives, False).select("anchor_id", F.struct(F.col("vec_id").alias("id"), "score").alias("ask")), "positives")
    # negatives: blocks of all rows; an anchor's windows, of which there are few, travel with it
    n_rows, n_asked = max(1, -(-rows.count() // ROW_BLOCK)), max(1, -(-chosen.count() // QUERY_BLOCK))
    windows = best.groupBy("anchor_id").agg(F.collect_list("ask").alias("asks"))
    asked = chosen.join(windows, "anchor_id").withColumn("q", part(F.xxhash64("anchor_id"), F.lit(n_asked))).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1))))
    dealt = rows.withColumn("r", part(number, F.lit(n_rows))).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(n_asked - 1))))
    found = _met(dealt, asked.select("d", "anchor_id", "label", "v", "asks", "r", "q"), negatives, True)
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
