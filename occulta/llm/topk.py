"""Exact top-k by inner product, without random access.

Each block of rows keeps one list of values for every dimension, in order. A
query reads each list from the end that its sign favours, in steps that begin
with ``FIRST`` values and double. Of the rows seen it has a lower bound (what
was read of a row, and the far ends of the other lists) and an upper bound
(with the last values read in place of those ends); rows not seen share one
upper bound, that of the last values alone. Rows are outsiders once their upper
bound is under the k-th best lower bound. Reading stops when the unseen are
outsiders and few of the seen are left; only the scores of those are resolved.
All queries of a block read together, and their bounds are matrix products over
the rows seen; upper ones only for queries that the unseen can't matter to.

With many dense dimensions about half of each list must be read before that
holds; with few, or skewed ones, a small part.

Rows and queries are dealt to a grid of blocks of fixed size; the k best of
each block meet in a last ranking by query. Components are sent as 16-bit
numbers where all of them fit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, vectors

SCALE = 256
ROW_BLOCK, QUERY_BLOCK = 8192, 16_384
#: Values of each list read in the first step.
FIRST = 64
#: Reading also goes on while more rows than this many times k might qualify.
SPARE = 8
#: Products stay exact in double precision up to this bound.
_EXACT = 2.0**52
SCHEMA = "query_id long, rank int, vec_id long, score long"
_FOUND = "query_id long, vec_id long, score long"


class Lists:
    """The sorted lists of a block of rows, one a dimension, and what has been read of them from either end."""

    def __init__(self, rows: np.ndarray):
        self.n, self.depth = len(rows), 0
        columns = np.ascontiguousarray(rows.T)
        self.order = np.argsort(columns, axis=1, kind="stable")
        self.values = np.take_along_axis(columns, self.order, axis=1)
        # by row and dimension: the value, if read, and from which end
        self.got, self.high, self.low = np.zeros(rows.shape), np.zeros(rows.shape, bool), np.zeros(rows.shape, bool)

    def read(self, depth: int) -> np.ndarray:
        """Read on to ``depth`` at both ends of every list; returns the rows seen by then."""
        for part, mask in ((slice(self.n - depth, self.n - self.depth), self.high), (slice(self.depth, depth), self.low)):
            at, dim = self.order[:, part], np.arange(len(self.order))[:, None]
            self.got[at, dim], mask[at, dim] = self.values[:, part], True
        self.depth = depth
        return np.flatnonzero(self.high.any(axis=1) | self.low.any(axis=1))

    def last(self) -> np.ndarray:
        """The last values read, from the high ends, then from the low ones."""
        return np.concatenate([self.values[:, self.n - self.depth], self.values[:, self.depth - 1]])

    def ends(self) -> np.ndarray:
        """The far ends of the lists as read from above, then from below."""
        return np.concatenate([self.values[:, 0], self.values[:, -1]])

    def filled(self, rows: np.ndarray, other: np.ndarray) -> np.ndarray:
        """What was read of ``rows`` from above and from below, ``other`` where nothing was."""
        got = self.got[rows]
        return np.where(np.hstack([self.high[rows], self.low[rows]]), np.hstack([got, got]), other)


def candidates(lists: Lists, queries: np.ndarray, owned: list[np.ndarray], k: int) -> dict[int, np.ndarray]:
    """For each query rows among which are its ``k`` best, and all that tie with the last.

    ``owned`` has the rows that take no part for each query.
    """
    out: dict[int, np.ndarray] = {}
    signed = np.hstack([np.maximum(queries, 0), np.minimum(queries, 0)])
    waiting = np.arange(len(queries))
    while len(waiting):
        depth = min(lists.n, max(FIRST, 2 * lists.depth))
        seen = lists.read(depth)
        place = np.full(lists.n, -1)
        place[seen] = np.arange(len(seen))
        least, most, unseen = lists.filled(seen, lists.ends()), None, signed[waiting] @ lists.last()
        later = []
        for a in range(0, len(waiting), 256):
            some = waiting[a : a + 256]
            lower = signed[some] @ least.T
            for x, q in enumerate(some):
                own = place[owned[q]]
                lower[x, own[own >= 0]] = -np.inf
            kth = np.partition(lower, len(seen) - k, axis=1)[:, len(seen) - k] if len(seen) > k else np.full(len(some), -np.inf)
            ripe = np.flatnonzero((unseen[a : a + 256] < kth) | (depth == lists.n))
            later.append(np.delete(some, ripe))
            if not len(ripe):
                continue
            if depth < lists.n:
                most = lists.filled(seen, lists.last()) if most is None else most
                upper = signed[some[ripe]] @ most.T
            else:
                upper = lower[ripe]
            may = (upper >= kth[ripe, None]) & (lower[ripe] > -np.inf)
            ended = (may.sum(axis=1) <= SPARE * k) | (depth == lists.n)
            out.update((int(q), seen[m]) for q, m, e in zip(some[ripe], may, ended) if e)
            later.append(some[ripe[~ended]])
        waiting = np.concatenate(later)
    return out


def block_top_k(rows: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query id, row id, score) of at least each query's ``k`` best rows of one block.

    Ties at the last place are all kept, so that ids can settle them later.
    """
    n, width = rows.shape
    if not n or not len(queries):
        return []
    if not width or width * float(np.abs(rows).max()) * float(np.abs(queries).max()) >= _EXACT:
        return _large(rows, ids, queries, query_ids, k)
    found: list[tuple[int, int, int]] = []
    by_id = np.argsort(ids, kind="stable")
    first, last = (np.searchsorted(ids, query_ids, side, sorter=by_id) for side in ("left", "right"))
    for q, left in candidates(Lists(rows), queries, [by_id[a:b] for a, b in zip(first, last)], k).items():
        scores = rows[left] @ queries[q]
        if len(left) > k:
            best = scores >= np.partition(scores, len(left) - k)[len(left) - k]
            left, scores = left[best], scores[best]
        found += zip([int(query_ids[q])] * len(left), ids[left].tolist(), [int(s) for s in scores])
    return found


def _large(rows, ids, queries, query_ids, k):
    """The same with whole numbers of any size, all lists read to the end; scores end at 64 bits."""
    whole = np.array([[int(v) for v in r] for r in rows.tolist()], object).reshape(rows.shape)
    out = []
    for q, i in zip(queries.tolist(), query_ids.tolist()):
        q = [int(v) for v in q]
        scores = sorted(((sum(a * b for a, b in zip(r, q)), -int(d)) for r, d in zip(whole, ids) if d != i), reverse=True)
        last = scores[k - 1][0] if len(scores) > k else None
        out += [(i, -d, max(-(1 << 63), min((1 << 63) - 1, s))) for s, d in scores if last is None or s >= last]
    return out


def top_k(embeddings: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The ``k`` rows of highest inner product with each query, other than its own.

    Both inputs have (vec_id, embedding); components become floor(256 * x).
    Vectors null or with null or non-finite components take no part, nor do
    rows without vec_id; vectors of different lengths are not compared. Ties go
    to the smaller vec_id; repeated rows rank each; a query with no partner, or
    an empty table, gives no row. Extra columns are left alone.
    """
    spark = embeddings.sparkSession
    common.ship(spark)

    def given(df: DataFrame) -> DataFrame:
        return df.filter(vectors.usable("embedding") & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.size("embedding").alias("d"))

    rows, asked = given(embeddings), given(queries)

    def measured(df: DataFrame) -> tuple[int, float]:
        return tuple(df.agg(F.count("*"), F.coalesce(F.max(F.array_max(F.transform("v", F.abs))), F.lit(0.0))).first())

    (n_rows, most), (n_asked, most_asked) = measured(rows), measured(asked)
    small = SCALE * max(most, most_asked) < 32_000
    if small:
        rows, asked = (df.withColumn("v", F.transform("v", lambda x: F.floor(x * SCALE).cast("short"))) for df in (rows, asked))
    n_rows, n_asked = max(1, -(-n_rows // ROW_BLOCK)), max(1, -(-n_asked // QUERY_BLOCK))
    number = F.xxhash64(F.monotonically_increasing_id())
    left = rows.withColumn("r", F.pmod(number, F.lit(n_rows)).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(n_asked - 1))))
    right = asked.withColumn("q", F.pmod(number, F.lit(n_asked)).cast("int")).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1))))

    def whole(column) -> np.ndarray:
        return vectors.matrix(column) if small else np.floor(SCALE * vectors.matrix(column))

    def block(a: pa.Table, b: pa.Table) -> pa.Table:
        found = block_top_k(whole(a["v"]), a["vec_id"].to_numpy(), whole(b["v"]), b["vec_id"].to_numpy(), k) if a.num_rows and b.num_rows else []
        q, v, s = zip(*found) if found else ((), (), ())
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(v, pa.int64()), "score": pa.array(s, pa.int64())})

    found = left.groupBy("r", "q", "d").cogroup(right.groupBy("r", "q", "d")).applyInArrow(block, _FOUND)
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", best).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
