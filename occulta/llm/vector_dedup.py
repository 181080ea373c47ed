"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

On a bounded sample, principal axes are found and rotations learned that bring
the rotated coordinates near the corners of a cube; their signs are balanced
binary codes. Cut into substrings of ``w`` bits, a code has a place in as many
tables. Vectors that agree on a whole substring meet there: all pairs of fewer
than ``tables`` different bits do, and of others so many that a pair at the
threshold is missed once in 1 / ``MISS`` cases, for it meets in one table with
probability ``(1 - angle / pi) ** w``. Where pairs meet, the Hamming distance of
their whole codes is computed, in blocks; a pair counts in the first table it
meets in, if at most ``radius`` bits differ, which a pair at the threshold
exceeds once in 1 / ``FAR`` cases. Only ids and codes are dealt to tables;
vectors are fetched for the rows that have a partner there, and links are
decided by the cosine of the original vectors, in double precision.

Codes are about the mean, which widens angles where vectors share a direction:
tables and radius are made for the widest possible. Where that takes more than
codes about zero would, those are learned (see ``Codes``). This holds for tables of any
size. All against all, which loses no link, is there for those who ask for it.

Equal vectors are one class before all this. A bucket beyond ``BLOCK`` rows is
compared block against block in several tasks, whole. Links within a task
leave it as counts and as a forest, never as pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, graph, vectors

COSINE = 0.9
#: Vectors that axes and rotations are learned from, at most: those of least hash.
SAMPLE_ROWS = 10_000
#: Rows aimed at in a bucket; most bits of a code from one rotation.
BUCKET, BITS = 256, 64
#: Shares of pairs at the threshold that meet in no table, and that are too far by their codes.
MISS, FAR = 1e-4, 1e-6
BLOCK, TILE = 4096, 512
#: What a copy of a row's code, and of its vector, in a shuffle costs, in pairs of codes compared.
COPY, VECTOR_COPY = 200, 1000
ITERATIONS = 30
SCHEMA = "vec_id long, n_links long, component_id long, kept boolean"


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, first by a power of two, which rounds nothing and keeps squares of very large and very small numbers in bounds."""
    rows = np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1, keepdims=True))[1])
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


class Codes:
    """Codes of vectors: ``tables`` substrings of ``w`` bits for each.

    * learned: bits of rotations learned from the sample. About the mean, if
      that costs less: two unit vectors are at most ``gap = sqrt(2 - 2 * least)``
      apart at the threshold and at least ``1 - |mean|`` from the mean, so that
      the angle seen from there, which the tables are made for, is
      ``2 * asin(gap / 2 / (1 - |mean|))`` at most; else about zero, where the
      angle is the threshold's. Tables are added, and the radius widened, until
      pairs planted in the sample meet as often as they should.
    * plain: signs about zero after random rotations.
    * whole: one table of no bits, all vectors against all.

    ``radius``: bits by which linked vectors' codes differ at most; bits of one
    rotation differ less often together than bits that know nothing of one
    another, for which it is made.
    """

    def __init__(self, sample: np.ndarray, rows: int, least: float = COSINE, plan: str = "learned"):
        bits = max(4, min(30, math.ceil(math.log2(max(1, rows) / BUCKET))) if rows > BUCKET else 4)
        self.width, self.plan, zero = sample.shape[1], plan, np.zeros(sample.shape[1])
        self.mean, self.w, self.tables, self.planes, self.radius = zero, 0, 1, np.zeros((self.width, 0)), 0
        if plan == "whole":
            return
        if plan not in ("learned", "plain"):
            raise ValueError(f"unknown plan {plan}")
        mean = sample.mean(axis=0)
        half = math.sqrt(max(0.0, 2 - 2 * least)) / 2
        far = 1 - float(np.linalg.norm(mean))
        centres = [(zero, math.acos(least))]
        if plan == "learned" and half < far:
            centres.append((mean, 2 * math.asin(half / far)))
        best, cost = {}, math.inf
        for centre, angle in centres:
            rng = np.random.default_rng(42)
            meet = (1 - angle / math.pi) ** bits
            tables = max(1, math.ceil(math.log(MISS) / math.log1p(-meet)))
            # tables alone cost more than what is found
            if best and rows * tables * COPY >= cost:
                continue
            self.mean, self.w, self.tables = centre, bits, tables
            while True:
                self.planes, self.radius = self._planes(sample, rng), within(bits * self.tables, angle / math.pi)
                missed, widest = self.missed(sample, least)
                self.radius = max(self.radius, widest)
                if missed <= 2 * MISS or self.tables >= 4 * tables:
                    break
                self.tables += -(-self.tables // 4)
            own = self._cost(sample, rows)
            if own <= cost:
                cost, best = own, self.__dict__.copy()
        self.__dict__.update(best)

    def _planes(self, sample: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        need = self.tables * self.w
        if self.plan == "learned":
            centred = sample - self.mean
            _, axes = np.linalg.eigh(centred.T @ centred)
            parts = [axes @ rotation(centred @ axes, rng) for _ in range(-(-need // self.width))]
        else:
            bits = min(BITS, self.width)
            parts = [np.linalg.qr(rng.standard_normal((self.width, bits)))[0] for _ in range(-(-need // bits))]
            parts = [p * rng.choice([-1.0, 1.0], p.shape[1]) for p in parts]
        # each substring takes its bits from all over the rotations
        n = parts[0].shape[1]
        order = np.concatenate([rng.permutation(n) + k * n for k in range(len(parts))])[:need]
        return np.hstack(parts)[:, order]

    def _cost(self, sample: np.ndarray, rows: int) -> float:
        """Pairs compared, and copies of rows in pairs' worth, as the sample's buckets foretell."""
        total, scale = 0.0, rows / len(sample)
        for codes in self.of(sample).T:
            m = np.unique(codes, return_counts=True)[1] * scale
            total += float((m * m / 2 + COPY * m * np.ceil(m / BLOCK)).sum())
        return total

    def missed(self, sample: np.ndarray, least: float) -> tuple[float, int]:
        """Share of pairs at the threshold, made of sample rows turned towards others, that meet in no table, and the most bits they differ by."""
        rng = np.random.default_rng(43)
        some = sample[rng.integers(len(sample), size=SAMPLE_ROWS)]
        to = sample[rng.integers(len(sample), size=SAMPLE_ROWS)]
        to = to - (to * some).sum(axis=1, keepdims=True) * some
        length = np.linalg.norm(to, axis=1)
        some, to = some[length > 1e-6], to[length > 1e-6] / length[length > 1e-6, None]
        if not len(some):
            return 0.0, 0
        x, y = self.bits(some), self.bits(least * some + math.sqrt(1 - least * least) * to)
        return float((self.substrings(x) != self.substrings(y)).all(axis=1).mean()), int((x != y).sum(axis=1).max())

    def bits(self, rows: np.ndarray) -> np.ndarray:
        return (rows - self.mean) @ self.planes >= 0

    def packed(self, bits: np.ndarray) -> np.ndarray:
        """Codes as rows of bytes."""
        return np.packbits(bits, axis=1, bitorder="little")

    def substrings(self, bits: np.ndarray) -> np.ndarray:
        """One number of ``w`` bits for each table."""
        return (bits.reshape(len(bits), self.tables, self.w) @ (1 << np.arange(self.w, dtype=np.int64))).astype(np.int32)

    def unpacked(self, codes: np.ndarray) -> np.ndarray:
        return np.unpackbits(codes, axis=1, count=self.w * self.tables, bitorder="little").astype(bool)

    def of(self, rows: np.ndarray) -> np.ndarray:
        """One number for each table of each row (of unit length)."""
        return self.substrings(self.bits(rows))


def within(bits: int, p: float) -> int:
    """The number of ``bits`` that differ, each with probability ``p``, in all but ``FAR`` cases."""
    logs = [math.lgamma(bits + 1) - math.lgamma(k + 1) - math.lgamma(bits - k + 1) + k * math.log(p) + (bits - k) * math.log1p(-p) for k in range(bits + 1)]
    tail = 0.0
    for k in range(bits, -1, -1):
        tail += math.exp(logs[k])
        if tail > FAR:
            return k
    return 0


def rotation(data: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A rotation that brings ``data`` close to its own signs, from a random start."""
    n = data.shape[1]
    turn, _ = np.linalg.qr(rng.standard_normal((n, n)))
    for _ in range(ITERATIONS):
        signs = np.where(data @ turn >= 0, 1.0, -1.0)
        u, _, v = np.linalg.svd(signs.T @ data)
        turn = (u @ v).T
    return turn


def fit(rows: DataFrame, n: int, least: float = COSINE, plan: str = "learned") -> Codes | None:
    """Codes learned from (v array<double>): vectors of the sample's most common length."""
    got = vectors_of(rows.orderBy(F.xxhash64("v")).limit(SAMPLE_ROWS))
    if not got:
        return None
    width = max(got, key=lambda k: (len(got[k]), k))
    return Codes(unit(got[width]), n, least, plan)


def vectors_of(rows: DataFrame) -> dict[int, np.ndarray]:
    """The vectors as matrices, by their lengths."""
    column = rows.select("v").toArrow()["v"].combine_chunks()
    sizes = np.array([len(v) for v in column], np.int64)
    return {int(n): vectors.matrix(column.take(pa.array(np.flatnonzero(sizes == n)))) for n in np.unique(sizes)}


def words_of(codes: np.ndarray) -> np.ndarray:
    """Codes as rows of 64-bit words."""
    return np.ascontiguousarray(np.pad(codes, ((0, 0), (0, -codes.shape[1] % 8)))).view(np.uint64)


def close_codes(x: dict, y: dict, same: bool, table: int, radius: int):
    """(rows, rows) of pairs within the radius that meet in no table before this, part by part; left ones first if ``same``."""
    for a in range(0, len(x["words"]), TILE):
        far = np.zeros((len(x["words"][a : a + TILE]), len(y["words"])), np.uint16)
        for k in range(x["words"].shape[1]):
            far += np.bitwise_count(x["words"][a : a + TILE, k, None] ^ y["words"][None, :, k])
        r, c = np.nonzero(far <= radius)
        r += a
        if same:
            r, c = r[r < c], c[r < c]
        for k in range(0, len(r), 1 << 20):
            s = slice(k, k + (1 << 20))
            first = (x["codes"][r[s]] == y["codes"][c[s]]).argmax(axis=1) == table
            yield r[s][first], c[s][first]


def close_vectors(x: dict, y: dict, same: bool, least: float):
    """The same for pairs whose cosine is about ``least`` or more, of all pairs."""
    for a in range(0, len(x["unit"]), TILE):
        r, c = np.nonzero(x["unit"][a : a + TILE] @ y["unit"].T >= least - 1e-9)
        r += a
        yield (r[r < c], c[r < c]) if same else (r, c)


def links_in_block(x: dict, y: dict, same: bool, pairs, least: float) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Counts for the rows of either side, and a forest's links (left row, right row), among ``pairs``.

    Rows are numbered over both sides, left first; ``same``: both are one side.
    """
    n, m = len(x["unit"]), len(y["unit"])
    counts_x, counts_y, forest = np.zeros(n), np.zeros(m), []
    for r, c in pairs:
        near = np.concatenate([np.einsum("ij,ij->i", x["unit"][r[k : k + 65_536]], y["unit"][c[k : k + 65_536]]) >= least for k in range(0, len(r), 65_536)]) if len(r) else np.zeros(0, bool)
        r, c = r[near], c[near]
        if not len(r):
            continue
        counts_x += np.bincount(r, y["n"][c], minlength=n)
        counts_y += np.bincount(c, x["n"][r], minlength=m)
        ends = c if same else c + n
        label = np.arange(n if same else n + m)
        while True:
            low = np.minimum(label[r], label[ends])
            before = label.copy()
            np.minimum.at(label, r, low)
            np.minimum.at(label, ends, low)
            label = label[label]
            if (label == before).all():
                break
        moved = np.flatnonzero(label != np.arange(len(label)))
        forest.append((moved, label[moved]))
    return counts_x, counts_y, forest


def near_duplicate_vectors(embeddings: DataFrame, least: float = COSINE, plan: str = "learned") -> DataFrame:
    """One row for each row of ``embeddings(vec_id, embedding)``.

    ``n_links`` counts the other rows whose cosine is ``least`` or more,
    ``component_id`` is the smallest vec_id reachable by links and ``kept``
    whether it is the row's own. Vectors that are null, zero or hold null or
    non-finite components link with nothing, nor do vectors of different
    lengths. Equal vectors and repeated rows are linked; a null vec_id stays
    null in its own row and is no component's name unless no other is there.
    An empty table gives no row; extra columns are left alone. ``plan``: see
    ``Codes``; ``whole`` is exact, and takes all pairs.
    """
    spark = embeddings.sparkSession
    common.ship(spark)
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(vectors.usable("embedding") & F.exists("embedding", lambda x: x != 0), F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0))).alias("v"))
    digest = F.unhex(F.concat(*[F.lpad(F.hex(F.xxhash64(x, F.size("v"))), 16, "0") for x in ("v", F.reverse("v"))]))
    rows = rows.withColumn("key", F.when(F.col("v").isNotNull(), digest))
    classes = common.materialise(rows.filter("key IS NOT NULL").groupBy("key").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("n"), F.first("v").alias("v")), "vectors")
    total = classes.count()
    codes = fit(classes, total, least, plan)
    if codes is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    # a node's order is that of its least id, so that a component's name has it too; rows without an id come last
    node = F.struct(F.col("vec_id").isNull().alias("no_id"), "vec_id", "key")
    # numbers that came as 32-bit floats travel as such
    narrow = dict(embeddings.dtypes)["embedding"] == "array<float>"
    classes = classes.select(node.alias("node"), "key", "n", (F.col("v").cast("array<float>") if narrow else F.col("v")).alias("v"), F.size("v").alias("d"))
    if codes.plan == "whole":
        met = blocked(classes.select("key", "d", F.lit(0).alias("t"), F.lit(0).alias("code")))
    else:
        met = common.materialise(partners(classes, codes), "partners")
    found = common.materialise(linked(met, classes, codes, least), "found")
    counts = found.filter("other IS NULL").groupBy("node").agg(F.sum("links").alias("links"))
    placed_in = graph.components(found.filter("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b"))).select("node", "component")
    nodes = classes.select("node", "key", "n").join(placed_in, "node", "left").join(counts, "node", "left")
    of_key = nodes.select("key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "node")["vec_id"].alias("component_id"))
    return rows.select("vec_id", "key").join(of_key, "key", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id")
    ).withColumn("kept", F.expr("vec_id <=> component_id"))


def blocked(placed: DataFrame) -> DataFrame:
    """``placed(key, d, t, code, ...)``, each row once for each pair of blocks (a, b) of its bucket that it is in; ``i`` is its own block."""
    heavy = placed.groupBy("d", "t", "code").agg(F.count("*").alias("m")).filter(F.col("m") > BLOCK)
    parts = F.coalesce(F.ceil(F.col("m") / BLOCK), F.lit(1)).cast("int")
    dealt = placed.join(heavy, ["d", "t", "code"], "left").withColumn("parts", parts).withColumn("i", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    return dealt.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("a", F.least("i", "j")).withColumn("b", F.greatest("i", "j")).drop("m", "parts", "j")


def partners(classes: DataFrame, codes: Codes) -> DataFrame:
    """(key, d, t, code, a, b, i, bits): rows that have another within the radius in a bucket's pair of blocks, and their codes.

    Pairs meet in the first table they can; no pair leaves a task.
    """
    known = classes.sparkSession.sparkContext.broadcast(codes)

    def code(batches):
        c = known.value
        for b in batches:
            got = b.column(2)
            fits = np.flatnonzero(np.array([len(v) == c.width for v in got]))
            # vectors of another length than the sample's meet by their length alone
            bits = np.zeros((b.num_rows, c.w * c.tables), bool)
            if len(fits):
                bits[fits] = c.bits(unit(vectors.matrix(got.take(pa.array(fits)))))
            numbers = pa.ListArray.from_arrays(pa.array(np.arange(0, b.num_rows * c.tables + 1, c.tables, dtype=np.int32)), pa.array(c.substrings(bits).reshape(-1)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x.tobytes() for x in c.packed(bits)], pa.binary()), numbers], ["key", "d", "bits", "codes"])

    coded = classes.select("key", "d", "v").mapInArrow(code, "key binary, d int, bits binary, codes array<int>")
    placed = blocked(coded.select("key", "d", "bits", F.posexplode("codes").alias("t", "code")))

    def close(group: pa.Table) -> pa.Table:
        c = known.value
        if group.num_rows < 2:
            return group.slice(0, 0)
        table, a, b = (group[x][0].as_py() for x in ("t", "a", "b"))
        side, sides = group["i"].to_numpy(), _sides(group, c)
        left, right = np.flatnonzero(side == a), np.flatnonzero(side == b)
        x, y = ({k: v[at] for k, v in sides.items()} for at in (left, right))
        some = np.zeros(group.num_rows, bool)
        for r, s in close_codes(x, y, a == b, table, c.radius):
            some[left[r]] = some[right[s]] = True
        return group.filter(pa.array(some))

    schema = "d int, t int, code int, key binary, bits binary, i int, a int, b int"
    return placed.select("d", "t", "code", "key", "bits", "i", "a", "b").groupBy("d", "t", "code", "a", "b").applyInArrow(close, schema)


def _sides(group: pa.Table, codes: Codes) -> dict[str, np.ndarray]:
    packed = np.frombuffer(b"".join(group["bits"].to_pylist()), np.uint8).reshape(group.num_rows, -1)
    return {"words": words_of(packed), "codes": codes.substrings(codes.unpacked(packed))}


def linked(met: DataFrame, classes: DataFrame, codes: Codes, least: float) -> DataFrame:
    """(node, other, links): a row's number of links within a pair of blocks (other null), and the links of a forest (0)."""
    known = classes.sparkSession.sparkContext.broadcast(codes)
    kind = dict(classes.dtypes)["node"]

    def compare(group: pa.Table) -> pa.Table:
        c, given = known.value, group["node"].combine_chunks()
        nodes = pa.StructArray.from_arrays(given.flatten(), names=[f.name for f in given.type])
        none = pa.table({"node": nodes[:0], "other": nodes[:0], "links": pa.array([], pa.int64())})
        if group.num_rows < 2:
            return none
        table, a, b = (group[x][0].as_py() for x in ("t", "a", "b"))
        side = group["i"].to_numpy()
        sides = {"unit": unit(vectors.matrix(group["v"])), "n": group["n"].to_numpy()} | ({} if c.plan == "whole" else _sides(group, c))
        left, right = np.flatnonzero(side == a), np.flatnonzero(side == b)
        x, y = ({k: v[at] for k, v in sides.items()} for at in (left, right))
        pairs = close_vectors(x, y, a == b, least) if c.plan == "whole" else close_codes(x, y, a == b, table, c.radius)
        counts_x, counts_y, forest = links_in_block(x, y, a == b, pairs, least)
        order = left if a == b else np.concatenate([left, right])
        at, links, other = [], [], []
        for own, counts in ((left, counts_x), (right, counts_y)):
            some = np.flatnonzero(counts)
            at.append(own[some])
            links.append(counts[some].astype(np.int64))
            other.append(np.full(len(some), -1))
        for x_, label in forest:
            at.append(order[x_])
            links.append(np.zeros(len(x_), np.int64))
            other.append(order[label])
        at, links, other = np.concatenate(at), np.concatenate(links), np.concatenate(other)
        return pa.table({"node": nodes.take(pa.array(at)), "other": nodes.take(pa.array(other, mask=other < 0)), "links": pa.array(links)})

    given = met.join(classes.select("key", "node", "n", "v"), "key")
    columns = ["d", "t", "code", "a", "b", "i", "node", "n", "v", *(["bits"] if "bits" in met.columns else [])]
    return given.select(*columns).groupBy("d", "t", "code", "a", "b").applyInArrow(compare, f"node {kind}, other {kind}, links long")
