"""A Merkle manifest of a table: a digest of every row, of every group and of the whole, with proofs.

Rows are leaves. Within a group they are numbered in order, by a range sort and
sums of run lengths, and dealt to aligned blocks of ``FANOUT ** LEVELS`` leaves.
In a block digests are one contiguous matrix of 64 hexadecimal bytes a row,
which is reshaped by the fanout and hashed row by row, level after level, to
the block's own digest; blocks' digests are the nodes of the next layer, until
one is left. Groups' digests are the leaves of one more tree of the same kind.

Proofs go the other way: a layer's blocks meet the path above them, one row
each, and index arithmetic finds every node's siblings in the matrices: in a
run that begins at ``r`` the ``k``-th sibling of node ``i`` is
``r + k + (k >= i - r)``. No task holds more than a block, and nothing but the
root comes to the driver.
"""

from __future__ import annotations

import binascii
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.vault import numbered
from . import common

FANOUT, LEVELS = 8, 4
HEX = 64
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
SCHEMA = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
_PATH = "left array<binary>, right array<binary>, sub binary"


def leaf(columns: tuple[str, ...] = COLUMNS, **other: Column) -> Column:
    """A row's digest: of each column ``-`` for null, else its bytes' number, a colon and its text; ``other`` stands in for columns."""
    values = [other.get(c, F.col(c)).cast("string") for c in columns]
    return F.unhex(F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]).cast("binary"), 256))


def matrix(digests) -> np.ndarray:
    """Digests of 32 bytes as rows of hexadecimal text."""
    return np.frombuffer(binascii.hexlify(b"".join(digests)), np.uint8).reshape(-1, HEX)


def levels_of(leaves: np.ndarray, total: int, most: int = LEVELS) -> list[np.ndarray]:
    """A block's levels, leaves first, ``most`` above them. ``total``: nodes of the whole layer; a lone one stays as it is."""
    out = [leaves]
    while total > 1 and (len(out) <= most if total > FANOUT**most else len(out[-1]) > 1):
        raw = out[-1].tobytes()
        out.append(matrix([sha256(raw[k : k + FANOUT * HEX]).digest() for k in range(0, len(raw), FANOUT * HEX)]))
    return out


def siblings(levels: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each level but the last and each leaf: its siblings' text in a row, their number, and how many stand before its node."""
    out, leaf_ = [], np.arange(len(levels[0]))
    for depth, level in enumerate(levels[:-1]):
        node = leaf_ // FANOUT**depth
        start, place = node - node % FANOUT, node % FANOUT
        k = np.arange(FANOUT - 1)
        index = start[:, None] + k + (k >= place[:, None])
        there = np.minimum(start + FANOUT, len(level)) - start - 1
        out.append((level[np.minimum(index, len(level) - 1)].reshape(len(leaf_), -1), there, place))
    return out


@dataclass(frozen=True)
class Manifest:
    """``layers`` of the groups' trees (g, pos, n, digest, ...), leaves first; ``tops`` of the tree over them; its ``root``; blocks have ``levels`` levels."""

    layers: list[DataFrame]
    tops: list[DataFrame]
    root: str | None
    levels: int = LEVELS


def _layers(nodes: DataFrame, levels: int) -> list[DataFrame]:
    def up(group: pa.Table) -> pa.Table:
        group = group.sort_by("pos")
        total = group["n"][0].as_py()
        digest = binascii.unhexlify(levels_of(matrix(group["digest"].to_pylist()), total, levels)[-1].tobytes())
        return pa.table({"g": group["g"].slice(0, 1), "pos": group["block"].slice(0, 1), "n": pa.array([-(-total // FANOUT**levels)]), "digest": pa.array([digest], pa.binary())})

    layers = [nodes]
    while (layers[-1].agg(F.max("n")).first()[0] or 1) > 1:
        given = layers[-1].select("g", "pos", "n", "digest", _block(levels).alias("block"))
        layers.append(common.materialise(given.groupBy("g", "block").applyInArrow(up, "g string, pos long, n long, digest binary"), "merkle"))
    return layers


def _block(levels: int) -> Column:
    return F.shiftright("pos", levels * (FANOUT.bit_length() - 1))


def build(docs: DataFrame, by: str = "lang", order: str = "doc_id", columns: tuple[str, ...] = COLUMNS, levels: int = LEVELS, **more: Column) -> Manifest:
    """The manifest of ``docs``: a tree for each value of ``by`` (null is one, the first), its leaves in ``order``.

    Null comes first in ``order``, rows alike in it are ordered by digest, and
    repeated rows are a leaf each. ``more`` columns are carried with the leaves.
    An empty table has no root.
    """
    common.ship(docs.sparkSession)
    group = F.coalesce(F.concat(F.lit("1"), F.col(by).cast("string")), F.lit("0"))
    rows = common.materialise(docs.select(group.alias("g"), F.col(order).alias("key"), leaf(columns).alias("digest"), *[c.alias(k) for k, c in more.items()]), "leaves")
    sizes = rows.groupBy("g").agg(F.count("*").alias("n"))
    nodes = numbered(rows, ["g"], ["key", "digest"]).withColumn("pos", F.col("number") - 1).drop("number")
    layers = _layers(common.materialise(nodes.join(sizes, "g"), "numbered"), levels)
    subs = numbered(layers[-1].select(F.lit("").alias("g"), F.col("g").alias("name"), "digest"), ["g"], ["name"])
    subs = common.materialise(subs.withColumn("pos", F.col("number") - 1).drop("number"), "subroots")
    tops = _layers(subs.withColumn("n", F.lit(subs.count()).cast("long")), levels)
    top = tops[-1].select(F.lower(F.hex("digest"))).first()
    return Manifest(layers, tops, top and top[0], levels)


def _down(layer: DataFrame, above: DataFrame, most: int) -> DataFrame:
    """(g, pos, left, right, sub) of a layer's nodes, given those of the next."""

    def extend(nodes: pa.Table, path: pa.Table) -> pa.Table:
        nodes = nodes.sort_by("pos")
        levels = levels_of(matrix(nodes["digest"].to_pylist()), nodes["n"][0].as_py(), most)
        left, right = path["left"][0].as_py(), path["right"][0].as_py()
        own = [[(row[: HEX * p].tobytes(), row[HEX * p : HEX * n].tobytes()) for row, n, p in zip(*level)] for level in siblings(levels)]
        rows = list(zip(*own)) if own else [()] * nodes.num_rows
        return pa.table({"g": nodes["g"], "pos": nodes["pos"], "left": pa.array([[x for x, _ in r] + left for r in rows], pa.list_(pa.binary())), "right": pa.array([[x for _, x in r] + right for r in rows], pa.list_(pa.binary())), "sub": pa.array([path["sub"][0].as_py()] * nodes.num_rows, pa.binary())})

    given = layer.select("g", "pos", "n", "digest", _block(most).alias("block")).groupBy("g", "block")
    return given.cogroup(above.withColumnRenamed("pos", "block").groupBy("g", "block")).applyInArrow(extend, f"g string, pos long, {_PATH}")


def paths(manifest: Manifest) -> DataFrame:
    """(g, pos, left, right, sub): what stands beside the path from each block of leaves to the root, level by level, and its group's digest."""
    none = F.array().cast("array<binary>")
    above = manifest.tops[-1].select("g", "pos", none.alias("left"), none.alias("right"), F.lit(b"").alias("sub"))
    for layer in manifest.tops[-2::-1]:
        above = common.materialise(_down(layer, above, manifest.levels), "paths")
    subs = manifest.tops[0].select(F.col("name").alias("g"), "pos", F.col("digest").alias("__sub"))
    above = above.drop("g", "sub").join(subs, "pos").withColumn("pos", F.lit(0).cast("long")).withColumnRenamed("__sub", "sub")
    for layer in manifest.layers[-2:0:-1]:
        above = common.materialise(_down(layer, above, manifest.levels), "paths")
    return above


def verify(docs: DataFrame, by: str = "lang", order: str = "doc_id", columns: tuple[str, ...] = COLUMNS, altered: Column | None = None, levels: int = LEVELS) -> DataFrame:
    """One row for each row of ``docs``: its digest, its group's, the root, its proof's digest, and what folds up from ``altered``.

    ``altered``: the digest (binary) of what a row is found to be, null where it
    is as it was. ``verified``: whether folding that with the row's siblings
    gives the root. Null values, empty and long texts are digested like others;
    repeated rows are leaves each; an empty table gives no row; extra columns
    are left alone.
    """
    made = build(docs, by, order, columns, levels, altered=F.lit(None).cast("binary") if altered is None else altered)
    root = made.root or ""

    def prove(nodes: pa.Table, path: pa.Table) -> pa.Table:
        nodes = nodes.sort_by("pos")
        leaves = matrix(nodes["digest"].to_pylist())
        found = siblings(levels_of(leaves, nodes["n"][0].as_py(), levels))
        sub = path["sub"][0].as_py().hex()
        upper = list(zip(path["left"][0].as_py(), path["right"][0].as_py()))
        rest = b"".join(x + y for x, y in upper)
        above: dict[bytes, bytes] = {}  # digests that arrive at the block's top, and what they fold to
        proofs, folded = [], []
        for i, changed in enumerate(nodes["altered"].to_pylist()):
            proof, digest = sha256(), changed.hex().encode() if changed is not None else leaves[i].tobytes()
            for text, there, before in found:
                beside, cut = text[i, : HEX * there[i]].tobytes(), HEX * before[i]
                proof.update(beside)
                digest = sha256(beside[:cut] + digest + beside[cut:]).hexdigest().encode()
            proof.update(rest)
            proofs.append(proof.hexdigest())
            if digest not in above:
                top = digest
                for x, y in upper:
                    top = sha256(x + top + y).hexdigest().encode()
                above[digest] = top
            folded.append(above[digest].decode())
        n = nodes.num_rows
        return pa.table({"doc_id": nodes["key"].cast(pa.int64()), "leaf": pa.array([x.tobytes().decode() for x in leaves]), "subroot": pa.array([sub] * n), "root": pa.array([root] * n), "proof_sha256": pa.array(proofs), "folded_root": pa.array(folded), "verified": pa.array([x == root for x in folded])})

    given = made.layers[0].select("g", "pos", "n", "key", "digest", "altered", _block(levels).alias("block")).groupBy("g", "block")
    return given.cogroup(paths(made).withColumnRenamed("pos", "block").groupBy("g", "block")).applyInArrow(prove, SCHEMA)


def lowered(text: str = "text") -> Column:
    """A text with its plain capitals lowered."""
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.col(text).cast("string"), capitals, capitals.lower())
