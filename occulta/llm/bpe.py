"""BPE by dynamic programming over prefixes.

Every prefix of a word has one last token in its encoding. An automaton over
all tokens gives, at each position, the tokens that end there; the one whose
neighbour - the last token of the prefix before it - it can stand beside
without any merge across their border is that last token. Following the stored
tokens from the end of the word back to its start yields the exact ids.

A vocabulary here has byte symbols, a mark on a word's last symbol, ranked
merges and two kinds of added text that count as one token each.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, token_files

#: Chunks, their bytes and pairs kept by a worker; beyond, chunks are computed as they come.
CACHE_CHUNKS, CACHE_BYTES, CACHE_PAIRS = 450_000, 64 << 20, 2_000_000
#: Stands for the mark of a word's end in the automaton's alphabet.
_END = "\ue000"
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
_loaded: dict[str, "PrefixBPE"] = {}


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte value."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(other)) for b in range(256)]


def codec(path: str) -> "PrefixBPE":
    if path not in _loaded:
        _loaded[path] = PrefixBPE(path)
    return _loaded[path]


class PrefixBPE:
    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        mark = model["end_of_word_suffix"]
        self.token_of = {i: t for t, i in model["vocab"].items()} | {a["id"]: a["content"] for a in spec["added_tokens"]}
        self.added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self._added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        space = r"\t-\r \x85\xa0  -     　"
        self._space = regex.compile(f"[{space}]+")
        self._pieces = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{space}\p{{L}}\p{{N}}]+")
        self._symbol = byte_symbols()
        own = {t: (t[: -len(mark)] + _END if t.endswith(mark) else t) for t in model["vocab"]}
        ids = {own[t]: i for t, i in model["vocab"].items()}
        self._merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self._merge.setdefault((model["vocab"][a], model["vocab"][b]), (rank, model["vocab"][a + b] if a + b in model["vocab"] else ids[own[a] + own[b]]))
        self._ids = ids
        self._rank: dict[int, int] = {}
        self._left: dict[int, int] = {}
        self._right: dict[int, int] = {}
        self.automaton = ahocorasick.Automaton()
        for text, i in ids.items():
            if self._reachable(text, i):
                self.automaton.add_word(text, (len(text), i))
        self.automaton.make_automaton()
        self._edges: tuple[dict, dict] = ({}, {})
        self._pairs: dict[tuple[int, int], bool] = {}
        self.cache: dict[str, tuple[int, bytes, bytes]] = {"": (0, b"", b"")}
        self.cached = 0

    def _symbols(self, text: str) -> list[str]:
        return [*text[:-2], text[-2:]] if text.endswith(_END) else [*text]

    def _reachable(self, text: str, token: int) -> bool:
        """Whether merging by rank makes ``token`` from its symbols; keeps its last merge."""
        parts = [self._ids[s] for s in self._symbols(text)]
        merge = self._merge
        while len(parts) > 1:
            best = min(((merge[p][0], k) for k, p in enumerate(zip(parts, parts[1:])) if p in merge), default=None)
            if best is None:
                return False
            k = best[1]
            rank, made = merge[parts[k], parts[k + 1]]
            if len(parts) == 2 and made == token:
                self._rank[token], self._left[token], self._right[token] = rank, parts[0], parts[1]
            parts[k : k + 2] = [made]
        return parts == [token]

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens that stand at a token's border while it is built, each with the rank that ends it."""
        if token not in self._edges[side]:
            half, out, until, t = (self._left, self._right)[side], [], float("inf"), token
            while True:
                out.append((t, until))
                if t not in half:
                    break
                until, t = self._rank[t], half[t]
            self._edges[side][token] = out
        return self._edges[side][token]

    def compatible(self, a: int, b: int) -> bool:
        """Whether ``a`` and ``b`` stay two tokens side by side: no merge crosses their border in time."""
        key = (a, b)
        found = self._pairs.get(key)
        if found is None:
            found, merge = True, self._merge
            for x, x_until in self._edge(a, 1):
                for y, y_until in self._edge(b, 0):
                    m = merge.get((x, y))
                    # of two equal merges the left one comes first: one inside a wins, one inside b loses
                    if m is not None and m[0] < x_until and m[0] <= y_until:
                        found = False
                        break
                if not found:
                    break
            if len(self._pairs) >= CACHE_PAIRS:
                self._pairs.clear()
            self._pairs[key] = found
        return found

    def encode_piece(self, text: str) -> list[int]:
        """Ids of one pre-token, whose last symbol carries the end mark."""
        word = "".join([self._symbol[b] for b in text.encode("utf-8")]) + _END
        n = len(word)
        last: list[int | None] = [None] * (n + 1)
        size = [0] * (n + 1)
        compatible, pairs = self.compatible, self._pairs
        for at, (length, token) in self.automaton.iter(word):
            end = at + 1
            if last[end] is None:
                before = end - length
                if before == 0:
                    last[end], size[end] = token, length
                elif (p := last[before]) is not None and (pairs.get((p, token)) or compatible(p, token)):
                    last[end], size[end] = token, length
        out, at = [], n
        while at:
            if last[at] is None:
                raise ValueError(f"the vocabulary has no token for a symbol of {text[:40]!r}")
            out.append(last[at])
            at -= size[at]
        return out[::-1]

    def pieces(self, text: str) -> list[str]:
        """Normalised pre-tokens of a text without added tokens."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            text = "".join([c.lower() for c in self._space.sub(" ", text)])
        else:
            text = text.lower()
        return self._pieces.findall(text)

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text; null counts as empty."""
        out: list[int] = []
        for part in self._added.split(text or "") if self._added else [text or ""]:
            if part in self.added:
                out.append(self.added[part])
            else:
                for p in self.pieces(part):
                    out += self.encode_piece(p)
        return out

    def decode(self, ids) -> str:
        """The tokens in a row with a space between, as a vocabulary without a decoder has it."""
        return " ".join([self.token_of[i] for i in ids if i in self.token_of])

    def chunk(self, text: str) -> tuple[int, bytes, bytes]:
        """Of text without white space: number of ids, ids in decimal, tokens."""
        ids = self.encode(text)
        return len(ids), " ".join(map(str, ids)).encode(), self.decode(ids).encode()

    def digests(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, and the hex digests of the ids in decimal and of the decoded text."""
        chunks = (text or "").replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        known, out = self.cache, []
        for c in chunks:
            x = known.get(c)
            if x is None:
                x = self.chunk(c)
                if len(known) < CACHE_CHUNKS and self.cached < CACHE_BYTES:
                    known[c] = x
                    self.cached += len(c) + len(x[1]) + len(x[2])
            if x[0]:
                out.append(x)
        if not out:
            return 0, hashlib.sha256(b"").hexdigest(), hashlib.sha256(b"").hexdigest()
        n, ids, tokens = zip(*out)
        return sum(n), hashlib.sha256(b" ".join(ids)).hexdigest(), hashlib.sha256(b" ".join(tokens)).hexdigest()


def encode_decode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Counts and digests of the ids of every ``docs(doc_id, text)`` and of what they decode to.

    A null text counts as empty (no ids; both digests are those of nothing);
    repeated rows give repeated results; an empty table gives none. Rows stay
    where they are: no shuffle.
    """
    common.ship(docs.sparkSession)

    def run(batches):
        bpe = codec(tokenizer)
        for b in batches:
            texts = b.column(1)
            for i, j in common.slices(len(texts), token_files._lengths(texts)):
                n, ids, decoded = zip(*map(bpe.digests, texts.slice(i, j - i).to_pylist()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def encode_ids(docs: DataFrame, tokenizer: str) -> DataFrame:
    """The ids themselves: (doc_id, ids array<int>)."""
    common.ship(docs.sparkSession)

    def run(batches):
        bpe = codec(tokenizer)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([bpe.encode(t) for t in b.column(1).to_pylist()], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")
