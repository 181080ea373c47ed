"""Encoding of whole texts with the tokenizers library, chunk by cached chunk.

The vocabularies in use split at white space, normalise chunks one by one and
never let a token cross a space or a line end; so a text's ids are its chunks'
ids in a row. The library encodes each distinct chunk once per worker.
"""

from __future__ import annotations

import os
import re

import numpy as np

#: Distinct chunks kept by a worker, and their bytes; later ones are encoded batch by batch.
CACHE_CHUNKS, CACHE_BYTES = 500_000, 64 << 20
#: A word of letters that neither normalisation nor lower-casing can break up,
#: and at most one mark after it: two pieces to the pre-tokeniser.
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,]?)")
#: A mark beside another sign, with which it may form one piece.
_BESIDE = re.compile("[.,][^ \n\t\ra-z0-9à-öø-ÿ]"), re.compile("[^ \n\t\ra-z0-9à-öø-ÿ][.,]")
_loaded: dict[str, "ChunkEncoder"] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encoder(path: str) -> "ChunkEncoder":
    """The worker's encoder of this vocabulary file."""
    if path not in _loaded:
        _loaded[path] = ChunkEncoder(path)
    return _loaded[path]


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size()


class ChunkEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        #: Which ids end a piece; empty for vocabularies without word ends.
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.marks = {m: self._one(m) for m in ("", ".", ",")}
        #: Whether the vocabulary's own rules fold case, as a sample shows.
        self.folds = self._one("The Äß, x.") == self._one("the äß ,x .")
        self.cache: dict[str, bytes] = {"": b""}
        self.cached = 0

    def _one(self, chunk: str) -> bytes:
        return np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, self.dtype).tobytes()

    def _words(self, words: list[str]) -> list[bytes] | None:
        """Ids of each plain word, encoded as one text and cut at the word ends."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, self.dtype)
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(words):
            return None
        raw, at = ids.tobytes(), [0, *(cuts * self.dtype.itemsize).tolist()]
        return [raw[a:b] for a, b in zip(at, at[1:])]

    def _encode_new(self, new: list[str]) -> dict[str, bytes]:
        known, found, plain, rest = self.cache, {}, [], []
        full = _PLAIN.fullmatch
        for c in new:
            if m := full(c):
                plain.append((c, *m.groups()))
            else:
                rest.append(c)
        stems = list({w for _, w, _ in plain if w not in known})
        ids = self._words(stems) if stems and self.ends.any() else None
        if ids is None and stems:
            rest += [c for c, _, _ in plain]
        else:
            found.update(zip(stems, ids or ()))
            for c, w, m in plain:
                if m:
                    found[c] = (found.get(w) or known[w]) + self.marks[m]
        if rest:
            got = self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)
            found.update((c, np.array(e.ids, self.dtype).tobytes()) for c, e in zip(rest, got))
        return found

    def _chunks(self, text: str | None) -> list[str]:
        """Parts of a text whose ids in a row are the text's ids.

        White space always parts. In Latin-1 text (which normalisation leaves
        alone and lower-casing changes letter by letter) case is folded before,
        and a lone mark begins a part; so more parts are alike.
        """
        if not text:
            return []
        try:
            text.encode("latin-1")
            if self.folds and "<|" not in text:
                text = text.lower()
                if not (_BESIDE[0].search(text) or _BESIDE[1].search(text)):
                    text = text.replace(".", " .").replace(",", " ,")
        except UnicodeEncodeError:
            pass
        return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids as little-endian integers of ``dtype``; null counts as empty."""
        split = list(map(self._chunks, texts))
        known = self.cache
        new = set().union(*split).difference(known)
        found = self._encode_new(list(new)) if new else {}
        size = sum(map(len, found)) + sum(map(len, found.values()))
        # a batch of very long chunks is as little kept as one that comes late
        full = len(known) >= CACHE_CHUNKS or self.cached + size > CACHE_BYTES
        if not full:
            self.cached += size
        known.update(found)
        get = known.__getitem__
        out = [b"".join(map(get, chunks)) for chunks in split]
        if full:
            for chunk in found:
                del known[chunk]
        return out
