"""Token ids of whole texts through a table of the words met so far.

The tokenizers used here never join across white space, so the ids of a text are those of
its words one after the other. Words are cut at ASCII white space (others stay inside a
word, where the tokenizer treats them as it always does), hashed in numpy, and only words
not met before are handed to the tokenizer. A worker keeps its table between tasks.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

from .words import BLANK, runs, span_hashes

#: Words a worker remembers, about 100 MB; the table starts anew beyond that, with all words
#: of the call at hand, however many.
TABLE_WORDS = 800_000


class WordTable:
    """Ids per word, found by a 64-bit hash of its bytes."""

    def __init__(self, encode):
        self.encode = encode  # list of words -> list of ids as little-endian 32-bit bytes
        self.clear()

    def clear(self):
        self.keys = np.zeros(0, np.uint64)
        self.starts = np.zeros(0, np.int64)
        self.counts = np.zeros(0, np.int64)
        self.flat = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def _learn(self, keys, words):
        coded = self.encode(words)
        counts = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        total = int(counts.sum())
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + total] = np.frombuffer(b"".join(coded), "<u4")
        starts = self.used + np.cumsum(counts) - counts
        self.used += total
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.starts = np.insert(self.starts, at, starts)
        self.counts = np.insert(self.counts, at, counts)

    def _find(self, keys):
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        return at, (self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool))

    def spans(self, data, starts, ends):
        """Ids of the byte spans one after the other, and how many each has."""
        hashes = span_hashes(data, starts, ends)
        keys, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        at, known = self._find(keys)
        if not known.all():
            new = np.flatnonzero(~known)
            if len(self.keys) + len(new) > TABLE_WORDS:
                self.clear()
                new = np.arange(len(keys))
            raw = data.tobytes()
            self._learn(keys[new], [raw[starts[i] : ends[i]].decode("utf-8", "replace") for i in first[new]])
            at, known = self._find(keys)
            assert known.all()
        counts = self.counts[at][which]
        total = int(counts.sum())
        where = np.repeat(self.starts[at][which] - (np.cumsum(counts) - counts), counts) + np.arange(total)
        return self.flat[where], counts

    def texts(self, data, offsets) -> list[np.ndarray]:
        """Ids of each document of a chunk, white space dropped."""
        starts, ends = runs(~BLANK[data], offsets)
        n = len(offsets) - 1
        if not len(starts):
            return [np.zeros(0, np.uint32)] * n
        ids, counts = self.spans(data, starts, ends)
        docs = np.searchsorted(offsets, starts, "right") - 1
        return np.split(ids, np.cumsum(np.bincount(docs, counts, n)).astype(np.int64)[:-1])


#: What the tokenizer's pattern cuts a word of these characters into.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
_PARTS = re.compile("'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


class PartEncoder:
    """Words to ids by way of their parts: case and punctuation share one entry.

    Parts of plain characters go straight to the tokenizer's merges; any other word goes
    through the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.merge = self.tok.model.tokenize
        self.letters = _byte_letters()
        self.known: dict[str, bytes] = {}  # bytes, as the garbage collector would walk lists

    def _ids(self, part: str) -> bytes:
        got = self.known.get(part)
        if got is None:
            tokens = self.merge(part.encode().decode("latin-1").translate(self.letters))
            got = self.known[part] = array("I", [t.id for t in tokens]).tobytes()
        return got

    def __call__(self, words: list[str]) -> list[bytes]:
        if len(self.known) > TABLE_WORDS // 2:
            self.known.clear()
        out = []
        for w in words:
            if _PLAIN.fullmatch(w) and "<|" not in w:
                out.append(b"".join([self._ids(p) for p in _PARTS.findall(w.lower())]))
            else:
                out.append(array("I", self.tok.encode(w, add_special_tokens=False).ids).tobytes())
        return out


_TABLES: dict[str, WordTable] = {}


def word_table(path: str) -> WordTable:
    """The worker's table for the lower-casing word tokenizer at ``path``."""
    if path not in _TABLES:
        _TABLES[path] = WordTable(PartEncoder(path))
    return _TABLES[path]
