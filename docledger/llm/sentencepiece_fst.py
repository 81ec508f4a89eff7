"""SentencePiece encoding and decoding by a weighted transducer.

The model file is compiled into three machines. The normaliser escapes spaces and puts one
before the text. The piece machine is a trie whose final states give a piece. The fallback
machine spells a character that has no piece in its UTF-8 bytes. Their composition with an
input is a lattice over the input's positions, and the ids are its shortest path in the
tropical semiring (weights add along a path, the least path wins).

* For a unigram model a piece weighs minus its score.
* A merge (BPE) model is not additive, so its machine is composed with an acceptor of
  neighbours: two pieces may follow each other only if merging what they spell gives just
  these two, else the arc weighs infinity. A sequence whose neighbours all pass is the
  result of the merges, and for each prefix there is one, so a position of the lattice
  keeps a single state.

The path passes through every position that no piece spans: before a run of spaces, if no
piece has a space inside, and around characters in no piece. Texts are cut there, and a
worker composes each distinct span once.

Defined results: null gives null ids, an empty text no ids. Texts of any length are encoded
whole. Ids beyond the vocabulary and control ids decode to nothing, the unknown id to its
sign, bytes that are no UTF-8 to U+FFFD. Repeated rows are encoded alike; an empty table gives
no rows. Other columns are carried, whatever their names.
"""

from __future__ import annotations

import math
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .tokens import WordTable
from .words import chunks

SPACE = "▁"
UNKNOWN = " ⁇ "
MEMO = 500_000
UNIGRAM, MERGES = 1, 2


class Transducer:
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        self._compile(model)

    def _compile(self, model):
        norm = model.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only identity normalisers that escape spaces are compiled")
        self.merges = model.trainer_spec.model_type == MERGES
        if not self.merges and model.trainer_spec.model_type != UNIGRAM:
            raise ValueError("only unigram and merge models are compiled")
        self.prefix = norm.add_dummy_prefix
        self.pieces = [p.piece for p in model.pieces]
        self.scores = [p.score for p in model.pieces]
        normal, unknown, control, own, byte = 1, 2, 3, 4, 6  # fixed values: types of pieces
        self.byte_ids, self.spell, self.unknown = {}, [], 0
        self.ids: dict[str, int] = {}
        for i, p in enumerate(model.pieces):
            out = b""
            if p.type == byte:
                self.byte_ids[int(p.piece[1:-1], 16)] = i
                out = bytes([int(p.piece[1:-1], 16)])
            elif p.type == unknown:
                self.unknown = i
                out = UNKNOWN.encode()
            elif p.type != control:
                out = p.piece.replace(SPACE, " ").encode()
                if p.type in (normal, own):
                    self.ids[p.piece] = i
            self.spell.append(out)
        # the piece machine: transitions and the piece of each final state
        self.moves: list[dict[str, int]] = [{}]
        self.final: list[int] = [-1]
        for piece, i in self.ids.items():
            at = 0
            for c in piece:
                nxt = self.moves[at].get(c)
                if nxt is None:
                    nxt = self.moves[at][c] = len(self.moves)
                    self.moves.append({})
                    self.final.append(-1)
                at = nxt
            self.final[at] = i
        self.alphabet = {c for piece in self.ids for c in piece}
        self.cut_spaces = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.follows: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}

    def _merge(self, text: str) -> list[str]:
        """What the merges make of a short text: the best-scored neighbours first, leftmost on ties."""
        parts, ids, scores = list(text), self.ids, self.scores
        while len(parts) > 1:
            best, at = -math.inf, -1
            for k in range(len(parts) - 1):
                i = ids.get(parts[k] + parts[k + 1])
                if i is not None and scores[i] > best:
                    best, at = scores[i], k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _may_follow(self, a: int, b: int) -> bool:
        key = a * len(self.pieces) + b
        known = self.follows.get(key)
        if known is None:
            if len(self.follows) > MEMO:
                self.follows.clear()
            p, q = self.pieces[a], self.pieces[b]
            known = p + q not in self.ids and self._merge(p + q) == [p, q]
            self.follows[key] = known
        return known

    def _is_whole(self, i: int) -> bool:
        known = self.whole.get(i)
        if known is None:
            known = self.whole[i] = self._merge(self.pieces[i]) == [self.pieces[i]]
        return known

    def shortest_path(self, text: str) -> list[int]:
        """Ids of the lightest path over an escaped text."""
        n, moves, final, scores = len(text), self.moves, self.final, self.scores
        cost = [math.inf] * (n + 1)
        last, back, cost[0] = [-1] * (n + 1), [0] * (n + 1), 0.0
        for at in range(n):
            if cost[at] == math.inf:
                continue
            before, state, any_piece = last[at], 0, False
            for to in range(at, n):
                state = moves[state].get(text[to], 0)
                if not state:
                    break
                piece = final[state]
                if piece < 0:
                    continue
                any_piece |= to == at
                if self.merges:
                    weight = 1.0
                    if not self._is_whole(piece) or before >= 0 and not self._may_follow(before, piece):
                        continue
                else:
                    weight = -scores[piece]
                if cost[at] + weight < cost[to + 1]:
                    cost[to + 1], last[to + 1], back[to + 1] = cost[at] + weight, piece, at
            if not any_piece:  # the fallback arc; merges never cross it
                weight = 1.0 if self.merges else 10.0 - min(scores)
                if cost[at] + weight < cost[at + 1]:
                    cost[at + 1], last[at + 1], back[at + 1] = cost[at] + weight, -1, at
        out: list[int] = []
        at = n
        while at:
            if last[at] >= 0:
                out.append(last[at])
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in reversed(text[back[at] : at].encode())]
            else:
                out.append(self.unknown)
            at = back[at]
        return out[::-1]

    def __call__(self, spans: list[str]) -> list[bytes]:
        path = self.shortest_path
        return [array("I", path(s.replace(" ", SPACE))).tobytes() for s in spans]


class Codec:
    """A worker's transducer with the spans it has met."""

    def __init__(self, path: str):
        self.machine = Transducer(path)
        self.table = WordTable(self.machine)
        self.alone = np.zeros(256, bool)  # ASCII characters that are in no piece
        self.alone[[b for b in range(128) if chr(b) not in self.machine.alphabet and b != 0x20]] = True
        spell = self.machine.spell
        self.lengths = np.array([len(s) for s in spell] + [0], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.letters = np.frombuffer(b"".join(spell), np.uint8)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        n = len(offsets) - 1
        some = np.diff(offsets) > 0
        if self.machine.prefix:
            data = np.insert(data, offsets[:-1][some], 0x20)
            offsets = offsets + np.concatenate([[0], np.cumsum(some)])
        if not len(data):
            return [np.zeros(0, np.uint32)] * n
        cut = np.zeros(len(data) + 1, bool)
        cut[offsets] = True
        if self.machine.cut_spaces:
            cut[1:-1] |= (data[1:] == 0x20) & (data[:-1] != 0x20)
        alone = self.alone[data]
        cut[:-1] |= alone
        cut[1:] |= alone
        edges = np.flatnonzero(cut)
        starts, ends = edges[:-1], edges[1:]
        ids, counts = self.table.spans(data, starts, ends)
        docs = np.searchsorted(offsets, starts, "right") - 1
        return np.split(ids, np.cumsum(np.bincount(docs, counts, n)).astype(np.int64)[:-1])

    def decode(self, ids: np.ndarray) -> bytes:
        ids = np.where((ids >= 0) & (ids < len(self.lengths) - 1), ids, len(self.lengths) - 1)
        lengths = self.lengths[ids]
        total = int(lengths.sum())
        at = np.repeat(self.starts[ids] - (np.cumsum(lengths) - lengths), lengths) + np.arange(total)
        out = self.letters[at].tobytes()
        return out[1:] if self.machine.prefix and out[:1] == b" " else out


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def _map(rows: DataFrame, value: Column, out: T.StructField, run) -> DataFrame:
    schema = T.StructType([*rows.schema.fields, out])
    names = schema.names

    def each(batches):
        for batch in batches:
            made = run(batch.column(batch.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], made], names=names)

    return rows.select("*", value.alias("llm_value")).mapInArrow(each, schema)


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """All columns and ``ids``, the ids of the whole text."""

    def run(column):
        out = []
        for _, _, data, offsets in chunks(column):
            out += codec(path).encode(data, offsets)
        valid = column.is_valid().to_pylist()
        return pa.array([o.astype(np.int32) if ok else None for o, ok in zip(out, valid)], pa.list_(pa.int32()))

    return _map(docs, F.col(text), T.StructField(ids, T.ArrayType(T.IntegerType())), run)


def decode(rows: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """All columns and ``decoded``, the text the ids stand for."""

    def run(column):
        out = []
        for v in column:
            out.append(codec(path).decode(v.values.to_numpy(zero_copy_only=False).astype(np.int64)).decode("utf-8", "replace") if v.is_valid else None)
        return pa.array(out, pa.string())

    return _map(rows, F.col(ids), T.StructField(text, T.StringType()), run)
