"""A SentencePiece vocabulary as arrays, and the occurrences of its pieces in words."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

SPACE = "▁"
NORMAL, UNKNOWN, BYTE = 1, 2, 6
_BASE = np.uint64(0x9E3779B97F4A7C13)


@dataclass(frozen=True, eq=False)
class Vocabulary:
    """Pieces by id; ranks: 0 for the best score; byte_ids: id of each byte's piece."""

    pieces: tuple[str, ...]
    scores: np.ndarray
    ranks: np.ndarray
    normal: np.ndarray
    byte_ids: np.ndarray
    unknown: int
    longest: int

    @property
    def ids(self) -> dict[str, int]:
        return _ids(self)


@lru_cache(maxsize=4)
def _ids(vocabulary: Vocabulary) -> dict[str, int]:
    return {p: i for i, (p, n) in enumerate(zip(vocabulary.pieces, vocabulary.normal.tolist(), strict=True)) if n}


@lru_cache(maxsize=4)
def load(path: str) -> Vocabulary:
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    kinds = np.array([p.type for p in model.pieces])
    pieces = tuple(p.piece for p in model.pieces)
    scores = np.array([p.score for p in model.pieces])
    ranks = np.empty(len(pieces), np.int64)
    ranks[np.argsort(-scores, kind="stable")] = np.arange(len(pieces))
    byte_ids = np.full(256, -1, np.int64)
    for i in np.flatnonzero(kinds == BYTE).tolist():
        byte_ids[int(pieces[i][3:5], 16)] = i
    normal = kinds == NORMAL
    longest = max((len(p) for p, n in zip(pieces, normal.tolist(), strict=True) if n), default=1)
    return Vocabulary(pieces, scores, ranks, normal, byte_ids, int(np.flatnonzero(kinds == UNKNOWN)[0]), longest)


class PieceTable:
    """Ids of code point spans by their rolling hash, open-addressed and read by arrays."""

    def __init__(self, vocabulary: Vocabulary):
        bits = 19
        self.shift, self.keys, self.ids = np.uint64(64 - bits), np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        for piece, number in vocabulary.ids.items():
            h = np.zeros(1, np.uint64)
            for c in piece:
                h = self.step(h, np.array([ord(c)], np.uint64))
            at = int((h * _BASE)[0] >> self.shift)
            while self.ids[at] >= 0:
                at = (at + 1) & ((1 << bits) - 1)
            self.keys[at], self.ids[at] = h[0], number

    @staticmethod
    def step(h: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The hash of a span one code point longer."""
        h = (h ^ c) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))

    def find(self, h: np.ndarray) -> np.ndarray:
        """The piece of each hash, -1 for none."""
        at = ((h * _BASE) >> self.shift).astype(np.int64)
        out = self.ids[at]
        wrong = np.flatnonzero((self.keys[at] != h) & (out >= 0))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & (len(self.ids) - 1)
            out[wrong] = self.ids[at[wrong]]
            wrong = wrong[(self.keys[at[wrong]] != h[wrong]) & (out[wrong] >= 0)]
        return out


@lru_cache(maxsize=4)
def piece_table(path: str) -> PieceTable:
    return PieceTable(load(path))
