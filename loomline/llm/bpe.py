"""Byte-pair merges of many words at once, as numpy matrices of symbols."""

from __future__ import annotations

import numpy as np

from loomline.llm import textscan

NONE = np.int32(2**31 - 1)


class PairTable:
    """Rank and merged symbol of symbol pairs: an open-addressed table read by whole arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray):
        bits = max(10, int(len(left) * 8).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys, self.slot = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        self.rank, self.merged = np.append(rank, NONE).astype(np.int32), np.append(merged, -1).astype(np.int32)
        keys = (left.astype(np.int64) << 32) | right
        for i, (key, at) in enumerate(zip(keys.tolist(), self._home(keys).tolist(), strict=True)):
            while self.keys[at] not in (-1, key):
                at = (at + 1) & (len(self.keys) - 1)
            if self.keys[at] == -1:
                self.keys[at], self.slot[at] = key, i

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Number of each pair in the table, the last for those that are not."""
        keys = (left.astype(np.int64) << 32) | right
        at, out = self._home(keys), np.full(len(keys), len(self.rank) - 1, np.int32)
        held = self.keys[at]
        hit = held == keys
        out[hit] = self.slot[at[hit]]
        left_over = np.flatnonzero(~hit & (held != -1))
        while len(left_over):
            at[left_over] = (at[left_over] + 1) & (len(self.keys) - 1)
            held = self.keys[at[left_over]]
            hit = held == keys[left_over]
            out[left_over[hit]] = self.slot[at[left_over[hit]]]
            left_over = left_over[~hit & (held != -1)]
        return out


def merge_all(symbols: np.ndarray, pairs: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """symbols: words of one length as rows. Merges the lowest-ranked pair of each word, the
    leftmost of equals, until none is left. Returns the symbols, left-aligned, and counts."""
    n, width = symbols.shape
    symbols, sizes = symbols.astype(np.int32).copy(), np.full(n, width, np.int64)
    if width == 1 or n == 0:
        return symbols, sizes
    found = pairs.find(symbols[:, :-1].ravel(), symbols[:, 1:].ravel()).reshape(n, width - 1)
    rows, work, size = np.arange(n), symbols, sizes
    while len(rows):
        ranks = pairs.rank[found]
        best = ranks.argmin(axis=1)
        each = np.arange(len(rows))
        go = ranks[each, best] < NONE
        if not go.all():
            done = ~go
            symbols[rows[done]], sizes[rows[done]] = work[done], size[done]
            rows, work, size, found, best = rows[go], work[go], size[go], found[go], best[go]
            each = np.arange(len(rows))
        if not len(rows):
            break
        work[each, best] = pairs.merged[found[each, best]]
        step = np.arange(width)
        take = np.minimum(step + (step > best[:, None]), width - 1)
        work = np.take_along_axis(work, take, 1)
        size = size - 1
        work[each, size] = -1
        step = np.arange(width - 1)
        found = np.take_along_axis(found, np.minimum(step + (step > best[:, None]), width - 2), 1)
        found[step >= (size - 1)[:, None]] = len(pairs.rank) - 1
        for side in (best - 1, best):
            ok = np.flatnonzero((side >= 0) & (side + 1 < size))
            found[ok, side[ok]] = pairs.find(work[ok, side[ok]], work[ok, side[ok] + 1])
    return symbols, sizes


class WordMerges:
    """A BPE with word ends over bytes, for words of ASCII and Latin-1 letters with trailing
    ASCII punctuation; ``plain`` says which words those are. Their letters are one pre-token
    and their punctuation another, in lower case, and no normal form changes them."""

    LETTER, MARK, LEAD, TAIL = 1, 2, 4, 8

    def __init__(self, vocab: dict[str, int], merges: list, alphabet: dict[int, str], word_end: str):
        split = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        left, right, merged = (np.array([vocab[f(m)] for m in split], np.int64) for f in (lambda m: m[0], lambda m: m[1], lambda m: m[0] + m[1]))
        self.pairs = PairTable(left, right, np.arange(len(split)), merged)
        self.inner = np.array([vocab.get(alphabet[b], -1) for b in range(256)], np.int32)
        self.last = np.array([vocab.get(alphabet[b] + word_end, -1) for b in range(256)], np.int32)
        kinds, lower = np.zeros(256, np.uint8), np.arange(256, dtype=np.uint8)
        kinds[[*range(65, 91), *range(97, 123)]] = self.LETTER
        kinds[[b for b in range(33, 127) if not chr(b).isalnum() and b != 0x27]] = self.MARK
        kinds[0xC3] = self.LEAD
        kinds[[b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)]] = self.TAIL
        lower[65:91] += 32
        self.kinds, self.lower = kinds, lower

    def plain(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which words can be merged here, and how many bytes of letters each begins with."""
        lengths = ends - starts
        flat = textscan.ranges(starts, lengths)
        at = np.cumsum(lengths) - lengths
        kind = self.kinds[data[flat]]
        mark = kind == self.MARK
        marks = np.add.reduceat(mark, at, dtype=np.int64)
        odd = kind == 0
        # a lead byte is followed by a tail byte in its word, a tail byte stands after a lead byte
        after_lead = np.zeros(len(kind), bool)
        after_lead[1:] = kind[:-1] == self.LEAD
        after_lead[at] = False
        odd |= (kind == self.TAIL) != after_lead
        odd[at + lengths - 1] |= kind[at + lengths - 1] == self.LEAD
        letters = lengths - marks
        # all marks stand at the end: the first of them is where the letters end
        first_mark = np.where(mark, np.arange(len(kind)), len(kind))
        first = np.minimum.reduceat(first_mark, at) - at
        ok = (np.add.reduceat(odd, at, dtype=np.int64) == 0) & ((marks == 0) | (first == letters)) & (lengths <= 48)
        return ok, letters

    def lowered(self, data: np.ndarray) -> np.ndarray:
        """Lower case of ASCII and of the Latin-1 letters."""
        out = self.lower[data]
        upper = np.zeros(len(data), bool)
        upper[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[upper] += 32
        return out

    def encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pre-tokens data[starts:ends], one after the other, and their counts."""
        lengths = ends - starts
        counts = np.zeros(len(starts), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for width in np.unique(lengths).tolist():
            which = np.flatnonzero(lengths == width)
            raw = data[starts[which][:, None] + np.arange(width)]
            symbols = self.inner[raw]
            symbols[:, -1] = self.last[raw[:, -1]]
            merged, sizes = merge_all(symbols, self.pairs)
            counts[which] = sizes
            parts.append((which, merged, sizes))
        offsets = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.uint32)
        for which, merged, sizes in parts:
            out[textscan.ranges(offsets[which], sizes)] = merged[np.arange(merged.shape[1]) < sizes[:, None]]
        return out, counts
