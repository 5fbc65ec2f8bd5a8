"""Words of Arrow text columns as numpy arrays, without a Python string for each word.

A column is cut into blocks of bounded size at spaces, so one very long text costs no more
memory than many short ones (a text without any space is one block).
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK = 1 << 19
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C13 | 3


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def draws(n: int, seed: int) -> np.ndarray:
    """n fixed 64-bit values for a seed."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(1 << 32)) * np.uint64(0x9E3779B97F4A7C15))


def _folded(table: np.ndarray) -> np.ndarray:
    """The table with A-Z as a-z."""
    out = table.copy()
    out[65:91] = table[97:123]
    return out


_BYTE = draws(256, 1)
#: Two families of word hashes: for each a value per byte (plain and folded), an odd one per
#: place, and one per stretch of PLACES places.
PLACES = 4096
_TABLES = [((t := draws(256, 21 + k)), _folded(t)) for k in range(2)]
_PLACES = [draws(PLACES, 23 + k) | np.uint64(1) for k in range(2)]
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers 0..n, and their inverses."""
    if len(_POWERS[0]) <= n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            out = np.empty(n + 1, np.uint64)
            out[0], out[1:] = 1, np.uint64(base % (1 << 64))
            _POWERS[k] = np.multiply.accumulate(out)
    return _POWERS[0], _POWERS[1]


def rolling(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which span_hash gets the hash of any span of data."""
    power, _ = _powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[: len(data)], out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans: equal for equal bytes wherever they stand. A polynomial
    modulo 2^64, which structured bytes can make collide: good to choose and to rule out,
    not to tell that spans are equal."""
    _, inverse = _powers(len(sums))
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, folded: bool = False, families: int = 2) -> list[np.ndarray]:
    """64-bit hashes, by each family, of spans of at least a byte that don't overlap: a random
    value for each byte times a random one for its place in the span, summed. The families are
    independent."""
    if not len(starts):
        return [np.zeros(0, np.uint64)] * families
    lengths = ends - starts
    at = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(at, lengths)
    letters = data[place + np.repeat(starts, lengths)]
    longest, block = int(lengths.max()), None
    if longest > PLACES:
        block, place = place // PLACES, place % PLACES
    out = []
    for k in range(families):
        values = _TABLES[k][folded][letters] * _PLACES[k][place]
        if block is not None:
            values *= (draws(longest // PLACES + 1, 25 + k) | np.uint64(1))[block]
        out.append(mix(np.add.reduceat(values, at) + lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    return out


def run_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The first family's run_hashes."""
    return run_hashes(data, starts, ends, families=1)[0]


def distinct(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """First of each different pair of hashes, the number of each pair's, and whether the
    first hash alone tells them apart."""
    _, first, inverse = np.unique(one, return_index=True, return_inverse=True)
    if (two == two[first][inverse]).all():
        return first, inverse, True
    _, first, inverse = np.unique(np.stack([one, two], 1), axis=0, return_index=True, return_inverse=True)
    return first, inverse.ravel(), False


class Memo:
    """Lists of ids by the two hashes of what they encode."""

    def __init__(self, most: int, kind: type):
        self.most, self.kind = most, kind
        self.forget()

    def forget(self) -> None:
        self.known, self.order = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.check, self.at, self.ids = np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, self.kind)

    def get(self, one: np.ndarray, two: np.ndarray, make) -> tuple[np.ndarray, np.ndarray]:  # noqa: ANN001
        """Ids of all units one after the other, and how many each has; make(places) gives
        those of units that aren't known. Units that share their first hash with others are
        made without being remembered."""
        first, inverse, alone = distinct(one, two)
        if len(self.known) > self.most:
            self.forget()
        keys, checks = one[first], two[first]
        place = np.minimum(np.searchsorted(self.known, keys), max(len(self.known) - 1, 0))
        held = self.known[place] == keys if len(self.known) else np.zeros(len(keys), bool)
        if not alone or (self.check[self.order[place[held]]] != checks[held]).any():
            ids, counts = make(first)
            offsets = np.cumsum(counts) - counts
            return ids[ranges(offsets[inverse], counts[inverse])], counts[inverse]
        if not held.all():
            ids, counts = make(first[~held])
            numbers = np.arange(len(self.known), len(self.known) + len(counts))
            self.ids, self.at = np.concatenate([self.ids, ids]), np.concatenate([self.at, self.at[-1] + np.cumsum(counts)])
            self.check = np.concatenate([self.check, checks[~held]])
            merged = np.concatenate([self.known, keys[~held]])
            order = np.argsort(merged, kind="stable")
            self.known, self.order = merged[order], np.concatenate([self.order, numbers])[order]
            place = np.searchsorted(self.known, keys)
        number = self.order[place][inverse]
        counts = self.at[number + 1] - self.at[number]
        return self.ids[ranges(self.at[number], counts)], counts


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the offsets of its texts in them; null is empty."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_string(column.type) else column
    column = column.fill_null(b"" if pa.types.is_large_binary(column.type) else "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


@dataclass
class Words:
    """The words of one block: byte spans in data, the text each belongs to."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray

    def hashes(self, folded: bool = False) -> list[np.ndarray]:
        """The words' run_hashes."""
        return run_hashes(self.data, self.starts, self.ends, folded)


def _cuts(data: np.ndarray, at: np.ndarray, block: int) -> Iterator[tuple[int, int]]:
    """Byte ranges of about block bytes that begin and end at spaces or between texts."""
    start, end = int(at[0]), int(at[-1])
    while start < end:
        stop = min(start + block, end)
        k = int(np.searchsorted(at, stop, "right")) - 1
        if stop < end and at[k] > start:
            stop = int(at[k])
        elif stop < end:
            last, step = int(at[k + 1]), 1 << 16
            while stop < last:
                found = np.flatnonzero(_IS_SPACE[data[stop : min(stop + step, last)]])
                if len(found):
                    stop += int(found[0])
                    break
                stop = min(stop + step, last)
        yield start, stop
        start = stop


def word_blocks(data: np.ndarray, at: np.ndarray, block: int = BLOCK) -> Iterator[Words]:
    """The words of the texts at[i]:at[i+1] of data, in order, a block at a time."""
    for start, stop in _cuts(data, at, block):
        part = data[start:stop]
        word = ~_IS_SPACE[part]
        first = word.copy()
        first[1:] &= ~word[:-1]
        lo, hi = np.searchsorted(at, start, "left"), np.searchsorted(at, stop, "left")
        edges = at[lo:hi] - start
        edges = edges[edges < len(part)]
        first[edges] |= word[edges]
        starts = np.flatnonzero(first)
        last = word.copy()
        last[:-1] &= ~word[1:]
        before = edges[edges > 0] - 1
        last[before] |= word[before]
        ends = np.flatnonzero(last) + 1
        yield Words(part, starts, ends, np.searchsorted(at, starts + start, "right") - 1)


def split_at(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """The spans as bytes objects."""
    raw = data.tobytes()
    return [raw[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]


def sliced(batches: Iterator[pa.RecordBatch], most: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in slices of so many rows, so that what is made of one stays small; at the
    end a worker, which lives on for other tasks, gives back the memory it has freed."""
    for batch in batches:
        for k in range(0, max(batch.num_rows, 1), most):
            yield batch.slice(k, most)
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... of each range, one after the other."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)
