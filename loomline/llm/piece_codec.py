"""SentencePiece encoding and decoding by suffix-array matching.

The distinct words of a batch are laid one after the other and indexed by a suffix array.
Every piece of the vocabulary finds its occurrences by binary search, as one range of the
array. The occurrences are edges of the words' lattices; sorted by where they end, they are
relaxed: a piece may end a prefix if it can stand next to the piece that ends the prefix
before it. For a byte-pair model one piece at most can, so the lattice holds the one
segmentation that the model's merges make, id for id.

Text is encoded as the model's library does with its identity normalizer: a space becomes
the mark, one mark is put in front, characters without a piece become byte pieces.
Defined results: a null or empty text has no ids and decodes to the empty text; a mark in
the text itself decodes to a space; unknown ids decode to nothing, broken bytes to U+FFFD;
repeated rows are coded each on its own; an empty table gives no rows; other columns aren't
read. Very long texts are coded in blocks of words. A word without spaces of any length falls
into the parts that no piece spans; time grows with its length, and with that of its longest
part a step of about 0.1 ms for each character.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from loomline.llm import textscan
from loomline.llm.bpe import NONE, PairTable
from loomline.llm.pieces import SPACE, Vocabulary, load

MARK = ord(SPACE)
REMEMBER = 500_000
BLOCK = 2 << 20
START = -1


class SuffixArray:
    """Positions of codes (0 ends a word) in the order of the next `depth` values.

    As many values as fit are packed into one key; keys are ranked, and pairs of ranks make
    the keys of twice the width, until `depth` values are told apart."""

    def __init__(self, codes: np.ndarray, depth: int):
        n = len(codes)
        present = np.zeros(int(codes.max(initial=0)) + 1, bool)
        present[codes] = True
        self.symbol = np.cumsum(present)
        self.symbol[~present] = 0
        self.bits = int(present.sum()).bit_length()
        self.width = min(63 // self.bits, depth)
        dense, key = self.symbol[codes], np.zeros(n, np.int64)
        for k in range(self.width):
            key <<= self.bits
            key[: n - k] |= dense[k:]
        self.ranked: list[np.ndarray] = []
        self.spans, span = [self.width], self.width
        while span < depth:
            known, rank = np.unique(key, return_inverse=True)
            self.ranked.append(known)
            key = (rank + 1) * (len(known) + 1)
            key[: n - span] += rank[span:] + 1
            span *= 2
            self.spans.append(span)
        self.order = np.argsort(key, kind="stable")
        self.keys = key[self.order]

    def _keys(self, pieces: np.ndarray, lengths: np.ndarray, start: int, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Range of the level's keys that begin with the pieces' values from start on."""
        if not level:
            low, missing = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), bool)
            for k in range(self.width):
                low <<= self.bits
                inside = lengths > start + k
                code = np.where(inside, pieces[:, min(start + k, pieces.shape[1] - 1)], 0)
                found = np.where(code < len(self.symbol), self.symbol[np.minimum(code, len(self.symbol) - 1)], 0)
                missing |= inside & (found == 0)
                low |= np.where(inside, found, 0)
            rest = self.width - np.clip(lengths - start, 0, self.width)
            return low, np.where(missing, low, low + (np.int64(1) << (rest * self.bits)))
        known, half = self.ranked[level - 1], self.spans[level - 1]
        base = len(known) + 1
        lo, hi = (np.searchsorted(known, x) + 1 for x in self._keys(pieces, lengths, start, level - 1))
        longer = lengths > start + half
        if not longer.any():
            return lo * base, hi * base
        lo2, hi2 = (np.searchsorted(known, x) + 1 for x in self._keys(pieces, lengths, start + half, level - 1))
        whole = hi == lo + 1
        return np.where(longer, lo * base + lo2, lo * base), np.where(longer, np.where(whole, lo * base + hi2, lo * base + lo2), hi * base)

    def occurrences(self, pieces: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each piece (a row of values, so many long) the range of order that begins with
        it: binary searches for its first and last key."""
        lo, hi = self._keys(pieces, lengths, 0, len(self.ranked))
        return np.searchsorted(self.keys, lo), np.searchsorted(self.keys, hi)


class Merges:
    """Which two pieces of a byte-pair model may stand side by side."""

    def __init__(self, v: Vocabulary):
        ids, scores = v.ids, v.scores
        left, right, merged = [], [], []
        for piece, number in ids.items():
            for k in range(1, len(piece)):
                a, b = ids.get(piece[:k]), ids.get(piece[k:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(number)
        kept = np.array(merged, np.int64)
        self.rank = v.ranks.astype(np.int64)
        self.pairs = PairTable(np.array(left, np.int64), np.array(right, np.int64), self.rank[kept], kept)
        self.by_pair = dict(zip(zip(left, right, strict=True), merged, strict=True))
        self.first, self.second, self.reached = (np.full(len(v.pieces), -1, np.int64) for _ in range(3))
        for piece, number in ids.items():
            if len(piece) == 1:
                self.reached[number] = 1
                continue
            tokens, last = self.merge([ids.get(c, -1) for c in piece], scores)
            if tokens == [number]:
                self.reached[number], (self.first[number], self.second[number]) = 1, last

    def merge(self, tokens: list[int], scores: np.ndarray) -> tuple[list[int], tuple[int, int]]:
        """The merges one by one, best score first, then leftmost; and the last pair merged."""
        tokens, last = list(tokens), (-1, -1)
        while True:
            best, at = -np.inf, -1
            for i, pair in enumerate(zip(tokens, tokens[1:], strict=False)):
                made = self.by_pair.get(pair)
                if made is not None and scores[made] > best:
                    best, at = scores[made], i
            if at < 0:
                return tokens, last
            last = (tokens[at], tokens[at + 1])
            tokens[at : at + 2] = [self.by_pair[last]]

    def beside(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the letters of a and b, side by side, leaves just a and b.

        The pieces are taken apart again, latest merge first; they may not stand side by side
        if their facing parts would have been merged before the merge that hides them."""
        ok = np.ones(len(a), bool)
        at = np.flatnonzero((a >= 0) & (b >= 0))
        x, y = a[at].astype(np.int64), b[at].astype(np.int64)
        until_x, until_y = np.full(len(at), int(NONE)), np.full(len(at), int(NONE))
        while len(at):
            made = self.pairs.rank[self.pairs.find(x, y)].astype(np.int64)
            # a merge of the facing parts comes first if it ranks before what x is taken from, and
            # not after what y is taken from: of equals the left one is merged first
            clash = (made < until_x) & (made <= until_y) & (made < NONE)
            ok[at[clash]] = False
            go = ~clash & ((self.first[x] >= 0) | (self.first[y] >= 0))
            at, x, y, until_x, until_y = at[go], x[go], y[go], until_x[go], until_y[go]
            split_x = (self.first[x] >= 0) & ((self.first[y] < 0) | (self.rank[x] > self.rank[y]))
            until_x, until_y = np.where(split_x, self.rank[x], until_x), np.where(split_x, until_y, self.rank[y])
            x, y = np.where(split_x, self.second[x], x), np.where(split_x, y, self.first[y])
        return ok


class Codec:
    """Encoder of one model; remembers the ids of words by two hashes."""

    def __init__(self, path: str):
        self.v = v = load(path)
        self.merges = Merges(v)
        usable = [(p, i) for p, i in v.ids.items() if self.merges.reached[i] == 1 and not (len(p) > 1 and set(p) == {SPACE})]
        self.piece_ids = np.array([i for _, i in usable], np.int64)
        self.lengths = np.array([len(p) for p, _ in usable], np.int64)
        self.codes = np.zeros((len(usable), v.longest), np.int64)
        for row, (p, _) in enumerate(usable):
            self.codes[row, : len(p)] = [ord(c) for c in p]
        self.length_of = np.ones(len(v.pieces), np.int64)
        self.length_of[self.piece_ids] = self.lengths
        self.mark = v.ids.get(SPACE, v.unknown)
        self.lone = not any("\n" in p for p in v.ids)
        self.forget()

    def forget(self) -> None:
        self.memo = textscan.Memo(REMEMBER, np.int32)

    @lru_cache(maxsize=4096)  # noqa: B019
    def marks(self, n: int) -> tuple[int, ...]:
        """Ids of n marks in a row."""
        longest = self.v.longest
        if n > 4 * longest:
            return self.marks(longest) * (n // longest - 2) + self.marks(n - longest * (n // longest - 2))
        return tuple(self.merges.merge([self.mark] * n, self.v.scores)[0])

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words (spaces as marks, at the front only) and how many each has."""
        text = "\0".join(words) + "\0"
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(sizes + 1) - sizes - 1
        index = SuffixArray(codes, self.v.longest)
        lo, hi = index.occurrences(self.codes, self.lengths)
        count = hi - lo
        begin = index.order[textscan.ranges(lo, count)]
        piece, length = np.repeat(self.piece_ids, count), np.repeat(self.lengths, count)
        # characters that no piece matches are edges too
        bare = np.ones(len(codes), bool)
        bare[begin[length == 1]] = False
        bare[starts + sizes] = False
        lost = np.flatnonzero(bare)
        begin, piece, length = np.concatenate([begin, lost]), np.concatenate([piece, -2 - codes[lost]]), np.concatenate([length, np.ones(len(lost), np.int64)])
        end = begin + length
        # no merge crosses a place that no piece spans: words fall into parts there
        spans = np.bincount(begin + 1, minlength=len(codes) + 2) - np.bincount(end, minlength=len(codes) + 2)
        parts = np.flatnonzero(np.cumsum(spans)[: len(codes)] == 0)
        parts = np.union1d(parts, starts)
        fresh = np.zeros(len(codes) + 1, bool)
        fresh[parts] = True
        step = end - parts[np.searchsorted(parts, begin, "right") - 1]
        by_end = np.argsort(step, kind="stable")
        begin, piece, end, step = begin[by_end], piece[by_end], end[by_end], step[by_end]
        # last[p]: the piece that ends the prefix before position p; NONE where there is none
        last = np.full(len(codes) + 1, int(NONE), np.int64)
        edges = np.concatenate([[0], np.flatnonzero(np.diff(step)) + 1, [len(step)]])
        for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            b, p, e = begin[i:j], piece[i:j], end[i:j]
            before = np.where(fresh[b], START, last[b])
            fits = np.flatnonzero(before != NONE)
            fits = fits[self.merges.beside(before[fits], p[fits])]
            last[e[fits]] = p[fits]
        return self._back(codes, starts, sizes, last)

    def _back(self, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Follow the last pieces from each word's end, and write unknown ones in bytes."""
        rows, at, parts = np.arange(len(starts)), starts + sizes, []
        live = sizes > 0
        rows, at = rows[live], at[live]
        while len(rows):
            piece = last[at]
            parts.append((rows, piece))
            at = at - np.where(piece >= 0, self.length_of[np.maximum(piece, 0)], 1)
            go = at > starts[rows]
            rows, at = rows[go], at[go]
        if not parts:
            return np.zeros(0, np.int32), np.zeros(len(starts), np.int64)
        row, piece = np.concatenate([r for r, _ in parts]), np.concatenate([p for _, p in parts])
        turn = np.concatenate([np.full(len(r), -k) for k, (r, _) in enumerate(parts)])
        order = np.lexsort((turn, row))
        row, piece = row[order], piece[order]
        odd = np.flatnonzero(piece < 0)
        if not len(odd):
            return piece.astype(np.int32), np.bincount(row, minlength=len(starts)).astype(np.int64)
        out: list[np.ndarray] = []
        width = np.ones(len(piece), np.int64)
        done = 0
        for k in odd.tolist():
            out.append(piece[done:k])
            spelled = self.v.byte_ids[list(chr(-2 - int(piece[k])).encode("utf-8", "replace"))]
            spelled = spelled if (spelled >= 0).all() else np.array([self.v.unknown])
            out.append(spelled)
            width[k], done = len(spelled), k + 1
        out.append(piece[done:])
        return np.concatenate(out).astype(np.int32), np.bincount(row, width, len(starts)).astype(np.int64)

    def _new(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct units: spaces in front, then a word; or a line end alone."""
        texts = [r.decode("utf-8", "replace") for r in raw]
        spaces = [len(t) - len(t.lstrip(" ")) for t in texts]
        bodies = [(SPACE if n else "") + t[n:] for t, n in zip(texts, spaces, strict=True)]
        ids, counts = self.words(bodies)
        many = [i for i, n in enumerate(spaces) if n > 1]
        if not many:
            return ids, counts
        parts, edges, done = [], np.concatenate([[0], np.cumsum(counts)]), 0
        for i in many:
            a, b = int(edges[i]), int(edges[i + 1])
            alone = ids[a] == self.mark
            front = self.marks(spaces[i] if alone else spaces[i] - 1)
            parts += [ids[done:a], np.array(front, np.int32)]
            counts[i] += len(front) - alone
            done = a + int(alone)
            parts.append(ids[done:b])
            done = b
        parts.append(ids[done:])
        return np.concatenate(parts), counts

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the offsets of the texts."""
        raw, at = textscan.buffers(column)
        sizes, parts = np.zeros(len(column), np.int64), []
        for lo, hi in _blocks(at):
            # one space in front of every text that has any character
            lengths = np.diff(at[lo : hi + 1])
            some = lengths > 0
            place = np.cumsum(lengths + some) - lengths - some
            data = np.full(int((lengths + some).sum()), 0x20, np.uint8)
            data[textscan.ranges(place + some, lengths)] = raw[at[lo] : at[hi]]
            if not len(data):
                continue
            first = np.zeros(len(data), bool)
            first[place[some]] = True
            space = data == 0x20
            first[1:] |= space[1:] & ~space[:-1]
            if self.lone:
                line = data == 0x0A
                first |= line
                first[1:] |= line[:-1]
            starts = np.flatnonzero(first)
            ends = np.append(starts[1:], len(data))
            ids, counts = self._units(data, starts, ends)
            parts.append(ids)
            owner = np.searchsorted(place, starts, "right") - 1
            sizes[lo:hi] += np.bincount(owner, counts, hi - lo).astype(np.int64)
        return np.concatenate(parts) if parts else np.zeros(0, np.int32), np.concatenate([[0], np.cumsum(sizes)])

    def _units(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.memo.get(*textscan.run_hashes(data, starts, ends), lambda picked: self._new(textscan.split_at(data, starts[picked], ends[picked])))


class Decoder:
    """Texts of ids: the pieces' bytes one after the other, without the mark in front."""

    def __init__(self, path: str):
        self.v = v = load(path)
        raw = [b"" if not n else p.replace(SPACE, " ").encode() for p, n in zip(v.pieces, v.normal.tolist(), strict=True)]
        for b, i in enumerate(v.byte_ids.tolist()):
            if i >= 0:
                raw[i] = bytes([b])
        self.raw_at = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
        self.raw = np.frombuffer(b"".join(raw), np.uint8)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The texts of ids[offsets[i]:offsets[i + 1]]."""
        ids = np.where((ids >= 0) & (ids < len(self.v.pieces)), ids, self.v.unknown)
        widths = self.raw_at[ids + 1] - self.raw_at[ids]
        data = self.raw[textscan.ranges(self.raw_at[ids], widths)].tobytes()
        at = np.concatenate([[0], np.cumsum(widths)])[offsets].tolist()
        return [data[a + (data[a : a + 1] == b" ") : b].decode("utf-8", "replace") if b > a else "" for a, b in zip(at[:-1], at[1:], strict=True)]


def _blocks(at: np.ndarray, block: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Numbers of texts that together have about `block` bytes."""
    lo = 0
    while lo < len(at) - 1:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + block, "right")) - 1)
        yield lo, hi
        lo = hi


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


@lru_cache(maxsize=2)
def decoder(path: str) -> Decoder:
    return Decoder(path)


def _coded(part: pa.RecordBatch, model: str) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Lists of ids of the batch's texts, and the ids and offsets that they are made of."""
    ids, offsets = codec(model).encode(part.column(1))
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids)), ids, offsets


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id_col and ids (array<int>) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in textscan.sliced(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), _coded(part, model)[0]], [id_col, "ids"])
        codec(model).forget()

    return docs.select(id_col, text).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, ids array<int>")


def decode(coded: DataFrame, model: str, id_col: str = "doc_id", ids: str = "ids") -> DataFrame:
    """id_col, ids and text, decoded, of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textscan.sliced(batches):
            lists = batch.column(1)
            counts = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64)
            flat = np.asarray(pc.fill_null(lists.flatten(), -1), np.int64)
            texts = decoder(model).decode(flat, np.concatenate([[0], np.cumsum(counts)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(texts, pa.string())], [id_col, "ids", "text"])

    return coded.select(id_col, ids).mapInArrow(run, f"`{id_col}` {dict(coded.dtypes)[id_col]}, ids array<int>, text string")


def round_trip(docs: DataFrame, model: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id_col, ids and text, decoded from them, of every text: decode over encode, in one
    Python worker for a task instead of two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in textscan.sliced(batches):
            lists, ids, offsets = _coded(part, model)
            yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(decoder(model).decode(ids, offsets), pa.string())], [id_col, "ids", "text"])
        codec(model).forget()

    return docs.select(id_col, text).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, ids array<int>, text string")
