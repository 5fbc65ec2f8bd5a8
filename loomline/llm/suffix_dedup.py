"""Removal of repeated passages by a distributed merge sort of suffixes.

A byte goes if it lies in a string of SPAN bytes that also starts anywhere else. Sorting
every suffix of a large corpus moves it many times over, so suffixes are taken where content
asks for them: every window of SPAN bytes names the anchor in it, the GRAM-byte string of
least hash, and equal windows name equal anchors at equal places. The windows of one anchor
reach over at most 2 * SPAN - GRAM bytes. Hashes only rule anchors out: one whose hash occurs
once holds no repeated window. What repeats is told by the bytes, in sorted order.

1. A task sends each hash it meets once, with a note if it met it more often; the others,
   whose hash is known to repeat, need no decision and are dealt evenly. So a passage that
   many texts share costs a row a task. Equal texts are known by 128 bits and lend their
   anchors once.
   An anchor that many texts hold, in different contexts, is parted: strings of SPAN - PARTED
   + 1 bytes stand in for it, each for PARTED distances of windows. Those within the passage
   that the texts share are the same in all of them and settle early; those that reach into
   the contexts occur once, but for a few at its edges, which differ in PARTED - 1 bytes.
2. Every repeated anchor becomes a suffix that starts there, with the bytes before it. A task
   cuts its suffixes by range at splitters (anchors of a bounded sample of texts), sorts each
   part, settles suffixes that are equal with all before them and keeps one of those, drops
   the prefix that each shares with the one before (front coding), and sends these runs on.
3. A loser tree merges the runs of a range. It holds for each run the prefix shared with the
   last string sent out, compares those lengths first and letters only beyond them. The merged
   order with its shared lengths shows which suffixes agree for how long; for each number of
   bytes before the anchor, occurrences that agree in them and far enough behind it hold equal
   windows. A range is as large however large the input; it is worked through anchor by anchor.
4. The repeated windows of an anchor are joined from the first to the last (they all hold the
   anchor, so nothing between is spared), and the spans of a text are merged and cut.

Defined results: null texts are empty; texts under SPAN bytes keep everything; equal texts,
of repeated rows too, go whole if at least SPAN long; very long texts are anchored in
segments; an empty table gives no rows; other columns stay; cuts may part a character,
``cut_text`` then drops its other bytes.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm import textscan
from loomline.llm.common import stored, text_key, text_of, whole_row

SPAN = 200
GRAM = 100
SEGMENT = 1 << 19
#: Bytes of suffixes that a task sorts at a time, and that a range is to hold.
SORTED = 16 << 20
RANGE = 32 << 20
#: About how many texts and at most how many anchors splitters are taken from. They only
#: balance the ranges.
SAMPLE_TEXTS, SAMPLE = 4096, 1 << 16
#: An anchor that 1 / HOT of the sampled texts, and so many, hold is parted.
HOT, HOT_TEXTS, PARTED = 64, 64, 8
NONE = np.zeros(0, np.uint64)
#: Bytes of suffixes for each byte of text, if all of them repeat.
SPREAD = 8
#: Suffixes that are looked at together at least, unless a range has fewer.
TOGETHER = 1 << 16
#: Hashes and texts that a task remembers to have sent.
TOLD = 1 << 20
ONCE, TWICE, SURE = 0, 1, 2


def window_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Least of values[i:i + width] for each i."""
    size = 1
    out = values
    while size * 2 <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    rest = width - size
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def anchors(part: np.ndarray, edges: np.ndarray, span: int = SPAN, gram: int = GRAM, hot: np.ndarray = NONE) -> tuple[np.ndarray, ...]:
    """Of the texts part[edges[i]:edges[i + 1]]: text number, first and last window start, and
    place of each anchor, and its hash. hot: hashes, in order, of anchors that are parted.

    The windows of a hot anchor are taken PARTED distances at a time; those that start so far
    before it share all but a few of their bytes, and these stand in for the anchor."""
    width = span - gram + 1
    none = np.zeros(0, np.int64)
    if len(part) < span:
        return none, none, none, none, none.astype(np.uint64)
    sums = textscan.rolling(part)
    at = np.arange(len(part) - gram + 1)
    hashes = textscan.span_hash(sums, at, at + gram)
    low = window_minimum((hashes & ~np.uint64(0xFFFFFF)) | at.astype(np.uint64), width)
    place = (low & np.uint64(0xFFFFFF)).astype(np.int64)
    text = np.searchsorted(edges, np.arange(len(low)), "right") - 1
    fits = np.arange(len(low)) + span <= edges[text + 1]
    same = fits[1:] & fits[:-1] & (place[1:] == place[:-1]) & (text[1:] == text[:-1])
    first, last = fits.copy(), fits.copy()
    first[1:] &= ~same
    last[:-1] &= ~same
    first, last = np.flatnonzero(first), np.flatnonzero(last)
    place = place[first]
    text, h = text[first], hashes[place]
    heat = np.flatnonzero(hot[np.minimum(np.searchsorted(hot, h), len(hot) - 1)] == h) if len(hot) else none
    if not len(heat):
        return text, first, last, place, h
    least, most = (place - last)[heat], (place - first)[heat]
    count = most // PARTED - least // PARTED + 1
    block = textscan.ranges(least // PARTED, count) * PARTED
    own = np.repeat(heat, count)
    least, most = np.maximum(np.repeat(least, count), block), np.minimum(np.repeat(most, count), block + PARTED - 1)
    start = place[own] - block
    core = textscan.mix(textscan.span_hash(sums, start, start + span - PARTED + 1) + block.astype(np.uint64) + np.uint64(1))
    cold = np.ones(len(h), bool)
    cold[heat] = False
    made = (text[own], place[own] - most, place[own] - least, start, core)
    return tuple(np.concatenate([x[cold], y]) for x, y in zip((text, first, last, place, h), made, strict=True))


def _segments(at: np.ndarray, span: int) -> Iterator[tuple[int, int, int, int]]:
    """(first text, end text, start, stop): texts together, or a piece of one long text whose
    windows start before the next piece's."""
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + SEGMENT, "right")) - 1)
        if at[hi] - at[lo] <= 2 * SEGMENT:
            yield lo, hi, int(at[lo]), int(at[hi])
        else:
            start, end = int(at[lo]), int(at[hi])
            while True:
                stop = min(start + SEGMENT + span - 1, end)
                yield lo, hi, start, stop
                if stop == end:
                    break
                start += SEGMENT
        lo = hi


def text_anchors(docs: DataFrame, hot: np.ndarray = NONE) -> DataFrame:
    """docs: th, text. h (hash of the anchor), th, at: the first window start << 18, the anchor's
    distance from it << 10, the number of further windows << 2, and the kind.

    Of each hash a task sends one row that needs a decision: ONCE, or TWICE if it has met it
    again. Further rows of a hash that it has told are SURE to repeat. Copies of a text it has
    seen are left out; those that other tasks see are equal rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told, seen = np.zeros(0, np.uint64), set()
        for batch in textscan.sliced(batches):
            fresh = []
            for i, key in enumerate(batch.column(0).to_pylist()):
                if key not in seen:
                    seen.add(key)
                    fresh.append(i)
            seen = seen if len(seen) < TOLD else set()
            keys, texts = (c.take(pa.array(fresh, pa.int64())) for c in batch.columns)
            data, at = textscan.buffers(texts)
            parts = []
            for lo, hi, start, stop in _segments(at, SPAN):
                edges = np.clip(at[lo : hi + 1], start, stop) - start
                text, first, last, place, h = anchors(data[start:stop], edges, hot=hot)
                packed = ((first + start - at[lo + text]) << 16) | ((place - first) << 8) | (last - first)
                parts.append((h, lo + text, packed))
            if not parts:
                continue
            h, text, packed = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((text, h))
            h, text, packed = h[order], text[order], packed[order]
            new = np.ones(len(h), bool)
            new[1:] = h[1:] != h[:-1]
            heads = np.flatnonzero(new)
            again = np.diff(np.append(heads, len(h))) > 1
            spot = np.minimum(np.searchsorted(told, h[heads]), max(len(told) - 1, 0))
            known = told[spot] == h[heads] if len(told) else np.zeros(len(heads), bool)
            kind = np.full(len(h), SURE)
            kind[heads] = np.where(known, SURE, np.where(again, TWICE, ONCE))
            more = h[heads][again & ~known]
            told = np.sort(np.concatenate([told, more])) if len(told) + len(more) < TOLD else more
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), keys.take(pa.array(text)), pa.array((packed << 2) | kind)], ["h", "th", "at"])

    return docs.mapInArrow(run, "h long, th binary, at long")


def repeated_anchors(rows: DataFrame) -> DataFrame:
    """h, th and at (without the kind) of the anchors whose hash occurs again, in another text
    or another time in its own. Rows arrive in order of h, th and at; a batch keeps back
    the rows of its last hash, a few of each task at most."""

    def settle(rows: pa.Table) -> pa.RecordBatch:
        h, at, key = rows["h"].to_numpy(), rows["at"].to_numpy(), rows["th"].combine_chunks().dictionary_encode().indices.to_numpy()
        same = h[1:] == h[:-1]
        other = np.append(False, same & (key[1:] != key[:-1])) | ((at & 3) == TWICE)
        group = np.cumsum(np.append(True, ~same)) - 1
        keep = np.bincount(group, other)[group] > 0
        keep[1:] &= ~(same & (key[1:] == key[:-1]) & (at[1:] == at[:-1]))
        return given(rows.filter(pa.array(keep)))

    def given(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.set_column(2, "at", pa.array(rows["at"].to_numpy() >> 2))
        return pa.RecordBatch.from_arrays([c.combine_chunks() for c in rows.columns], rows.column_names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            sure = (batch.column(2).to_numpy() & 3) == SURE
            table = pa.Table.from_batches([batch])
            if sure.any():
                yield given(table.filter(pa.array(sure)))
                table = table.filter(pa.array(~sure))
            table = pa.concat_tables([held, table]) if held is not None else table
            if not table.num_rows:
                continue
            h = table["h"].to_numpy()
            change = np.flatnonzero(h != h[-1])
            start = int(change[-1]) + 1 if len(change) else 0
            if start:
                yield settle(table.slice(0, start))
            held = table.slice(start)
        if held is not None and held.num_rows:
            yield settle(held)

    return rows.mapInArrow(run, "h long, th binary, at long")


def lcp_from(a: bytes, b: bytes, start: int) -> int:
    """Length of the common prefix, known to be at least start."""
    n = min(len(a), len(b))
    x, y = a[start:n], b[start:n]
    if x == y:
        return n
    differ = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
    return start + len(x) - (differ.bit_length() + 7) // 8


class LoserTree:
    """Merge of sorted runs of (key, shared, item), shared being the prefix shared with the
    item before in its run. Each loser keeps the prefix it shares with the winner that beat
    it, so a match reads letters only beyond what both share with the last winner."""

    def __init__(self, runs: list[Iterator[tuple[bytes, int, object]]]):
        self.size = 1 << max(len(runs) - 1, 0).bit_length() if runs else 1
        self.runs = list(runs) + [iter(())] * (self.size - len(runs))
        self.keys: list[bytes | None] = [None] * self.size
        self.items: list[object] = [None] * self.size
        self.shared = [0] * self.size
        self.losers = [0] * self.size
        self.compared = 0
        for i in range(self.size):
            self._advance(i, first=True)
        self.winner = self._build(1)

    def _advance(self, i: int, first: bool = False) -> None:
        step = next(self.runs[i], None)
        self.keys[i], self.items[i] = (step[0], step[2]) if step else (None, None)
        self.shared[i] = 0 if first or not step else step[1]

    def _match(self, a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's shared becomes what it shares with the winner."""
        x, y = self.keys[a], self.keys[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        p, q = self.shared[a], self.shared[b]
        if p != q:
            return (a, b) if p > q else (b, a)
        n = lcp_from(x, y, p)
        self.compared += n - p
        if x[n : n + 1] > y[n : n + 1] or (x == y and a > b):
            self.shared[a] = n
            return b, a
        self.shared[b] = n
        return a, b

    def _build(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        win, lose = self._match(self._build(2 * node), self._build(2 * node + 1))
        self.losers[node] = lose
        return win

    def __iter__(self) -> Iterator[tuple[bytes, int, object]]:
        """(key, prefix shared with the key before, item) in order."""
        while self.keys[self.winner] is not None:
            i = self.winner
            yield self.keys[i], self.shared[i], self.items[i]
            self._advance(i)
            node = (i + self.size) >> 1
            while node:
                i, self.losers[node] = self._match(i, self.losers[node])
                node >>= 1
            self.winner = i


def front_coded(strings: list[tuple[bytes, bytes, int, int]]) -> bytes:
    """A sorted run of (suffix, bytes before it reversed, th, place): per string the shared
    length, the rest's and the other bytes' lengths, th and place, then the bytes; as a whole
    compressed."""
    heads, bodies, last = np.zeros((len(strings), 5), "<i8"), [], b""
    for k, (key, left, th, place) in enumerate(strings):
        n = lcp_from(last, key, 0)
        heads[k] = n, len(key) - n, len(left), th, place
        bodies += [key[n:], left]
        last = key
    return zstandard.compress(len(strings).to_bytes(8, "little") + heads.tobytes() + b"".join(bodies), 1)


def run_strings(run: bytes) -> Iterator[tuple[bytes, int, object]]:
    """The strings of a front-coded run, one at a time."""
    raw = zstandard.decompress(run)
    n = int.from_bytes(raw[:8], "little")
    at, last = 8 + 40 * n, b""
    for shared, rest, left, th, place in np.frombuffer(raw, "<i8", 5 * n, 8).reshape(n, 5).tolist():
        last = last[:shared] + raw[at : at + rest]
        at += rest
        yield last, shared, (raw[at : at + left], th, place)
        at += left


def agreeing(shared: np.ndarray, lefts: list[bytes], least: np.ndarray, most: np.ndarray, span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """For suffixes in order, of which windows may start `least` to `most` bytes before the
    anchor: the least and most such distance whose window occurs again (most -1: none).

    Going back byte by byte, suffixes of one anchor are told apart by what stands before them;
    one that is alone doesn't go on. At each distance those that are still together and agree
    far enough behind hold equal windows."""
    n = len(lefts)
    longest = min(max((len(x) for x in lefts), default=0), span - gram)
    before = np.zeros((n, longest), np.uint8)
    for i, x in enumerate(lefts):
        before[i, : len(x)] = np.frombuffer(x, np.uint8)[:longest]
    low, high = np.full(n, 1 << 20), np.full(n, -1)
    live, alike = np.arange(n), np.cumsum(shared < gram)
    for x in range(longest + 1):
        if x:
            go = most[live] >= x
            live, alike = live[go], alike[go] * 256 + before[live[go], x - 1]
        _, alike, count = np.unique(alike, return_inverse=True, return_counts=True)
        go = count[alike] > 1
        live, alike = live[go], alike[go]
        if not len(live):
            break
        fits = least[live] <= x
        rows = live[fits]
        behind = np.cumsum(shared < span - x)[rows]
        _, place, count = np.unique(alike[fits] * (n + 1) + behind, return_inverse=True, return_counts=True)
        hit = rows[count[place] > 1]
        low[hit] = np.minimum(low[hit], x)
        high[hit] = x
    return low, high


def merged(spans: np.ndarray) -> np.ndarray:
    """Spans (rows of start and end) in order, touching ones joined."""
    if len(spans) < 2:
        return spans
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    ends = np.maximum.accumulate(spans[:, 1])
    new = np.ones(len(spans), bool)
    new[1:] = spans[1:, 0] > ends[:-1]
    heads = np.flatnonzero(new)
    return np.stack([spans[heads, 0], ends[np.append(heads[1:], len(spans)) - 1]], 1)


def cut(text: bytes, spans: np.ndarray) -> bytes:
    """text without the merged spans."""
    parts, at = [], 0
    for a, b in spans.tolist():
        parts.append(text[at:a])
        at = b
    parts.append(text[at:])
    return b"".join(parts)


_FOUND = "th binary, n_removed long, n_spans long, kept_sha256 string, kept string"
_PARTS = _FOUND + ", packed binary, spans binary, bucket int, run binary, keys binary"
_KINDS = [pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.binary()]


def _names(schema: str) -> list[str]:
    return [x.split(" ")[0] for x in schema.split(", ")]


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names = _names(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS[: len(names)], strict=True)], names)


def _result(text: bytes, spans: np.ndarray, with_text: bool) -> tuple:
    spans = merged(spans)
    kept = cut(text, spans)
    return len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if with_text else None


def settle_equal(strings: list[tuple[bytes, bytes, int, int]]) -> tuple[list[tuple[bytes, bytes, int, int]], dict[int, list[int]]]:
    """The sorted suffixes (key, bytes before reversed, number of the text, anchor << 1 |
    settled) with one of each lot of equal ones, settled; and by text the start and end of the
    reach of each that was settled here."""
    strings.sort()
    out: list[tuple[bytes, bytes, int, int]] = []
    spans: dict[int, list[int]] = {}

    def note(x: tuple[bytes, bytes, int, int]) -> None:
        if not x[3] & 1:
            a = x[3] >> 1
            spans.setdefault(x[2], []).extend((a - len(x[1]), a + len(x[0])))

    for x in strings:
        if out and out[-1][0] == x[0] and out[-1][1] == x[1]:
            note(x)
            note(out[-1])
            out[-1] = (*out[-1][:3], out[-1][3] | 1)
        else:
            out.append(x)
    return out, spans


def _by_text(joined: DataFrame, splitters: list[bytes], with_text: bool) -> DataFrame:
    """joined: th, packed text, copies, places. Rows of four kinds: results of texts with copies;
    other texts, which wait; spans of texts that are settled; front-coded runs of a range with
    the keys of their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges: dict[int, list] = {}
        keys: list[bytes] = []
        held = 0

        def runs() -> pa.RecordBatch:
            rows, found = [], {}
            for bucket, strings in ranges.items():
                left, spans = settle_equal(strings)
                for k, x in spans.items():
                    found.setdefault(k, []).extend(x)
                own = sorted({k for _, _, k, _ in left})
                number = {k: i for i, k in enumerate(own)}
                rows.append((None,) * 7 + (bucket, front_coded([(a, b, number[k], p) for a, b, k, p in left]), b"".join(keys[k] for k in own)))
            rows += [(keys[k], *(None,) * 5, np.array(x, np.int64).tobytes(), None, None, None) for k, x in found.items()]
            return _batch(rows, _PARTS)

        for batch in textscan.sliced(batches, 64):
            rows = []
            for th, packed, copies, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text, whole = zstandard.decompress(packed), copies > 1
                if whole:
                    rows.append((th, *_result(text, np.array([[0, len(text)]]), with_text), None, None, None, None, None))
                else:
                    rows.append((th, None, None, None, None, packed, None, None, None, None))
                for at in places or ():
                    first = at >> 16
                    a, last = first + ((at >> 8) & 255), first + (at & 255)
                    key = text[a : last + SPAN]
                    ranges.setdefault(bisect_right(splitters, key[:GRAM]), []).append((key, text[first:a][::-1], len(keys), a << 1 | whole))
                    held += len(key) + a - first
                keys.append(th)
                if held > SORTED:
                    yield runs()
                    ranges, keys, held = {}, [], 0
            if rows:
                yield _batch(rows, _PARTS)
        if ranges:
            yield runs()

    return joined.mapInArrow(run, _PARTS)


def merge_runs(runs: list[bytes], keys: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
    """Keys of texts and their spans that the runs of a range show to repeat. keys: those of
    each run's texts, 16 bytes each."""
    table = b"".join(keys)
    offsets = np.concatenate([[0], np.cumsum([len(k) // 16 for k in keys])]).tolist()

    def numbered(run: bytes, offset: int) -> Iterator[tuple[bytes, int, object]]:
        for key, shared, (left, text, place) in run_strings(run):
            yield key, shared, (left, text + offset, place)

    def spans(rows: list[tuple[int, int, bytes, int, int]]) -> Iterator[tuple[bytes, bytes]]:
        shared, size, place, text = (np.array([r[k] for r in rows], np.int64) for k in (0, 1, 3, 4))
        lefts = [r[2] for r in rows]
        low, high = agreeing(shared, lefts, np.maximum(SPAN - size, 0), np.fromiter(map(len, lefts), np.int64, len(lefts)))
        found = np.flatnonzero((high >= 0) & (place & 1 == 0))
        found = found[np.argsort(text[found], kind="stable")]
        anchor = place[found] >> 1
        pairs = np.stack([anchor - high[found], anchor - low[found] + SPAN], 1)
        edges = np.flatnonzero(np.diff(text[found])) + 1
        for k, own in zip(text[found][np.concatenate([[0], edges])].tolist() if len(found) else [], np.split(pairs, edges), strict=len(found) > 0):
            yield table[16 * k : 16 * k + 16], own.tobytes()

    rows: list[tuple[int, int, bytes, int, int]] = []
    for key, shared, (left, text, place) in LoserTree([numbered(r, o) for r, o in zip(runs, offsets, strict=False)]):
        if shared < GRAM and len(rows) >= TOGETHER:
            yield from spans(rows)
            rows = []
        rows.append((shared if rows else 0, len(key), left, place, text))
    if rows:
        yield from spans(rows)


def _merged_spans(runs: DataFrame) -> DataFrame:
    """runs: bucket, run, keys. th and spans that each range shows; ranges are merged one
    after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(runs: list[bytes], keys: list[bytes]) -> Iterator[pa.RecordBatch]:
            found = list(merge_runs(runs, keys))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*found, strict=True)], ["th", "spans"])

        bucket, runs, keys = None, [], []
        for batch in textscan.sliced(batches, 64):
            for b, r, k in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != bucket:
                    yield from out(runs, keys)
                    bucket, runs, keys = b, [], []
                runs.append(r)
                keys.append(k)
        yield from out(runs, keys)

    return runs.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "th binary, spans binary")


def _sampled(plain: DataFrame, parallel: int) -> tuple[list[bytes], np.ndarray]:
    """From a sample of the texts: anchors that part the suffixes into even ranges of about
    RANGE bytes, even if all of them repeat; and the hashes of anchors that a 1 / HOT of the
    sampled texts and HOT_TEXTS of them at least hold, of which there are few."""
    texts, size = plain.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    ranges = max(parallel, -(-size * SPREAD // RANGE))
    share = F.pmod(F.xxhash64("th"), F.lit(1 << 40)) < int((1 << 40) * min(1, SAMPLE_TEXTS / max(texts, 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textscan.sliced(batches):
            data, at = textscan.buffers(batch.column(0))
            for lo, hi, start, stop in _segments(at, SPAN):
                part = data[start:stop]
                text, _, _, place, h = anchors(part, np.clip(at[lo : hi + 1], start, stop) - start)
                _, first = np.unique(np.stack([h, text.astype(np.uint64)], 1), axis=0, return_index=True)
                grams = [part[a : a + GRAM].tobytes() if k & 7 == 0 else None for a, k in zip(place[first].tolist(), h[first].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), pa.array(grams, pa.binary())], ["h", "gram"])

    # copies are one text
    drawn = plain.filter(share).groupBy("th").agg(F.first("text").alias("text")).select("text").mapInArrow(run, "h long, gram binary")
    grams = sorted(drawn.filter("gram is not null").select("gram").limit(SAMPLE).toArrow()["gram"].to_pylist())
    many = max(HOT_TEXTS, min(texts, SAMPLE_TEXTS) // HOT)
    hot = drawn.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= many).select("h").toArrow()["h"].to_numpy()
    return sorted({grams[len(grams) * k // ranges] for k in range(1, ranges)}) if grams else [], np.sort(hot.view(np.uint64))


def repeats(docs: DataFrame, text: str = "text", with_text: bool = False) -> DataFrame:
    """The columns _FOUND for every different text (th: its key) that holds a repeat or has
    copies."""
    parallel = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    plain = docs.select(text_key(text).alias("th"), text_of(text).alias("text")).filter(F.octet_length("text") >= SPAN)
    splitters, hot = _sampled(plain, parallel)
    deal = F.when(F.col("at").bitwiseAND(3) == SURE, F.xxhash64("th", "at")).otherwise(F.col("h"))
    dealt = text_anchors(plain, hot).repartition(deal).sortWithinPartitions("h", "th", "at")
    places = repeated_anchors(dealt).groupBy("th").agg(F.collect_set("at").alias("places"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = zstandard.ZstdCompressor(1)
        for batch in textscan.sliced(batches, 8192):
            data, at = textscan.buffers(batch.column(1))
            raw, seen, packed = memoryview(data), {}, []
            for key, a, b in zip(batch.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                if key not in seen:
                    packed.append(coder.compress(raw[a:b]))
                seen[key] = seen.get(key, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(packed, pa.binary()), pa.array(seen.values(), pa.int64())], ["th", "packed", "copies"])

    texts = plain.mapInArrow(pack, "th binary, packed binary, copies long").groupBy("th").agg(F.first("packed").alias("packed"), F.sum("copies").alias("copies"))
    joined = texts.join(places, "th", "left").filter("copies > 1 OR places IS NOT NULL").select("th", "packed", "copies", "places")
    parts = stored(_by_text(joined, splitters, with_text), "repeats")
    spans = parts.filter("spans is not null").select("th", "spans").union(_merged_spans(parts.filter("run is not null").select("bucket", "run", "keys")))
    spans = spans.groupBy("th").agg(F.collect_list("spans").alias("spans"))
    waiting = parts.filter("packed is not null").select("th", "packed").join(spans, "th")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textscan.sliced(batches):
            rows = []
            for th, packed, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows.append((th, *_result(zstandard.decompress(packed), np.frombuffer(b"".join(found), np.int64).reshape(-1, 2), with_text)))
            if rows:
                yield _batch(rows, _FOUND)

    done = parts.filter("n_removed is not null").select(*_names(_FOUND))
    return done.unionByName(waiting.mapInArrow(finish, _FOUND))


def measure_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id_col, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    found = repeats(docs, text).drop("kept")
    rows = docs.select(F.col(id_col).alias("id"), text_key(text).alias("th"), F.octet_length(text_of(text)).cast("long").alias("n_bytes"), F.sha2(text_of(text), 256).alias("whole"))
    out = rows.join(found, "th", "left")
    zero = F.lit(0).cast("long")
    return out.select(F.col("id").alias(id_col), "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", "whole").alias("kept_sha256"))


def cut_text(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with repeated passages cut out of the text; bytes of parted characters go too."""
    found = repeats(docs, text, with_text=True).filter("n_removed > 0")
    short = found.select("th", F.col("kept").alias("left"))
    out = docs.select(whole_row(docs).alias("row"), text_key(text).alias("th")).join(short, "th", "left")
    return out.select(*[F.coalesce("left", F.col("row")[c]).alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns])
