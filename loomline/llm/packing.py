"""Packing of tokenized texts into sequences of bounded length.

A text's ids and an end id are cut into full pieces of ``size`` ids and a rest. A full piece
is a sequence of its own. The rests are dealt at random to groups, and each group packs its
own by first-fit decreasing: a tournament tree over the bins' free room gives the first bin
that a piece fits in.

Defined results: a null or empty text is its end id alone; repeated rows are packed each on
its own; an empty table gives no pieces; a text of any length is cut as above. Groups are
drawn from the row's content and its number among equal rows of a batch, so a task that runs
again deals alike and copies spread over all groups.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm import bpe, textscan

SIZE = 2048
END = 1
#: Texts that a group packs, on average.
GROUP = 4096
#: Distinct words whose ids a worker keeps.
REMEMBER = 700_000
PIECE = "start long, length long, ids_crc32 long, doc_tokens long"

#: The pre-token pattern that bpe.WordMerges stands for (a fixed value of such tokenizers).
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_encoders: dict[str, WordEncoder] = {}


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordEncoder:
    """Ids of words by a tokenizer whose pieces never span spaces; each word is encoded once
    and remembered by two hashes. Plain words go through bpe.WordMerges, if the tokenizer has
    the set-up that it reproduces; all others through the tokenizer itself."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = self._merges(json.loads(Path(path).read_text()))
        self.forget()

    @staticmethod
    def _merges(file: dict) -> bpe.WordMerges | None:
        model, pre = file["model"], file.get("pre_tokenizer") or {}
        steps = [x.get("type") for x in (file.get("normalizer") or {}).get("normalizers", [])]
        patterns = [x.get("pattern", {}).get("Regex") for x in pre.get("pretokenizers", []) if x.get("type") == "Split"]
        plain = model.get("type") == "BPE" and model.get("end_of_word_suffix") and not model.get("dropout") and not model.get("ignore_merges")
        if not plain or steps != ["NFC", "Replace", "Lowercase"] or patterns != [WORD_SPLIT]:
            return None
        return bpe.WordMerges(model["vocab"], model["merges"], byte_alphabet(), model["end_of_word_suffix"])

    def forget(self) -> None:
        self.memo = textscan.Memo(REMEMBER, np.uint32)

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def _encode_new(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        plain, letters = self.merges.plain(data, starts, ends) if self.merges else (np.zeros(len(starts), bool), starts)
        counts, parts = np.zeros(len(starts), np.int64), []
        if not plain.all():
            rest = np.flatnonzero(~plain)
            raw = textscan.split_at(data, starts[rest], ends[rest])
            coded = [e.ids for e in self.tokenizer.encode_batch([w.decode("utf-8", "replace") for w in raw], add_special_tokens=False)]
            counts[rest] = np.fromiter(map(len, coded), np.int64, len(coded))
            parts.append((rest, np.fromiter((i for c in coded for i in c), np.uint32, int(counts[rest].sum())), counts[rest]))
        if plain.any():
            which = np.flatnonzero(plain)
            a, b, c = starts[which], starts[which] + letters[which], ends[which]
            edges = np.stack([a, b, b, c], 1).reshape(-1, 2)
            some = edges[:, 0] < edges[:, 1]
            ids, sizes = self.merges.encode(self.merges.lowered(data), edges[some, 0], edges[some, 1])
            own = np.bincount(np.repeat(np.arange(len(which)), 2)[some], sizes, len(which)).astype(np.int64)
            counts[which] = own
            parts.append((which, ids, own))
        out, offsets = np.empty(int(counts.sum()), np.uint32), np.cumsum(counts) - counts
        for which, ids, own in parts:
            out[textscan.ranges(offsets[which], own)] = ids
        return out, counts

    def encode(self, words: textscan.Words) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the block's words one after the other, and how many each word has."""
        return self.memo.get(*words.hashes(), lambda picked: self._encode_new(words.data, words.starts[picked], words.ends[picked]))


def encode_texts(column: pa.Array, path: str, end: int = END) -> tuple[np.ndarray, np.ndarray]:
    """All texts' ids, each text followed by the end id, and the offsets of the texts."""
    data, at = textscan.buffers(column)
    encoder, parts, sizes = WordEncoder.of(path), [], np.ones(len(column), np.int64)
    for words in textscan.word_blocks(data, at):
        if len(words.starts):
            ids, lengths = encoder.encode(words)
            parts.append(ids)
            sizes += np.bincount(words.rows, lengths, len(column)).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    out = np.full(offsets[-1], end, np.uint32)
    body = np.ones(len(out), bool)
    body[offsets[1:] - 1] = False
    out[body] = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    return out, offsets


def nth_of(keys: np.ndarray) -> np.ndarray:
    """How many equal keys stand before each."""
    order = np.argsort(keys, kind="stable")
    heads = np.flatnonzero(np.append(True, keys[order][1:] != keys[order][:-1])) if len(keys) else np.zeros(0, np.int64)
    out = np.empty(len(keys), np.uint64)
    out[order] = np.arange(len(keys)) - np.repeat(heads, np.diff(np.append(heads, len(keys))))
    return out


def cut_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text", size: int = SIZE, end: int = END, with_ids: bool = False) -> DataFrame:
    """id_col, the PIECE columns, draw (a hash that deals the piece), and ids if asked for."""
    kind = dict(docs.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, {PIECE}, draw long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textscan.sliced(batches):
            ids, offsets = encode_texts(batch.column(1), tokenizer, end)
            counts = np.diff(offsets)
            pieces = -(-counts // size)
            row = np.repeat(np.arange(len(counts)), pieces)
            start = (textscan.ranges(np.zeros(len(counts), np.int64), pieces)) * size
            length = np.minimum(size, counts[row] - start)
            low = offsets[row] + start
            raw = memoryview(ids.astype("<u4").view(np.uint8))
            crc = np.fromiter((zlib.crc32(raw[a:b]) for a, b in zip((low * 4).tolist(), ((low + length) * 4).tolist(), strict=True)), np.int64, len(row))
            key = textscan.mix(crc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (start * 4099 + length).astype(np.uint64))
            owner = batch.column(0)
            own = np.fromiter((zlib.crc32(str(x).encode()) for x in owner.to_pylist()), np.uint64, len(owner))
            draw = textscan.mix(key + textscan.mix(nth_of(key) + (own[row] << np.uint64(20)))).view(np.int64)
            columns = [owner.take(pa.array(row)), pa.array(start), pa.array(length), pa.array(crc), pa.array(counts[row]), pa.array(draw)]
            names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "draw"]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.append(low, offsets[-1]).astype(np.int32)), pa.array(ids.astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)
        WordEncoder.of(tokenizer).forget()

    return docs.select(id_col, text).mapInArrow(run, schema)


class Bins:
    """Bins of equal room, in order, under a tournament tree of their free room."""

    def __init__(self, size: int, most: int):
        self.leaves = 1 << max(most - 1, 1).bit_length()
        self.tree = [size] * (2 * self.leaves)

    def first_fit(self, length: int) -> tuple[int, int]:
        """The first bin with so much room, and the room it had; it is taken."""
        tree, k = self.tree, 1
        while k < self.leaves:
            k *= 2
            if tree[k] < length:
                k += 1
        room = tree[k]
        tree[k], best = room - length, room - length
        bin_ = k - self.leaves
        while k > 1:
            other = tree[k ^ 1]
            best = best if best > other else other
            k >>= 1
            if tree[k] == best:
                break
            tree[k] = best
        return bin_, room


def first_fit_decreasing(lengths: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset in the bin of each length, in the order given; longest placed first,
    ties in order. Lengths of size get a bin each without entering the tree."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    full = lengths >= size
    order = np.argsort(-lengths, kind="stable")
    order = order[~full[order]]
    tree, used = Bins(size, len(order)), 0
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        bins[i], room = tree.first_fit(n)
        offsets[i] = size - room
        used = max(used, int(bins[i]) + 1)
    bins[full] = used + np.arange(full.sum())
    return bins, offsets


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text", size: int = SIZE, end: int = END, group: int = GROUP, with_ids: bool = False) -> DataFrame:
    """A row per piece: id_col, the PIECE columns, sequence_id and offset (and ids)."""
    groups = max(1, -(-docs.count() // group))
    pieces = cut_pieces(docs, tokenizer, id_col, text, size, end, with_ids)
    pieces = pieces.withColumn("pack_group", F.pmod("draw", F.lit(groups)))
    kind = dict(docs.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, {PIECE}" + ", ids array<int>" * with_ids + ", sequence_id long, offset long"

    def run(table: pa.Table) -> pa.Table:
        order = np.lexsort((table["draw"].to_numpy(), table["start"].to_numpy()))
        table = table.take(pa.array(order))
        bins, offsets = first_fit_decreasing(table["length"].to_numpy(), size)
        number = table["pack_group"].to_numpy()[:1].astype(np.int64)[0]
        keep = [id_col, "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
        return table.select(keep).append_column("sequence_id", pa.array((number << 32) + bins)).append_column("offset", pa.array(offsets))

    return pieces.groupBy("pack_group").applyInArrow(run, schema)
