"""Subword lattice language model.

A text is its words, each after a word mark, and an end. Every way of writing a word in
pieces of an existing vocabulary is weighted by its pieces' probabilities, and a forward
recursion in log space sums over all of them: the word's marginal probability. The pieces'
probabilities start from the vocabulary's own scores and are fitted to the distinct training
words by expectation steps over the same lattices. A word of the training texts also has an
edge that spans it whole, weighted by its count less DISCOUNT; what the discounts leave goes
to the pieces. So P(word) = (uses - DISCOUNT) / words + DISCOUNT * types / words * P(pieces).

Texts are cut into bounded chunks; a chunk is stored as its distinct words and, for each
document, numbers into them. So each distinct word is scored once over the whole corpus and
sent to a chunk once, whatever the number of its uses.

Defined results: null and empty texts are an end alone; characters without a piece are
written in byte pieces; repeated rows count each time; a table without training rows gives
every token the same smoothed base probability and the vocabulary's own piece scores; an
empty table gives no rows; other columns aren't read. A very long text is a chunk of its own,
of its distinct words; a word of any length is summed over all its segmentations.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.llm import textscan
from loomline.llm.common import stored
from loomline.llm.pieces import SPACE, load, piece_table

CHUNK = 8 << 20
ROUNDS = 2
#: Code points above which a word is summed on its own.
LONG = 64
#: Taken from the count of each training word, for words in pieces.
DISCOUNT = 0.75
#: Weight that every piece gets besides what the training words give.
PRIOR = 0.1

Edges = list[tuple[np.ndarray, int, int, np.ndarray]]


def first_log_probs(path: str) -> np.ndarray:
    """Log probability of each piece id, and at the end of the text's end, from the scores:
    log probabilities are taken as they are, ranks as by Zipf's law."""
    v = load(path)
    usable = v.normal | np.isin(np.arange(len(v.pieces)), v.byte_ids)
    ranked = v.scores[v.normal].min() < -1000
    raw = -np.log(v.ranks + 10.0) if ranked else v.scores.copy()
    raw[~usable] = -np.inf
    raw[v.byte_ids[v.byte_ids >= 0]] = raw[usable & v.normal].min()
    raw = np.append(raw, raw[usable].max())
    return raw - np.logaddexp.reduce(raw)


@lru_cache(maxsize=2)
def _byte_sums(path: str) -> dict[int, np.ndarray]:
    return {}


def _char_bytes(path: str, code: int) -> np.ndarray:
    """The byte pieces of a code point."""
    held = _byte_sums(path)
    if code not in held:
        if len(held) > 100_000:
            held.clear()
        held[code] = load(path).byte_ids[list(chr(code).encode("utf-8", "replace"))]
    return held[code]


def word_matrix(words: list[str]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length in code points: numbers of the words and their code points, mark first."""
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    flat = np.frombuffer((SPACE + SPACE.join(words)).encode("utf-32-le"), np.uint32)
    starts = np.cumsum(lengths) - lengths
    return {n: ((which := np.flatnonzero(lengths == n)), flat[starts[which][:, None] + np.arange(n)]) for n in np.unique(lengths).tolist()}


def edges_of(chars: np.ndarray, path: str) -> Edges:
    """(rows, start, length, pieces) of all occurrences of pieces in the rows, by start."""
    table, longest, width = piece_table(path), load(path).longest, chars.shape[1]
    out: Edges = []
    wide = chars.astype(np.uint64)
    for j in range(width):
        h = np.zeros(len(chars), np.uint64)
        for n in range(1, min(longest, width - j) + 1):
            h = table.step(h, wide[:, j + n - 1])
            found = table.find(h)
            rows = np.flatnonzero(found >= 0)
            if len(rows):
                out.append((rows, j, n, found[rows]))
            if n == 1 and len(rows) < len(chars):
                none = np.flatnonzero(found < 0)
                out.append((none, j, 1, -1 - chars[none, j].astype(np.int64)))
    return out


def _weight(pieces: np.ndarray, logs: np.ndarray, path: str) -> np.ndarray:
    """Log weights of edges; code points without a piece are held as -1 - code point."""
    out = logs[np.maximum(pieces, 0)]
    for i in np.flatnonzero(pieces < 0).tolist():
        out[i] = logs[_char_bytes(path, -1 - int(pieces[i]))].sum()
    return out


def forward(edges: Edges, n: int, width: int, logs: np.ndarray, path: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """alpha[row, k]: log probability of all ways to write the row's first k code points."""
    alpha = np.full((n, width + 1), -np.inf)
    alpha[:, 0] = 0
    weights = []
    for rows, j, k, pieces in edges:
        weights.append(w := _weight(pieces, logs, path))
        alpha[rows, j + k] = np.logaddexp(alpha[rows, j + k], alpha[rows, j] + w)
    return alpha, weights


def expected(edges: Edges, weights: list[np.ndarray], alpha: np.ndarray, uses: np.ndarray, size: int, path: str) -> np.ndarray:
    """Expected uses of each piece over all ways to write the rows, each used so often."""
    beta = np.full(alpha.shape, -np.inf)
    beta[:, -1] = 0
    out = np.zeros(size)
    for (rows, j, k, pieces), w in zip(reversed(edges), reversed(weights), strict=True):
        through = w + beta[rows, j + k]
        beta[rows, j] = np.logaddexp(beta[rows, j], through)
        share = np.exp(alpha[rows, j] + through - alpha[rows, -1]) * uses[rows]
        known = pieces >= 0
        out += np.bincount(pieces[known], share[known], size)
        for i in np.flatnonzero(~known).tolist():
            np.add.at(out, _char_bytes(path, -1 - int(pieces[i])), share[i])
    return out


def long_word(word: str, logs: np.ndarray, path: str, uses: float = 0, into: np.ndarray | None = None) -> float:
    """Log probability of one long word; its expected pieces are added to into. Two numbers
    are kept for each code point, edges are found again on the way back."""
    v, text = load(path), SPACE + word
    ids, n, inf = v.ids, len(text), -math.inf

    def edges(j: int) -> list[tuple[int, int, float]]:
        own = [(k, i, float(logs[i])) for k in range(1, min(v.longest, n - j) + 1) if (i := ids.get(text[j : j + k], -1)) >= 0]
        if not own or own[0][0] != 1:
            own.insert(0, (1, -1, float(logs[_char_bytes(path, ord(text[j]))].sum())))
        return own

    alpha = array("d", [inf]) * (n + 1)
    alpha[0] = 0.0
    for j in range(n):
        for k, _, w in edges(j):
            x, y = alpha[j + k], alpha[j] + w
            alpha[j + k] = y if x == inf else max(x, y) + math.log1p(math.exp(-abs(x - y)))
    if into is not None:
        beta = array("d", [inf]) * (n + 1)
        beta[n] = 0.0
        for j in range(n - 1, -1, -1):
            for k, i, w in edges(j):
                y = w + beta[j + k]
                x = beta[j]
                beta[j] = y if x == inf else max(x, y) + math.log1p(math.exp(-abs(x - y)))
                share = math.exp(alpha[j] + y - alpha[n]) * uses
                if i >= 0:
                    into[i] += share
                else:
                    np.add.at(into, _char_bytes(path, ord(text[j])), share)
    return alpha[n]


def word_logs(words: list[str], logs: np.ndarray, path: str, uses: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Natural log probability of each word, and the expected uses of pieces if uses are given."""
    out, gathered = np.zeros(len(words)), np.zeros(len(logs))
    short = [i for i, w in enumerate(words) if len(w) < LONG]
    if len(short) < len(words):
        for i, w in enumerate(words):
            if len(w) >= LONG:
                out[i] = long_word(w, logs, path, 0 if uses is None else float(uses[i]), None if uses is None else gathered)
    place = np.array(short, np.int64)
    if short:
        for width, (which, chars) in word_matrix([words[i] for i in short]).items():
            edges = edges_of(chars, path)
            alpha, weights = forward(edges, len(chars), width, logs, path)
            out[place[which]] = alpha[:, -1]
            if uses is not None:
                gathered += expected(edges, weights, alpha, uses[place[which]], len(logs), path)
    return out, gathered


def chunked(docs: DataFrame, id_col: str, text: str, train: Column) -> DataFrame:
    """Rows of two kinds. Words: chunk, word, number, uses (in training texts). Documents:
    chunk, id_col, train, numbers and counts (packed) of their words, and n_words."""
    kind = dict(docs.dtypes)[id_col]
    schema = f"chunk string, word string, number int, uses long, `{id_col}` {kind}, train boolean, numbers binary, counts binary, n_words long"
    columns = [x.split(" ")[0].strip("`") for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, chunk = TaskContext.get().partitionId(), 0
        for batch in batches:
            data, at = textscan.buffers(batch.column(2))
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(at, at[lo] + CHUNK, "right")) - 1)
                yield from _chunk(f"{part}.{chunk}", batch.slice(lo, hi - lo), data, at[lo : hi + 1], columns)
                lo, chunk = hi, chunk + 1

    return docs.select(id_col, train.alias("train"), text).mapInArrow(run, schema)


def _chunk(name: str, rows: pa.RecordBatch, data: np.ndarray, at: np.ndarray, columns: list[str]) -> Iterator[pa.RecordBatch]:
    trained = rows.column(1).to_numpy(zero_copy_only=False).astype(bool)
    seen: dict[bytes, int] = {}
    numbers, owners = [], []
    for words in textscan.word_blocks(data, at):
        if not len(words.starts):
            continue
        first, inverse, _ = textscan.distinct(*words.hashes(folded=True))
        low = words.data.copy()
        low[(low >= 65) & (low <= 90)] += 32
        raw = textscan.split_at(low, words.starts[first], words.ends[first])
        own = np.fromiter((seen.setdefault(w, len(seen)) for w in raw), np.int64, len(raw))
        numbers.append(own[inverse])
        owners.append(words.rows)
    n = len(seen)
    number, owner = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (numbers, owners))
    names = list(seen)
    by_name = sorted(range(n), key=names.__getitem__)
    rank = np.empty(n, np.int64)
    rank[by_name] = np.arange(n)
    number = rank[number]
    pairs, counts = np.unique(owner * max(n, 1) + number, return_counts=True)
    owner, number = pairs // max(n, 1), pairs % max(n, 1)
    uses = np.bincount(number, counts * trained[owner], n).astype(np.int64)
    null = lambda k, t: pa.nulls(k, t)
    ids = rows.column(0)
    yield pa.RecordBatch.from_arrays(
        [pa.array([name] * n, pa.string()), pa.array([names[i].decode("utf-8", "replace") for i in by_name], pa.string()), pa.array(np.arange(n, dtype=np.int32)), pa.array(uses), null(n, ids.type), null(n, pa.bool_()), null(n, pa.binary()), null(n, pa.binary()), null(n, pa.int64())],
        columns,
    )
    k, edges = rows.num_rows, np.searchsorted(owner, np.arange(rows.num_rows + 1))
    words_in = np.bincount(owner, counts, k).astype(np.int64)
    packed = lambda x, t: pa.array([x[a:b].astype(t).tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary())
    yield pa.RecordBatch.from_arrays(
        [pa.array([name] * k, pa.string()), null(k, pa.string()), null(k, pa.int32()), null(k, pa.int64()), ids, pa.array(trained), packed(number, "<u4"), packed(counts, "<u4"), pa.array(words_in)],
        columns,
    )


def fit(words: DataFrame, path: str, rounds: int = ROUNDS) -> np.ndarray:
    """Log probabilities of the pieces and the end. words: word, uses (weights of words)."""
    logs = first_log_probs(path)
    usable = np.isfinite(logs)
    for _ in range(rounds):
        held = logs

        def run(batches: Iterator[pa.RecordBatch], held: np.ndarray = held) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(held))
            for batch in batches:
                total += word_logs(batch.column(0).to_pylist(), held, path, batch.column(1).to_numpy().astype(float))[1]
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], ["piece", "uses"])

        # a row for each piece of the vocabulary at most
        sums = words.select("word", "uses").mapInArrow(run, "piece long, uses double").groupBy("piece").agg(F.sum("uses").alias("uses"))
        got = np.zeros(len(logs))
        for r in sums.collect():
            got[r.piece] = r.uses
        got[-1] = 1
        got[usable] += PRIOR
        logs = np.where(usable, np.log(np.where(usable, got, 1)) - math.log(got[usable].sum()), -np.inf)
    return logs


def score_texts(docs: DataFrame, path: str, train: Column, id_col: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """id_col, train, n_tokens, n_known, train_tokens, base_score and score (both log10) of
    every text, learnt from the rows for which train holds."""
    parts = stored(chunked(docs, id_col, text, train), "chunks")
    vocab = parts.filter("word is not null").select("chunk", "word", "number", "uses")
    texts = parts.filter("word is null").select("chunk", id_col, "train", "numbers", "counts", "n_words")
    words = stored(vocab.groupBy("word").agg(F.sum("uses").alias("uses")), "words")
    tokens, known = words.agg(F.coalesce(F.sum("uses"), F.lit(0)), F.count_if(F.col("uses") > 0)).first()
    ends = texts.filter("train").count()
    tokens, known = tokens + ends, known + (ends > 0)
    types, in_words = known - (ends > 0), tokens - ends
    logs = fit(words.filter("uses > 0").select("word", F.lit(1).alias("uses")), path, rounds if types else 0)
    under = tokens + 0.5 * (known + 1)
    end_share = ends / tokens if tokens else math.exp(logs[-1])
    end_log, word_share = math.log10(end_share), math.log(1 - end_share) if end_share < 1 else 0.0
    left = math.log(DISCOUNT * types / in_words) if types else 0.0

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = left + word_logs(batch.column(0).to_pylist(), logs, path)[0]
            whole = np.maximum(batch.column(1).to_numpy() - DISCOUNT, 0) / max(in_words, 1)
            values = (word_share + np.logaddexp(values, np.log(whole, out=np.full(len(whole), -np.inf), where=whole > 0))) / math.log(10)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values)], ["word", "uses", "log"])

    rated = words.select("word", "uses").mapInArrow(rate, "word string, uses long, log double")
    sent = vocab.select(F.col("chunk").alias("part"), "word", "number").join(rated, "word").select("part", "number", "uses", "log")
    kind = dict(docs.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    end_base = math.log10((ends + 0.5) / under)

    def add(texts: pa.Table, rated: pa.Table) -> pa.Table:
        size = rated.num_rows
        uses, log = np.zeros(size, np.int64), np.zeros(size)
        number = rated["number"].to_numpy()
        uses[number], log[number] = rated["uses"].to_numpy(), rated["log"].to_numpy()
        base = np.log10((uses + 0.5) / under)
        known_, based, scored = [], [], []
        for a, b in zip(texts["numbers"].to_pylist(), texts["counts"].to_pylist(), strict=True):
            i, n = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
            known_.append(int(n[uses[i] > 0].sum()) + (ends > 0))
            based.append(float((base[i] * n).sum()) + end_base)
            scored.append(float((log[i] * n).sum()) + end_log)
        k = texts.num_rows
        n_tokens = pa.array(texts["n_words"].to_numpy() + 1)
        return pa.table({id_col: texts[id_col], "train": texts["train"], "n_tokens": n_tokens, "n_known": pa.array(known_, pa.int64()), "train_tokens": pa.array([tokens] * k, pa.int64()), "base_score": pa.array(based, pa.float64()), "score": pa.array(scored, pa.float64())})

    return texts.groupBy("chunk").cogroup(sent.groupBy("part")).applyInArrow(add, schema)
