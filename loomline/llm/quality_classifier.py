"""Quality classifier by Bradley-Terry pairwise ranking.

Pairs of a preferred and a rejected labelled text give a logistic loss on the difference of
their features; its weights make a score for any text. The cut between the classes is the
quantile of the training scores that separates the labels best, and the published score is a
logistic curve that passes CUT there.

Features are those of the whole text: hashed words and word pairs, hashed runs of three
bytes, each as the root of its share, and a few measurements (lengths, shares of kinds of
characters, of different words, of words and word runs said again, of lines said again).

The ranking is fitted on the driver, on at most about ``most`` labelled rows (MOST; those of
least hash of the id), each paired with PARTNERS rows of the other kind, drawn at random, however
many rows there are. All rows are scored, in one pass without a shuffle.

Defined results: null and empty texts have all features 0 and get the score of that point;
repeated rows get equal scores; of rows that repeat a labelled id the least text is learnt; a
text with several labels counts with their mean, one of exactly a half not at all; without
labels of both kinds every weight is 0 and every score is CUT. Very long texts are read in
blocks; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.llm import textscan
from loomline.llm.common import text_of

CUT = 0.3
MOST = 10_000
PARTNERS = 32
RIDGE = 0.03
#: Buckets of the hashed words and of the hashed byte runs.
WORDS, BYTES = 512, 512
MEASURES = (
    "length", "word_length", "letters", "capitals", "digits", "signs", "high", "line_ends",
    "different_words", "said_twice", "runs_again", "lines_again",
)
WIDTH = WORDS + BYTES + 2 * len(MEASURES)
RUN = 4

_KIND = np.full(256, 4, np.int64)
_KIND[0x80:] = 5
_KIND[[*range(97, 123)]], _KIND[[*range(65, 91)]], _KIND[[*range(48, 58)]] = 0, 1, 2
_KIND[[0x20, *range(0x09, 0x0E)]] = 3
_NEXT = textscan.draws(RUN, 31) | np.uint64(1)
_BYTE_MIX = np.uint32(0x9E3779B1)


@dataclass(frozen=True)
class Ranking:
    """Weights of the features and the score at the cut."""

    weights: tuple[float, ...]
    cut: float


def _again(keys: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """By row: how many keys, and how many of them the row has had before."""
    total = np.bincount(rows, minlength=n)
    order = np.lexsort((keys, rows))
    same = (keys[order][1:] == keys[order][:-1]) & (rows[order][1:] == rows[order][:-1])
    return total, np.bincount(rows[order][1:][same], minlength=n)


def text_features(texts: pa.Array) -> np.ndarray:
    """A row of WIDTH features for each text."""
    data, at = textscan.buffers(texts)
    n = len(texts)
    words, rows, pairs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], np.zeros((n, BYTES))
    letters = np.zeros(n)
    for block in textscan.word_blocks(data, at):
        if len(block.starts):
            words.append(textscan.run_hashes(block.data, block.starts, block.ends, folded=True, families=1)[0])
            rows.append(block.rows)
            letters += np.bincount(block.rows, block.ends - block.starts, n)
    word, row = np.concatenate(words), np.concatenate(rows)
    joined = np.zeros(0, np.uint64)
    follows = np.zeros(0, bool)
    if len(word):
        follows = row[1:] == row[:-1]
        joined = textscan.mix(word[:-1] * _NEXT[0] + word[1:] * _NEXT[1])[follows]
    buckets = [(row * WORDS + (w % np.uint64(WORDS)).astype(np.int64)) for row, w in ((row, word), (row[1:][follows], joined))]
    counts = sum(np.bincount(b, minlength=n * WORDS) for b in buckets).reshape(n, WORDS)
    kinds, lines = np.zeros((n, 6)), np.zeros(n)
    line_keys, line_rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        for lo in range(a, b, textscan.BLOCK):
            part = data[lo : min(lo + textscan.BLOCK + 2, b)]
            own = part[: textscan.BLOCK]
            kinds[i] += np.bincount(_KIND[own], minlength=6)
            if len(part) > 2:
                wide = part.astype(np.uint32)
                run = ((wide[:-2] << np.uint32(16)) | (wide[1:-1] << np.uint32(8)) | wide[2:]) * _BYTE_MIX
                pairs[i] += np.bincount(run >> np.uint32(23), minlength=BYTES)
        if b > a:
            ends = np.flatnonzero(data[a:b] == 0x0A)
            lines[i] = len(ends)
            if len(ends):
                edges = np.stack([np.append(0, ends + 1), np.append(ends, b - a)], 1)
                edges = edges[edges[:, 1] > edges[:, 0]]
                line_keys.append(textscan.run_hash(data[a:b], edges[:, 0], edges[:, 1]))
                line_rows.append(np.full(len(edges), i))
    size = np.maximum(np.diff(at), 1)
    total, again = _again(word, row, n)
    said = np.bincount(row[1:][follows & (word[1:] == word[:-1])], minlength=n) if len(word) else np.zeros(n)
    run_total, run_again = np.zeros(n), np.zeros(n)
    if len(word) >= RUN:
        whole = row[RUN - 1 :] == row[: len(row) - RUN + 1]
        keys = sum((word[k : len(word) - RUN + 1 + k] * _NEXT[k] for k in range(1, RUN)), word[: len(word) - RUN + 1] * _NEXT[0])
        run_total, run_again = _again(textscan.mix(keys[whole]), row[RUN - 1 :][whole], n)
    line_total, line_again = _again(np.concatenate(line_keys), np.concatenate(line_rows), n)
    some = np.maximum(total, 1)
    measured = np.stack([
        np.log1p(total) / 10, np.minimum(letters / some / 10, 5), kinds[:, 0] / size, kinds[:, 1] / size, kinds[:, 2] / size, kinds[:, 4] / size,
        kinds[:, 5] / size, np.minimum(lines / some, 1), 1 - again / some, said / some, run_again / np.maximum(run_total, 1), line_again / np.maximum(line_total, 1),
    ], 1) * (total > 0)[:, None]
    share = lambda c: np.sqrt(c / np.maximum(c.sum(axis=1, keepdims=True), 1))
    return np.concatenate([share(counts), share(pairs), measured, np.sqrt(measured)], axis=1).astype(np.float32)


def partners(liked: np.ndarray, each: int = PARTNERS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a liked row and another: every row with `each` of the other kind, at random."""
    good, bad = np.flatnonzero(liked), np.flatnonzero(~liked)
    draw = np.random.default_rng(7)
    return np.concatenate([np.repeat(good, each), draw.choice(good, each * len(bad))]), np.concatenate([draw.choice(bad, each * len(good)), np.repeat(bad, each)])


def pair_loss(scores: np.ndarray, weights: np.ndarray, i: np.ndarray, j: np.ndarray) -> float:
    """Mean of log(1 + exp(-(score of liked - score of other))), and the ridge."""
    return float(np.logaddexp(0, scores[j] - scores[i]).mean() + RIDGE / 2 * weights @ weights)


def fit_weights(x: np.ndarray, i: np.ndarray, j: np.ndarray, steps: int = 20) -> np.ndarray:
    """The weights of least pair_loss over the rows of x: Newton steps, each solved by
    conjugate gradients, so that only products with x are needed."""
    n, w = len(x), np.zeros(x.shape[1])
    times = lambda m, v: (m @ v.astype(m.dtype)).astype(np.float64)  # noqa: E731  without a copy of m
    gathered = lambda g: times(x.T, (np.bincount(i, g, n) - np.bincount(j, g, n)) / len(i))
    scores = times(x, w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(scores[i] - scores[j], -30, 30)))
        slope, curve = gathered(p) - RIDGE * w, p * (1 - p)
        if np.abs(slope).max() < 1e-6:
            break
        move, rest = np.zeros_like(w), slope.copy()
        way, size = rest.copy(), rest @ rest
        for _ in range(30):
            u = times(x, way)
            turned = gathered(curve * (u[i] - u[j])) + RIDGE * way
            step = size / max(way @ turned, 1e-300)
            move += step * way
            rest -= step * turned
            before, size = size, rest @ rest
            if size < 1e-6 * (slope @ slope):
                break
            way = rest + size / before * way
        now, far = pair_loss(scores, w, i, j), 1.0
        while far > 1e-3 and pair_loss(times(x, w + far * move), w + far * move, i, j) > now:
            far /= 2
        w = w + far * move
        scores = times(x, w)
    return w


def best_cut(scores: np.ndarray, liked: np.ndarray) -> float:
    """The lowest quantile of the scores at which the two shares of right answers are about
    largest together (of two doubtful errors, keeping a bad text is the lesser), moved half-way
    to the next score below, so that near ties stay on its good side."""
    cuts = np.unique(np.quantile(scores, np.linspace(0, 1, 4001), method="nearest"))
    good, bad = np.sort(scores[liked]), np.sort(scores[~liked])
    right = 1 - np.searchsorted(good, cuts) / len(good) + np.searchsorted(bad, cuts) / len(bad)
    best = cuts[int(np.flatnonzero(right >= right.max() - 0.004)[0])]
    below = scores[scores < best]
    return float((best + below.max()) / 2 if len(below) else best)


def fit_pairs(rows: np.ndarray, liked: np.ndarray) -> Ranking:
    """The ranking of rows of features of which some are liked."""
    if not liked.any() or liked.all():
        return Ranking((0.0,) * rows.shape[1], 0.0)
    scale = rows.std(axis=0, dtype=np.float64)
    scale[scale < 1e-6] = np.inf
    scale = np.maximum(scale, 1e-3)
    x = (rows / scale).astype(rows.dtype)
    w = fit_weights(x, *partners(liked))
    return Ranking(tuple((w / scale).tolist()), best_cut(x @ w, liked))


def learn(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text: str = "text", label: str = "quality", most: int = MOST) -> Ranking:
    """The ranking from labelled rows for which train (over the ids) holds."""
    named = labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull()).filter(train).groupBy(F.col(id_col).alias("label_id")).agg((F.avg(label) - 0.5).alias("side")).filter("side <> 0")
    n = named.count()
    if n > most:
        named = named.filter(F.pmod(F.xxhash64(F.col("label_id").cast("string")), F.lit(1 << 40)) < int((1 << 40) * most / n))
    picked = named.limit(2 * most)  # the share's own spread is far below this bound
    rows = docs.select(F.col(id_col).alias("label_id"), text_of(text).alias("text")).join(F.broadcast(picked), "label_id")
    rows = rows.groupBy("label_id").agg(F.min("text").alias("text"), F.first("side").alias("side"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textscan.sliced(batches):
            x = text_features(batch.column(1)).astype(np.float16)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), batch.column(0)], ["x", "side"])

    found = rows.select("side", "text").mapInArrow(run, "x binary, side double").toArrow()
    x = np.frombuffer(b"".join(found["x"].to_pylist()), np.float16).reshape(-1, WIDTH).astype(np.float32)
    return fit_pairs(x, found["side"].to_numpy() > 0)


def score(x: np.ndarray, ranking: Ranking, cut: float = CUT) -> np.ndarray:
    """The scores, 0 to 1, of rows of features; `cut` at the ranking's cut."""
    far = x.astype(np.float64) @ np.array(ranking.weights) - ranking.cut
    return 1 / (1 + np.exp(-np.clip(far + np.log(cut / (1 - cut)), -700, 700)))


def classify(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text: str = "text", label: str = "quality", most: int = MOST) -> DataFrame:
    """id_col, score and predicted for every row; labels of ids for which train holds are used."""
    ranking = learn(docs, labels, train, id_col, text, label, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textscan.sliced(batches, 128):
            scores = score(text_features(batch.column(1)), ranking)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array((scores >= CUT).astype(np.int32))], ["id", "score", "predicted"])

    made = docs.select(F.col(id_col).alias("id"), text).mapInArrow(run, f"id {dict(docs.dtypes)[id_col]}, score double, predicted int")
    return made.withColumnRenamed("id", id_col)
