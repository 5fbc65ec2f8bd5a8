from __future__ import annotations

import collections
import heapq
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomline.llm import ann_forest as A
from loomline.llm import lattice_lm as L
from loomline.llm import packing as K
from loomline.llm import piece_codec as C
from loomline.llm import quality_classifier as B
from loomline.llm import sharding as H
from loomline.llm import textscan as T
from loomline.llm.common import crc_fold
from loomline.llm.queries import piece_vocabulary, word_tokenizer

ODD = [None, "", " ", "   x   y ", "a  b\n\n c \t d", "日本語 テスト 𝔘nicode", "x" * 3000, "def f():\n        return  1\n", "é á\x0bñ ß İ ſt", "don't <|endoftext|> 12345 ...!", "trail   "]


def test_word_blocks_see_every_word_once():
    texts = ["one two", "", None, "three" * 50, " four  five ", "six"] * 3
    data, at = T.buffers(pa.array(texts))
    for block in (1, 7, 64, 1 << 20):
        got = [(int(r), w.data[s:e].tobytes().decode()) for w in T.word_blocks(data, at, block) for s, e, r in zip(w.starts, w.ends, w.rows, strict=True)]
        assert got == [(i, w) for i, t in enumerate(texts) for w in (t or "").split()]


def alike():
    """Two words of 1024 letters that polynomial hashes modulo 2^64 can't tell apart."""
    s = "a"
    for _ in range(10):
        s += s.translate(str.maketrans("ab", "ba"))
    return s, s.translate(str.maketrans("ab", "ba"))


def test_words_that_polynomial_hashes_confuse(docs):
    import sentencepiece
    from tokenizers import Tokenizer

    one, two = alike()
    data, at = T.buffers(pa.array([one, two]))
    sums = T.rolling(data)
    assert len(set(T.span_hash(sums, at[:-1], at[1:]).tolist())) == 1
    texts = [one, two, f"x {one} {two} y", f"{two} {one}"]
    tokenizer = Tokenizer.from_file(word_tokenizer())
    ids, at = K.encode_texts(pa.array(texts), word_tokenizer())
    assert [ids[at[i] : at[i + 1] - 1].tolist() for i in range(4)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    library = sentencepiece.SentencePieceProcessor(model_file=piece_vocabulary())
    ids, at = C.codec(piece_vocabulary()).encode(pa.array(texts))
    assert [ids[at[i] : at[i + 1]].tolist() for i in range(4)] == [library.encode(t) for t in texts]
    rows = L.score_texts(docs([(0, one), (1, two), (2, one)]), piece_vocabulary(), F.col("doc_id") == 0).collect()
    assert {r.doc_id: r.n_known for r in rows} == {0: 2, 1: 1, 2: 2}


def test_memo_tells_units_of_one_hash_apart():
    made = []

    def make(places):
        made.append(places.tolist())
        counts = two[places].astype(np.int64)
        return np.repeat(two[places], counts).astype(np.int32), counts

    for keys, checks in (([5, 5, 7, 5], [1, 2, 3, 1]), ([5, 7], [1, 3]), ([5, 7], [2, 3]), ([5, 7], [1, 3])):
        one, two = np.array(keys, np.uint64), np.array(checks, np.uint64)
        memo = T.Memo(10, np.int32) if len(keys) == 4 else memo
        ids, counts = memo.get(one, two, make)
        assert counts.tolist() == checks and ids.tolist() == [c for c in checks for _ in range(c)]
    assert len(made) == 3  # the last units were remembered


def test_packing_ids_are_the_tokenizers(prose):
    from tokenizers import Tokenizer

    texts = [*ODD, prose(300), prose(200).upper(), "Éàü Çé, été! (ÄÖÜ) naïve... L'eau × ÷ ª"]
    ids, at = K.encode_texts(pa.array(texts), word_tokenizer())
    tokenizer = Tokenizer.from_file(word_tokenizer())
    for i, text in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], text


def test_pack(docs, prose):
    pairs = [*enumerate([*ODD, *[prose(n) for n in (1, 50, 400, 3000, 9000)]]), (3, "same"), (3, "same"), (None, "none")]
    rows = K.pack(docs(pairs), word_tokenizer(), size=256, group=4).collect()
    bins, parts = collections.defaultdict(list), collections.Counter()
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
        parts[r.doc_id] += r.length
    for used in bins.values():
        at = 0
        for offset, length in sorted(used):
            assert offset == at
            at += length
        assert at <= 256
    ids, at = K.encode_texts(pa.array([t for _, t in pairs]), word_tokenizer())
    want = collections.Counter()
    for i, (d, _) in enumerate(pairs):
        want[d] += int(at[i + 1] - at[i])
    assert parts == want
    first = next(r for r in rows if r.doc_id == len(ODD) + 2 and r.start == 0)
    own = ids[at[len(ODD) + 2] :][: first.length]
    assert first.ids_crc32 == zlib.crc32(own.astype("<u4").tobytes())
    assert K.pack(docs([]), word_tokenizer()).count() == 0
    coded = K.pack(docs(pairs), word_tokenizer(), with_ids=True).filter("doc_id = 3").select(F.size("ids") == F.col("length")).collect()
    assert all(r[0] for r in coded)


def test_first_fit_decreasing_is_first_fit():
    lengths = np.random.default_rng(3).integers(1, 100, 300)
    bins, offsets = K.first_fit_decreasing(lengths, 100)
    room: list[int] = []
    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])
        k = next((k for k, r in enumerate(room) if r >= n), len(room))
        if k == len(room):
            room.append(100)
        assert (bins[i], offsets[i]) == (k, 100 - room[k])
        room[k] -= n


def test_piece_codec_is_the_librarys(spark, docs, prose):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=piece_vocabulary())
    texts = [*ODD, prose(400), prose(100).title(), "enenen ababab aaaa " * 20]
    ids, at = C.codec(piece_vocabulary()).encode(pa.array(texts))
    for i, text in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == library.encode(text or ""), text
    out = C.decode(C.encode(docs(list(enumerate(texts))), piece_vocabulary()), piece_vocabulary()).collect()
    assert {r.doc_id: r.text for r in out} == {i: t or "" for i, t in enumerate(texts)}
    assert C.encode(docs([]), piece_vocabulary()).count() == 0
    once = C.round_trip(docs(list(enumerate(texts))), piece_vocabulary()).collect()
    assert sorted(map(str, once)) == sorted(map(str, out)) and C.round_trip(docs([]), piece_vocabulary()).count() == 0


def test_long_words_fall_into_parts(prose):
    import random

    import sentencepiece

    draw = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"
    texts = ["".join(draw.choice(letters) for _ in range(20_000)), "".join(chr(draw.randint(0x4E00, 0x9FA0)) for _ in range(20_000)), prose(2000).replace(" ", ""), "ab" * 700]
    library = sentencepiece.SentencePieceProcessor(model_file=piece_vocabulary())
    ids, at = C.codec(piece_vocabulary()).encode(pa.array(texts))
    assert [ids[at[i] : at[i + 1]].tolist() for i in range(4)] == [library.encode(t) for t in texts]


def test_suffix_array_and_occurrences():
    codes = np.array([ord(c) for c in "banana\0bandana\0"], np.int64)
    index = C.SuffixArray(codes, 16)
    order = index.order
    text = "banana\0bandana\0"
    assert [text[i:] for i in order] == sorted(text[i:] for i in order)
    lo, hi = index.occurrences(np.array([[ord("a"), ord("n"), ord("a")], [ord("x"), 0, 0]]), np.array([3, 1]))
    assert sorted(order[lo[0] : hi[0]].tolist()) == [1, 3, 11] and lo[1] == hi[1]


def all_ways(word, logs, v):
    """Log of the sum over all segmentations, one by one."""
    text, total = "▁" + word, -math.inf
    ids = v.ids

    def go(at, log):
        nonlocal total
        if at == len(text):
            total = float(np.logaddexp(total, log))
            return
        found = False
        for n in range(1, v.longest + 1):
            if at + n <= len(text) and (i := ids.get(text[at : at + n])) is not None:
                found |= n == 1
                go(at + n, log + logs[i])
        if not found:
            go(at + 1, log + logs[v.byte_ids[list(text[at].encode())]].sum())

    go(0, 0.0)
    return total


def test_forward_sums_all_segmentations():
    path = piece_vocabulary()
    logs, v = L.first_log_probs(path), L.load(path)
    words = ["the", "ounding", "été", "ab", "x", "日本"]
    got, uses = L.word_logs(words, logs, path, np.ones(len(words)))
    for w, g in zip(words, got, strict=True):
        assert g == pytest.approx(all_ways(w, logs, v), rel=1e-9)
        into = np.zeros(len(logs))
        assert L.long_word(w, logs, path, 1.0, into) == pytest.approx(g, rel=1e-9)
    assert uses.sum() > len(words)
    assert np.exp(logs[np.isfinite(logs)]).sum() == pytest.approx(1)


def test_lm_scores(docs, prose):
    pairs = [*enumerate([*ODD, *[prose(80) for _ in range(40)], "y" * 200]), (3, "again"), (None, "none")]
    rows = L.score_texts(docs(pairs), piece_vocabulary(), crc_fold("doc_id") != 1).collect()
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5
    tokens = [[w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w] + [None] for _, t in pairs]
    counts = collections.Counter(w for (i, _), ws in zip(pairs, tokens, strict=True) if fold(i) != 1 for w in ws)
    n, under = sum(counts.values()), sum(counts.values()) + 0.5 * (len(counts) + 1)
    want = sorted((str(i), len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(math.log10((counts[w] + 0.5) / under) for w in ws), 6)) for (i, _), ws in zip(pairs, tokens, strict=True))
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows)
    assert L.score_texts(docs([]), piece_vocabulary(), F.lit(True)).count() == 0
    assert L.score_texts(docs([(1, "a b")]), piece_vocabulary(), F.lit(False)).first().n_known == 0


def test_classifier(docs, spark, prose):
    good, bad = [(i, prose(60)) for i in range(60)], [(i, " ".join(w + "###" for w in prose(60).split())) for i in range(60, 120)]
    extra = [(200, None), (201, ""), (0, good[0][1])]
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad] + [(0, 1), (500, 1), (None, 0), (3, None)], "doc_id long, quality int")
    held = crc_fold("doc_id") == 0
    rows = B.classify(docs(good + bad + extra), labels, ~held).collect()
    assert len(rows) == 123 and all(0 <= r.score <= 1 for r in rows)
    assert all(r.predicted == (r.score >= B.CUT) for r in rows)
    assert all(r.predicted == (r.doc_id < 60) for r in rows if r.doc_id < 120)
    none = B.classify(docs(good[:3]), labels.limit(0), ~held).collect()
    assert {round(r.score, 6) for r in none} == {B.CUT}
    assert B.classify(docs([]), labels, ~held).count() == 0


def brute_uses(words, logs, v):
    """Expected uses of each piece over all ways to write the words, one way at a time."""
    out = np.zeros(len(logs))
    for word in words:
        text, ways = "▁" + word, []

        def go(at, used, text=text, ways=ways):
            if at == len(text):
                ways.append(used)
                return
            own = [(n, [i]) for n in range(1, v.longest + 1) if at + n <= len(text) and (i := v.ids.get(text[at : at + n])) is not None]
            if not own or own[0][0] != 1:
                own.append((1, v.byte_ids[list(text[at].encode())].tolist()))
            for n, pieces in own:
                go(at + n, [*used, *pieces])

        go(0, [])
        weights = np.exp([logs[w].sum() for w in ways])
        for way, share in zip(ways, weights / weights.sum(), strict=True):
            np.add.at(out, way, share)
    return out


def test_scores_by_brute_force(docs):
    path = piece_vocabulary()
    v, train = L.load(path), ["the cat the été", "cat sat", ""]
    held = ["the dog", "日 sat", None]
    counts = collections.Counter(w for t in train for w in t.split())
    logs = L.first_log_probs(path)
    usable = np.isfinite(logs)
    for _ in range(L.ROUNDS):
        got = brute_uses(sorted(counts), logs, v)
        got[-1] = 1
        got[usable] += L.PRIOR
        with np.errstate(divide="ignore"):
            logs = np.where(usable, np.log(got / got[usable].sum()), -np.inf)
    words, ends = sum(counts.values()), len(train)

    def score(text):
        total = math.log10(ends / (words + ends))
        for w in (text or "").split():
            pieces = math.exp(all_ways(w, logs, v))
            p = max(counts[w] - L.DISCOUNT, 0) / words + L.DISCOUNT * len(counts) / words * pieces
            total += math.log10(words / (words + ends) * p)
        return total

    rows = L.score_texts(docs([*enumerate(train), *enumerate(held, 10)]), path, F.col("doc_id") < 10).collect()
    assert {r.doc_id: round(r.score, 6) for r in rows} == {i: round(score(t), 6) for i, t in [*enumerate(train), *enumerate(held, 10)]}


def test_very_long_texts_are_scored(docs, prose):
    long = " ".join(prose(1000) for _ in range(40)) + " " + "x" * 30_000
    rows = {r.doc_id: r for r in L.score_texts(docs([(1, long), (2, long), (3, "a")]), piece_vocabulary(), F.col("doc_id") < 3).collect()}
    assert rows[1].n_tokens == 40_002 == rows[1].n_known and rows[1].score == rows[2].score < -30_000


def test_ranking_orders_pairs():
    x = np.random.default_rng(0).normal(size=(400, 3))
    liked = x @ [2.0, -1.0, 0.0] > 0
    r = B.fit_pairs(x, liked)
    assert (((x @ r.weights) >= r.cut) == liked).mean() > 0.98


def test_ann(spark):
    draw = np.random.default_rng(4)
    x = draw.normal(size=(600, 16)).astype(np.float32)
    x[300:420] = x[7]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1100, [0.0] * 16), (1200, [float("nan")] * 16), (None, x[0].tolist()), (1300, [1.0, None] + [0.0] * 14), (7, x[7].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for r in A.search(df, F.col("id") % 50 == 0).collect():
        got[r.query_id].append((r.rank, r.id, r.score))
    hit = 0
    y = x.astype(float)
    for q in range(0, 600, 50):
        d = np.sqrt(((y - y[q]) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((np.arange(600), d)) if i != q][:10]
        answer = sorted(got[q])
        assert [a[0] for a in answer] == list(range(1, 11))
        hit += len({a[1] for a in answer} & set(order))
        assert all(abs(s - d[i]) < 1e-12 for _, i, s in answer)
        if 300 <= q < 420:
            assert [a[1] for a in answer] == order
    assert hit >= 0.9 * 120 and set(got) == set(range(0, 600, 50))
    assert A.search(df.limit(0), F.col("id") >= 0).count() == 0
    assert A.search(df.filter("vec_id < 3"), F.col("id") == 0).count() == 2


def test_ann_budget_grows_until_recall_is_met(spark):
    x = np.random.default_rng(6).normal(size=(3000, 24)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = collections.defaultdict(set)
    for r in A.search(df, F.col("id") % 50 == 0, trees=6, leaf=16, search=100, sample=256).collect():
        got[r.query_id].add(r.id)
    hit = 0
    for q in range(0, 3000, 50):
        d = np.square(x.astype(float) - x[q]).sum(axis=1)
        d[q] = np.inf
        hit += len(got[q] & set(np.argsort(d)[:10].tolist()))
    assert hit >= 0.98 * 600


def test_ranking_has_the_least_loss_and_the_best_cut():
    draw = np.random.default_rng(2)
    x = draw.normal(size=(80, 5))
    liked = x @ [1.0, -2.0, 0.5, 0.0, 0.0] + draw.normal(size=80) > 0
    i, j = B.partners(liked)
    assert liked[i].all() and not liked[j].any() and np.bincount(np.concatenate([i, j]), minlength=80).min() >= B.PARTNERS

    def loss(w):
        s = x @ w
        return sum(math.log1p(math.exp(s[b] - s[a])) for a, b in zip(i.tolist(), j.tolist(), strict=True)) / len(i) + B.RIDGE / 2 * sum(v * v for v in w)

    w = B.fit_weights(x, i, j)
    least = loss(w)
    for k in range(5):
        for step in (-0.02, 0.02):
            assert loss(w + step * np.eye(5)[k]) > least
    s = x @ w
    right = lambda c: np.mean(s[liked] >= c) + np.mean(s[~liked] < c)
    assert right(B.best_cut(s, liked)) >= max(right(c) for c in s) - 0.005


def test_features_are_those_of_the_whole_text(prose):
    long = (prose(3000) + "\n") * 60
    parts = B.text_features(pa.array([long, None, "", "one two\none two", long]))
    assert parts.shape == (5, B.WIDTH) and (parts[0] == parts[4]).all() and not parts[1:3].any()
    at = {m: B.WORDS + B.BYTES + k for k, m in enumerate(B.MEASURES)}
    assert parts[3, at["different_words"]] == 0.5 and parts[3, at["lines_again"]] == 0.5
    words = re.findall("[^ \n]+", long.lower())
    assert parts[0, at["different_words"]] == pytest.approx(len(set(words)) / len(words), rel=1e-4)
    assert parts[0, at["lines_again"]] == pytest.approx(59 / 60, rel=1e-4)


def test_classifier_on_planted_junk(docs, spark, prose):
    junk = [lambda t: t.upper(), lambda t: " ".join(w for w in t.split() for _ in range(3)), lambda t: "!!! $$$ ".join(t.split()), lambda t: "click here now " * 20]
    pairs = [(i, prose(80) if i % 2 else junk[i // 2 % 4](prose(80))) for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, quality int")
    held = crc_fold("doc_id") == 0
    rows = B.classify(docs(pairs), labels, ~held).withColumn("held", held).filter("held").collect()
    assert len(rows) > 50 and np.mean([r.predicted == r.doc_id % 2 for r in rows]) > 0.97
    few = B.classify(docs(pairs), labels, ~held, most=100).collect()
    assert np.mean([r.predicted == r.doc_id % 2 for r in few]) > 0.9


def walked(forest, q):
    """Leaves of all trees, taken from a heap of branches one by one."""
    first, heap, out = (1 << forest.depth) - 1, [(0.0, t, 0) for t in range(len(forest.normals))], []
    margins = [(n @ q - h).tolist() for n, h in zip(forest.normals, forest.thresholds, strict=True)]
    heapq.heapify(heap)
    while heap:
        far, t, node = heapq.heappop(heap)
        while node < first:
            m = margins[t][node]
            heapq.heappush(heap, (far + m * m, t, 2 * node + 1 + (m <= 0)))
            node = 2 * node + 1 + (m > 0)
        out.append((far, (t << forest.depth) + node - first))
    return out


def test_ann_queue_is_that_of_a_heap():
    x = np.random.default_rng(1).normal(size=(500, 12)).astype(np.float32)
    forest = A.grow(x, 5, 4)
    for q, order in zip(x[:10], forest.queue(x[:10]), strict=True):
        heap = walked(forest, q)
        assert [round(f, 4) for f, _ in heap] == sorted(round(f, 4) for f, _ in heap)
        far = {leaf: f for f, leaf in heap}
        assert np.allclose([far[k] for k in order.tolist()], [f for f, _ in heap], atol=1e-5)
        assert sorted(order.tolist()) == sorted(far)


@pytest.mark.parametrize("clustered", [False, True])
def test_ann_looks_at_under_half_the_table(clustered):
    draw = np.random.default_rng(3)
    x = draw.normal(size=(6000, 32)) if not clustered else draw.normal(size=(60, 32))[draw.integers(0, 60, 6000)] * 3 + draw.normal(size=(6000, 32))
    x = x.astype(np.float32)
    block = A.Block(np.arange(6000), x, 10, A.TREES, A.LEAF, A.SEARCH, A.SAMPLE, A.RECALL, False)
    seen, hit = [], 0
    nearest = block.nearest
    block.answers(x[: A.PROBED].astype(float))
    block.nearest = lambda q, c: (seen.append(len(c)), nearest(q, c))[1]
    for q, (found, _) in zip(x[200:400].astype(float), block.answers(x[200:400].astype(float)), strict=True):
        hit += len(set(block.first[found].tolist()) & set(np.argsort(np.square(x - q).sum(axis=1))[:11].tolist()))
    assert hit >= 0.95 * 11 * 200 and np.mean(seen) < (0.1 if clustered else 0.5) * 6000


def test_ann_blocks_and_exact(spark):
    draw = np.random.default_rng(9)
    x = (draw.normal(size=(30, 16))[draw.integers(0, 30, 4000)] * 2 + draw.normal(size=(4000, 16))).astype(np.float32)
    x[100:1500] = x[50]  # a third of the rows are one vector
    df = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(x)], "vec_id long, embedding array<float>, ids string")
    want = {}
    for q in range(0, 4000, 100):
        d = np.sqrt(np.square(x.astype(float) - x[q]).sum(axis=1))
        want[q] = [i for i in np.lexsort((np.arange(4000), d)).tolist() if i != q][:10]
    for exact in (False, True):
        got = collections.defaultdict(dict)
        for r in A.search(df, F.col("id") % 100 == 0, sample=512, blocks=8, exact=exact).collect():
            got[r.query_id][r.rank] = r.id
        hit = sum(len(set(got[q].values()) & set(want[q])) for q in want)
        assert hit >= (1 if exact else 0.95) * 400 and all(len(got[q]) == 10 for q in want)
        assert not exact or all([got[q][k] for k in range(1, 11)] == want[q] for q in want)


def test_sharding(docs):
    names = H.shard_names(7)
    table = H.lookup_table(names, 211)
    shares = collections.Counter(table)
    assert max(shares.values()) - min(shares.values()) <= 1
    more = H.lookup_table((*names, "new"), 211)
    assert sum(a != b for a, b in zip(table, more, strict=True)) < 211 * 0.35
    heavy = collections.Counter(H.lookup_table(names, 211, (3, 1, 1, 1, 1, 1, 1)))
    assert heavy[0] > 2 * heavy[1]
    with pytest.raises(ValueError, match="prime"):
        H.lookup_table(names, 210)
    rows = H.assign_shards(docs([(1, "a"), (1, "b"), (None, None), (3, "c")]), names=names, size=211).collect()
    assert len(rows) == 4 and all(table[r.slot] == r.shard for r in rows)
    assert len({r.shard for r in rows if r.doc_id == 1}) == 1
    assert H.assign_shards(docs([])).count() == 0


def test_write_shards(docs, spark, tmp_path):
    H.write_shards(docs([(i, "x") for i in range(50)]), str(tmp_path / "out"), names=H.shard_names(4), size=211, files=2)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 50
