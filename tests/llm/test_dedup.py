from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from loomline.llm import near_dedup as N
from loomline.llm import suffix_dedup as X
from loomline.llm.graph import components


def shingles(text):
    w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near_copies(prose, seed=3):
    """A base with many edits of it, chains of edits, exact copies, short and empty texts."""
    draw, out = random.Random(seed), []
    base = prose(160).split()
    for _ in range(40):
        w = list(base)
        for _ in range(draw.randint(0, 4)):
            w[draw.randrange(len(w))] = "edit" + str(draw.random())
        out.append(" ".join(w))
    chain = prose(150).split()
    for k in range(12):
        chain = [*chain]
        chain[10 * k] = f"step{k}"
        out.append(" ".join(chain))
    out += [out[0]] * 30 + ["one two three", "ONE two  three", "one two", None, "", " \n", *[prose(60) for _ in range(20)], prose(30_000)]
    return list(enumerate(out, 10))


def expected_components(pairs):
    sets = [shingles(t) for _, t in pairs]
    root = list(range(len(pairs)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            n = len(a & sets[j])
            if a and 100 * n >= 85 * (len(a) + len(sets[j]) - n):
                x, y = top(i), top(j)
                root[max(x, y)] = min(x, y)
    lows: dict = {}
    for i, (d, _) in enumerate(pairs):
        lows.setdefault(top(i), []).append(d)
    return {d: (len(sets[i]), min(lows[top(i)])) for i, (d, _) in enumerate(pairs)}


def test_near_duplicates(docs, prose, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 8)
    pairs = near_copies(prose)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_duplicates(docs(pairs)).collect()}
    want = expected_components(pairs)
    assert got == want
    kept = N.drop_near_duplicates(docs(pairs))
    assert kept.columns == docs(pairs).columns
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(d for d, (_, c) in want.items() if c == d)


def test_near_duplicates_of_odd_rows(docs):
    same = "a b c d e f g"
    rows = N.near_duplicates(docs([(None, same), (5, same), (5, same), (None, None), (3, "")])).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept, r.n_shingles) for r in rows) == [("3", "3", True, 0), ("5", "5", True, 3), ("5", "5", True, 3), ("None", "5", False, 3), ("None", "None", True, 0)]
    assert N.near_duplicates(docs([])).count() == 0
    assert N.drop_near_duplicates(docs([(5, same), (5, same), (6, same)])).count() == 1


def test_unrelated_documents_under_one_id_all_stay(docs, prose):
    one, two, three, four = prose(40), prose(40), prose(40), prose(40)
    pairs = [(None, one), (None, two), (None, two), (7, three), (7, four), (7, four), (9, three), (None, None), (None, "")]
    kept = N.drop_near_duplicates(docs(pairs)).collect()
    assert sorted((str(r.doc_id), r.text or "") for r in kept) == sorted([("None", one), ("None", two), ("7", three), ("7", four), ("None", ""), ("None", "")])


def test_names_that_clash_and_words_that_hashes_confuse(docs, prose):
    from test_text_models import alike

    one, two = alike()
    rows = docs([(1, one), (2, two), (3, two), (4, prose(30))]).withColumnRenamed("th", "th_").withColumnRenamed("kept", "id_").withColumnRenamed("blob", "th__").withColumnRenamed("lang", "row")
    got = N.drop_near_duplicates(rows)
    assert got.columns == rows.columns and sorted(r.doc_id for r in got.collect()) == [1, 2, 4]
    assert {r.doc_id: r.component_id for r in N.near_duplicates(rows).collect()} == {1: 1, 2: 2, 3: 2, 4: 4}


def test_groups_do_not_depend_on_batches(docs, prose, spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 4)
    pairs = near_copies(prose, 5)
    want = expected_components(pairs)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_duplicates(docs(pairs)).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want


def test_sketch_bound_follows_the_threshold():
    assert N.most_bits(85) == 84 and N.most_bits(80) == 98


def test_thresholds_that_the_bands_cannot_serve_are_refused(docs):
    for least in (50, 79, 101):
        with pytest.raises(ValueError, match="least"):
            N.near_duplicates(docs([(1, "a")]), least=least)


def test_set_sketch_never_has_more_bits_than_sets_differ():
    draw = np.random.default_rng(1)
    a = np.unique(draw.integers(0, 2**63, 400).astype(np.uint64))
    b = np.unique(np.concatenate([a[:350], draw.integers(0, 2**63, 30).astype(np.uint64)]))
    parity = [np.bincount((x & np.uint64(N.SET_BITS - 1)).astype(np.int64), minlength=N.SET_BITS) & 1 for x in (a, b)]
    assert (parity[0] ^ parity[1]).sum() <= len(np.setxor1d(a, b))


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)}


def brute_removed(texts):
    raw = [(t or "").encode() for t in texts]
    seen: dict = {}
    for b in raw:
        for i in range(len(b) - 199):
            seen[b[i : i + 200]] = seen.get(b[i : i + 200], 0) + 1
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def repeated_texts(prose):
    passage, other = prose(60), prose(45)
    texts = [prose(30) + " " + passage + " " + prose(20) for _ in range(8)]
    texts += [other + prose(3) + passage[:230], "x" + other, passage[5:300], passage[:199], "z" * 900, "ab" * 150, None, ""]
    texts += [prose(80)] * 3 + ["é" * 150 + passage, "è" + "é" * 150, other + other, passage[:150] + "Q" + passage[151:]]
    return texts


def test_repeated_passages(docs, prose, monkeypatch):
    texts = repeated_texts(prose)
    for segment in (1 << 20, 300):
        monkeypatch.setattr(X, "SEGMENT", segment)
        got = {r.doc_id: tuple(r)[1:] for r in X.measure_repeats(docs(list(enumerate(texts)))).collect()}
        assert got == dict(enumerate(brute_removed(texts)))
    cut = X.cut_text(docs(list(enumerate(texts))))
    assert cut.columns == docs([]).columns
    sizes = {r.doc_id: len((r.text or "").encode()) for r in cut.select("doc_id", "text").collect()}
    assert all(0 <= n - gone - sizes[i] <= 6 for i, (n, gone, _, _) in enumerate(brute_removed(texts)))


def test_hot_anchors_are_parted(docs, prose, monkeypatch):
    monkeypatch.setattr(X, "HOT_TEXTS", 3)
    line, draw = prose(70), random.Random(4)
    texts = repeated_texts(prose) + [prose(draw.randint(5, 40)) + " " + line[draw.choice((0, 0, 0, 30, 77)) :] + prose(draw.randint(0, 40)) for _ in range(25)]
    texts += [texts[-1][:-3] + "abc", "u" * 700]
    rows = docs(list(enumerate(texts)))
    plain = rows.select(X.text_key("text").alias("th"), X.text_of("text").alias("text"))
    splitters, hot = X._sampled(plain, 4)
    assert len(hot) > 3 and splitters == sorted(splitters)
    got = {r.doc_id: tuple(r)[1:] for r in X.measure_repeats(rows).collect()}
    assert got == dict(enumerate(brute_removed(texts)))


def test_repeated_passages_of_odd_rows(docs, prose):
    text = prose(60)
    rows = X.measure_repeats(docs([(1, text), (1, text), (None, prose(50)), (2, "short")])).collect()
    assert sorted((str(r.doc_id), r.n_removed) for r in rows) == sorted([("1", len(text)), ("1", len(text)), ("None", 0), ("2", 0)])
    assert X.measure_repeats(docs([])).count() == 0


def test_repeated_anchors_do_not_depend_on_batches(spark):
    key = lambda n: bytes([n]) * 16
    once, twice, sure = X.ONCE, X.TWICE, X.SURE
    rows = [
        (1, key(10), 0, once), (1, key(11), 0, once), (1, key(11), 0, once),  # two texts, one of them met by two tasks
        (2, key(12), 0, once), (2, key(12), 0, once),  # copies of one text: nothing repeats
        (3, key(13), 5, twice), (3, key(13), 5, twice), (3, key(14), 9, once),
        (4, key(15), 7, sure), (5, key(16), 0, once), (6, key(17), 1, twice),
    ]
    want = {(1, 10, 0), (1, 11, 0), (3, 13, 5), (3, 14, 9), (4, 15, 7), (6, 17, 1)}
    for size in ("1", "2", "3", "100"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        made = spark.createDataFrame([(h, k, at << 2 | kind) for h, k, at, kind in rows], "h long, th binary, at long").coalesce(1)
        got = [(r.h, r.th[0], r.at) for r in X.repeated_anchors(made.sortWithinPartitions("h", "th", "at")).collect()]
        assert len(got) == len(want) and set(got) == want
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def brute_agreeing(rows, gram):
    """Least and most distance of each suffix's repeated windows, by comparing all pairs."""
    out = []
    for i, (key, left) in enumerate(rows):
        hits = []
        for x in range(len(left) + 1):
            mine = left[:x][::-1] + key[: X.SPAN - x]
            if len(mine) == X.SPAN and any(j != i and k[:gram] == key[:gram] and len(w) >= x and w[:x][::-1] + k[: X.SPAN - x] == mine for j, (k, w) in enumerate(rows)):
                hits.append(x)
        out.append((min(hits, default=None), max(hits, default=-1)))
    return out


def test_merged_ranges_give_what_pairs_give():
    draw = random.Random(8)
    letters = lambda n: bytes(draw.choice(b"ab") for _ in range(n))
    grams, rights, lefts = [letters(X.GRAM) for _ in range(3)], [letters(100) for _ in range(3)], [letters(100) for _ in range(3)]
    rows = []
    for _ in range(120):
        right, left = draw.choice(rights), draw.choice(lefts)
        cut_right, cut_left = draw.randint(0, 100), draw.randint(0, 100)
        right, left = right[:cut_right] + letters(100 - cut_right), left[:cut_left] + letters(100 - cut_left)
        rows.append((draw.choice(grams) + right[: draw.randint(0, 100)], left[: draw.randint(0, 100)]))
    rows = [r for r in rows if len(r[0]) + len(r[1]) >= X.SPAN]
    want = brute_agreeing(rows, X.GRAM)
    keys = [bytes([i // 256, i % 256]) * 8 for i in range(len(rows))]
    runs, tables, found = [], [], {}
    for own in (range(0, len(rows), 3), range(1, len(rows), 3), range(2, len(rows), 3)):
        strings, settled = X.settle_equal([(*rows[i], k, 1000 << 1) for k, i in enumerate(own)])
        runs.append(X.front_coded(strings))
        tables.append(b"".join(keys[i] for i in own))
        for k, spans in settled.items():
            found.setdefault(keys[own[k]], []).extend(np.array(spans).reshape(-1, 2).tolist())
    for key, spans in X.merge_runs(runs, tables):
        found.setdefault(key, []).extend(np.frombuffer(spans, np.int64).reshape(-1, 2).tolist())
    for key, (least, most) in zip(keys, want, strict=True):
        spans = found.get(key, [])
        assert (bool(spans)) == (most >= 0)
        if spans:
            assert (min(a for a, _ in spans), max(b for _, b in spans)) == (1000 - most, 1000 - least + X.SPAN)


def test_loser_tree_merges_and_skips_known_prefixes():
    draw = random.Random(2)
    runs = [sorted("".join(draw.choice("ab") for _ in range(draw.randint(0, 30))).encode() for _ in range(draw.randint(0, 40))) for _ in range(7)]
    coded = [X.front_coded([(k, b"", 0, i) for i, k in enumerate(r)]) for r in runs]
    tree = X.LoserTree([X.run_strings(r) for r in coded])
    got = list(tree)
    assert [k for k, _, _ in got] == sorted(k for r in runs for k in r)
    for (a, _, _), (b, shared, _) in zip(got, got[1:], strict=False):
        assert shared == X.lcp_from(a, b, 0)
    assert tree.compared < sum(len(k) for k, _, _ in got) * 3
    assert list(X.LoserTree([])) == []


def test_sketch_rows_of_nothing():
    assert len(N.sketch_rows(pa.array([None, "", " "]))["number"]) == 0
