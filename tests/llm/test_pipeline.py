from __future__ import annotations

import re

import pyarrow as pa
from test_dedup import brute_removed, expected_components
from test_quality_and_secrets import measured

import corpus_pipeline
from loomline.llm import packing
from loomline.llm.common import stored
from loomline.llm.queries import word_tokenizer


def rows_of(prose):
    passage, body = prose(70), prose(120)
    texts = [prose(90) for _ in range(10)] + [prose(40) + " " + passage + " " + prose(30) for _ in range(5)]
    texts += [body, body, body + " tail", "too short", None, "", "spam " * 60, prose(50) + ' secret = "abcdef123456" ' + prose(10), " ".join(w + "$$$" for w in prose(40).split())]
    return list(enumerate(texts))


def test_stages_and_run_agree_with_brute_force(spark, docs, prose, tmp_path):
    pairs = rows_of(prose)
    plain = docs(pairs).drop("blob", "th", "kept")
    plain.write.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for d, t in pairs:
        n, _, symbols, _, repeats = measured(t)
        if n >= 20 and 100 * repeats <= 30 * n and 100 * symbols <= 50 * n:
            kept[d] = t
    alone = {d for d, (_, c) in expected_components(list(kept.items())).items() if c == d}
    texts = {d: t for d, t in kept.items() if d in alone}
    removed = brute_removed(list(texts.values()))
    now, seen = plain, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stored(stage(spark, now, str(tmp_path)), name)
        assert now.columns == plain.columns
        seen.append({r.doc_id: r.text for r in now.select("doc_id", "text").collect()})
    assert set(seen[0]) == set(kept) and seen[1] == texts
    assert {d: len(t.encode()) for d, t in seen[2].items()} == {d: n - gone for d, (n, gone, _, _) in zip(texts, removed, strict=True)}
    assert seen[3] == {d: re.sub(r'secret = "abcdef123456', "[SECRET]", t) for d, t in seen[2].items()}
    assert any("[SECRET]" in t for t in seen[3].values())
    ids, at = packing.encode_texts(pa.array(list(seen[3].values())), word_tokenizer())
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.doc_tokens for r in pieces} == {d: int(at[i + 1] - at[i]) for i, d in enumerate(seen[3])}
    assert sum(r.length for r in pieces) == len(ids)


def test_stages_take_an_empty_table(spark, docs):
    now = docs([]).drop("blob", "th", "kept")
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, "")
    assert now.count() == 0


def test_near_dedup_stage_takes_a_similarity_of_080(spark, docs, prose):
    words = [f"{w}{i}" for i, w in enumerate(prose(160).split())]
    pairs = []
    for d, n in enumerate((0, 3, 4)):  # shared with the first: 156 of 156, 141 of 171 (0.82), 136 of 176 (0.77)
        w = list(words)
        for k in range(n):
            w[20 + 30 * k] = f"edit{d}x{k}"
        pairs.append((d, " ".join(w)))
    kept = corpus_pipeline.near_dedup_stage(spark, docs(pairs), "").collect()
    assert sorted(r.doc_id for r in kept) == [0, 2]


def test_secrets_stage_redacts_whole_private_keys(spark, docs):
    head, end = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    lines = ["MIIEow" + "Ab+/" * 14 + f"{k:02}" for k in range(400)]
    body = "\n".join(lines)
    cut = "\\n".join(lines[:5])
    enc = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0A1B2C\n\n"
    cases = {
        f"a {head}\n{body}\nQw==\n{end} b": "a [SECRET] b",
        f"a {head}\n{body}\nQw==\nplain words follow": "a [SECRET]\nplain words follow",
        f"a {head}\r\n{enc}{body}\n{end}\nb": "a [SECRET]\nb",
        f"a {head}\n{enc}{body}\nno end here": "a [SECRET]\nno end here",
        f'k = "{head}\\n{cut}\\n{end}"': 'k = "[SECRET]"',
        f'k = "{head}\\n{cut}" rest of it': 'k = "[SECRET]" rest of it',
        f"{head} is a header and {head}\n{body}\n{end} x": "[SECRET] is a header and [SECRET] x",
        f"{head}\n{lines[0]}\n-----BEGIN CERTIFICATE-----\n{lines[1]}": f"[SECRET]\n-----BEGIN CERTIFICATE-----\n{lines[1]}",
    }
    plain = docs(list(enumerate(cases))).drop("blob", "th", "kept")
    got = {r.doc_id: r.text for r in corpus_pipeline.secrets_stage(spark, plain, "").collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())


def test_stages_take_odd_rows_and_very_long_texts(spark, docs, prose):
    long = " ".join(prose(1000) for _ in range(30))
    one, two = prose(60), prose(60)
    pairs = [(None, one), (None, two), (5, one + " x"), (5, long), (6, long), (7, None), (8, ""), (9, "same " * 3000), (10, two), (10, two)]
    now = docs(pairs).withColumnRenamed("kept", "row_").withColumnRenamed("th", "secret_spans").withColumnRenamed("blob", "n_words")
    columns = now.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stored(stage(spark, now, ""), "odd")
        assert now.columns == columns
    texts = sorted(r.text for r in now.collect())
    assert len(texts) == 3 and long in texts and two in texts
    pieces = corpus_pipeline.STAGES[-1][1](spark, now, "").collect()
    ids, _ = packing.encode_texts(pa.array(texts), word_tokenizer())
    assert sum(r.length for r in pieces) == len(ids)
