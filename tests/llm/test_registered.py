"""The registered queries over whole tables, held to SQL, to brute force, or to what they must be."""

from __future__ import annotations

import importlib
import zlib
from collections import defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from test_dedup import brute_removed, expected_components

from loomline.llm import packing
from loomline.llm.queries import piece_vocabulary, queries, word_tokenizer

SMALL = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SMALL.exists(), reason="no tables")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for file in SMALL.glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    yield con
    con.close()


@pytest.fixture(scope="module")
def texts(tables):
    return dict(tables.execute("SELECT doc_id, text FROM documents").fetchall())


@pytest.fixture(scope="module")
def result(spark):
    held = {}

    def of(n):
        name = next(k for k in queries() if k.startswith(f"op{n}_"))
        if n not in held:
            held[n] = queries()[name](spark, str(SMALL)).collect()
        return held[n]

    return of


def test_one_query_for_each_operator():
    entry = importlib.import_module("__spark_entry__")
    assert [sum(k.startswith(f"op{n}_") for k in entry.queries()) for n in range(1, 11)] == [1] * 10
    assert "pipeline" in entry.queries()


@pytest.mark.parametrize("n", [1, 6, 10])
def test_sql_gives_the_same(result, tables, n):
    entry = importlib.import_module("__spark_entry__")
    want = tables.execute(next(v for k, v in entry.oracle_sql().items() if k.startswith(f"op{n}_")))
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(result(n)[0].asDict())
    assert sorted(str([r[c] for c in columns]) for r in result(n)) == sorted(str(list(r)) for r in want.fetchall())


def test_pieces_are_the_librarys(result, texts):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=piece_vocabulary())
    assert {r.doc_id: list(r.ids) for r in result(2)} == {i: library.encode(t or "") for i, t in texts.items()}


def test_neighbours_against_brute_force(result, tables):
    rows = [(i, np.array(v, float)) for i, v in tables.execute("SELECT vec_id, embedding FROM embeddings ORDER BY 1").fetchall() if v is not None]
    ids, x = np.array([i for i, _ in rows]), np.stack([v for _, v in rows])
    got, hit, n = defaultdict(dict), 0, 0
    for r in result(3):
        got[r.query_id][r.rank] = (r.vec_id, r.score)
    for q in ids[ids % 100 == 0].tolist():
        d = np.sqrt(np.square(x - x[ids == q][0]).sum(axis=1))
        near = [i for i in ids[np.lexsort((ids, d))].tolist() if i != q][:10]
        assert sorted(got[q]) == list(range(1, 11))
        assert all(abs(d[ids == i][0] - s) < 1e-9 for i, s in got[q].values())
        hit, n = hit + len({i for i, _ in got[q].values()} & set(near)), n + 10
    assert hit >= 0.9 * n


def test_quality_on_held_out_labels(result, tables):
    labels = dict(tables.execute("SELECT doc_id, min(quality) FROM labels GROUP BY 1 HAVING min(quality) = max(quality)").fetchall())
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) for r in result(4))
    right = [r.predicted == labels[r.doc_id] for r in result(4) if r.held_out and r.doc_id in labels]
    assert np.mean(right) >= 0.8


def test_language_model_counts(result, texts):
    assert {r.doc_id: r.n_tokens for r in result(5)} == {i: len([w for w in _words(t) if w]) + 1 for i, t in texts.items()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1) and r.score < 0 and r.base_score < 0 for r in result(5))


def _words(text):
    for c in "\t\n\x0b\f\r":
        text = (text or "").replace(c, " ")
    return text.split(" ")


def test_components_against_brute_force(result, texts):
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in result(7)} == expected_components(list(texts.items()))
    assert all(r.kept == (r.doc_id == r.component_id) for r in result(7))


def test_repeats_against_brute_force(result, texts):
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in result(8)} == dict(zip(texts, brute_removed(list(texts.values())), strict=True))


def test_pieces_cover_the_ids(result, texts):
    ids, at = packing.encode_texts(pa.array(list(texts.values())), word_tokenizer())
    want = {i: ids[at[k] : at[k + 1]] for k, i in enumerate(texts)}
    used, parts = defaultdict(list), defaultdict(list)
    for r in result(9):
        own = want[r.doc_id][r.start : r.start + r.length]
        assert (len(own), r.doc_tokens, r.ids_crc32) == (r.length, len(want[r.doc_id]), zlib.crc32(own.astype("<u4").tobytes()))
        used[r.sequence_id].append((r.offset, r.length))
        parts[r.doc_id].append((r.start, r.length))
    for own in [*used.values(), *parts.values()]:
        ends = np.cumsum([n for _, n in sorted(own)]).tolist()
        assert [a for a, _ in sorted(own)] == [0, *ends[:-1]]
    assert all(sum(n for _, n in own) <= packing.SIZE for own in used.values())
    assert {i: sum(n for _, n in own) for i, own in parts.items()} == {i: len(w) for i, w in want.items()}
