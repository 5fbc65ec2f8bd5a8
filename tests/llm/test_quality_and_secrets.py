from __future__ import annotations

import hashlib
import re

import pytest

from loomline.llm import quality_rules as Q
from loomline.llm import secret_scan as S

CASES = [(1, None), (2, ""), (3, " \n\t "), (4, "a b"), (4, "a b"), (None, "x " * 400), (6, "one two three\none two three\n\nfour"), (7, "wörter äöü 𝔘 " * 30), (8, "!!! ### $$$ " * 20)]


def measured(text):
    text = text or ""
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    at: dict = {}
    for i in range(len(words) - 7):
        at.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


def test_measures(docs, prose):
    cases = [*CASES, (9, prose(300)), (10, (p := prose(60)) + "\n" + p + " tail " + p)]
    got = sorted((tuple(r) for r in Q.ledger(docs(cases)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()), key=str)
    assert got == sorted(((i, *measured(t)) for i, t in cases), key=str)
    assert Q.ledger(docs(cases).limit(0)).count() == 0


def test_very_long_texts_and_clashing_names(docs, prose):
    long = " ".join(prose(1000) for _ in range(60))
    rows = docs([(1, long), (2, long + " " + long)]).withColumnRenamed("source", "t_").withColumnRenamed("lang", "n_words")
    book = Q.ledger(rows, keep=("doc_id", "t_", "n_words")).collect()
    assert {r.doc_id: (r.n_words, r.n_repeat_words) for r in book} == {1: (60_000, measured(long)[4]), 2: (120_000, 120_000)}
    assert all(r.t_ == "s" for r in book)


def test_policies_and_ablations(docs, prose):
    book = Q.ledger(docs([*CASES, (9, prose(50)), (10, prose(80))]))
    kept = {r.doc_id: r.kept for r in Q.apply_policy(book).collect()}
    assert kept[9] and kept[10] and not kept[2] and not kept[8]
    rows = Q.apply_policy(book).collect()
    for r in Q.ablations(book).collect():
        bit = Q.BITS[r.rule]
        hits = [x.fail_bits & Q.STANDARD.mask for x in rows]
        assert (r.n_failed, r.n_only, r.n_kept_without) == (sum(bool(h & bit) for h in hits), sum(h == bit for h in hits), sum(h in (0, bit) for h in hits))
    assert sorted(r.doc_id for r in Q.kept_rows(book).collect()) == sorted(i for i, k in kept.items() if k)


SECRETS = [
    (1, None), (2, ""), (3, 'Password = "abc123+/x" then token:short secret=longenough'), (3, 'Password = "abc123+/x" then token:short secret=longenough'),
    (4, "AKIA" + "Z9" * 8 + " AKIASHORT " + "ab12" * 8), (5, "é𝔘 api_key='0123456789' é " + "f" * 23 + " " + "f" * 24), (None, "secret=token:abcdefgh"),
    (7, "-----BEGIN RSA PRIVATE KEY-----\nghp_" + "a1" * 18), (8, "apikey:a.b-c=d_e/f+g password:\n12345678 PASSWD  =  ''x"),
]
BASE = [
    ("assign", r"""(?a:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, re.I),
    ("access", "AKIA[A-Z0-9]+", 0, 20, 0),
    ("hex", "[0-9a-f]+", 0, 24, 0),
]


def base_spans(text):
    found = []
    for k, (kind, pattern, group, least, flags) in enumerate(BASE):
        if k == 0:  # only the names are in either case
            pattern = pattern.replace("[A-Za-z0-9", "[A-Za-z0-9")
        for m in re.finditer(pattern, text or "", flags | re.A):
            if len(m.group(group)) >= least:
                found.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(found))


def test_base_spans(docs):
    out = S.find_secrets(docs(SECRETS))
    base = [(r.doc_id, ",".join(f"{S.RULES[s.kind_no].kind}:{s.start}:{s.end}" for s in r.secret_spans if s.kind_no < S.BASE_KINDS)) for r in out.collect()]
    assert sorted(base, key=str) == sorted(((i, base_spans(t)) for i, t in SECRETS), key=str)
    assert set(docs(SECRETS).columns) < set(out.columns)
    assert S.find_secrets(docs([])).count() == 0


def test_a_second_scan_reads_no_seen_blob(docs, spark, tmp_path):
    path, text = str(tmp_path / "ledger"), 'secret = "abcdef123456"'
    first = S.find_by_ledger(docs([(1, text), (2, text), (3, "plain")]), path).collect()
    assert {r.doc_id: len(r.secret_spans) for r in first} == {1: 1, 2: 1, 3: 0}
    size = spark.read.parquet(path).count()
    assert size == 2
    # a rule that would find something, had it been run again: the ledger's own answer stands
    spark.read.parquet(path).selectExpr("blob", "transform_values(found, (k, v) -> array(struct(0 AS start, 1 AS end))) AS found").write.parquet(str(tmp_path / "other"))
    again = S.find_by_ledger(docs([(7, "plain"), (8, text), (9, "new text")]), str(tmp_path / "other")).collect()
    assert {r.doc_id: len(r.secret_spans) for r in again} == {7: len(S.RULES), 8: len(S.RULES), 9: 0}
    assert spark.read.parquet(str(tmp_path / "other")).count() == size + 1


def test_findings_of_very_long_texts_and_names_that_clash(docs, spark, prose):
    long = " ".join(prose(1000) for _ in range(40)) + " token:abcdef123456 " + prose(1000)
    rows = docs([(1, long), (2, None), (3, "x")] * 2).withColumnRenamed("lang", "secret_spans").withColumnRenamed("th", "bit").withColumnRenamed("kept", "row")
    got = S.find_secrets(rows).collect()
    at = long.index("token:")
    assert sorted((r.doc_id, [(s.start, s.end) for s in r.secret_spans]) for r in got) == sorted([(1, [(at, at + 18)]), (2, []), (3, [])] * 2)
    assert sorted(got[0].asDict()) == sorted(rows.columns)
    doubled = S.scan_blobs(S.unseen_blobs(rows, "text", None))
    assert [len(r.spans) for r in S.spans_by_blob(doubled.union(doubled)).collect()] == [1]


def test_ledger_is_incremental(docs, spark, tmp_path):
    path = str(tmp_path / "ledger")
    old = S.RULES[:2]
    S.update_ledger(spark, docs(SECRETS[:4]), path, rules=old)
    before = S.read_ledger(spark, path)
    todo = {r.blob: r.seen for r in S.unseen_blobs(docs(SECRETS), "text", before).collect()}
    seen = hashlib.sha256(SECRETS[2][1].encode()).hexdigest()
    assert sorted(todo[seen]) == sorted(r.key for r in old)
    assert len(todo) == len({t or "" for _, t in SECRETS})
    assert S.unseen_blobs(docs(SECRETS[:4]), "text", before, old).count() == 0
    full = S.update_ledger(spark, docs(SECRETS), path)
    fresh = {r.blob: r.spans for r in S.spans_by_blob(S.scan_blobs(S.unseen_blobs(docs(SECRETS), "text", None))).collect()}
    assert {r.blob: r.spans for r in S.spans_by_blob(full).collect()} == fresh
    both = S.find_secrets(docs(SECRETS), ledger=before).select("doc_id", "secret_spans").collect()
    assert sorted(map(str, both)) == sorted(map(str, S.find_secrets(docs(SECRETS)).select("doc_id", "secret_spans").collect()))


@pytest.mark.parametrize(("spans", "left"), [([], "abcdef"), ([(1, 3)], "a[]def"), ([(0, 2), (1, 4)], "[]ef"), ([(0, 1), (5, 6)], "[]bcde[]")])
def test_redact(spark, spans, left):
    df = spark.createDataFrame([("abcdef", [(a, 0, b) for a, b in spans])], "t string, s array<struct<start:int,kind_no:int,end:int>>")
    assert df.select(S.redact(df.t, df.s, "[]")).first()[0] == left
